"""Compare registered queries with their oracle SQL, as rows without order.

``python tests/oracle.py <table folder> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, folder: str, function, sql: str | None):
    """(rows, problem or None) of one query."""
    df = function(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {df.columns} instead of {names}"
    left, right = _rows(got, df.columns), _rows(expected, names)
    if left == right:
        return len(got), None
    counts: dict = {}
    for row in left:
        counts[row] = counts.get(row, 0) + 1
    for row in right:
        counts[row] = counts.get(row, 0) - 1
    more = [r for r, n in counts.items() if n > 0][:3]
    less = [r for r, n in counts.items() if n < 0][:3]
    return len(got), f"{len(left)} rows, expected {len(right)}; only here {more}; missing {less}"


def main(folder: str, names: list[str]) -> int:
    from keyhound.session import build_session
    import __spark_entry__ as entry

    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, function in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        started = time.time()
        try:
            rows, problem = compare(spark, connection, folder, function, oracles.get(name))
        except Exception as error:
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        state = "ok" if problem is None else "BAD"
        kind = "" if name in oracles else " (rows only)"
        print(f"{state:4}{name}{kind}: {rows} rows, {time.time() - started:.1f}s", flush=True)
        if problem:
            print("      " + problem[:1800], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
