"""The registry of queries over the test tables.

A query is a function of (session, table folder); its oracle is SQL that states the
expected rows independently.  Texts in formats the tables do not hold are built from
their columns, and the oracle states the expected pairs straight from the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.session import spread
from keyhound.sources.tables import files_from_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def built_files(df: DataFrame, path: str, text: str) -> DataFrame:
    """Documents whose path and text are SQL expressions over the columns of ``df``."""
    return files_from_table(spread(df), F.expr(path), F.expr(text))


def text_lines(*lines: str) -> str:
    """SQL for a text of these lines; each is an SQL expression, the last line ends too."""
    return " || chr(10) || ".join(f"({line})" for line in lines) + " || chr(10)"


def kv_rows(table_name: str, path: str, *pairs: tuple[str, str, str, int]) -> str:
    """SQL for expected pairs: (key, value, kv_path, line) per row of a table."""
    return " UNION ALL ".join(
        f"SELECT {path} AS file_path, {key} AS key, {value} AS value, "
        f"'{kv_path}' AS kv_path, CAST({line} AS INTEGER) AS line FROM {table_name}"
        for key, value, kv_path, line in pairs
    )


def document_lines(column: str = "text", table_name: str = "documents", key: str = "doc_id") -> str:
    """SQL for the lines of a text column: path, line, text."""
    return f"""
        SELECT path, CAST(line AS INTEGER) AS line,
               CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END
                   AS text
        FROM (SELECT path, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line
              FROM (SELECT path, string_split(body, chr(10)) AS parts
                    FROM (SELECT CAST({key} AS VARCHAR) AS path,
                                 CASE WHEN ends_with({column}, chr(10))
                                      THEN left({column}, length({column}) - 1)
                                      ELSE {column} END AS body
                          FROM {table_name} WHERE {column} <> '')))"""


def document_files(
    spark: SparkSession, folder: str, text: Column | None = None, name: str = "documents",
    key: str = "doc_id",
) -> DataFrame:
    text = F.col("text") if text is None else text
    rows = spread(table(spark, folder, name))
    return files_from_table(rows, F.col(key).cast("string"), text)
