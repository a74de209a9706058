"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Every row has a global row number: its rank in the order of the given columns, among equal ones by a hash
of the whole row.  A keyed Feistel network permutes the numbers; position ``p`` of the shuffle is slot
``p div shards`` of shard ``p mod shards``, so shard sizes are at most one row apart (law ``rows``) and slots
have no gaps.  Shard and slot of a row follow from its number, the number of rows, the number of shards
and the seed; ``back`` gives the number of the row at a place.

The network works on a grid of ``a x b`` cells, ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``: a round adds a
hash of one coordinate to the other, modulo its size, so it can be undone whatever the hash.  Less than
``a`` cells lie beyond ``n``; a number that lands there is permuted again until it does not (cycle
walking).  At most that many steps are needed, and at most that many rows need any.

Only DataFrame functions are used.  Rows are sorted by ranges; the driver sees a count, and tasks get the
number of rows before each range (a row per range).  Equal rows, however many, are spread by their place in
the table.  The rows are written once before the sort, whose sampling would else compute them twice.

Defined cases: null texts have size 1 (no bytes) and checksum 0; null ids come first; repeated rows get
places of their own, and rows that are equal in all columns may swap them; an empty table gives no rows; other
columns are kept whatever their names (``names`` renames the two added ones).
Equal texts are not kept together: a group may hold a third of all rows, and the law is ``rows``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyhound.session import written

#: The hash works modulo this prime, so products fit a long; coordinates must be smaller: n below 2**61.
PRIME = (1 << 31) - 1
ROUNDS = 8
MAX_RANGES = 100_000
_INDEX = (1 << 33) - 1
_FIRST_STEPS = 4


def keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers for each round."""
    digests = [hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(ROUNDS)]
    return [tuple(int.from_bytes(x[i : i + 8], "big") % PRIME for i in (0, 8, 16)) for x in digests]


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest nearly square grid that holds ``n`` cells."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _hash(x: Column, key: Sequence[Column | int]) -> Column:
    """A product of three terms modulo ``PRIME``; ``x`` should be a column, since it is used three times."""
    one, two, three = ((x + k) % PRIME for k in key)
    return (one * two % PRIME) * three % PRIME


def _network(df: DataFrame, a: int, b: int, seed: int, sign: int) -> DataFrame:
    """All rounds on the columns ``__l`` and ``__r``, or with ``sign`` -1 their inverse.

    A projection for each round: nested in one expression they would double with every round.
    """
    rounds = list(enumerate(keys(seed)))
    for k, key in rounds[::sign]:
        if k % 2 == 0:
            df = df.withColumn("__l", F.pmod(F.col("__l") + sign * _hash(F.col("__r"), key), F.lit(a)))
        else:
            df = df.withColumn("__r", F.pmod(F.col("__r") + sign * _hash(F.col("__l"), key), F.lit(b)))
    return df


def _walk(cell: Column, n: int, a: int, b: int, seed: int, sign: int, steps: int) -> Column:
    """The permutation again, up to ``steps`` times, while the cell is not below ``n``."""
    table = [
        F.struct(F.lit(k % 2).alias("side"), *(F.lit(x).alias(f"k{i}") for i, x in enumerate(key)))
        for k, key in list(enumerate(keys(seed)))[::sign]
    ]

    def one(at: Column, k: Column) -> Column:
        key = [k["k0"], k["k1"], k["k2"]]
        left = F.when(k["side"] == 0, F.pmod(at["l"] + sign * _hash(at["r"], key), F.lit(a))).otherwise(at["l"])
        right = F.when(k["side"] == 1, F.pmod(at["r"] + sign * _hash(at["l"], key), F.lit(b))).otherwise(at["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    def again(x: Column, _: Column) -> Column:
        start = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"))
        whole = F.aggregate(F.array(*table), start, one, lambda at: at["l"] * b + at["r"])
        return F.when(x < n, x).otherwise(whole)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), cell, again)


def _permuted(df: DataFrame, number: str, out: str, n: int, seed: int, sign: int) -> DataFrame:
    a, b = grid(n)
    start = df.withColumn("__l", F.expr(f"{number} div {b}")).withColumn("__r", F.col(number) % b)
    cell = F.col("__l") * b + F.col("__r")
    found = _network(start, a, b, seed, sign).withColumn("__cell", cell)
    beyond = a * b - n
    # Nearly all rows are done here; few steps do for nearly all others; the last ones get as many as can be needed.
    for steps in [min(beyond, _FIRST_STEPS), beyond] if beyond else []:
        walked = _walk(F.col("__cell"), n, a, b, seed, sign, steps)
        found = found.withColumn("__cell", F.when(F.col("__cell") < n, F.col("__cell")).otherwise(walked))
    return found.withColumn(out, F.col("__cell")).drop("__l", "__r", "__cell")


def forth(df: DataFrame, number: str, out: str, n: int, seed: int) -> DataFrame:
    """Add the position in the shuffle of the row numbers 0 to ``n`` - 1."""
    return _permuted(df, number, out, n, seed, 1)


def back(df: DataFrame, position: str, out: str, n: int, seed: int) -> DataFrame:
    """Add the row number at a position of the shuffle."""
    return _permuted(df, position, out, n, seed, -1)


def numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``row`` (all columns) and ``number``, its rank from 0 in ``order``; and how many there are."""
    hashed = [F.col(f"`{x.name}`") for x in rows.schema if "map<" not in x.dataType.simpleString()]
    by = [f"by{k}" for k in range(len(order))]
    narrow = rows.select(
        F.struct(*[F.col(f"`{x}`") for x in rows.columns]).alias("row"),
        *(F.col(f"`{x}`").alias(y) for x, y in zip(order, by, strict=True)),
        F.xxhash64(*hashed).alias("hash"),
    )
    placed = written(narrow, "rows").withColumn("at", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(*by, "hash", "at").sortWithinPartitions(*by, "hash", "at")
    # The place after the sort: partition and index in it.
    ranked = written(ordered.select("row", F.monotonically_increasing_id().alias("place")), "ranked")
    ranked = ranked.withColumn("part", F.shiftright("place", 33))
    counts = ranked.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("part", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    n, ranges = starts.agg(F.sum("count"), F.count(F.lit(1))).first()
    joined = ranked.join(F.broadcast(starts) if ranges <= MAX_RANGES else starts, "part")
    return joined.select("row", (F.col("before") + F.col("place").bitwiseAND(F.lit(_INDEX))).alias("number")), n or 0


def assign(
    rows: DataFrame, order: Sequence[str], shards: int = 16, seed: int = 0, names: tuple[str, str] = ("shard", "slot")
) -> DataFrame:
    """All columns, and the shard and slot of each row."""
    found, n = numbered(rows, order)
    position = F.col("position")
    return forth(found, "number", "position", n, seed).select(
        "row.*", (position % shards).cast("int").alias(names[0]), F.expr(f"position div {shards}").alias(names[1])
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """A folder per shard; files and their rows ascend by slot.  A large shard is written by several tasks."""
    ordered = assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` of documents."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def oracle(shards: int, seed: int, table: str = "documents") -> str:
    """The same in SQL; the checksum of a text is folded byte by byte."""
    rounds = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(keys(seed)))

    def term(x: str) -> str:
        return f"((({x} + k0) % {PRIME}) * (({x} + k1) % {PRIME}) % {PRIME}) * (({x} + k2) % {PRIME}) % {PRIME}"

    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
docs AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes,
         row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS nr
  FROM {table}),
sums AS (
  SELECT nr, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM docs, crc_table),
sides AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM docs)),
rounds(k, k0, k1, k2) AS (VALUES {rounds}),
walk AS (
  SELECT nr, 0 AS done, nr // b AS l, nr % b AS r FROM docs, sides
  UNION ALL
  SELECT nr, k + 1, CASE WHEN k % 2 = 0 THEN (l + {term("r")}) % a ELSE l END,
         CASE WHEN k % 2 = 1 THEN (r + {term("l")}) % b ELSE r END
  FROM walk, sides, rounds
  WHERE k = done % {ROUNDS} AND NOT (done = {ROUNDS} AND l * b + r < n))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((l * b + r) % {shards} AS INTEGER) AS shard, (l * b + r) // {shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM walk JOIN sides ON done = {ROUNDS} AND l * b + r < n JOIN docs USING (nr) JOIN sums USING (nr)
"""
