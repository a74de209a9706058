"""Token ids of whole texts, written as Parquet list columns and read back in part or whole.

Ids are those that the tokenizers library gives for a whole text (see ``encoding``).

Files hold one row per document in ascending id order: ``doc_id``, ``n_tokens``, ``part`` and
``part_start`` (delta encoding) and ``ids`` (dictionary encoding: a vocabulary fits one dictionary page),
in row groups of ``GROUP_BYTES`` with column and offset indexes every ``PAGE_ROWS`` rows.  A reader of
lengths never touches the ids, and one of few documents skips pages by the index of ``doc_id``.

Defined cases: a null text is empty and has the end id alone; rows of one id are ordered by text, null
ids come first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyhound.llm import encoding

GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
BROADCAST_FILES = 100_000


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row slices with the texts of each, about ``limit`` bytes together; null is empty."""
    texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    row = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit or k + 1 == len(texts):
            yield batch.slice(row, k + 1 - row), texts[row : k + 1]
            row, size = k + 1, 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = None) -> None:
    """Encode ``text`` of all rows and write them in ascending ``doc_id`` order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = encoding.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in slices(batch):
                ids, offsets = encoder.encode(texts)
                if end is not None:
                    ids = np.insert(ids, offsets[1:], end)
                    offsets = offsets + np.arange(len(offsets))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.record_batch(
                    [
                        rows.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        pa.array(np.full(len(texts), part, np.int32)),
                        pa.array(offsets[:-1] + start),
                        lists,
                    ],
                    ["doc_id", "n_tokens", "part", "part_start", "ids"],
                )
                start += int(offsets[-1])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(encode, f"doc_id {kind}, n_tokens long, part int, part_start long, ids array<int>")
    writer = encoded.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.page.row.count.limit", PAGE_ROWS)
    for name in ("doc_id", "n_tokens", "part_start"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the length columns alone."""
    return _with_start(spark.read.parquet(path).select("doc_id", "n_tokens", "part", "part_start"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or of those with ids from ``low`` to ``high``."""
    rows = spark.read.parquet(path)
    starts = _part_starts(rows)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return _with_start(rows, starts)


def _part_starts(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return sums.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def _with_start(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    starts = _part_starts(rows) if starts is None else starts
    # A few bytes for each file; beyond a number of files both sides are shuffled.
    few = len(rows.inputFiles()) <= BROADCAST_FILES
    joined = rows.join(F.broadcast(starts) if few else starts, "part")
    found = joined.withColumn("start", F.col("before") + F.col("part_start"))
    return found.select("doc_id", "start", "n_tokens", *(["ids"] if "ids" in rows.columns else []))


def with_crc(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the checksum of the ids as little-endian unsigned integers."""
    kept = [x for x in rows.columns if x != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4").tobytes())
            at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.record_batch([*(batch.column(x) for x in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("ids_crc32", "long"))
