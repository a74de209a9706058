"""I-Match fingerprints over several randomised lexicon subsets.

Terms are lower-cased words, hashed.  The lexicon keeps terms whose document frequency, counted over all
documents, lies between ``LOW`` and ``HIGH`` of their number (an inverse-document-frequency band) and is
at least 2.  Subsets are drawn by hashes of the terms: ``SUBSETS`` of them for each rate in ``RATES``.
The sorted distinct lexicon terms of a text in one subset give one hash; the fingerprint lists them all.
Likeness is the share of equal hashes among subsets that either text has terms in.

Only terms that fall in some subset are counted and kept.  At most (distinct terms per text) / ``LOW``
terms can reach the band, whatever the number of documents, so the lexicon is broadcast.

``edited`` pairs each document with the next in descending id order: rows are dealt out by id ranges and
sorted; the last row of a range meets the first of the next in a small second step.

Defined cases: a null text is empty; a text without lexicon terms has a hash of itself as fingerprint,
and its likeness is 1 for an equal fingerprint, else 0; rows of one id are ordered by text, null ids come
last; a single row is its own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyhound.llm import flat
from keyhound.session import written

LOW, HIGH = 1 / 4000, 1 / 8
RATES = (5, 7, 9, 11)
SUBSETS = 8
_TERM_BITS = np.uint64(44)
_COMPACT = 2_000_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, term) of the terms that fall in a subset, as two arrays."""
    data = flat.LOWER[data]
    starts, ends, row = flat.words(data, offsets, flat.WORD_BYTE)
    term = flat.span_hash(flat.prefix_sums(data), starts, ends) >> (np.uint64(64) - _TERM_BITS)
    drawn = np.zeros(len(term), bool)
    for rate in RATES:
        drawn |= _subset(term, rate) < SUBSETS
    keys = np.unique((row[drawn].astype(np.uint64) << _TERM_BITS) | term[drawn])
    return (keys >> _TERM_BITS).astype(np.int64), keys & ((np.uint64(1) << _TERM_BITS) - np.uint64(1))


def _subset(term: np.ndarray, rate: int) -> np.ndarray:
    return (flat.mix(term + np.uint64(rate * 7919)) & np.uint64((1 << rate) - 1)).astype(np.int64)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms within the frequency band."""
    total = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0

        def summed() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.record_batch([pa.array(term.astype(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

        for batch in batches:
            for _, data, offsets in flat.pieces(batch):
                found.append(terms(data, offsets)[1])
                size += len(found[-1])
                if size >= _COMPACT:
                    yield summed()
                    found, size = [], 0
        if found:
            yield summed()

    counts = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= high * total)).select("term").toPandas()
    return np.sort(band["term"].to_numpy().astype(np.int64)).astype(np.uint64)


def fingerprints(texts: list[bytes], kept: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The subset hashes of each text (0: none) and the fingerprint strings."""
    out = np.zeros((len(texts), len(RATES) * SUBSETS), np.uint64)
    batch = pa.record_batch([pa.array(texts, pa.large_binary())], ["text"])
    first = 0
    for piece, data, offsets in flat.pieces(batch):
        row, term = terms(data, offsets)
        if len(kept):
            inside = kept[np.minimum(np.searchsorted(kept, term), len(kept) - 1)] == term
            row, term = row[inside], term[inside]
            for k, rate in enumerate(RATES):
                subset = _subset(term, rate)
                drawn = subset < SUBSETS
                np.add.at(out, (first + row[drawn], k * SUBSETS + subset[drawn]), flat.mix(term[drawn] * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1 << 24))
        first += piece.num_rows
    used = out != 0
    out = np.where(used, flat.mix(out) % np.uint64((1 << 24) - 1) + np.uint64(1), 0).astype(np.uint64)
    names = []
    for text, hashes in zip(texts, out.tolist(), strict=True):
        if any(hashes):
            names.append(",".join([f"{x:06x}" if x else "" for x in hashes]))
        else:
            names.append("x" + hashlib.sha256(text).hexdigest()[:32])
    return out, names


def likeness(a: np.ndarray, b: np.ndarray, a_names: list[str], b_names: list[str]) -> np.ndarray:
    either = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    equal = np.array([x == y for x, y in zip(a_names, b_names, strict=True)], float)
    return np.where(either > 0, same / np.maximum(either, 1), equal)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(ids: list, texts: list[str], nexts: list[str], kept: np.ndarray) -> list[list]:
    edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, nexts, strict=True)]
    own, own_names = fingerprints([x.encode() for x in texts], kept)
    new, new_names = fingerprints([x.encode() for x in edited], kept)
    other, other_names = fingerprints([x.encode() for x in nexts], kept)
    return [
        ids,
        [len(x) for x in texts],
        [hashlib.sha256(x.encode()).hexdigest() for x in edited],
        own_names,
        new_names,
        likeness(own, new, own_names, new_names).tolist(),
        likeness(own, other, own_names, other_names).tolist(),
    ]


def edited(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, and their likeness."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs, low, high))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def arrays(columns: list[list], key: pa.DataType) -> list[pa.Array]:
        return [pa.array(x, t or key) for x, t in zip(columns, types, strict=True)]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, part = shared.value, TaskContext.get().partitionId()
        held: tuple | None = None  # the row whose next is not known yet

        def edge(name: object, text: str, which: str, key: pa.DataType) -> pa.RecordBatch:
            nothing = [pa.nulls(1, t or key) for t in types[1:]]
            return pa.record_batch(
                [pa.array([name], key), *nothing, pa.array([which]), pa.array([part], pa.int32()), pa.array([text])],
                [*_NAMES, "edge", "part", "text"],
            )

        key = None
        for batch in batches:
            key = batch.schema.field("doc_id").type
            names, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()
            if not names:
                continue
            if held is None:
                yield edge(names[0], texts[0], "first", key)
            else:
                names, texts = [held[0], *names], [held[1], *texts]
            size = start = 0
            for k in range(len(texts) - 1):
                size += len(texts[k])
                if size >= 1 << 20 or k + 2 == len(texts):
                    found = _compare(names[start : k + 1], texts[start : k + 1], texts[start + 1 : k + 2], kept)
                    n = k + 1 - start
                    more = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
                    yield pa.record_batch([*arrays(found, key), *more], [*_NAMES, "edge", "part", "text"])
                    start, size = k + 1, 0
            held = (names[-1], texts[-1])
        if held is not None:
            yield edge(held[0], held[1], "last", key)

    order = F.col("doc_id").desc_nulls_last()
    ranged = docs.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order, "text")
    found = written(ranged.mapInArrow(inside, f"{result}, edge string, part int, text string"), "imatch")
    firsts = found.where(F.col("edge") == "first").select("part", F.col("text").alias("next"))
    # One row a range: the range after each, and the first for the last.
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every))
    parts = firsts.select("part", after.alias("after"))
    lasts = found.where(F.col("edge") == "last").select("doc_id", "part", "text").join(parts, "part")
    meeting = lasts.join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one row a range
                one = batch.slice(row, 1)
                ids, text, after = (one.column(x).to_pylist() for x in ("doc_id", "text", "next"))
                yield pa.record_batch(arrays(_compare(ids, text, after, shared.value), one.schema.field("doc_id").type), _NAMES)

    return found.where(F.col("edge").isNull()).select(*_NAMES).unionByName(meeting.mapInArrow(across, result))
