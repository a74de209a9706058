"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL-proximal steps.

Words are stretches without white space.  Each word gives four features, hashed to ``DIMS``: the word,
its shape (lower, upper, digit and punctuation runs), and the pairs of either with the word before.
A feature's value is its count over the square root of all counts of the text, so a score is a sparse
dot product that costs one table look-up per feature.

Learning takes a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by a hash of the id), dealt
to ``SHARDS`` groups; each runs its own FTRL pass and the weights are averaged.  The weights (``DIMS``
floats, whatever the input) are broadcast for scoring.

Defined cases: null and empty texts have no features and get the score of the intercept; a null label
or id is not learned from; several labels of one id count by their mean; without any label all scores
are 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhound.llm import flat

DIMS = 1 << 18
TRAIN_ROWS = 12_000
SHARDS = 4
EPOCHS = 3
_ALPHA, _BETA, _L1, _L2 = 0.6, 0.05, 0.0, 0.02


def _shape_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    return table


_SHAPE = _shape_table()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, and the offsets of each row's own."""
    starts, ends, row = flat.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = flat.span_hash(flat.prefix_sums(data), starts, ends)
    classes = _SHAPE[data]
    change = np.empty(len(data), bool)
    change[0], change[1:] = True, classes[1:] != classes[:-1]
    change[starts] = True
    rank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(change, out=rank[1:])
    shape = flat.span_hash(flat.prefix_sums(classes[change]), rank[starts], rank[ends])
    fresh = np.empty(len(row), bool)
    fresh[0], fresh[1:] = True, row[1:] != row[:-1]

    def pair(x: np.ndarray, salt: int, same: np.ndarray) -> np.ndarray:
        before = np.roll(x, 1)
        before[fresh] = 7
        return flat.mix(before * np.uint64(3) + x + np.uint64(salt) + same)

    same = np.zeros(len(word), np.uint64)
    same[1:] = word[1:] == word[:-1]
    same[fresh] = 0
    out = np.empty((len(word), 4), np.uint64)
    out[:, 0], out[:, 1] = word, flat.mix(shape + np.uint64(11))
    out[:, 2] = pair(word, 101, np.zeros_like(same))
    out[:, 3] = pair(shape, 211, same * np.uint64(977))
    count = np.bincount(row, minlength=len(offsets) - 1) * 4
    return (out.reshape(-1) & np.uint64(DIMS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(count)])


def _learn(table: pa.Table) -> pa.Table:
    """FTRL-proximal over one shard; returns the non-zero weights, the intercept as number ``DIMS``."""
    rows = []
    for batch in table.combine_chunks().to_batches():
        for piece, data, offsets in flat.pieces(batch):
            ids, bounds = features(data, offsets)
            for k, y in enumerate(piece.column("label").to_pylist()):
                index, count = np.unique(ids[bounds[k] : bounds[k + 1]], return_counts=True)
                size = max(1.0, float(count.sum())) ** 0.5
                rows.append((np.append(index, DIMS).astype(np.int32), np.append(count / size, 1.0).astype(np.float32), float(y)))
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            index, x, y = rows[k]
            w = _weights(z[index], n[index])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / _ALPHA
            z[index] += g - step * w
            n[index] += g * g
    w = _weights(z, n)
    used = np.flatnonzero(w)
    return pa.table({"feature": pa.array(used, pa.int64()), "weight": pa.array(w[used], pa.float64())})


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    raw = -(z - np.sign(z) * _L1) / ((_BETA + np.sqrt(n)) / _ALPHA + _L2)
    return np.where(np.abs(z) <= _L1, 0.0, raw)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of ``DIMS`` features and the intercept, from about ``max_rows`` labelled rows."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    total = marked.count()
    if total > max_rows:
        share = int(max_rows / total * 1_000_000)
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share)
    marked = marked.groupBy("doc_id").agg(F.avg(label).alias("label"))
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(marked), "doc_id")  # at most about max_rows pairs of numbers
        .select("text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard"))
    )
    parts = sample.groupBy("shard").applyInArrow(_learn, "feature long, weight double")
    summed = parts.groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros(DIMS + 1, np.float32)
    weights[summed["feature"].to_numpy()] = summed["weight"].to_numpy() / SHARDS
    return weights


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and, as ``name``, the probability of a good text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [x for x in keep if x != "text"]
    source = docs.select(*kept, "text")
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                ids, bounds = features(data, offsets)
                count = np.diff(bounds)
                dot = flat.row_sums(w[ids], bounds[:-1], bounds[1:]) / np.sqrt(np.maximum(count, 1))
                p = 1 / (1 + np.exp(-np.clip(dot + w[DIMS], -35, 35)))
                yield pa.record_batch([*(piece.column(x) for x in keep), pa.array(p, pa.float64())], [*keep, name])

    return source.mapInArrow(run, schema)
