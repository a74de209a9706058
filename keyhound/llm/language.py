"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased letter by letter, everything else becomes a blank, and n-grams of 2 and 3 code
points are hashed to ``DIMS`` numbers.  Counts per language come from all labelled rows: each task sums
its own, so the rows exchanged depend on tasks, languages and ``DIMS`` alone.  The matrix of log
probabilities (``DIMS`` x languages) is broadcast, and a batch is scored by table look-ups and running
sums in numpy.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages are not
learned from; a language whose texts hold no letter is left out; if nothing can be learned every text is
``und``; on equal scores the language first in order wins; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.llm import flat

DIMS = 1 << 15
ORDERS = (2, 3)
MAX_LANGUAGES = 512
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return _letters()[points], heads[offsets]


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that start at each code point."""
    size = max(0, len(points) - order + 1)
    code = np.zeros(size, np.uint64)
    for k in range(order):
        code = code * np.uint64(0x1F123BB5) + points[k : k + size]
    code[code != 0] += np.uint64(order)
    out = (flat.mix(code) & np.uint64(DIMS - 1)).astype(np.int64)
    out[code == 0] = DIMS  # blanks alone say nothing
    return out


def train(docs: DataFrame, usable: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log probabilities as (language, n-gram) with a column of zeros last."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    named = [r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(named) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model would be too large to broadcast")
    languages = sorted(named)
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * (DIMS + 1), np.int64)
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                points, bounds = _points(data, offsets)
                codes = np.array([number[x] for x in piece.column("lang").to_pylist()], np.int64)
                for order in ORDERS:
                    hashed = grams(points, order)
                    row = np.searchsorted(bounds, np.arange(len(hashed)), "right") - 1
                    inside = np.arange(len(hashed)) + order <= bounds[row + 1]
                    np.add.at(counts, codes[row[inside]] * (DIMS + 1) + hashed[inside], 1)
        for lang, own in enumerate(counts.reshape(-1, DIMS + 1)):
            gram = np.flatnonzero(own[:DIMS])
            yield pa.record_batch(
                [pa.array(np.full(len(gram), lang), pa.int32()), pa.array(gram, pa.int32()), pa.array(own[gram], pa.int64())],
                ["lang", "gram", "n"],
            )

    found = rows.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    learned, lang = np.unique(found["lang"].to_numpy(), return_inverse=True)
    languages = [languages[k] for k in learned]
    counts = np.full((max(1, len(languages)), DIMS), 0.2)
    counts[lang, found["gram"].to_numpy()] += found["n"].to_numpy()
    matrix = np.zeros((len(languages), DIMS + 1), np.float32)
    if languages:
        matrix[:, :DIMS] = np.log(counts / counts.sum(1, keepdims=True))
        matrix[:, :DIMS] -= matrix[:, :DIMS].mean(0)
    return languages, matrix


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, the posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = np.array([*languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                points, bounds = _points(data, offsets)
                sums = np.zeros((len(languages) + 1, piece.num_rows))
                for order in ORDERS:
                    hashed = grams(points, order)
                    first = np.minimum(bounds[:-1], len(hashed))
                    last = np.minimum(np.maximum(bounds[1:] - order + 1, first), len(hashed))
                    for k in range(len(languages)):
                        sums[k] += flat.row_sums(weights[k][hashed], first, last)
                letters = flat.row_sums(points != 0, bounds[:-1], bounds[1:])
                known = (letters > 0) & (len(languages) > 0)
                sums[-1] = -np.inf
                best = sums.argmax(0)
                top = sums.max(0)
                with np.errstate(invalid="ignore"):
                    score = 1 / np.exp(sums[:-1] - top).sum(0) if languages else np.zeros(piece.num_rows)
                best = np.where(known, best, len(languages))
                yield pa.record_batch(
                    [
                        *(piece.column(x) for x in keep),
                        pa.array(names[best], pa.string()),
                        pa.array(np.where(known, score, 0.0), pa.float64()),
                    ],
                    [*keep, "lang_pred", "score"],
                )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
