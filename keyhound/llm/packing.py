"""Order-preserving packing of documents into token sequences.

The ids of a partition's documents form one stream.  Dynamic programming cuts it into windows of at most
``size`` ids, minimising padding plus cut penalties: none at the end of a document, ``SENTENCE`` after a
sentence, ``INSIDE`` elsewhere (allowed every ``GRID`` ids, so a document without sentences can be cut
too).  A window whose length is a power of two needs no padding.  As padding is linear in the window's
length, the best start of all other windows is the minimum of a sliding range, kept in a monotone queue;
the few starts a power of two back are looked up.  What remains at the end of a partition is cut into
powers of two, so it needs no padding either.

A partition is worked off in stretches of ``STRETCH`` ids; the last windows of a stretch are decided
again with the next, so memory does not grow with the partition, and the end of a stretch inside a document is neither a
free cut nor the end of a piece.  Documents keep the table's order, no
rows are shuffled, and a sequence never spans partitions.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed as rows of their
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from keyhound.llm import encoding, tokens

STRETCH = 1 << 19
GRID = 32
SENTENCE, INSIDE, SHORT = 1.0, 10.0, 8.0
_KEPT_BACK = 6


@cache
def _sentence_ends(path: str) -> np.ndarray:
    """For each id whether its text ends a sentence or a line."""
    tokenizer = encoding.load(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for text, number in vocabulary.items():
        ends[number] = text.endswith((".", "!", "?", "Ċ"))
    return ends


def cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, size: int, last: bool = True) -> list[int]:
    """Ends of the windows, the last of them ``len(ids)``; or, if more ids follow, the cheapest in reach of it."""
    total = len(ids)
    price = np.full(total + 1, np.inf)
    price[::GRID] = INSIDE
    price[np.flatnonzero(sentence[ids]) + 1] = SENTENCE
    price[doc_ends] = 0.0
    price[0] = 0.0
    if last:
        price[total] = 0.0
    places = np.flatnonzero(np.isfinite(price))
    number = np.full(total + 1, -1, np.int64)
    number[places] = np.arange(len(places))
    shorter = [1 << k for k in range(6, size.bit_length()) if 1 << k < size]
    back = [np.where(places >= s, number[np.maximum(places - s, 0)], -1).tolist() for s in shorter]
    at, fee = places.tolist(), price[places].tolist()
    best, origin = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    looked = list(zip(*back, strict=True)) if back else [()] * len(at)
    for j in range(1, len(at)):
        end = at[j]
        while queue[0][1] < end - size:
            queue.popleft()
        value, _, start = queue[0]
        value += size - end
        for i in looked[j]:
            if i >= 0 and best[i] + SHORT < value:
                value, start = best[i] + SHORT, i
        value += fee[j]
        best[j], origin[j] = value, start
        key = value + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, end, j))
    out, j = [], len(at) - 1
    if not last:
        near = [k for k in range(len(at)) if at[k] > total - size] or [j]
        j = min(near, key=lambda k: (best[k], -k))
    while j > 0:
        out.append(at[j])
        j = origin[j]
    return out[::-1]


def _powers_of_two(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end: int | None = 0, size: int = 1024, with_ids: bool = True) -> DataFrame:
    """A row per piece of a document in a sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on demand, ``ids``.
    """
    tail = np.zeros(0, np.int32) if end is None else np.array([end], np.int32)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sentence = encoding.encoder(tokenizer), _sentence_ends(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # doc_id, doc_tokens, start, ids: a document, or a stretch of a long one
        waiting = 0

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal held, waiting, sequence
            stream = np.concatenate([x[3] for x in held])
            doc_ends = np.cumsum([len(x[3]) for x in held])
            whole = np.array([start + len(ids) == total for _, total, start, ids in held])
            ends = cuts(stream, doc_ends[whole], sentence, size, last)
            if last:
                begin = ends[-2] if len(ends) > 1 else 0
                rest = len(stream) - begin
                if rest < size:
                    ends[-1:] = (begin + np.cumsum(_powers_of_two(rest))).tolist()
            else:
                ends = ends[:-_KEPT_BACK]
            bounds = np.array([0, *ends], np.int64)
            stop = int(bounds[-1])
            doc_starts = doc_ends - np.array([len(x[3]) for x in held])
            begins = doc_starts[np.array([x[2] == 0 for x in held])]
            edges = np.union1d(bounds, begins[begins < stop])
            first, final = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, first, "right")
            window = np.searchsorted(bounds, first, "right") - 1
            raw = memoryview(stream[:stop].tobytes())
            owners = doc.tolist()
            spans = list(zip((first * 4).tolist(), (final * 4).tolist(), strict=True))
            columns = [
                pa.array([held[k][0] for k in owners], key),
                pa.array(first - doc_starts[doc] + np.array([held[k][2] for k in owners], np.int64)),
                pa.array(final - first),
                pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                pa.array([held[k][1] for k in owners], pa.int64()),
                pa.array(window + sequence),
                pa.array(first - bounds[window]),
            ]
            if with_ids:
                offsets = pa.array(np.append(first, stop).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(stream[:stop])))
            sequence += len(ends)
            rest = []
            for k in range(int(np.searchsorted(doc_ends, stop, "right")), len(held)):
                name, total, start, ids = held[k]
                used = max(0, stop - int(doc_starts[k]))
                rest.append((name, total, start + used, ids[used:]))
            held, waiting = rest, len(stream) - stop
            return pa.record_batch(columns, [*names, *(["ids"] if with_ids else [])])

        for batch in batches:
            key = batch.schema.field("doc_id").type
            for rows, texts in tokens.slices(batch):
                found, offsets = encoder.encode(texts)
                for k, name in enumerate(rows.column("doc_id").to_pylist()):
                    ids = np.concatenate([found[offsets[k] : offsets[k + 1]], tail])
                    for at in range(0, len(ids), STRETCH):
                        held.append((name, len(ids), at, ids[at : at + STRETCH]))
                        waiting += len(held[-1][3])
                        if waiting >= STRETCH:
                            yield settle(False)
        if waiting:
            yield settle(True)

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
