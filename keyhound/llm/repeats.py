"""Exact substring dedup: equal windows of ``LENGTH`` bytes, by anchors and window hashes.

This takes the place of suffix order and longest previous factors: no suffixes are sorted and no factor lengths
are held, as a fixed ``LENGTH`` asks only whether another window is equal:

1. In each window of ``LENGTH`` bytes the ``GRAM`` bytes with the smallest hash are its anchor (about 1.3
   anchors in 100 bytes).  Equal windows have equal anchors at equal places.  Anchors are counted over the
   corpus; those that occur once are done.  An anchor's windows form its context: one stretch of bytes.
2. If all contexts of an anchor are equal by their hash, all its windows repeat.  No bytes are looked at.
3. Otherwise one copy of each context is fetched.  Their windows of ``LENGTH`` bytes are ordered by hash, equal
   ones by place, and compared byte by byte with their neighbour: the one before tells whether an earlier window
   is equal, the two together whether any other is.

``removed="all"`` removes bytes that any other place repeats; ``removed="later"`` keeps the first place of
each repeated string (smallest id, then place) and removes later ones.

Contexts of one anchor are handled in one task, which sorts them in stretches of ``TASK_BYTES``.  An anchor
with more than ``CONTEXTS`` different contexts (a very common line) is handled window by window instead: its
windows' hashes (two of 64 bits, no bytes) are dealt out and counted with a sum on the map side, so no task holds them all.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes keep everything; repeated rows repeat each
other and get equal results; rows are told apart by id and a hash of the text; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhound.llm import flat
from keyhound.session import written

LENGTH = 200
GRAM = 50
CONTEXTS = 32_768
TASK_BYTES = 8 << 20
_PLACE = np.uint64(24)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    level, size = x, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    rest = width - size
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``row, first, last, anchor, context``: runs of window starts with one anchor, as places in ``data``."""
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    step = 1 << int(_PLACE) - 1
    for begin in range(0, max(1, len(data) - length + 1), step):
        part = data[begin : begin + step + length - 1]
        if len(part) < length:
            break
        sums = flat.prefix_sums(part)
        starts = np.arange(len(part) - gram + 1)
        hashed = flat.span_hash(sums, starts, starts + gram)
        place = starts.astype(np.uint64)
        small = _sliding_min((hashed >> _PLACE << _PLACE) | place, length - gram + 1)
        window = np.arange(begin, begin + len(small))
        row = np.searchsorted(offsets, window, "right") - 1
        inside = window + length <= offsets[row + 1]
        fresh = np.empty(len(small), bool)
        fresh[0], fresh[1:] = True, (small[1:] != small[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(fresh & inside)
        if not len(head):
            continue
        # The windows of a run stop where the row's last window is.
        ends = np.append(np.flatnonzero(fresh)[1:], len(small))
        tail = ends[np.searchsorted(ends, head, "right")] - 1
        tail = np.minimum(tail, offsets[row[head] + 1] - length - begin)
        at = (small[head] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        context = flat.span_hash(sums, head, tail + length) ^ flat.mix((at - head).astype(np.uint64))
        out.append((row[head], head + begin, tail + begin, hashed[at].astype(np.int64), context.astype(np.int64)))
    if not out:
        return none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, text_id, first, last, anchor, context`` of all anchors."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                row, first, last, anchor, context = anchors(data, offsets, length, gram)
                index = pa.array(row)
                yield pa.record_batch(
                    [
                        piece.column("doc_id").take(index),
                        piece.column("text_id").take(index),
                        pa.array((first - offsets[row]).astype(np.int32)),
                        pa.array((last - offsets[row]).astype(np.int32)),
                        pa.array(anchor),
                        pa.array(context),
                    ],
                    ["doc_id", "text_id", "first", "last", "anchor", "context"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, text_id long, first int, last int, anchor long, context long")


_PLACE_OF = ("doc_id", "text_id", "first")


def _contexts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """``anchor, context, n, rank, bytes`` of the chosen place of each context."""
    wanted = chosen.groupBy(F.col("place.doc_id").alias("__doc"), F.col("place.text_id").alias("__text")).agg(
        F.collect_list(F.struct("anchor", "context", "n", F.col("place.first").alias("first"), "last")).alias("wanted")
    )
    joined = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__doc")) & (docs["text_id"] == F.col("__text")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "n", "doc_id", "text_id", "first", "bytes"]
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                lists = piece.column("wanted")
                items = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                first = items.field("first").to_numpy().astype(np.int64)
                stop = items.field("last").to_numpy().astype(np.int64) + length
                raw = memoryview(data)
                begin = offsets[row]
                cut = [bytes(raw[a:b]) for a, b in zip((begin + first).tolist(), (begin + stop).tolist(), strict=True)]
                index = pa.array(row)
                yield pa.record_batch(
                    [
                        *(items.field(x) for x in ("anchor", "context", "n")),
                        piece.column("doc_id").take(index),
                        piece.column("text_id").take(index),
                        items.field("first"),
                        pa.array(cut, pa.binary()),
                    ],
                    names,
                )

    schema = f"anchor long, context long, n long, doc_id {kind}, text_id long, first int, bytes binary"
    # Rows of one id and text were wanted once for each repetition.
    return joined.select("doc_id", "text_id", "text", "wanted").mapInArrow(run, schema).dropDuplicates(["anchor", "context"])


def longest_previous(contexts: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For the suffixes of ``length`` bytes of contexts given in order of place.

    Returns the context and place of each suffix, whether an earlier place has its first ``length`` bytes,
    and whether any other place has.
    """
    sizes = np.array([len(x) for x in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = begins[owner] + place
    key = flat.span_hash(flat.prefix_sums(data), start, start + length) ^ flat.mix(anchor[owner].astype(np.uint64))
    order = np.argsort(key, kind="stable")  # equal strings stay in order of place
    sorted_start = start[order]
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(key[order][1:] == key[order][:-1])
    lanes = np.arange(length)
    for k in range(0, len(near), 20_000):
        pair = near[k : k + 20_000]
        left = data[sorted_start[pair][:, None] + lanes]
        right = data[sorted_start[pair + 1][:, None] + lanes]
        same[pair + 1] = (left == right).all(1) & (anchor[owner[order[pair]]] == anchor[owner[order[pair + 1]]])
    # Inside a stretch of equal strings places ascend, so the previous smaller place is the neighbour
    # before and the next one (greater) the neighbour after.
    earlier = np.zeros(len(order), bool)
    other = np.zeros(len(order), bool)
    earlier[order] = same
    later = np.append(same[1:], False)
    other[order] = same | later
    return owner, place, earlier, other


def _stretches(flag: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked places within one owner."""
    joined = np.zeros(len(flag), bool)
    joined[1:] = flag[1:] & flag[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(flag & ~joined)
    last = np.flatnonzero(flag & ~np.append(joined[1:], False))
    return owner[first], place[first], place[last]


_FOUND = "anchor long, context long, a int, b int, earlier boolean"


def _matches(contexts: DataFrame, length: int) -> DataFrame:
    """``anchor, context, a, b, earlier``: repeated windows of each context."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        # Contexts in order of their place, so that earlier in the list is earlier in the corpus.
        table = table.sort_by([("doc_id", "ascending"), ("text_id", "ascending"), ("first", "ascending")])
        anchor = table.column("anchor").to_numpy()
        owner, place, earlier, other = longest_previous(table.column("bytes").to_pylist(), anchor, length)
        parts = []
        for flag, name in ((earlier, True), (other, False)):
            who, a, b = _stretches(flag, owner, place)
            parts.append((who, a, b, np.full(len(who), name)))
        who, a, b, name = (np.concatenate(x) for x in zip(*parts, strict=True))
        index = pa.array(who)
        return pa.record_batch(
            [
                pa.array(anchor[who]),
                table.column("context").take(index).combine_chunks(),
                pa.array(a.astype(np.int32)),
                pa.array(b.astype(np.int32)),
                pa.array(name),
            ],
            ["anchor", "context", "a", "b", "earlier"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size += batch.nbytes
            if size >= TASK_BYTES:
                anchor = batch.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # rows are sorted by anchor
                if cut or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
                    done = [*held, batch.slice(0, cut)] if cut else held
                    yield settle(done)
                    held, batch = [], batch.slice(cut)
                    size = batch.nbytes
            held.append(batch)
        if held:
            yield settle(held)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def _common_matches(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contexts, window by window."""
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "place", "one", "two", "doc_id", "text_id", "first"]
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                rows = batch.slice(k, 4096)
                texts = rows.column("bytes").to_pylist()
                anchor = rows.column("anchor").to_numpy()
                sizes = np.array([len(x) for x in texts], np.int64)
                data = np.frombuffer(b"".join(texts), np.uint8)
                count = sizes - length + 1
                owner = np.repeat(np.arange(len(texts)), count)
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                start = (np.cumsum(sizes) - sizes)[owner] + place
                index = pa.array(owner)
                yield pa.record_batch(
                    [
                        pa.array(anchor[owner]),
                        rows.column("context").take(index),
                        pa.array(place.astype(np.int32)),
                        pa.array(flat.span_hash(flat.prefix_sums(data), start, start + length).view(np.int64)),
                        pa.array(flat.span_hash(flat.prefix_sums(data ^ np.uint8(0x55)), start, start + length).view(np.int64)),
                        *(rows.column(x).take(index) for x in ("doc_id", "text_id", "first")),
                    ],
                    names,
                )

    schema = f"anchor long, context long, place int, one long, two long, doc_id {kind}, text_id long, first int"
    windows = written(contexts.mapInArrow(run, schema), "repeat-windows")
    key = ["anchor", "one", "two"]
    where = F.struct("doc_id", "text_id", "first", "place").alias("where")
    counted = windows.select(*key, where).groupBy(*key).agg(F.count("*").alias("n"), F.min("where").alias("least")).where("n > 1")
    hits = windows.select("context", "place", *key, where).join(counted, key)
    each = hits.select("anchor", "context", F.col("place").alias("a"), F.col("place").alias("b"))
    later = hits.where(F.col("where") > F.col("least")).select("anchor", "context", F.col("place").alias("a"), F.col("place").alias("b"))
    return each.withColumn("earlier", F.lit(False)).unionByName(later.withColumn("earlier", F.lit(True)))


def find(docs: DataFrame, removed: str = "all", length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """``doc_id, text_id, spans``: starts and last starts of repeated windows, for rows that have any."""
    if removed not in ("all", "later"):
        raise ValueError("removed is 'all' or 'later'")
    keep_first = removed == "later"
    places = _rows(docs, length, gram)
    place = F.struct(*_PLACE_OF)
    counted = places.groupBy("anchor").agg(
        F.count("*").alias("n"),
        (F.min("context") != F.max("context")).alias("mixed"),
        *([F.min(place).alias("least")] if keep_first else []),
    )
    repeated = counted.where("n > 1").drop("n")
    own = written(places.join(repeated, "anchor"), "repeat-places")

    mixed = own.where("mixed").groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct(*_PLACE_OF, "last")).alias("place")
    )
    chosen = written(mixed.select("anchor", "context", "n", "place", F.col("place.last").alias("last")), "repeat-chosen")
    fetched = written(_contexts(docs, chosen, length), "repeat-contexts")
    common = chosen.groupBy("anchor").count().where(F.col("count") > contexts).select("anchor")
    matches = _matches(fetched.join(common, "anchor", "left_anti"), length)
    if not common.isEmpty():
        matches = matches.unionByName(_common_matches(fetched.join(common, "anchor"), length))

    same = own.where("NOT mixed")
    span = F.struct(F.col("first").alias("a"), F.col("last").alias("b")).alias("span")
    if keep_first:
        same = same.where(place > F.col("least"))
        # Places of an equal context after its first one go whole; in the first, what has an earlier match.
        first_of = chosen.select("anchor", "context", F.struct(*(F.col(f"place.{x}") for x in _PLACE_OF)).alias("chosen"))
        split = own.where("mixed").join(first_of, ["anchor", "context"])
        copies = split.where(place > F.col("chosen"))
        rest = split.where(place == F.col("chosen")).join(matches.where("earlier"), ["anchor", "context"])
    else:
        twice = chosen.select("anchor", "context", "n")
        split = own.where("mixed").join(twice, ["anchor", "context"])
        copies = split.where("n > 1")
        rest = split.where("n = 1").join(matches.where("NOT earlier"), ["anchor", "context"])
    inner = F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")).alias("span")
    hits = same.select("doc_id", "text_id", span).unionByName(copies.select("doc_id", "text_id", span))
    hits = hits.unionByName(rest.select("doc_id", "text_id", inner))
    return hits.groupBy("doc_id", "text_id").agg(F.collect_set("span").alias("spans"))


def dedup(docs: DataFrame, removed: str = "all", length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS, text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, on demand, the remaining bytes ``kept``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    spans = find(docs, removed, length, gram, contexts).withColumnsRenamed({"doc_id": "__doc", "text_id": "__text"})
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("__doc")) & (docs["text_id"] == F.col("__text")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").cast(pa.binary()), batch.column("spans")
            out: list[list] = [[] for _ in names[1:]]
            for row in range(batch.num_rows):
                raw = texts[row].as_py()
                hit = spans[row].values
                kept, gone, runs = raw, 0, 0
                if hit is not None and len(hit):
                    a, b = hit.field("a").to_numpy(), hit.field("b").to_numpy() + length
                    order = np.argsort(a)
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > b[:-1])
                    starts, ends = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(raw)]
                    kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    gone, runs = int((ends - starts).sum()), len(starts)
                values = (len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types, strict=False))], names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else "")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)
