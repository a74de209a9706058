"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its stretches of ``SHINGLE`` words (a shorter text has one stretch).
Documents of equal sets form one class; the join runs over classes.

Chosen paths: ``COORDINATES`` min-hashes sample tokens of a set in the same way for all sets, so two sets
agree on one with the probability of their similarity.  In each run all sets start in one bucket.  A bucket
draws one coordinate, and a second with probability ``1 / threshold - 1``, and splits by the sampled token.
Buckets of one set end; those of up to ``SMALL`` sets are compared directly; larger ones are split again, up
to ``DEPTH`` times.  ``runs_for`` gives the number of runs that finds a pair at the threshold with the target
recall even if all its buckets are split ``DEPTH`` times; the more similar, the surer.

Comparison: in a bucket, pairs whose min-hashes agree on less than ``threshold - MARGIN`` are left out, and
a pair is looked at in the first of its common buckets only.  Sets of the remaining documents are fetched
once for each bucket that needs them and compared exactly.  A bucket that stays large (a group of very many
near copies) is dealt to cells of pairs of blocks of about ``BLOCK`` sets, or of ``BLOCK_HASHES`` hashes if its
sets are long.  Cells above ``DENSE`` sets compare tiles of pairs by array operations, and their sets by products
of token columns, so a pair costs nanoseconds; what leaves a cell is a number of links per set and a spanning
forest, never all pairs.  Counting the links of a group of n sets that are all alike still looks at n * n pairs.
Groups are the connected components of the links, found by star contraction on DataFrames.

Defined cases: null and empty texts are classes of their own without links; a null id takes part in its
class, and a group without any id is named by its hash; repeated rows are copies of one class; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.llm import flat
from keyhound.session import written

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
SMALL = 64
DEPTH = 4
BLOCK = 2048
BLOCK_HASHES = 4_000_000
DENSE = 128
TILE = 256
MARGIN = 0.22
_PAIRS = 100_000
_HELD = 1_000_000
_WIDTH = 2048


def runs_for(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in some bucket with probability ``recall``.

    Runs count as independent.  They share ``COORDINATES`` min-hashes, so a pair exactly at 0.8 whose buckets
    are all split ``DEPTH`` times is found with about 0.998 at the default recall.
    """
    met, second = 1.0, min(1.0, 1 / threshold - 1)
    for _ in range(depth):
        hit = threshold * met
        met = (1 - second) * hit + second * (1 - (1 - hit) ** 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the bounds of each row's own."""
    data = flat.LOWER[data]
    starts, ends, row = flat.words(data, offsets)
    word = flat.span_hash(flat.prefix_sums(data), starts, ends)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    number = np.maximum(count - size + 1, np.minimum(count, 1))  # of shingles
    owner = np.repeat(np.arange(rows), number)
    at = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    hashed = np.zeros(len(at), np.uint64)
    stop = first[owner] + count[owner]
    for k in range(size):
        inside = at + k < stop
        hashed = np.where(inside, flat.mix(hashed * np.uint64(31) + word[np.minimum(at + k, len(word) - 1)]), hashed)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[new], owner[new]
    return hashed, np.searchsorted(owner, np.arange(rows + 1))


_FACTORS = flat.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def minhashes(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``COORDINATES`` min-hashes of each row as int32; rows without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.int32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(COORDINATES):
            least = np.minimum.reduceat(hashed * _FACTORS[k], bounds[full])
            out[full, k] = (flat.mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _identity(hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(flat.mix(hashed + np.uint64(salt)), out=sums[1:])
        out.append(flat.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_id, node, check, size, sketch`` of each row; ``node`` and ``check`` name its set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                hashed, bounds = shingles(data, offsets, size)
                node, check = _identity(hashed, bounds)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * COORDINATES), pa.array(minhashes(hashed, bounds).ravel())
                )
                yield pa.record_batch(
                    [piece.column("doc_id"), piece.column("text_id"), pa.array(node), pa.array(check), pa.array(np.diff(bounds)), lists],
                    ["doc_id", "text_id", "node", "check", "size", "sketch"],
                )

    source = docs.select("doc_id", _text_id(), "text")
    return source.mapInArrow(run, f"doc_id {kind}, text_id long, node long, check long, size long, sketch array<int>")


def _text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id")


def buckets(classes: DataFrame, threshold: float, recall: float, small: int, depth: int) -> DataFrame:
    """``path, node, size, members, hashes``: the buckets of at least two sets in which all runs end."""
    second = min(1.0, 1 / threshold - 1)

    def draw(path: str, salt: int) -> Column:
        return F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(COORDINATES)).cast("int")

    def split(rows: DataFrame) -> DataFrame:
        more = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1_000_000)) < int(second * 1_000_000)
        drawn = F.when(more & (draw("path", 1) != draw("path", 2)), F.array(draw("path", 1), draw("path", 2))).otherwise(F.array(draw("path", 1)))
        rows = rows.withColumn("coordinate", F.explode(drawn))
        return rows.select(F.xxhash64("path", "coordinate", F.get("sketch", "coordinate")).alias("path"), "node", "size")

    runs = F.explode(F.sequence(F.lit(1), F.lit(runs_for(threshold, recall, depth))))
    open_ = split(classes.select("node", "size", "sketch", runs.alias("run")).withColumn("path", F.xxhash64("run")))
    ended = None
    for level in range(1, depth + 1):
        open_ = written(open_, "join-open")
        counts = open_.groupBy("path").agg(F.count("*").alias("members"), F.sum("size").alias("hashes")).where("members > 1")
        shared = written(open_.join(counts, "path"), "join-shared")
        done = shared if level == depth else shared.where(F.col("members") <= small)
        ended = done if ended is None else ended.unionByName(done)
        rest = shared.where(F.col("members") > small).select("path", "node", "size")
        if level == depth or rest.isEmpty():
            break
        open_ = split(rest.join(classes.select("node", "sketch"), "node"))
    return ended


def _cells(rows: DataFrame) -> DataFrame:
    """``cell`` and both blocks of each row: buckets above a block become pairs of blocks."""
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.least(F.col("hashes") / BLOCK_HASHES, F.col("members")))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "path"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("inner", F.col("block") == F.col("other"))
    return rows.withColumn("cell", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")))


class _Cells:
    """Rows sorted by cell, handed out as tables of whole cells of about ``limit`` bytes."""

    def __init__(self, batches: Iterator[pa.RecordBatch], limit: int = 8 << 20):
        self.batches, self.limit = batches, limit

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in self.batches:
            if not batch.num_rows:
                continue
            size += batch.nbytes
            if size >= self.limit:
                cell = batch.column("cell").to_numpy()
                cut = int(np.searchsorted(cell, cell[-1]))
                if cut or (held and held[-1].column("cell")[-1].as_py() != cell[0]):
                    yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                    held, batch = [], batch.slice(cut)
                    size = batch.nbytes
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _candidates(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are first met in their cell and whose sketches agree on ``least``."""
    cell, node, path = (_column(table, x).to_numpy() for x in ("cell", "node", "path"))
    block = _column(table, "block").to_numpy()
    inner = _column(table, "inner").to_numpy(zero_copy_only=False)
    sketch = _column(table, "sketch").flatten().to_numpy().reshape(-1, COORDINATES)
    lists = _column(table, "paths")
    size = np.diff(lists.offsets.to_numpy())
    widest = int(size.max())
    paths = np.full((len(cell), widest), np.iinfo(np.int64).max)
    paths[np.arange(widest) < size[:, None]] = lists.flatten().to_numpy()
    begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    ends = np.append(begins[1:], len(cell))
    waiting: list[np.ndarray] = []
    total = 0

    def judged() -> tuple[np.ndarray, np.ndarray]:
        pairs = np.concatenate(waiting)
        left, right = pairs[:, 0], pairs[:, 1]
        # In a cell of two blocks, pairs inside one block belong to that block's own cell.
        own = inner[left] | (block[left] != block[right])
        left, right = left[own], right[own]
        agree = np.zeros(len(left), np.int16)
        for k in range(COORDINATES):
            agree += sketch[left, k] == sketch[right, k]
        near = agree >= least * COORDINATES
        left, right = left[near], right[near]
        first = np.full(len(left), np.iinfo(np.int64).max)
        for k in range(widest):
            mine = paths[left, k]
            common = (paths[right] == mine[:, None]).any(1)
            first = np.minimum(first, np.where(common, mine, first))
        met = first == path[left]
        return left[met], right[met]

    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a > DENSE:
            for left, right in _dense(sketch[a:b], paths[a:b], path[a], inner[a], block[a:b], least * COORDINATES):
                yield left + a, right + a
            continue
        left, right = np.triu_indices(b - a, 1)
        waiting.append(np.stack([left + a, right + a], 1))
        total += len(left)
        if total >= _PAIRS:
            yield judged()
            waiting, total = [], 0
    if total:
        yield judged()


def _met(paths: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share a path below ``here``: a matrix for rare paths, columns for common ones."""
    out = np.zeros((len(paths), len(paths)), bool)
    row, slot = np.nonzero(paths < here)
    value = paths[row, slot]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    edges = np.flatnonzero(np.diff(value)) + 1
    begins, ends = np.append(0, edges), np.append(edges, len(value))
    common = [row[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a > 1]
    wide = [x for x in common if len(x) > SMALL]
    for rows in common:
        if len(rows) <= SMALL:
            out[rows[:, None], rows] = True
    columns = np.zeros((len(paths), len(wide)), np.float32)
    for k, rows in enumerate(wide):
        columns[rows, k] = 1
    return out, columns


def _dense(sketch: np.ndarray, paths: np.ndarray, here: int, inner: bool, block: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_candidates`` of one large cell, by tiles of ``TILE`` rows."""
    met, columns = _met(paths, here)
    by_coordinate = np.ascontiguousarray(sketch.T)
    for a in range(0, len(sketch), TILE):
        b = min(len(sketch), a + TILE)
        open_ = ~met[a:b, a:] & (np.arange(a, b)[:, None] < np.arange(a, len(sketch)))
        if not inner:
            open_ &= block[a:b, None] != block[a:]
        if columns.shape[1]:
            open_ &= columns[a:b] @ columns[a:].T == 0
        column = np.flatnonzero(open_.any(0))
        if not len(column):
            continue
        agree = np.zeros((b - a, len(column)), np.uint8)
        others = by_coordinate[:, a + column]
        for k in range(COORDINATES):
            agree += by_coordinate[k, a:b, None] == others[k]
        left, right = np.nonzero(open_[:, column] & (agree >= least))
        if len(left):
            yield left + a, column[right] + a


def _needed(cells: DataFrame, least: float) -> DataFrame:
    """``cell, node`` of the sets that have a candidate pair in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Cells(batches):
            used = np.zeros(table.num_rows, bool)
            for left, right in _candidates(table, least):
                used[left] = used[right] = True
            index = pa.array(np.flatnonzero(used))
            if len(index):
                yield pa.record_batch([_column(table, "cell").take(index), _column(table, "node").take(index)], ["cell", "node"])

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "cell long, node long")


def _with_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, set`` for the nodes of ``wanted`` (``node, doc_id``): their shingle hashes as bytes."""
    wanted = wanted.select("node", F.col("doc_id").alias("__doc"))
    joined = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__doc"))).select("text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in flat.pieces(batch):
                hashed, bounds = shingles(data, offsets, size)
                node, _ = _identity(hashed, bounds)
                right = np.flatnonzero(node == piece.column("node").to_numpy())  # an id may repeat with other texts
                raw, at = hashed.tobytes(), (bounds * 8).tolist()
                yield pa.record_batch(
                    [pa.array(node[right]), pa.array([raw[at[k] : at[k + 1]] for k in right.tolist()], pa.binary())], ["node", "set"]
                )

    return joined.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sorted distinct sets, with about ``_HELD`` hashes in hand."""
    size = np.array([len(x) for x in sets], np.int64)
    rows, lefts = np.unique(left, return_inverse=True)
    columns, rights = np.unique(right, return_inverse=True)
    if len(left) < 16 * (len(rows) + len(columns)):
        return _each(sets, size, left, right)
    out = np.zeros(len(left))
    row_tile, column_tile = np.cumsum(size[rows]) // _HELD, np.cumsum(size[columns]) // _HELD
    tile = row_tile[lefts] * (column_tile[-1] + 1) + column_tile[rights]
    order = np.argsort(tile, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        rows, lefts = np.unique(left[part], return_inverse=True)
        columns, rights = np.unique(right[part], return_inverse=True)
        if len(part) < 16 * (len(rows) + len(columns)):
            out[part] = _each(sets, size, left[part], right[part])
        else:
            common = _products([sets[k] for k in rows.tolist()], [sets[k] for k in columns.tolist()])[lefts, rights]
            out[part] = common / (size[left[part]] + size[right[part]] - common)
    return out


def _products(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each of ``rows`` with each of ``columns``, by products of ``_WIDTH`` token columns."""

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, token = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        here = np.searchsorted(tokens, token)
        known = tokens[np.minimum(here, len(tokens) - 1)] == token
        order = np.argsort(here[known], kind="stable")
        return owner[known][order], here[known][order]

    out = np.zeros((len(rows), len(columns)))
    tokens = np.intersect1d(np.concatenate(rows), np.concatenate(columns))
    if not len(tokens):
        return out
    (own, mine), (other, theirs) = entries(rows), entries(columns)
    for start in range(0, len(tokens), _WIDTH):
        sides = []
        for count, owner, token in ((len(rows), own, mine), (len(columns), other, theirs)):
            a, b = np.searchsorted(token, [start, start + _WIDTH])
            side = np.zeros((count, min(_WIDTH, len(tokens) - start)), np.float32)
            side[owner[a:b], token[a:b] - start] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _each(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``_overlaps`` for pairs with few others on either side: one look-up of all right sets per left set."""
    out = np.zeros(len(left))
    order = np.argsort(left, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, left[order][1:] != left[order][:-1])), len(left))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = sets[left[order[a]]]
        heap = np.cumsum(size[right[order[a:b]]]) // _HELD
        for part in np.split(order[a:b], np.flatnonzero(heap[1:] != heap[:-1]) + 1):
            others = right[part]
            lengths = size[others]
            hashes = np.concatenate([sets[k] for k in others.tolist()])
            hit = mine[np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)] == hashes
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
            out[part] = common / (lengths + len(mine) - common)
    return out


def _roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, once components ``root`` are joined by more links."""
    new_links = root[left] != root[right]
    if not new_links.any():
        return root
    left = np.append(left[new_links], np.arange(len(root)))
    right = np.append(right[new_links], root)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_LINKS = "node long, links long, root long"


def _links(cells: DataFrame, threshold: float, least: float) -> DataFrame:
    """``node, links, root``: per cell the copies linked to each set, and an edge of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Cells(batches):
            node, copies = _column(table, "node").to_numpy(), _column(table, "copies").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in _column(table, "set")]
            linked = np.zeros(len(node), np.int64)
            root = np.arange(len(node))
            for left, right in _candidates(table, least):
                if not len(left):
                    continue
                near = _overlaps(sets, left, right) >= threshold - 1e-12
                left, right = left[near], right[near]
                np.add.at(linked, left, copies[right])
                np.add.at(linked, right, copies[left])
                root = _roots(root, left, right)
            used = np.flatnonzero(linked)
            if len(used):
                yield pa.record_batch(
                    [pa.array(node[used]), pa.array(linked[used]), pa.array(node[root[used]])], ["node", "links", "root"]
                )

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, _LINKS)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (``a, b``), by large-star and small-star steps."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a != b").distinct(), "star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
        edges = written(small.where("a != b").distinct(), "star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """``doc_id, class_id, copy_id, n_links, text_id`` of each row.

    ``class_id`` is the smallest id of the group joined by links, ``copy_id`` that of the documents of an
    equal set, ``n_links`` the number of other documents with a similarity of at least ``threshold``;
    ``text_id`` is a hash of the text, which tells rows of one id apart.
    """
    docs = docs.select("doc_id", "text")
    rows = written(sketches(docs, size), "join-rows")
    full = rows.where("size > 0")
    classes = full.groupBy("node", "check").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch")
    )
    classes = written(classes, "join-classes")
    least = threshold - MARGIN
    ended = buckets(classes, threshold, recall, small, depth)
    paths = ended.groupBy("node").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    paths = written(paths.join(classes.select("node", "doc_id", "copies", "sketch"), "node"), "join-paths")
    cells = _cells(ended)
    plain = cells.join(paths.select("node", "paths", "sketch"), "node")
    needed = written(_needed(plain, least), "join-needed")
    wanted = needed.select("node").distinct().join(classes.select("node", "doc_id"), "node")
    sets = written(_with_sets(docs, wanted, size), "join-sets")
    ready = cells.join(needed, ["cell", "node"]).join(paths.select("node", "paths", "copies", "sketch"), "node").join(sets, "node")
    found = written(_links(ready, threshold, least), "join-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("node", "check", "doc_id", "copies").join(links, "node", "left").join(groups, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    names = known.groupBy("root").agg(F.coalesce(F.min("doc_id"), F.first("root")).alias("class_id"))
    known = written(known.join(names, "root"), "join-known").select(
        "node",
        "check",
        "class_id",
        F.coalesce("doc_id", "node").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    linked = full.select("doc_id", "text_id", "node", "check").join(known, ["node", "check"])
    alone = rows.where("size = 0").select("doc_id", "text_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", "class_id", "copy_id", "n_links", "text_id").unionByName(alone)


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one of the smallest id stays.

    Rows without words stay; rows equal in id and text count as one.
    """
    found = written(join(docs, threshold), "join-found")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    grouped = found.where(F.col("copy_id").isNotNull() & (F.col("class_id").isNotNull()))
    kept = grouped.groupBy("class_id").agg(F.min(row).alias("kept"))
    lost = grouped.join(kept, "class_id").where(row != F.col("kept"))
    lost = lost.select(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text")).distinct()
    rest = docs.join(lost, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__text")), "left_anti")
    repeated = found.groupBy("doc_id", "text_id").count().where("count > 1")
    return rest if repeated.isEmpty() else rest.dropDuplicates(["doc_id", "text"])
