"""How far the sources of a language diverge: exact term counts by sorting pointers into the text buffers.

Each task takes its texts as Arrow buffers, in slices of ``SLICE_BYTES`` of whole documents.  In a slice it
builds a pointer to every start of a term and sorts them by the bytes they point at with a multikey
quicksort whose characters are eight bytes wide: all pointers are sorted by the first character, then the
runs that are still equal and go on by the next one, and so forth.  Pointers keep the order of the text
inside a run of equal terms, so a run gives the term's occurrences and documents in each (lang, source).  Spark adds
these counts up over all slices.

Terms are maximal stretches of ASCII letters and bytes above 127, A-Z lower-cased.  A language keeps the
terms of at least ``least`` of its documents.  A group (a language's source, or the whole language) gives a
kept term ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``.  The divergence of two groups is the sum over kept
terms of ``floor((p - q)^2 / (p + q))``.  All numbers are whole.

Divergences of all pairs of sources are summed in tiles: at most ``TILE`` sources against as many, over one
block of the language's terms at a time, so no task holds a language or a term's sources whole.  Terms that
neither tile has count by a closed form.  The number of pairs is that of the result.

Defined cases: null text, lang and source are empty; every row is a document of its own, repeated ones and
ties included (ranks follow the item's bytes then); a source without terms keeps all its pairs; languages without kept
terms have value 0 for all pairs and no term rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyhound.llm import flat
from keyhound.session import written

UNIT = 1_000_000_000
SLICE_BYTES = 4 << 20
TILE = 128
#: Counts (of a term in a source) that a block of terms holds in about.
BLOCK_ROWS = 100_000
#: Cells of sources and terms that are in hand at once, and rows of group tables that are sent to all tasks.
CELLS = 1 << 20
MAX_BROADCAST = 100_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_WIDTH = 8


# --- pointers -----------------------------------------------------------------


def _character(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as one number; zeros stand beyond the term's end.

    ``data`` has eight bytes to spare at its end.  Terms hold no zero byte, so the order is that of bytes.
    """
    windows = np.lib.stride_tricks.sliding_window_view(data, _WIDTH)[at]
    wide = np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)
    cut = np.clip(_WIDTH - left, 0, _WIDTH).astype(np.uint64) * np.uint64(8)
    return np.where(cut < 64, wide >> (cut & np.uint64(63)) << (cut & np.uint64(63)), np.uint64(0))


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, and for each place whether a new term begins there.

    Equal terms keep the order of the pointers.
    """
    n = len(starts)
    padded = np.concatenate([data, np.zeros(_WIDTH, np.uint8)])
    order = np.arange(n)
    fresh = np.zeros(n, bool)
    places, run, depth = np.arange(n), np.zeros(n, np.int64), 0  # places still to be sorted, in runs equal so far
    while len(places):
        at = order[places]
        begin = starts[at] + depth
        left = ends[at] - begin
        character, on = _character(padded, begin, left), left > _WIDTH
        # A term that ends with this character comes before longer ones.
        by = np.lexsort((on, character, run) if depth else (on, character))
        order[places] = at[by]
        character, on, run = character[by], on[by], run[by]
        new = np.ones(len(by), bool)
        new[1:] = (character[1:] != character[:-1]) | (on[1:] != on[:-1]) | (run[1:] != run[:-1])
        fresh[places[new]] = True
        number = np.cumsum(new) - 1
        go_on = on & (np.bincount(number)[number] > 1)
        run, places, depth = number[go_on], places[go_on], depth + _WIDTH
    return order, fresh


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``SLICE_BYTES`` of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        texts = batch.column("text")
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for k, length in enumerate(lengths.tolist()):
            size += length
            if size >= SLICE_BYTES:
                yield pa.Table.from_batches([*held, batch.slice(begin, k + 1 - begin)]).combine_chunks().to_batches()[0]
                held, size, begin = [], 0, k + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, starts, values = texts.buffers()
    offsets = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of documents with numbered groups: group, term, occurrences and documents with the term, for each group and term."""
    lower = flat.LOWER[data]
    starts, ends = flat.runs(_LETTER[data], offsets)
    order, fresh = sort_pointers(lower, starts, ends)
    doc = (np.searchsorted(offsets, starts, "right") - 1)[order]
    # Inside a term, a document's pointers are together: the order of the text is kept.
    new_doc = np.ones(len(order), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | fresh[1:]
    code = (np.cumsum(fresh) - 1) * (int(group.max(initial=0)) + 1) + group[doc]
    found, place, n = np.unique(code, return_index=True, return_counts=True)
    docs = np.bincount(np.searchsorted(found, code[new_doc]), minlength=len(found))
    first = order[place]
    lengths = ends[first] - starts[first]
    stops = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts[first] - stops[:-1], lengths) + np.arange(stops[-1])
    buffers = [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(lower[at])]
    return group[doc[place]], pa.Array.from_buffers(pa.large_binary(), len(first), buffers).cast(pa.binary()), n, docs


def _count_long(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Term and occurrences of one long document, a stretch at a time; stretches end between terms."""
    found: list[pa.Table] = []
    begin = 0
    while begin < len(data):
        end = min(begin + SLICE_BYTES, len(data))
        while end < len(data) and _LETTER[data[end]]:
            end += 1
        _, terms, n, _ = count_terms(data[begin:end], np.array([0, end - begin]), np.zeros(1, np.int64))
        found.append(pa.table({"term": terms, "n": n}))
        if len(found) == 8:
            found = [_added(found)]
        begin = end
    added = _added(found)
    return added["term"].combine_chunks(), added["n"].to_numpy()


def _added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")])
    return sums.rename_columns({"n_sum": "n"})


def count_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of a slice: occurrences, and documents with the term."""
    data, offsets = _buffer(batch.column("text"))
    langs, sources, group = _groups(batch)
    if batch.num_rows == 1 and len(data) > 2 * SLICE_BYTES:
        terms, n = _count_long(data)
        owner, docs = np.zeros(len(terms), np.int64), np.ones(len(terms), np.int64)
    else:
        owner, terms, n, docs = count_terms(data, offsets, group)
    owner = pa.array(owner)
    columns = [langs.take(owner), sources.take(owner), terms, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))]
    return pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])


def _groups(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Lang and source of the groups of a batch, and each row's group."""
    lang, source = (batch.column(c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("lang", "source"))
    _, first, group = np.unique(lang * (int(source.max(initial=0)) + 1) + source, return_index=True, return_inverse=True)
    return batch.column("lang").take(pa.array(first)), batch.column("source").take(pa.array(first)), group


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield count_slice(batch)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*named, F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- divergence ---------------------------------------------------------------


def _share(n: str, total: str) -> Column:
    """``1 + floor(UNIT (n + 2) / (total + 2 V))``, exact at any size; the terms of a language are in ``V``."""
    over = f"cast(greatest({total} + 2 * V, 1) as decimal(20, 0))"
    return F.expr(f"1 + (cast({n} + 2 as decimal(20, 0)) * {UNIT}BD) div {over}")


DIVERGENCE = "((p - q) * (p - q)) div (p + q)"


def _fitting(df: DataFrame) -> DataFrame:
    """A hint to send a table of groups to all tasks, if it has few rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _tile_sums(table: pa.Table) -> pa.Table:
    """Sums over a block's terms for the pairs of two tiles' sources.  Rows without a term introduce the sources."""
    introduced = table.filter(pc.is_null(table["term"])).sort_by("number")
    rows = table.filter(pc.is_valid(table["term"]))
    numbers, base = (introduced[c].to_numpy() for c in ("number", "p0"))
    tile = introduced["tile"].to_numpy()
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
    coded = rows["term"].combine_chunks().dictionary_encode()
    width = len(coded.dictionary)
    column = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.searchsorted(numbers, rows["number"].to_numpy())
    values = rows["p"].to_numpy()
    by = np.argsort(column, kind="stable")
    column, owner, values = column[by], owner[by], values[by]
    sums = np.zeros((len(left), len(right)), np.int64)
    step = max(1, CELLS // max(len(numbers), 1))
    for begin in range(0, width, step):
        end = min(begin + step, width)
        part = slice(*np.searchsorted(column, [begin, end]))
        cells = np.repeat(base[:, None], end - begin, 1)
        cells[owner[part], column[part] - begin] = values[part]
        others = cells[right]
        for k, a in enumerate(left):
            off = others - cells[a]
            sums[k] += (off * off // (others + cells[a])).sum(1)
    a, b = np.nonzero(np.ones_like(sums, bool) if lo != hi else np.triu(np.ones_like(sums, bool), 1))
    first, second = pa.array(left[a]), pa.array(right[b])
    n = len(a)
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()] * n, pa.string()),
            "one": introduced["source"].take(first),
            "other": introduced["source"].take(second),
            "p": introduced["p0"].take(first),
            "q": introduced["p0"].take(second),
            "V": introduced["V"].take(first),
            "part_sum": pa.array(sums[a, b]),
            "terms": pa.array(np.full(n, width, np.int64)),
        }
    )


def _pairs(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for all ordered pairs of a language's sources."""
    size = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    layout = sources.join(_fitting(size), "lang", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    order = Window.partitionBy("lang")
    layout = (
        layout.withColumn("number", F.row_number().over(order.orderBy("source")) - 1)
        .withColumn("tiles", F.ceil(F.count(F.lit(1)).over(order) / TILE).cast("int"))
        .withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
        .withColumn("p0", _share("0", "total"))
    )
    layout = written(layout.select("lang", "source", "number", "tile", "tiles", "blocks", "p0", "V"), "sources")
    shared = ["lang", "source", "number", "tile", "tiles", "block", "p0", "V"]
    heads = layout.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.select(*shared, F.lit(None).cast("binary").alias("term"), F.lit(None).cast("long").alias("p"))
    cells = rows.select("lang", "source", "term", "p").join(_fitting(layout), ["lang", "source"])
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select(*shared, "term", "p")
    dealt = heads.unionByName(cells).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("lo", F.least("tile", "with")).withColumn("hi", F.greatest("tile", "with"))
    sums = dealt.drop("tiles", "with").groupBy("lang", "lo", "hi", "block").applyInArrow(
        _tile_sums, "lang string, one string, other string, p long, q long, V long, part_sum long, terms long"
    )
    total = sums.groupBy("lang", "one", "other", "p", "q", "V").agg(F.sum("part_sum").alias("part_sum"), F.sum("terms").alias("terms"))
    value = F.expr(f"part_sum + (V - terms) * ({DIVERGENCE})").alias("value")
    both = F.inline(
        F.array(
            F.struct(F.col("one").alias("source"), F.col("other").alias("item")),
            F.struct(F.col("other").alias("source"), F.col("one").alias("item")),
        )
    )
    return total.select("lang", "one", "other", value).select("lang", both, "value")


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: a row for each ordered pair of sources of a language
    (part ``pair``), and for the ``top`` terms that a source has more often than its language (part ``term``)."""
    found = written(counts(docs), "term-counts")
    terms = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = written(terms.where(F.col("docs") >= least).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("lang_n").alias("lang_total"))
    rows = found.drop("docs").join(kept, ["lang", "term"])
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sources = docs.select(*named).distinct().join(totals, ["lang", "source"], "left").join(_fitting(langs), "lang", "left")
    sources = written(sources.na.fill(0, ["total", "V", "lang_total"]), "groups")
    shares = written(
        rows.join(_fitting(sources), ["lang", "source"])
        .withColumn("p", _share("n", "total"))
        .withColumn("q", _share("lang_n", "lang_total"))
        .select("lang", "source", "term", "p", "q"),
        "shares",
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value).cast("int").alias("rank")
    own = shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), F.expr(DIVERGENCE).alias("value"))
    best = own.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    pairs = _pairs(shares, sources).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.unionByName(best)


def oracle(least: int = 10, top: int = 10, table: str = "documents") -> str:
    """The same in SQL, with every kept term given to every source."""
    share = f"1 + CAST({UNIT} AS HUGEINT) * ({{n}} + 2) // ({{total}} + 2 * V)"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM {table}),
terms AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM terms GROUP BY ALL HAVING sum(docs) >= {least}),
langs AS (SELECT lang, count(*) AS V, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM sources JOIN kept USING (lang) LEFT JOIN terms USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, {share.format(n="n", total="total")} AS p, {share.format(n="lang_n", total="lang_total")} AS q
  FROM dense JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
own AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', item, value FROM own)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {top}
"""
