"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed and combined to hashes of ``GRAM`` words; of the hashes in each window of ``span`` words
the smallest is kept.  Equal windows keep equal hashes, so every shared stretch of ``span`` words shares a
kept hash: test and training fingerprints are joined on it, and a hit is extended to its whole window,
whose words are compared.  Items shorter than ``span`` words form one window each; there are fewer than
``span`` such lengths, and each is looked up with fingerprints of its own length.

A table of item windows of at most ``BROADCAST_WINDOWS`` rows is broadcast and document words never move;
a larger one is joined by shuffling the fingerprints with their windows (skewed keys are split by the
adaptive join).  What is shuffled afterwards are hits, keyed by document.

Defined cases: null texts and texts without words have no words and no hits; items without words never
occur; a null item id counts as an item whose id is empty in the list; repeated rows give a result row
each, ids may repeat with other texts; empty tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.session import written

SPAN = 10
GRAM = 5
BROADCAST_WINDOWS = 400_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _beside(name: str, step: int, join: Callable[[Column, Column], Column], other: str | None = None) -> Column:
    """``join`` of each element of ``name`` and the one ``step`` later in ``other``; shorter by ``step``."""
    other = other or name
    size = F.greatest(F.size(other) - step, F.lit(0))
    return F.zip_with(F.slice(name, 1, size), F.slice(other, step + 1, size), join)


def _doubling(df: DataFrame, start: str, out: str, width: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Column ``out``: ``join`` over each ``width`` neighbours of ``start``, by doubling and adding up."""
    level, size, done, have = start, 1, None, 0
    while size <= width:
        if width & size:
            if done is None:
                done, have = level, size
            else:
                name = f"__{out}_{have + size}"
                df = df.withColumn(name, _beside(done, have, join, level))
                done, have = name, have + size
        size *= 2
        if size <= width:
            name = f"__{out}_twice{size}"
            df = df.withColumn(name, _beside(level, size // 2, join))
            level = name
    return df.withColumn(out, F.col(done))


def _fingerprints(df: DataFrame, span: int, gram: int) -> DataFrame:
    """Column ``kept``: for each window of ``span`` words of column ``words`` the smallest hash in it."""
    df = df.withColumn("__one", F.transform("words", lambda x: F.xxhash64(x)))
    df = _doubling(df, "__one", "__gram", gram, lambda a, b: F.xxhash64(a, b))
    df = _doubling(df, "__gram", "kept", span - gram + 1, lambda a, b: F.least(a, b))
    return df.drop(*(x for x in df.columns if x.startswith("__")))


def _item_windows(items: DataFrame, span: int, gram: int) -> DataFrame:
    """``kept, window, item`` of all windows of ``span`` words, each once."""
    # The plain function would have the optimizer write a filter on all of the hashing's expressions.
    found = _fingerprints(items, span, gram).select("item", "words", F.posexplode_outer("kept").alias("at", "kept"))
    return found.where("at IS NOT NULL").select("kept", F.slice("words", F.col("at") + 1, span).alias("window"), "item").distinct()


def _hits(docs: DataFrame, windows: DataFrame, span: int, gram: int, marker: bool, small: bool) -> DataFrame:
    """A row per document window and item that has it; with ``marker`` one more per document."""
    kept = F.concat(F.array(F.lit(None).cast("long")), "kept")
    rows = _fingerprints(docs, span, gram).select("doc_id", "text_id", "words", F.posexplode(kept).alias("at", "kept"))
    here = F.slice("words", F.greatest("at", F.lit(1)), span)
    n_words = F.when(F.col("at") == 0, F.size("words")).alias("n_words")
    windows = windows.select(F.col("kept").alias("key"), "window", "item")
    if small:
        rows, windows = rows.select("doc_id", "text_id", "at", "kept", "words", n_words), F.broadcast(windows)
    else:
        rows, here = rows.select("doc_id", "text_id", "at", "kept", here.alias("here"), n_words), F.col("here")
    # The join is on the hash alone; words are cut out and compared for the rows that meet.
    joined = rows.join(windows, F.col("kept") == F.col("key"), "left" if marker else "inner")
    found = joined.where((F.col("at") == 0) | (here == F.col("window")) if marker else (F.col("at") > 0) & (here == F.col("window")))
    span_of = F.when(F.col("window").isNotNull(), F.struct(F.col("at").alias("at"), F.lit(span).alias("n")))
    return found.select("doc_id", "text_id", "n_words", span_of.alias("hit"), F.when(F.col("window").isNotNull(), F.col("item")).alias("item"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, text_id, n_words, hits, items`` per row of ``docs``.

    ``hits`` are the sorted windows (first word from 1, number of words), ``items`` the ids as sorted
    strings; ``text_id`` is a hash that tells rows of one ``doc_id`` apart.
    """
    source = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), words_of(F.col("text")).alias("words"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    items = written(items.where(F.size("words") > 0), "benchmark-words")
    lengths = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    found = None
    for length in [span, *lengths]:
        part = items.where(F.size("words") >= span if length == span else F.size("words") == length)
        windows = written(_item_windows(part, length, gram if length == span else length), "benchmark-windows")
        small = windows.count() <= broadcast_windows
        more = _hits(source, windows, length, gram if length == span else length, length == span, small)
        found = more if found is None else found.unionByName(more)
    grouped = found.groupBy("doc_id", "text_id").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("marks"),
        F.collect_set("hit").alias("hits"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    # The key of a marker is null and never joins, so there is one for each repeated row.
    rows = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("marks").cast("int"))))
    return rows.select("doc_id", "text_id", "n_words", F.sort_array("hits").alias("hits"), "items")


def hit_words(hits: Column) -> Column:
    """Number of words covered by sorted windows."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["n"])
        return F.struct(end.alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["at"]), F.lit(0))).alias("n"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` that share no window with an item of ``benchmark``."""
    hit = contamination(docs, benchmark, span).where(F.size("hits") > 0).select(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"))
    text_id = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit.distinct(), docs["doc_id"].eqNullSafe(F.col("__doc")) & (text_id == F.col("__text")), "left_anti")
