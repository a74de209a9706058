"""Files → pairs → findings, in one pass.

Every file takes the same way: a row per file, with its name, its pieces (lines, logical shell lines, or the
document itself) and, for YAML, JSON and XML, the nodes of its tree; then a row per piece or node, and
the pairs of each.  Documents without any text their extractor needs are never cut.  Only trees go
through Python, as one more column.  Documents and files that cannot be read or parsed come out of
the same pass, marked.  The pass is narrow: a scan of a table shuffles nothing.

A file tree is listed once and each file is opened once; lines of very large files are read in ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.fixed_values import FILE_NAME_KEY, FILE_NAME_KV_PATH, MIN_FILE_BYTES
from keyhound.functions.memo import remembered
from keyhound.functions.predicates import any_of
from keyhound.functions.strings import base_name, item, let, no_items
from keyhound.operators import dispatch
from keyhound.operators.document_extractors import (
    DOCUMENT_EXTRACTORS,
    logical_line_pieces,
    piece_line,
    piece_text,
)
from keyhound.operators.line_extractors import (
    LINE_EXTRACTORS,
    LineExtractor,
    extract_lines,
    shell_items,
)
from keyhound.operators.match import Rules, findings, match
from keyhound.operators.tree import NODE_ARRAY, node_array, node_items, read_trees, tree_errors
from keyhound.session import written
from keyhound.sources import corpus
from keyhound.sources.config import ScanConfig
from keyhound.sources.corpus import RANGE_BYTES, list_corpus, load_content
from keyhound.sources.rules import read_rules
from keyhound.sources.tables import large_enough, line_array, without_carriage_return


@dataclass
class CustomExtractor:
    """A user's extractor: files in, pairs out, for names with the given extensions."""

    extract: Callable[[DataFrame], DataFrame]
    extensions: tuple[str, ...]


@dataclass
class Extractors:
    """The extractors of a scan.  ``register`` adds formats or replaces known ones."""

    custom: dict[str, CustomExtractor] = field(default_factory=dict)
    extended_dispatch: bool = False

    def register(
        self,
        name: str,
        extract: Callable[[DataFrame], DataFrame],
        extensions: Iterable[str] = (),
    ) -> Extractors:
        self.custom[name] = CustomExtractor(extract, tuple(e.lower() for e in extensions))
        return self


def route(files: DataFrame, extractors: Extractors, sniff: bool = True) -> DataFrame:
    """Add ``format``; extensions of registered extractors come first."""
    named = (dispatch.with_format if sniff else dispatch.with_name_format)(
        files, extractors.extended_dispatch
    )
    return large_enough(named.withColumn("format", _custom_format(extractors)))


def _custom_format(extractors: Extractors, known: Column | None = None) -> Column:
    ext = dispatch.effective_extension(F.substring_index(F.col("path"), "/", -1))
    fmt = F.col("format") if known is None else known
    for name, extractor in extractors.custom.items():
        if extractor.extensions:
            fmt = F.when(ext.isin(list(extractor.extensions)), F.lit(name)).otherwise(fmt)
    return fmt


@remembered
def _pieces(custom: frozenset[str]) -> Column:
    """What a document is cut into; nothing when it holds no text its extractor needs."""
    text, fmt = F.col("content").cast("string"), F.col("format")
    cut = [
        (fmt == name) & extractor.may_match(text)
        for name, extractor in LINE_EXTRACTORS.items()
        if name not in custom
    ]
    pieces = F.when(any_of(cut), line_array(text))
    for name in DOCUMENT_EXTRACTORS:
        if name not in custom:
            pieces = pieces.when(fmt == name, F.array(text))
    if "shell" not in custom:
        pieces = pieces.when(fmt == "shell", logical_line_pieces(text))
    return pieces


@remembered
def _piece_filter(custom: frozenset[str]) -> Column:
    """Lines their extractor may find something in, by a search for plain texts."""
    fmt, piece = F.col("format"), F.col("piece")
    keep = F.when(F.lit(False), F.lit(False))
    for name, extractor in LINE_EXTRACTORS.items():
        if name not in custom:
            keep = keep.when(fmt == name, extractor.may_match(piece))
    return keep.otherwise(F.lit(True))


@remembered
def _piece_items(custom: frozenset[str]) -> Column:
    """Pairs of a piece, by the extractor of its format."""
    fmt, piece = F.col("format"), F.col("piece")

    def items(text: Column) -> Column:
        chosen = F.when(fmt == "shell", shell_items(text))
        for name, extractor in LINE_EXTRACTORS.items():
            if name not in custom:
                chosen = chosen.when(fmt == name, extractor.items(text))
        for name, document_items in DOCUMENT_EXTRACTORS.items():
            if name not in custom:
                chosen = chosen.when(fmt == name, document_items(text))
        return chosen.otherwise(no_items())

    unit = (
        F.when(fmt == "shell", piece_text(piece))
        .when(fmt.isin(list(DOCUMENT_EXTRACTORS)), piece)
        .otherwise(without_carriage_return(piece))
    )
    return let(unit, items)


def _without_small(files: DataFrame, extractors: Extractors, sniff: bool = True) -> DataFrame:
    """Add ``format`` as ``route`` does; it is null for files that are not analysed, which stay for their names."""
    named = (dispatch.with_format if sniff else dispatch.with_name_format)(files, extractors.extended_dispatch)
    return named.withColumn("format", F.when(F.col("length") >= MIN_FILE_BYTES, _custom_format(extractors)))


#: Columns of a file's row besides ``path, length, content, format``: why it or its folder could not be read, and where a range begins.
_PLACE = {"error": "string", "problem": "string", "start": "bigint", "first_line": "bigint"}


def tagged(files: DataFrame, custom: frozenset[str] = frozenset(), with_names: bool = True) -> DataFrame:
    """``file_path, key, value, kv_path, line, format, failed`` of ``path, length, content, format`` rows.

    Pairs, file names included, and with ``failed`` a row for each document or file that cannot be read
    or parsed, its reason as ``value``.
    """
    for name, kind in _PLACE.items():
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    fmt, piece, node = F.col("format"), F.col("piece"), F.col("node")
    error = F.coalesce("error", "problem")
    trees = [t for t in dispatch.TREE_FORMATS if t not in custom]
    rows = files.select("path", "format", "content", *_PLACE, node_array(files, trees).alias("nodes"))

    first = F.coalesce(F.col("start") == 0, F.lit(True)) & F.col("problem").isNull() & F.lit(with_names)
    name = F.struct(
        F.lit("pair").alias("kind"),
        F.lit(FILE_NAME_KEY).alias("key"),
        base_name(F.col("path")).alias("value"),
        F.lit(FILE_NAME_KV_PATH).alias("kv_path"),
        F.lit(0).alias("line"),
    )
    unread = F.struct(
        F.lit("error").alias("kind"),
        F.lit("").alias("key"),
        error.alias("value"),
        F.lit("").alias("kv_path"),
        F.lit(0).alias("line"),
    )
    none = F.array().cast(NODE_ARRAY)
    own = F.concat(
        F.when(first, F.array(name)).otherwise(none),
        F.when(error.isNotNull(), F.array(unread)).otherwise(none),
        F.coalesce("nodes", none),
    )
    # Place 0 stands for the file itself, with its nodes; the pieces follow.
    pieces = F.concat(F.array(F.lit("")), F.coalesce(_pieces(custom), F.array().cast("array<string>")))
    cut = rows.select(
        F.col("path").alias("file_path"),
        "format",
        F.coalesce("first_line", F.lit(0)).alias("first_line"),
        own.alias("nodes"),
        F.posexplode(pieces).alias("pos", "piece"),
    ).filter((F.col("pos") == 0) | _piece_filter(custom))
    nodes = F.when(F.col("pos") == 0, F.col("nodes")).otherwise(F.array(F.lit(None).cast(NODE_ARRAY[6:-1])))
    units = cut.select("file_path", "format", "first_line", "pos", "piece", F.explode(nodes).alias("node"))

    failed = F.coalesce(node["kind"] == "error", F.lit(False))
    items = (
        F.when(failed, F.array(item(F.lit(""), node["value"], "")))
        .when(F.col("pos") == 0, node_items("node"))
        .otherwise(_piece_items(custom))
    )
    line = (
        F.when(F.col("pos") == 0, node["line"])
        .when(fmt == "shell", piece_line(piece))
        .when(fmt.isin(list(DOCUMENT_EXTRACTORS)), F.lit(0))
        .otherwise((F.col("pos") + F.col("first_line")).cast("int"))
    )
    return units.select("file_path", "format", line.alias("line"), failed.alias("failed"), F.inline(items)).select(
        "file_path", "key", "value", "kv_path", "line", "format", "failed"
    )


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("failed")).drop("format", "failed")


def _failures(rows: DataFrame) -> DataFrame:
    return rows.filter("failed").select("file_path", "format", F.col("value").alias("message"))


def _custom_kv(routed: DataFrame, extractors: Extractors) -> DataFrame | None:
    """Pairs of registered extractors, which take and give DataFrames and so read their files themselves."""
    found = None
    for name, extractor in extractors.custom.items():
        own = extractor.extract(routed.filter(F.col("format") == name))
        own = own.select("file_path", "key", "value", "kv_path", "line")
        found = own if found is None else found.unionByName(own)
    return found


def extract(files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """Pairs of ``path, length, content`` rows, file names included."""
    extractors = extractors or Extractors()
    kv = _pairs(tagged(_without_small(files, extractors), frozenset(extractors.custom)))
    own = _custom_kv(route(files, extractors), extractors)
    return kv if own is None else kv.unionByName(own)


def parse_errors(files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """``file_path, format, message`` of the documents a scan has to skip."""
    extractors = extractors or Extractors()
    return tree_errors(read_trees(route(files, extractors)))


def file_errors(loaded: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """The same of ``path, length, content, error`` rows, as ``load_files`` gives them."""
    extractors = extractors or Extractors()
    routed = _without_small(loaded, extractors)
    return _failures(tagged(routed, frozenset([*extractors.custom, *LINE_EXTRACTORS, *DOCUMENT_EXTRACTORS, "shell"]), False))


def scan(
    files: DataFrame,
    rules: Rules | None = None,
    config: ScanConfig | None = None,
    mode: str = "first",
    extractors: Extractors | None = None,
) -> DataFrame:
    """Findings of ``path, length, content`` rows; batch and streaming alike."""
    rules = read_rules() if rules is None else rules
    return findings(match(extract(files, extractors), rules, mode, config))


def _corpus_rows(
    spark: SparkSession, root: str, config: ScanConfig, extractors: Extractors, streaming: bool, range_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Tagged rows of a file tree, and its files of registered formats.

    A batch writes its listing once.  Files of line formats above ``range_bytes`` become ranges, if there are any.
    """
    custom = frozenset(extractors.custom)
    listing = list_corpus(spark, root, config.exclude_files, streaming, with_problems=True)
    named = _without_small(listing, extractors, sniff=False)
    parts = named = named if streaming else written(named, "listing")
    if not streaming:
        ranged = [n for n in [*LINE_EXTRACTORS] if n not in custom]
        large = F.coalesce(F.col("format").isin(ranged) & (F.col("length") > range_bytes), F.lit(False))
        if not named.filter(large).isEmpty():
            sniffed = [dispatch.CONFIG_LIKE] if dispatch.CONFIG_LIKE in ranged else []
            cut = written(corpus.line_ranges(named.filter(large), root, range_bytes, sniffed), "line-ranges")
            parts = named.filter(~large).unionByName(cut, allowMissingColumns=True)
    wanted = F.col("format").isNotNull() & ~F.col("format").isin(list(custom)) if custom else F.col("format").isNotNull()
    loaded = corpus.load_parts(parts, root, wanted)
    whole = F.col("start").isNull() if "start" in loaded.columns else F.lit(True)
    sniffed = F.when(whole, dispatch.sniff_xml(F.col("format"), F.col("content"))).otherwise(F.col("format"))
    return tagged(loaded.withColumn("format", sniffed), custom), named.filter(F.col("format").isin(list(custom)))


def scan_corpus(
    spark: SparkSession,
    root: str,
    rules: Rules | None = None,
    config: ScanConfig | None = None,
    mode: str = "first",
    extractors: Extractors | None = None,
    streaming: bool = False,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Findings of a file tree.  It is listed once, and only files with an extractor are opened, once each."""
    config, extractors = config or ScanConfig(), extractors or Extractors()
    rules = read_rules(config.rules) if rules is None else rules
    rows, own = _corpus_rows(spark, root, config, extractors, streaming, range_bytes)
    kv = _pairs(rows)
    if extractors.custom:
        loaded = load_content(own, root).withColumn("format", _custom_format(extractors, F.lit(None).cast("string")))
        kv = kv.unionByName(_custom_kv(loaded, extractors))
    return findings(match(kv, rules, mode, config))


def scan_corpus_outputs(
    spark: SparkSession,
    root: str,
    rules: Rules | None = None,
    config: ScanConfig | None = None,
    mode: str = "first",
    extractors: Extractors | None = None,
    range_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Findings, and ``file_path, format, message`` of folders, files and documents that could not be read or parsed.

    Both come from one run over the tree: its matches and failures are written to one table, and read from there.
    """
    config, extractors = config or ScanConfig(), extractors or Extractors()
    rules = read_rules(config.rules) if rules is None else rules
    rows, own = _corpus_rows(spark, root, config, extractors, False, range_bytes)
    out = written(match(rows, rules, mode, config, "failed", ["format"]), "outputs")
    hits = findings(out.filter(~F.col("failed")))
    if extractors.custom:
        loaded = load_content(own, root).withColumn("format", _custom_format(extractors, F.lit(None).cast("string")))
        hits = hits.unionByName(findings(match(_custom_kv(loaded, extractors), rules, mode, config)))
    return hits, _failures(out)


def corpus_errors(
    spark: SparkSession,
    root: str,
    config: ScanConfig | None = None,
    extractors: Extractors | None = None,
) -> DataFrame:
    """``file_path, format, message`` of folders, files and documents that a scan of a tree has to skip."""
    config, extractors = config or ScanConfig(), extractors or Extractors()
    return _failures(_corpus_rows(spark, root, config, extractors, False, RANGE_BYTES)[0])


def line_scan(
    lines: DataFrame,
    extractor: LineExtractor,
    rules: Rules | None = None,
    config: ScanConfig | None = None,
    mode: str = "first",
) -> DataFrame:
    """Findings of a ``path, line, text`` table under one line extractor."""
    rules = read_rules() if rules is None else rules
    return findings(match(extract_lines(lines, extractor), rules, mode, config))
