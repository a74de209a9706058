"""Findings with the lines around them, review prompts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhound.fixed_values import (
    CONTEXT_MESSAGE_BLOCK,
    CONTEXT_MESSAGE_SINGLE,
    CONTEXT_RADIUS,
    FALSE_POSITIVE_MARK,
    REVIEW_PROMPT,
    VERDICT_FALSE_POSITIVE,
    VERDICT_TRUE_POSITIVE,
)
from keyhound.session import written

# A chunk of lines is hot when it holds this many findings and more than one in HOT_SHARE of all:
# by that definition there are never more than HOT_SHARE hot chunks.
HOT_FINDINGS = 10_000
HOT_SHARE = 1_000
SALTS = 64
# Windows per chunk of lines.  Lines near the ends of a chunk are in its neighbour too, so
# a line is shuffled 1 + 1 / WINDOWS times on average.
WINDOWS = 4
# Up to this many files with findings, their paths are sent to every task so that lines
# of other files are dropped before the shuffle.
MAX_BROADCAST_PATHS = 200_000


def _chunk(line: Column, width: int) -> Column:
    return F.floor((line - 1) / width).cast("int")


def _width(radius: int) -> int:
    return WINDOWS * (2 * radius + 1)


def line_chunks(lines: DataFrame, width: int, margin: int = 0) -> DataFrame:
    """``FilePath, chunk, rows``: ``width`` neighbouring lines each and ``margin`` more on both sides, in order."""
    line = F.col("line")
    first, last = _chunk(F.greatest(line - margin, F.lit(1)), width), _chunk(line + margin, width)
    placed = lines.filter(line >= 1).select(
        F.col("path").alias("FilePath"), F.explode(F.sequence(first, last)).alias("chunk"), "line", "text"
    )
    return placed.groupBy("FilePath", "chunk").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))


def _in_chunks(targets: DataFrame, radius: int) -> DataFrame:
    """Targets with the ``chunk`` that holds their window; null without a line."""
    number = F.col("LineNumber")
    place = F.when(number.isNotNull(), _chunk(F.greatest(number, F.lit(1)), _width(radius)))
    return targets.withColumn("chunk", place)


def _window(radius: int) -> Column:
    """The shown lines of a target, cut out of the ``rows`` of its chunk."""
    number = F.col("LineNumber")

    def shown(row: Column) -> Column:
        mark = row["line"] == number
        start = F.concat(row["line"].cast("string"), F.when(mark, F.lit(": >>> ")).otherwise(F.lit(": ")))
        return F.concat(start, row["text"], F.when(mark, F.lit(" <<<\n")).otherwise(F.lit("\n")))

    inside = F.filter("rows", lambda row: row["line"].between(number - radius, number + radius))
    return F.transform(inside, shown)


def _framed(targets: DataFrame, chunks: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """All targets, with ``context_block`` and ``context_lines``; nulls where no line is shown."""
    kept = [c for c in targets.columns if c not in keys or c == "FilePath"]
    found = targets.join(chunks, keys, "left").select(*kept, F.array(_window(radius)).alias("windows"))
    # Unfolding computes a window once; it is used twice.
    window = F.col("window")
    return found.select(*kept, F.explode("windows").alias("window")).select(
        *kept,
        F.when(F.size(window) > 0, F.array_join(window, "")).alias("context_block"),
        F.when(F.size(window) > 0, F.size(window)).alias("context_lines"),
    )


def context_blocks(targets: DataFrame, lines: DataFrame, radius: int) -> DataFrame:
    """``FilePath, LineNumber, context_block, context_lines`` for distinct target lines.

    Lines are put together to chunks of some windows, each with the lines around it that a window
    of its own lines may reach.  A target joins its one chunk by equality on (path, chunk), which spreads even a
    single huge file, and cuts its lines out of it.  Lines are shuffled about once, whatever the radius, and
    blocks never.
    """
    places = _in_chunks(targets.select("FilePath", "LineNumber"), radius)
    chunks = line_chunks(lines, _width(radius), radius)
    framed = _framed(places, chunks, radius, ["FilePath", "chunk"])
    return framed.filter(F.col("context_lines").isNotNull())


def with_context(findings: DataFrame, lines: DataFrame, level: int = 2) -> DataFrame:
    """Add ``context_block``, ``context_lines`` and ``context_msg`` to findings.

    Levels 2, 3 and 4 show 5, 20 and 50 lines on both sides; level 1, or a file without
    such lines, shows the finding's own content.  A finding on line 0 gets the first
    lines and no marker.  Findings go to their lines, and blocks stay where they are built.
    Chunks with very many findings are salted.  Findings are written once, since
    chunks to look for and the result start from them.
    """
    radius = CONTEXT_RADIUS.get(level, 0)
    if radius == 0:
        return findings.select(
            "*",
            F.col("Content").alias("context_block"),
            F.lit(0).alias("context_lines"),
            F.lit(CONTEXT_MESSAGE_SINGLE).alias("context_msg"),
        )
    columns, keys = findings.columns, ["FilePath", "chunk"]
    findings = _in_chunks(written(findings, "findings"), radius)
    chunks = line_chunks(lines_of(lines, findings.select("FilePath")), _width(radius), radius)

    total = findings.count()
    counted = findings.filter("chunk IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counted.filter((F.col("n") >= HOT_FINDINGS) & (F.col("n") * HOT_SHARE > total)).drop("n")
    if total < HOT_FINDINGS or hot.isEmpty():
        framed = _framed(findings, chunks, radius, keys)
    else:
        hot = F.broadcast(written(hot, "hot-chunks"))
        salt = F.pmod(F.xxhash64("Content", "RuleID"), F.lit(SALTS)).cast("int").alias("salt")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        spread = findings.join(hot, keys, "left_semi").select("*", salt)
        copies = chunks.join(hot, keys, "left_semi").select("*", salts)
        framed = _framed(findings.join(hot, keys, "left_anti"), chunks, radius, keys).unionByName(
            _framed(spread, copies, radius, [*keys, "salt"])
        )
    found = F.col("context_block").isNotNull()
    return framed.select(
        *columns,
        F.coalesce("context_block", "Content").alias("context_block"),
        F.coalesce("context_lines", F.lit(0)).alias("context_lines"),
        F.when(found, context_message(level, F.col("context_lines")))
        .otherwise(F.lit(CONTEXT_MESSAGE_SINGLE))
        .alias("context_msg"),
    )


def lines_of(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Lines of the given files only.

    The number of files is checked first: few paths are broadcast, so that lines of
    other files never reach the shuffle; many are left to the join that follows.
    """
    distinct = paths.distinct()
    if distinct.limit(MAX_BROADCAST_PATHS + 1).count() > MAX_BROADCAST_PATHS:
        return lines
    wanted = distinct.withColumnRenamed("FilePath", "path")
    return lines.join(F.broadcast(wanted), "path", "left_semi")


def context_message(level: int, line_count: Column) -> Column:
    """How much context a review gets, as shown to the reviewer."""
    return F.format_string(CONTEXT_MESSAGE_BLOCK, F.lit(level), line_count)


def with_prompt(df: DataFrame) -> DataFrame:
    """Add ``prompt``: the review request built from a finding and its context."""
    return df.withColumn(
        "prompt",
        F.format_string(
            REVIEW_PROMPT, "FilePath", "RuleID", "LineNumber", "context_msg", "context_block"
        ),
    )


def verdict(reply: Column) -> Column:
    """The verdict a reply states."""
    return F.when(
        F.contains(reply, F.lit(FALSE_POSITIVE_MARK)), F.lit(VERDICT_FALSE_POSITIVE)
    ).otherwise(F.lit(VERDICT_TRUE_POSITIVE))


def parse_context(df: DataFrame) -> DataFrame:
    """One row per line of ``context_block``: ``line``, ``text`` and ``is_target``."""
    pattern = r"(?d)\A\s*(\d+): (.*)\z"
    keep = [c for c in df.columns if c != "context_block"]
    number = F.regexp_extract("raw", pattern, 1)
    return (
        df.select(*keep, F.explode(F.split("context_block", "\n")).alias("raw"))
        .filter(number != "")
        .select(
            *keep,
            number.cast("int").alias("line"),
            F.regexp_extract("raw", pattern, 2).alias("text"),
            (number.cast("int") == F.col("LineNumber")).alias("is_target"),
        )
    )
