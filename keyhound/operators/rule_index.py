"""Matching against very many rules, by a join instead of an expression for each rule.

Most patterns hold a plain text that every match must contain.  Such a text offers all its stretches of the
largest of the lengths ``GRAMS`` that fits, and the rule is listed under the one fewest rules share, so that rules which
differ in some place of their texts rarely share one, however many there are.  A pair offers those stretches of its
key and value that a filter of the stretches in use lets pass, few beyond the ones in use, so an equality join finds the rules it may
match, and their tests run with the rule's fields as columns.  Rules without such a text are candidates of every pair.  They and the
rules with the shortest texts are sent to all tasks and tested before pairs are shuffled.  The plan does not grow with the number of rules.

The rule table is a DataFrame and stays one: patterns are read in tasks, and Java says there which it accepts.

Letters are compared in lower case, and the few signs beyond ASCII that have ASCII letters for case
variants are replaced first, so patterns that ignore case are listed too.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyhound.functions import regex
from keyhound.functions.predicates import (
    is_ascii,
    is_base64,
    is_luhn,
    is_static,
    is_uri,
    similarity_limit,
)
from keyhound.functions.strings import similarity_ratio
from keyhound.operators import stretches
from keyhound.schemas import KV_COLUMNS
from keyhound.session import spread, written
from keyhound.sources.rules import MatchConfig, Rule

log = logging.getLogger(__name__)

GRAMS = stretches.SIZES
#: Rules (and their index rows, one each) that are sent to all tasks, those with the shortest texts first, since most pairs meet these;
#: the others are joined by a shuffle.
MAX_BROADCAST_RULES = 200_000
#: Words of 64 bits of the filter of the stretches in use, which is sent to all tasks so that few others are shuffled.  A word serves two
#: or three stretches; above that the filter grows no more and lets more others pass.
MAX_BROADCAST_STRETCHES = 1 << 22
#: In a shuffle, rules without a text that are too many to be sent are met by so many shares of the pairs.
OPEN_SHARES = 64
#: Numbers of stretches that are told apart when rules are dealt to tasks or to the shuffle.
MAX_NUMBER = 100
#: Invalid patterns that are logged one by one.
MAX_LOGGED = 20
_ANY = "*"
_SIDES = ("key", "value")
_FIELDS = ("rule_order", "rule_id", "description", "message", "severity")


def _stretches(side: str, pattern: str | None, ignorecase: bool | None) -> set[str]:
    """The stretches of all texts a pattern requires, led by the side it tests."""
    found = set()
    for text in regex.required_texts(pattern, bool(ignorecase)) if pattern else ():
        size = max((n for n in GRAMS if n <= len(text)), default=None)
        if size:
            found.update(side[0] + text[i : i + size] for i in range(len(text) - size + 1))
    return found


def index_grams(rules: list[tuple[int, Rule]]) -> dict[int, str]:
    """What ``listed_rules`` chooses, for a list of rules: the stretch of each, led by its side; ``*`` where no text is required."""
    offered: dict[int, set[str]] = {}
    for order, rule in rules:
        configs = [(side, getattr(rule, side) or MatchConfig()) for side in _SIDES]
        offered[order] = {gram for side, c in configs for gram in _stretches(side, c.regex, c.ignorecase)}
    frequency = Counter(gram for grams in offered.values() for gram in grams)
    return {order: min(grams, key=lambda g: (frequency[g], g)) if grams else _ANY for order, grams in offered.items()}


def numbered(rules: DataFrame) -> DataFrame:
    """A rule table whose ``rule_order`` is the place of each rule, from 0; it is sorted in ranges."""
    place = F.monotonically_increasing_id().alias("place")
    rows = written(rules.repartitionByRange("rule_order").sortWithinPartitions("rule_order").select("*", place), "ordered-rules")
    rows = rows.withColumn("range", F.shiftright("place", 33))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("range").agg(F.count(F.lit(1)).alias("rules"))  # a row per range
    first = ranges.select("range", F.coalesce(F.sum("rules").over(before), F.lit(0)).alias("first"))
    order = (F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
    return rows.join(F.broadcast(first), "range").withColumn("rule_order", order).drop("range", "place", "first")


def _read_pattern(side: str, pattern: str | None, ignorecase: bool | None) -> tuple[str | None, list[str]]:
    """A pattern as Java has it, or nothing, and its stretches."""
    if not pattern:
        return None, []
    try:
        return regex.java_search(pattern, bool(ignorecase)), sorted(_stretches(side, pattern, ignorecase))
    except Exception:  # not in the dialect, or nested too deep: the rule never matches
        return None, []


def read_patterns(rules: DataFrame) -> DataFrame:
    """The rules whose patterns are valid, with the tests of both sides and all their stretches."""

    read_pattern = F.udf(_read_pattern, "STRUCT<pattern: STRING, stretches: ARRAY<STRING>>")

    def read(side: str) -> Column:
        return read_pattern(F.lit(side), F.col(side)["regex"], F.col(side)["ignorecase"]).alias(f"{side}_read")

    def tests(side: str) -> Column:
        c = F.col(side)
        flags = [F.coalesce(c[f"is_{name}"], F.lit(False)).alias(name) for name in ("base64", "uri", "luhn", "ascii")]
        pattern = F.col(f"{side}_read")["pattern"].alias("pattern")
        return F.struct(pattern, F.coalesce(c["minlen"], F.lit(0)).alias("minlen"), *flags).alias(f"{side}_tests")

    def valid(side: str) -> Column:
        compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(f"{side}_read")["pattern"])
        return (F.coalesce(F.col(side)["regex"], F.lit("")) == "") | compiled.isNotNull()

    limit = F.when(F.coalesce("similar", F.lit(0.0)) == 0, similarity_limit(None)).otherwise(F.col("similar"))
    texts = [F.coalesce(n, F.lit("")).alias(n) for n in ("description", "message", "severity")]
    patterns = F.concat_ws(" ", *(F.col(side)["regex"] for side in _SIDES)).alias("patterns")
    rows = spread(rules).select("*", *map(read, _SIDES)).select(
        "rule_order", "rule_id", *texts, limit.alias("similar"), *map(tests, _SIDES), patterns,
        F.concat(*(F.col(f"{side}_read")["stretches"] for side in _SIDES)).alias("stretches"),
        (valid("key") & valid("value")).alias("valid"),
    )
    kept = written(rows, "read-rules")
    for row in kept.filter(~F.col("valid")).select("patterns").limit(MAX_LOGGED).collect():
        log.warning("pattern ignored, it does not compile: %s", row.patterns)
    return kept.filter("valid").drop("valid", "patterns")


def listed_rules(rules: DataFrame) -> DataFrame:
    """The valid rules, and the ``stretch`` each is listed under, led by its side; ``*`` where no text is required."""
    rows = read_patterns(rules)
    offers = rows.select("rule_order", F.explode("stretches").alias("stretch"))
    shared = offers.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("stretch", F.struct("n", "stretch")).alias("stretch")
    chosen = offers.join(shared, "stretch").groupBy("rule_order").agg(rarest)
    stretch = F.coalesce("stretch", F.lit(_ANY)).alias("stretch")
    kept = [c for c in rows.columns if c != "stretches"]
    number = F.least(F.size("stretches"), F.lit(MAX_NUMBER)).alias("number")
    return written(rows.select(*kept, number).join(chosen, "rule_order", "left").select(*kept, "number", stretch), "rules")


def folded(text: Column) -> Column:
    """Lower case; i, s and k also for the letters beyond ASCII that match them without regard to case."""
    return F.lower(F.translate(text, "İıſK", "iisk"))


def stretch_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """The filter of about ``count`` different hashes, put together in tasks; its size is bounded, whatever their number."""
    size = 1
    while size * 3 < count and size * 2 <= MAX_BROADCAST_STRETCHES:
        size *= 2
    value = F.col("hash")
    place = F.shiftrightunsigned(value, 65 - size.bit_length()) if size > 1 else F.lit(0).cast("long")
    # ``shiftleft`` takes a shift that is a column only in SQL.
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {6 * k}) & 63 AS INT))" for k in range(4))
    rows = hashes.select(place.alias("place"), F.expr(bits).alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("word")).toArrow()
    words = np.zeros(size, np.int64)
    words[rows["place"].to_numpy()] = rows["word"].to_numpy()
    return words.view(np.uint64)


def offered_hashes(pairs: DataFrame, sizes: Sequence[int], words: np.ndarray) -> Column:
    """Hashes of the stretches of key and value under which rules may be listed, each once."""
    sent = pairs.sparkSession.sparkContext.broadcast(words)

    def offered(key: pa.Array, value: pa.Array) -> pa.Array:
        return stretches.offered({"k": key, "v": value}, sizes, sent.value)

    return F.arrow_udf(offered, "array<bigint>")(folded(F.col("key")), folded(F.col("value")))


def open_hash(share: Column) -> Column:
    """What rules without a text are met by, in a share of the pairs."""
    return F.xxhash64(F.lit(_ANY), share)


def _with_hash(listed: DataFrame, shares: int) -> DataFrame:
    """Rules with the ``hash`` of what they are listed under; those without a text are met in each share."""
    own = F.arrow_udf(stretches.listed_hashes, "bigint")("stretch").alias("own")
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")), open_hash)
    hashes = F.when(F.col("stretch") == _ANY, places).otherwise(F.array("own"))
    rows = listed.select("*", own).select("*", F.explode(hashes).alias("hash"))
    size = (F.char_length("stretch") - 1).alias("size")
    return rows.select("hash", size, "number", *_FIELDS, "similar", *(f"{side}_tests" for side in _SIDES))


def _fits(side: str) -> Column:
    """The tests of a side, as the rule's columns say."""
    text, tests = F.col(side), F.col(f"{side}_tests")
    return (
        (F.octet_length(text) >= tests["minlen"])
        & (~tests["ascii"] | is_ascii(text))
        & (tests["pattern"].isNull() | F.rlike(text, tests["pattern"]))
        & (~tests["base64"] | is_base64(text))
        & (~tests["uri"] | is_uri(text))
        & (~tests["luhn"] | F.coalesce(is_luhn(text), F.lit(False)))
    )


def _fitting() -> Column:
    """All tests of a candidate."""
    return _fits("key") & _fits("value") & (similarity_ratio(F.col("key"), F.col("value")) < F.col("similar"))


def match_indexed(kv: DataFrame, rules: DataFrame, mode: str = "first") -> DataFrame:
    """What ``match`` gives for a rule table whose ``rule_order`` differs from rule to rule."""
    listed = listed_rules(rules)
    size = (F.char_length("stretch") - 1).alias("size")
    counts = listed.groupBy(size, "number").count().orderBy("size", "number").collect()  # a row per length and number, at most
    sizes = sorted({row["size"] for row in counts} - {0})
    total, without = sum(row["count"] for row in counts), sum(row["count"] for row in counts if not row["size"])
    last, room = (-1, 0), MAX_BROADCAST_RULES
    for row in counts:
        room -= row["count"]
        if room < 0:
            break
        last = (row["size"], row["number"])
    few, shares = room >= 0, 1 if without <= MAX_BROADCAST_RULES else OPEN_SHARES
    pairs = kv.filter(is_static(F.col("key"), F.col("value"))).withColumn("pair", F.monotonically_increasing_id())
    hashed = _with_hash(listed, shares)
    used = hashed.filter("size > 0").select("hash")
    own = offered_hashes(pairs, sizes, stretch_filter(used, total - without)) if sizes else F.array().cast("array<bigint>")
    met = [F.array(open_hash(F.pmod("pair", F.lit(shares))))] if without else []
    offered = pairs.select("*", own.alias("hashes")).select("*", F.explode(F.concat("hashes", *met)).alias("hash")).drop("hashes")
    if few or shares > 1:
        found = offered.join(F.broadcast(hashed) if few else hashed, "hash").filter(_fitting())
    else:
        is_sent = F.struct("size", "number") <= F.struct(F.lit(last[0]), F.lit(last[1]))
        found = _found_by_shuffle(offered, hashed.filter(is_sent), hashed.filter(~is_sent))
    if mode == "first":
        row = F.min_by(F.struct(*KV_COLUMNS, *_FIELDS), "rule_order").alias("row")
        return found.groupBy("pair").agg(row).select("row.*")
    return found.select(*KV_COLUMNS, *_FIELDS)


def _found_by_shuffle(offered: DataFrame, sent: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs with the rules they match, of which ``sent`` are tested where the pairs are and ``others`` after a shuffle."""
    pair = [*KV_COLUMNS, "pair"]
    # Hashes of both kinds of rules have a row without a rule, for the shuffle.
    both = sent.select("hash").distinct().join(others.select("hash"), "hash", "left_semi")
    tested = offered.join(F.broadcast(sent.unionByName(both, allowMissingColumns=True)), "hash", "left")
    done = F.col("rule_order").isNotNull()
    rows = tested.filter(~done | _fitting()).select(
        # Pairs that are done go along, each to a place of its own.
        *pair, F.when(done, F.xxhash64("pair", "rule_order")).otherwise(F.col("hash")).alias("place"),
        F.when(done, F.struct(*_FIELDS)).alias("sent"),
    )
    joined = rows.join(others, F.col("sent").isNull() & (F.col("place") == F.col("hash")), "left")
    kept = joined.filter(F.col("sent").isNotNull() | (done & _fitting()))
    return kept.select(*pair, F.inline(F.array(F.coalesce("sent", F.struct(*_FIELDS)))))
