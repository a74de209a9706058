"""Text helpers that stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyhound.fixed_values import UNICODE_SPACES

EMPTY_ITEMS_SQL = "CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING, kv_path: STRING>>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` alone strips blanks only)."""
    return F.btrim(text, F.lit(UNICODE_SPACES))


def starts_with(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def before(text: Column, mark: str) -> Column:
    """Everything before the first ``mark`` (the whole text when there is none)."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """Everything after the first ``mark``; call only where ``mark`` is present."""
    return F.substr(text, F.instr(text, mark) + F.lit(len(mark)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def item(key: Column, value: Column, kv_path: Column | str) -> Column:
    """One extracted pair, shaped like ``schemas.KV_ITEM``."""
    where = F.lit(kv_path) if isinstance(kv_path, str) else kv_path
    return F.struct(key.alias("key"), value.alias("value"), where.alias("kv_path"))


def no_items() -> Column:
    return F.expr(EMPTY_ITEMS_SQL)


def items_when(condition: Column, *items: Column) -> Column:
    """An array holding ``items`` when ``condition`` is true, else an empty array."""
    return F.when(condition, F.array(*items)).otherwise(no_items())


def lowered_pair(a: Column, b: Column) -> Column:
    """Both texts trimmed and in lower case, as similarity compares them."""
    return F.struct(F.lower(trim_space(a)).alias("left"), F.lower(trim_space(b)).alias("right"))


def ratio_bound(pair: Column) -> Column:
    """The most the ratio of a lowered pair can be: all of the shorter text is common."""
    left, right = pair["left"], pair["right"]
    shorter = F.least(F.char_length(left), F.char_length(right))
    return F.when(shorter == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * shorter / (F.octet_length(left) + F.octet_length(right))
    )


def ratio_of(pair: Column) -> Column:
    """``2 * |common characters| / (bytes of left + bytes of right)`` of a lowered pair.

    Common characters are counted as a multiset.  Equal texts give 1 and an empty
    text gives 0.  Only the distinct characters of ``left`` are walked, so the shorter
    text (the key) comes first.
    """
    left, right = pair["left"], pair["right"]

    def occurrences(text: Column, char: Column) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, char, F.lit("")))

    common = F.aggregate(
        F.array_distinct(F.split(left, "")),
        F.lit(0),
        lambda total, char: total
        + F.when((char == "") | ~F.contains(right, char), 0).otherwise(
            F.least(occurrences(left, char), occurrences(right, char))
        ),
    )
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(left == right, F.lit(1.0))
        .otherwise(F.lit(2.0) * common / (F.octet_length(left) + F.octet_length(right)))
    )


def similarity_ratio(a: Column, b: Column) -> Column:
    """How much two texts have in common, from 0 to 1; see ``ratio_of``."""
    return let(lowered_pair(a, b), ratio_of)
