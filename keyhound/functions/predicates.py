"""Predicates over the key and value of a pair.  Each returns a boolean Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyhound.fixed_values import DEFAULT_SIMILARITY_LIMIT, UNICODE_SPACES, URI_PATTERN
from keyhound.functions import regex
from keyhound.functions.strings import similarity_ratio, starts_with, trim_space

_BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False)) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def is_excluded(
    key: Column,
    value: Column,
    kv_path: Column,
    keys: Sequence[str] = (),
    values: Sequence[str] = (),
    paths: Sequence[str] = (),
) -> Column:
    """True when an exclusion pattern (always case-insensitive) hits; empty text never does."""
    hits = []
    for text, patterns in ((kv_path, paths), (key, keys), (value, values)):
        if patterns:
            hits.append((text != "") & any_of([regex.search(text, p, True) for p in patterns]))
    return any_of(hits)


def is_literal(value: Column) -> Column:
    """False for an empty, templated or placeholder value."""
    return ~any_of(
        [
            value.isin("", "null"),
            starts_with(value, "$") & ~F.contains(F.substr(value, F.lit(2)), F.lit("$")),
            F.contains(value, F.lit("{{")) & F.contains(value, F.lit("}}")),
            starts_with(value, "${") & F.endswith(value, F.lit("}")),
            starts_with(value, "<") & F.endswith(value, F.lit(">")),
            starts_with(value, "!"),
        ]
    )


def is_named_after_key(key: Column, value: Column) -> Column:
    """True when a value ends with its key; both in lower case, without outer blanks."""
    return (key != "") & F.endswith(value, key)


def is_static(key: Column, value: Column) -> Column:
    """True for a hard-coded value, false for an empty, templated or self-named one."""
    # A suffix test needs no trimming on the left.
    name, text = F.lower(trim_space(key)), F.lower(F.rtrim(value, F.lit(UNICODE_SPACES)))
    return is_literal(value) & ~is_named_after_key(name, text)


def has_min_length(text: Column, min_bytes: int) -> Column:
    """Length is counted in bytes; 0 or less switches the test off."""
    return F.octet_length(text) >= min_bytes if min_bytes > 0 else F.lit(True)


def is_base64(text: Column) -> Column:
    """Strict standard Base64 with padding; line breaks are ignored."""
    return F.translate(text, "\r\n", "").rlike(_BASE64)


def is_uri(text: Column) -> Column:
    return regex.search(text, URI_PATTERN, True)


def is_uri_ascii(text: Column) -> Column:
    """The same test with the ASCII character classes that extractors use."""
    return F.contains(text, F.lit(":/")) & text.rlike(
        "(?diu)" + regex.simplify_search(URI_PATTERN)
    )


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def is_luhn(text: Column) -> Column:
    """Check-digit test over the digits left after blanks and dashes are removed."""
    digits = F.translate(text, " -", "")
    return (F.octet_length(digits) >= 2) & F.call_function("luhn_check", digits)


def similarity_limit(similar: float | None) -> float:
    return similar or DEFAULT_SIMILARITY_LIMIT


def passes_similarity(key: Column, value: Column, similar: float | None = None) -> Column:
    """False when key and value resemble each other at or above the limit."""
    return similarity_ratio(key, value) < similarity_limit(similar)
