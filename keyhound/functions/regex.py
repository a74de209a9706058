"""Rule patterns as Java patterns.

Rules are written in a .NET-like dialect and tested as an unanchored search.
``java_pattern`` sets the flags under which Java agrees with that dialect;
``search`` builds the boolean Column and removes work a search does not need.
"""

from __future__ import annotations

import logging
import re
import warnings
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from keyhound.fixed_values import URI_PATTERN

try:
    from re import _parser
except ImportError:  # other Python versions: patterns run without guards
    _parser = None

log = logging.getLogger(__name__)

_LITERAL_ANCHORED = re.compile(r"\^([A-Za-z0-9_ ]+)\$")
# `^` and `$` may stand at any line of the text: its length says nothing about a match.
_MULTILINE = re.compile(r"\(\?[a-zA-Z]*m")
_UNICODE_CLASS = re.compile(r"\\[wWdDsSbBpP]|\[:")
_LEADING_RUN = re.compile(r"(\[(?:[^\[\]\\]|\\.)+\])(?:\+|(\{\d+),\})(?![+?])")
# The same searches without backtracking over long runs.  A text that is found from one
# `jdbc` is also found from the last `jdbc` of its run, so a run is left at the next one.
_LINEAR_FORMS = {
    URI_PATTERN: r"(?:http|ftp|smtp|scp|ssh|s3)s?:/.|jdbc(?:(?!jdbc)[:\w])*+(?<=:)/.",
}


def escape_class_syntax(pattern: str) -> str:
    """Escape ``[`` and ``&&`` inside a character class: Java reads them as set operators."""
    out, in_class, class_start, i = [], False, -1, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if not in_class and char == "[":
            in_class, class_start = True, i
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                class_start = i - 1
                continue
        elif in_class and char == "]" and i > class_start + 1:
            in_class = False
        elif in_class and (char == "[" or (char == "&" and pattern[i + 1 : i + 2] == "&")):
            out.append("\\")
        out.append(char)
        i += 1
    return "".join(out)


def subtract_classes(pattern: str) -> str:
    """``[a-z-[aeiou]]``, a class less another one, as ``(?:(?![aeiou])[a-z])``."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "[":
            text, i = _class_at(pattern, i)
        else:
            text = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
            i += len(text)
        out.append(text)
    return "".join(out)


def _class_at(pattern: str, start: int) -> tuple[str, int]:
    """The class that opens at ``start``, without subtraction, and the place after it."""
    first = start + (2 if pattern.startswith("^", start + 1) else 1)
    i = first
    while i < len(pattern):
        if pattern[i] == "]" and i > first:
            return pattern[start : i + 1], i + 1
        if i > first and pattern.startswith("-[", i) and not pattern.startswith("-[:", i):
            less, end = _class_at(pattern, i + 1)
            if pattern.startswith("]", end):
                return f"(?:(?!{less}){pattern[start:i]}])", end + 1
        i += 2 if pattern[i] == "\\" else 1
    return pattern[start:], len(pattern)


class PatternError(ValueError):
    """The rule dialect, or Java, has no such pattern."""


@dataclass(frozen=True)
class _Group:
    """``(…)``: what opens it in Java, its name or number if it captures, and the sequences it chooses from."""

    opening: str
    name: str | int | None
    choices: tuple


@dataclass(frozen=True)
class _Back:
    """A reference to what a group has matched."""

    name: str | int


_FLAGS = "imnsx"
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??")
_INLINE = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])")
_NAMED = re.compile(r"\(\?(?:<([^\W\d]\w*|[1-9]\d*)>|'([^\W\d]\w*|[1-9]\d*)')")
_NAMED_BACK = re.compile(r"\\k(?:<(\w+)>|'(\w+)')")
_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c[@-_a-z]|[pP]\{\^?\w+\}|0[0-7]{0,2}|[wWdDsSbBAZzGtnrfaev]|[^A-Za-z0-9_])")
_CLASS_ESCAPES = {"\\b": "\\x08", "\\v": "\\x0B"}


class _Parser:
    """A pattern as a tree: sequences of Java text, groups and references.

    ``m``, ``n`` and ``x`` are worked out here; ``i`` (with Unicode case) and ``s`` become flags of Java with the
    same scope.  Named groups are numbered after the others, as the dialect does.
    """

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.plain, self.named = 0, []
        self.tree = self.choices(frozenset())
        if self.at < len(pattern):
            raise PatternError("unbalanced )")

    def choices(self, flags: frozenset) -> tuple:
        """Sequences up to a closing bracket or the end.  Flags set on the way hold for the following ones too."""
        found, sequence = [], []
        while self.at < len(self.pattern) and self.pattern[self.at] != ")":
            if self.pattern[self.at] == "|":
                self.at += 1
                found.append(tuple(sequence))
                sequence = []
            else:
                flags = self.step(sequence, flags)
        return (*found, tuple(sequence))

    def step(self, sequence: list, flags: frozenset) -> frozenset:
        pattern, char = self.pattern, self.pattern[self.at]
        if "x" in flags and (char in " \t\n\r\f\v" or char == "#"):
            end = pattern.find("\n", self.at) if char == "#" else self.at
            self.at = len(pattern) if end < 0 else end + 1
            return flags
        if pattern.startswith("(?#", self.at):
            end = pattern.find(")", self.at)
            if end < 0:
                raise PatternError("unterminated comment")
            self.at = end + 1
            return flags
        if char == "(":
            return self.group(sequence, flags)
        quantifier = _QUANTIFIER.match(pattern, self.at)
        if quantifier:
            if not sequence or sequence[-1] in _UNREPEATABLE:
                raise PatternError("nothing to repeat")
            self.at = quantifier.end()
            sequence += [quantifier[0], _REPEATED]
            return flags
        sequence.append(self.single(char, flags))
        return flags

    def single(self, char: str, flags: frozenset) -> str | _Back:
        pattern = self.pattern
        if char == "[":
            text, self.at = _class_at(pattern, self.at)
            return escape_class_syntax(_class_escapes(text))
        if char != "\\":
            self.at += 1
            if "m" in flags and char in "^$":
                return "(?:\\A|(?<=\\n))" if char == "^" else "(?=\\n|\\z)"
            return "\\" + char if char in "{}" else char
        named = _NAMED_BACK.match(pattern, self.at)
        number = re.compile(r"\\([1-9]\d*)").match(pattern, self.at)
        if named or number:
            self.at = (named or number).end()
            name = named[1] or named[2] if named else number[1]
            return _Back(int(name) if name.isdigit() else name)
        escape = _ESCAPE.match(pattern, self.at)
        if not escape:
            raise PatternError("unknown escape")
        self.at = escape.end()
        return {"\\v": "\\x0B", "\\0": "\\x00"}.get(escape[0], escape[0])

    def group(self, sequence: list, flags: frozenset) -> frozenset:
        pattern = self.pattern
        inline, named = _INLINE.match(pattern, self.at), _NAMED.match(pattern, self.at)
        inner, name = flags, None
        if inline:
            on, off = frozenset(inline[1].lower()), frozenset((inline[2] or "").lower())
            if not (on | off) <= frozenset(_FLAGS):
                raise PatternError("unknown flag")
            inner = (flags | on) - off
            opening = "(?" + _java_flags(on - off, off) + inline[3]
            self.at = inline.end()
            if inline[3] == ")":
                if opening != "(?)":
                    sequence += [opening, _FLAG]
                return inner
        elif named:
            opening, name = "(", named[1] or named[2]
            name = int(name) if name.isdigit() else name
            self.at = named.end()
            if name not in self.named:
                self.named.append(name)
        else:
            special = next((x for x in ("(?=", "(?!", "(?<=", "(?<!", "(?>") if pattern.startswith(x, self.at)), None)
            if special is None and pattern.startswith("(?", self.at):
                raise PatternError("unknown group")
            opening = special or ("(?:" if "n" in flags else "(")
            self.at += len(special or "(")
            if opening == "(":
                self.plain += 1
                name = self.plain
        choices = self.choices(inner)
        if self.at >= len(pattern):
            raise PatternError("unbalanced (")
        self.at += 1
        sequence.append(_Group(opening, name, choices))
        return flags


#: Stands behind a quantifier, and behind flags: neither can be repeated.
_REPEATED, _FLAG = "", "(?:)"
_UNREPEATABLE = (_REPEATED, _FLAG)


def _java_flags(on: frozenset, off: frozenset) -> str:
    def known(flags: frozenset) -> str:
        return ("iu" if "i" in flags else "") + ("s" if "s" in flags else "")

    return known(on) + ("-" + known(off) if known(off) else "")


def _class_escapes(text: str) -> str:
    return re.sub(r"\\.", lambda m: _CLASS_ESCAPES.get(m[0], m[0]), text, flags=re.DOTALL)


def translated(pattern: str) -> str:
    """A pattern of the rule dialect as text for Java, flags with their scope."""
    parser = _Parser(pattern)
    order: list = []

    def collect(choices: tuple) -> None:
        for item in (x for sequence in choices for x in sequence):
            if isinstance(item, _Group):
                if item.name is not None:
                    order.append(("named" if item.opening == "(" and item.name in parser.named else "plain", item.name))
                collect(item.choices)

    collect(parser.tree)
    places: dict = {}
    for place, (kind, name) in enumerate(order, 1):
        if kind == "named" and name in places:
            raise PatternError("a name for two groups")
        # Names of one number share it; without names a number is the group's own.
        places[name] = place
    for k, name in enumerate((n for n in parser.named if isinstance(n, str)), parser.plain + 1):
        places.setdefault(k, places[name])

    def shown(choices: tuple) -> str:
        return "|".join("".join(map(item_text, sequence)) for sequence in choices)

    def item_text(item) -> str:
        if isinstance(item, _Back):
            if item.name not in places:
                raise PatternError("reference to no group")
            return f"(?:\\{places[item.name]})"
        if isinstance(item, _Group):
            return f"{item.opening}{shown(item.choices)})"
        return item

    return shown(parser.tree)


def simplify_search(pattern: str) -> str:
    """Drop leading repetition, which never changes whether a search succeeds.

    ``.*X`` finds something exactly when ``X`` does, ``[c]+X`` exactly when ``[c]X``
    does, and ``[c]{3,}X`` exactly when ``[c]{3}X`` does.  The longer forms are quadratic
    on long texts in a backtracking engine.
    """
    known = _LINEAR_FORMS.get(pattern.removeprefix("(?i)"))
    if known is not None:
        return "(?i)" + known if pattern.startswith("(?i)") else known
    while pattern.startswith(".*") and pattern[2:3] not in ("+", "?", ""):
        pattern = pattern[2:]
    if "|" not in _outside_groups(pattern):
        head = _LEADING_RUN.match(pattern)
        if head:
            count = head.group(2) + "}" if head.group(2) else ""
            pattern = head.group(1) + count + pattern[head.end() :]
    return pattern


def _outside_groups(pattern: str) -> str:
    """The characters of ``pattern`` that sit in no group, class or escape."""
    out, depth, in_class, i = [], 0, False, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 2
            continue
        if in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif depth == 0:
            out.append(char)
        i += 1
    return "".join(out)


def java_pattern(pattern: str, ignorecase: bool = False) -> str:
    """``(?d)`` makes ``.`` and ``$`` know only ``\\n``; ``U`` makes ``\\w \\d \\s`` Unicode."""
    flags = "diu" if ignorecase else "d"
    if _UNICODE_CLASS.search(pattern):
        flags += "U"
    return f"(?{flags})" + translated(pattern)


def java_search(pattern: str, ignorecase: bool = False) -> str:
    """A Java pattern that is found in the same texts, without work that a search does not need."""
    known = _LINEAR_FORMS.get(pattern.removeprefix("(?i)"))
    if known is None:
        return java_pattern(simplify_search(pattern), ignorecase)
    return ("(?diuU)" if ignorecase or pattern.startswith("(?i)") else "(?dU)") + known  # Java's already


@dataclass(frozen=True)
class Needs:
    """What every text a pattern matches must have; used to skip the pattern cheaply."""

    min_chars: int = 0
    max_chars: int | None = None
    literal: str = ""

    def guards(self, text: Column) -> list[Column]:
        """Conditions in bytes: a character takes one to four of them."""
        tests = []
        if self.min_chars > 1:
            tests.append(F.octet_length(text) >= self.min_chars)
        if self.max_chars is not None:
            tests.append(F.octet_length(text) <= 4 * self.max_chars)
        if self.literal:
            tests.append(F.contains(text, F.lit(self.literal)))
        return tests


def needs(pattern: str, ignorecase: bool = False) -> Needs:
    """Length limits and a plain text that follow from the pattern; nothing when unsure."""
    tree = _parsed(pattern)
    if tree is None:
        return Needs()
    low, high = tree.getwidth()
    ops = list(tree)
    anchored = (
        len(ops) > 1
        and str(ops[0][0]) == str(ops[-1][0]) == "AT"
        and str(ops[0][1]).startswith("AT_BEGINNING")
        and str(ops[-1][1]).startswith("AT_END")
    )
    runs = _literal_runs(ops, _may_ignore_case(pattern, ignorecase))
    literal = max(runs, key=len, default="")
    return Needs(
        min_chars=min(low, 10_000),
        # `$` also matches before one final line feed.
        max_chars=high + 1 if anchored and high < 10_000 and not _MULTILINE.search(pattern) else None,
        literal=literal if len(literal) > 1 else "",
    )


def _parsed(pattern: str):
    """The pattern as Python's parser sees it, where both dialects agree; else nothing."""
    if _parser is None or "{," in pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # notes on syntax of later versions
            return _parser.parse(subtract_classes(pattern))
    except (re.error, OverflowError, RecursionError):
        return None


def _may_ignore_case(pattern: str, ignorecase: bool) -> bool:
    return ignorecase or "(?" in pattern.replace("(?:", "").replace("(?=", "").replace("(?!", "")


def required_texts(pattern: str, ignorecase: bool = False) -> list[str]:
    """ASCII texts in lower case that the folded form of every matching text contains."""
    tree = _parsed(pattern)
    if tree is None:
        return []
    found = []
    for run in _literal_runs(list(tree), False):
        found += re.findall(r"[\x00-\x7f]+", run)
    return [x.lower() for x in found]


def _literal_runs(ops: list, caseless: bool) -> list[str]:
    """Plain texts that must appear, in order.  Caseless patterns offer uncased characters only."""
    runs, run = [], ""
    for op, argument in ops:
        name = str(op)
        char = chr(argument) if name == "LITERAL" else ""
        if char and not (caseless and char.lower() != char.upper()):
            run += char
            continue
        runs.append(run)
        run = ""
        if name == "SUBPATTERN":
            runs += _literal_runs(list(argument[-1]), caseless)
        elif name == "MAX_REPEAT" and argument[0] > 0:
            runs += _literal_runs(list(argument[2]), caseless)
    return [*runs, run]


def search_tests(text: Column, pattern: str, ignorecase: bool = False) -> list[Column]:
    """Conditions that together mean ``pattern`` matches in ``text``: cheap ones first."""
    literal = _LITERAL_ANCHORED.fullmatch(pattern)
    if literal and not ignorecase:
        # `$` also matches before one final line feed.
        return [text.isin(literal.group(1), literal.group(1) + "\n")]
    return [*needs(pattern, ignorecase).guards(text), text.rlike(java_search(pattern, ignorecase))]


def search(text: Column, pattern: str, ignorecase: bool = False) -> Column:
    """True where ``pattern`` matches anywhere in ``text``."""
    return reduce(and_, search_tests(text, pattern, ignorecase))


def is_valid(spark: SparkSession, pattern: str, ignorecase: bool = False) -> bool:
    """True when Java accepts the pattern; checked on the driver, before any task runs."""
    try:
        candidate = java_search(pattern, ignorecase)
        spark.sql("SELECT 1").select(F.lit("").rlike(candidate)).collect()
    except Exception as error:  # the message carries the pattern, never scanned text
        log.warning("pattern ignored, it does not compile: %s (%s)", pattern, type(error).__name__)
        return False
    return True


_known: dict[tuple[str, bool], bool] = {}
_PROBED = 500  # patterns that one probe tries


def valid_patterns(spark: SparkSession, patterns: list[tuple[str, bool]]) -> set[tuple[str, bool]]:
    """The patterns Java accepts.  One probe covers all new ones in the usual case."""
    unknown = [p for p in dict.fromkeys(patterns) if p not in _known]
    for start in range(0, len(unknown), _PROBED):
        new = unknown[start : start + _PROBED]
        try:
            probe = [
                F.lit("").rlike(java_search(p, ic)).alias(f"p{i}")
                for i, (p, ic) in enumerate(new)
            ]
            spark.sql("SELECT 1").select(*probe).collect()
            _known.update(dict.fromkeys(new, True))
        except Exception:
            _known.update({(p, ic): is_valid(spark, p, ic) for p, ic in new})
    return {p for p in patterns if _known[p]}
