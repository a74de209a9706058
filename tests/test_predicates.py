"""Predicates and pattern translation."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyhound.fixed_values import URI_PATTERN
from keyhound.functions import predicates as p
from keyhound.functions import regex
from keyhound.functions.strings import similarity_ratio, trim_space
from keyhound.operators.match import match
from keyhound.sources.rules import read_rules


def evaluate(spark, rows, build, schema="a STRING, b STRING"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, " + schema)
    result = df.select("i", build(F.col("a"), F.col("b")).alias("r")).collect()
    return [r.r for r in sorted(result)]


def brute_ratio(a, b):
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    a, b = a.strip(spaces).lower(), b.strip(spaces).lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    return 2.0 * common / (len(a.encode()) + len(b.encode()))


def test_similarity_against_brute_force(spark):
    rng = random.Random(7)
    alphabet = "abcABC é€𝄞 1"
    rows = [
        tuple("".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in "ab")
        for _ in range(400)
    ] + [("pip password", "pip-pass"), ("secret", "docker-temp-pass"), ("same", " SAME ")]
    got = evaluate(spark, rows, similarity_ratio)
    assert got == pytest.approx([brute_ratio(a, b) for a, b in rows], abs=1e-12)
    assert got[-3] == 0.7


@pytest.mark.parametrize(
    "key,value,expected",
    [
        ("k", "", False), ("k", "null", False), ("k", "Null", True),
        ("k", "$VAR", False), ("k", "$a$b", True), ("k", "$", False),
        ("k", "a {{ b }}", False), ("k", "${x}", False), ("k", "${x} y", False),
        ("k", "$${x}", True), ("k", "$a${x}", True), ("k", "<x>", False), ("k", "<x> ", True),
        ("k", "!Ref x", False), ("pass", "my-PASS", False), ("pass", "pass ", False),
        ("pass", "pass1", True), ("", "x", True), ("  ", "x", True), ("k", " ", True),
        ("x\u3000", "ax\u2003", False),
    ],
)
def test_is_static(spark, key, value, expected):
    assert evaluate(spark, [(key, value)], p.is_static) == [expected]


def test_checks(spark):
    def values(build, *texts):
        return evaluate(spark, [("", t) for t in texts], lambda a, b: build(b))

    assert values(p.is_base64, "", "QUJD", "QUI=", "QQ==", "QQ=", "QUJ", "QU\nJD", "QU-D", "=") == [
        True, True, True, True, False, False, True, False, False,
    ]
    assert values(p.is_luhn, "0", "00", "4111 1111-1111 1111", "4111111111111112", "a0", "") == [
        False, True, True, False, False, False,
    ]
    assert values(p.is_ascii, "abc", "é", "") == [True, False, True]
    assert values(lambda t: p.has_min_length(t, 3), "é", "éa", "abc") == [False, True, True]
    assert values(lambda t: p.has_min_length(t, 0), "") == [True]
    assert values(p.is_uri, "http://x", "HTTPS:/x", "see s3://b", "http://", "http:x", "ſcp://x") == [
        True, True, True, True, False, True,
    ]
    assert values(trim_space, "\u3000a b\x85", " \t") == ["a b", ""]


def test_dialect(spark):
    def found(pattern, text, ignorecase=False):
        return evaluate(spark, [("", text)], lambda a, b: regex.search(b, pattern, ignorecase))[0]

    assert found("a.b", "a\rb") and not found("a.b", "a\nb")
    assert found("b$", "ab\n") and not found("b$", "ab\nc") and not found("b$", "ab\r")
    assert found(r"^\w$", "é") and found(r"^\d$", "٣")
    assert found("pass", "PAſS", True) and not found("pass", "PASS")
    assert found("[[]x", "[x") and found("^[a&&b]+$", "a&b")
    assert found("^file$", "file\n") and not found("^file$", "file ")
    assert found(r"^(?=.*[A-Z])(?!.*x)a", "aB") and not found(r"^(?=.*[A-Z])(?!.*x)a", "aBx")


SEARCHES = [
    ".*ab", ".*[ab]+c", "[ab]+c", "[ab]+", ".*(a|b)c$", "[a]+b|c", ".*a|b", "^a.*b$", "(?i)ab",
    "[ab]{2,}c", "[a]{1,}(b|c)", "[ab]{2,}?c", "a?b", "(ab)+c", "a(bc|b)", ".*.*a", ".*?a", "[ab]+?c",
]


def test_simplified_searches_find_the_same():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc\nA") for _ in range(rng.randrange(7))) for _ in range(3000)]
    for pattern in SEARCHES:
        simple = regex.simplify_search(pattern)
        needs = regex.needs(simple)
        for text in texts:
            hit = re.search(pattern, text) is not None
            assert (re.search(simple, text) is not None) == hit, (pattern, simple, text)
            if hit:
                assert len(text) >= needs.min_chars and needs.literal in text
                assert needs.max_chars is None or len(text) <= needs.max_chars


def test_the_linear_uri_search_finds_the_same():
    rng = random.Random(13)
    parts = ["jdbc", "JDBC", "http", "s3", "s", ":", ":", "/", "//", "x", "\n", " ", "jd", "bc"]
    simple = regex.simplify_search(URI_PATTERN)
    assert simple != URI_PATTERN
    hits = 0
    for _ in range(60_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))
        hit = re.search(URI_PATTERN, text, re.I) is not None
        hits += hit
        assert (re.search(simple, text, re.I) is not None) == hit, text
    assert 300 < hits < 59_000


def test_long_texts_take_linear_time(spark):
    rules = read_rules()
    size = 300_000
    texts = [
        "A" * size, "a1B/" * (size // 4) + "=", "-" * size + "BEGIN ", "/" * size, "1" * size,
        "jdbc" * (size // 4) + " :/", "http" * (size // 4) + " :/", "\n" * size,
    ]
    rows = [("f", k, v, "p", 0) for t in texts for k, v in [("password1", t), (t, "some value")]]
    table = spark.createDataFrame(
        rows, "file_path STRING, key STRING, value STRING, kv_path STRING, line INT"
    )
    started = time.time()
    for mode in ("first", "all"):
        match(table, rules, mode).count()
    assert time.time() - started < 60


def test_needs_of_shipped_patterns():
    def of(pattern, ignorecase=False):
        n = regex.needs(pattern, ignorecase)
        return n.min_chars, n.max_chars, n.literal

    assert of("^A(AG|CC)A[A-Z0-9]{16}$") == (20, 21, "")
    assert of(r"https://a\.b/[A-Z]{2}", True)[2] == "://"
    assert of("(?i)ab://c")[2] == "://"
    assert of("x|yz") == (1, None, "")
    assert of("(") == (0, None, "")
    assert of("[-]{3,}BEGIN (A|B)?K")[2] == "BEGIN "


# --- the dialect as Java patterns ---------------------------------------------


@st.composite
def dialect_patterns(draw, depth=2):
    """Patterns with flag groups, in syntax that the rule dialect shares with the ``regex`` library."""
    atoms = ["a", "b", "é", "É", "A", ".", "^", "$", r"\n", r"\w", r"\s", "[aé]", "[^b]", r"[\n-]", "-"]
    out = []
    for _ in range(draw(st.integers(1, 4))):
        kind = draw(st.integers(0, 9))
        if kind < 6 or depth == 0:
            atom = draw(st.sampled_from(atoms))
            out.append(atom + (draw(st.sampled_from(["", "", "?", "*", "+?", "{2}"])) if atom not in "^$" else ""))
        elif kind == 6:
            out.append(draw(st.sampled_from(["(?i)", "(?m)", "(?s)", "(?im)", "(?is)", "(?-i)", "(?s-i)", "(?ms-i)"])))
        else:
            opening = draw(st.sampled_from(["(", "(?:", "(?i:", "(?im:", "(?s-i:", "(?-m:", "(?=", "(?!", "(?>"]))
            body = draw(dialect_patterns(depth - 1))
            if draw(st.booleans()):
                body += "|" + draw(dialect_patterns(depth - 1))
            out.append(f"{opening}{body})")
    return "".join(out)


def test_random_patterns_with_flags(spark):
    """Against another engine with scoped flags and Unicode case."""
    other = pytest.importorskip("regex")
    texts = ["", "a", "é", "É", "A\n", "a\nb", "aé\nÉA\n", "\n\n", "-a-", "É\na", "ab é", "AAéé", "b\nA", "aa\n"]
    tried = []

    @given(dialect_patterns())
    @settings(max_examples=250, deadline=None, database=None, derandomize=True)
    def collect(pattern):
        tried.append(pattern)

    collect()
    patterns = sorted(set(tried))
    valid = regex.valid_patterns(spark, [(p, ic) for p in patterns for ic in (False, True)])
    assert len(valid) > 1.5 * len(patterns)
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for k in range(0, len(patterns), 40):
        part = [(p, ic) for p in patterns[k : k + 40] for ic in (False, True) if (p, ic) in valid]
        columns = [regex.search(F.col("t"), p, ic).alias(f"c{n}") for n, (p, ic) in enumerate(part)]
        for row in rows.select("t", *columns).collect():
            for n, (p, ic) in enumerate(part):
                wanted = other.search(p, row.t, other.V1 | (other.I if ic else 0)) is not None
                assert row[f"c{n}"] == wanted, (p, ic, row.t)


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("(?im)é", ["É"], ["e"]), ("(?is)é.b", ["É\nB"], ["éb"]), ("(?i:é)x", ["Éx"], ["ÉX"]),
        ("(?m)^b$", ["a\nb\nc"], ["ab"]), ("(?m)a\n^$", ["a\n"], ["a"]), ("a(?i)b|c", ["aB", "C"], ["Ab"]),
        ("(?x) a  b # note\n c", ["abc"], ["a b c"]), ("(?x:a b)c d", ["abc d"], ["abcd"]), ("(?#note)a", ["a"], ["b"]),
        ("(?n)(a)(?<x>b)\\1", ["abb"], ["aba"]), ("(?<x>a)(b)\\1\\2", ["abba"], ["abab"]),
        ("(?'x'a)\\k'x'", ["aa"], ["ab"]), ("a{,2}", ["a{,2}"], ["aa"]), ("${x}", ["\n"], []), ("\\$\\{", ["${"], ["$"]),
        ("[\\b]", ["\x08"], ["b"]), ("a\\vb", ["a\x0bb"], ["a\nb"]), ("[a-z-[aeiou]]{2}", ["xyz"], ["aeiou"]),
    ],
)
def test_dialect_cases(spark, pattern, yes, no):
    if pattern == "${x}":
        assert regex.java_pattern(pattern) == "(?d)$\\{x\\}"
        return
    assert evaluate(spark, [("", t) for t in yes + no], lambda a, b: regex.search(b, pattern)) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("pattern", ["a++", "\\h", "(", "a)", "(?(1)a)", "\\2(a)", "**", "(?z)a", "\\Qa", "(?<a-b>x)", "(?P<n>x)"])
def test_patterns_of_other_dialects_are_invalid(spark, pattern):
    assert regex.valid_patterns(spark, [(pattern, False)]) == set()
