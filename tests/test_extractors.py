"""Extractors against brute force and on hard lines."""

import random
import re
import time

import pytest
from conftest import pairs
from pyspark.sql import functions as F

from keyhound.functions.uri import uri_items
from keyhound.operators import line_extractors as le
from keyhound.operators.document_extractors import (
    dockercfg_items,
    extract_documents,
    extract_shell,
    html_items,
    shell_lines,
)
from keyhound.operators.line_extractors import LINE_EXTRACTORS, extract_lines
from keyhound.sources.tables import to_lines

QUOTED, OPEN = r"""['"]([^'"]+)['"]""", r"""['"]([^'"]*)['"]"""
# The patterns as a free search writes them.
PLAIN = {
    "go": rf"([a-zA-Z_]\w*)\s*(?::=|=)\s*{QUOTED}",
    "java": rf"(?:[a-zA-Z_]\w*\s+)+([a-zA-Z_]\w*)\s*=\s*{QUOTED}",
    "js": rf"(?:const|let|var)\s+([a-zA-Z_]\w*)\s*=\s*{QUOTED}",
}
KEYWORD = rf"([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*{OPEN}"
ASSIGN = rf"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*{OPEN}"
CALL = r"([a-zA-Z_][a-zA-Z0-9._]*)\s*\("
PHP = rf"(?:(?:\$([a-zA-Z_]\w*))|(?:{QUOTED}\s*=>))\s*=\s*{QUOTED}"


def random_lines(alphabet, count=1500, size=14, seed=5):
    rng = random.Random(seed)
    return [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, size))) for _ in range(count)
    ]


def line_table(spark, texts):
    return spark.createDataFrame(
        [("f", i, t) for i, t in enumerate(texts)], "path STRING, line INT, text STRING"
    )


WORDS = ["a", "b1", "_", "1", "9x", " ", "  ", "=", ":=", "=", '"', "'", '"v"', "'w'", "let ",
         "int ", "é", ".", "(", "$", "=>", "\t"]


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_first_assignment_against_a_free_search(spark, name):
    texts = random_lines(WORDS)
    expected = []
    for i, text in enumerate(texts):
        hit = re.search(PLAIN[name], text, re.ASCII)
        if hit:
            expected.append((i, hit.group(1), hit.group(2)))
    got = extract_lines(line_table(spark, texts), LINE_EXTRACTORS[name])
    assert pairs(got, "line", "key", "value") == sorted(expected)
    assert expected


def test_php_assignment_against_a_free_search(spark):
    texts = random_lines(WORDS)
    expected = []
    for i, text in enumerate(texts):
        hit = re.search(PHP, text, re.ASCII)
        if hit:
            expected.append((i, hit.group(1) or hit.group(2), hit.group(3)))
    got = extract_lines(line_table(spark, texts), le.php_assign_items)
    assert pairs(got, "line", "key", "value") == sorted(expected)


def test_python_against_free_searches(spark):
    texts = random_lines(WORDS)
    expected = []
    for i, text in enumerate(texts):
        hit = re.search(ASSIGN, text, re.ASCII)
        if hit:
            expected.append((i, *hit.groups(), "assignment"))
        elif "=" in text:
            expected += [(i, *g, "keyword") for g in re.findall(KEYWORD, text, re.ASCII)]
        expected += [(i, "function", n + "()", "call") for n in re.findall(CALL, text, re.ASCII)]
    got = extract_lines(line_table(spark, texts), LINE_EXTRACTORS["python"])
    kept = got.filter("kv_path IN ('assignment', 'keyword', 'call')")
    assert pairs(kept, "line", "key", "value", "kv_path") == sorted(expected)


def brute_shell(text):
    """Logical lines, one physical line after the other."""
    out, held = [], ""
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip(" \t\r")
        if not line:
            continue
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        out.append((number, held + line))
        held = ""
    return out


def test_shell_lines_against_brute_force(spark, files):
    rng = random.Random(11)
    parts = ["a", "1", "12", "\\", "\\", "\n", "\n", "\n", " ", "\t", "=", "\r\n", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    got = shell_lines(files({str(i): t for i, t in enumerate(texts)}))
    expected = [(str(i), n, t) for i, text in enumerate(texts) for n, t in brute_shell(text)]
    assert pairs(got, "path", "line", "text") == sorted(expected)


def test_shell_pairs(files):
    text = (
        "export FOO=x\n# A=1\nA =  \nB=1 \\\n\n  2\ncurl -u 'me:pw' h\ncurl --user me:p w\n"
        "CURL -U a:b:c\ncurl -u nobody\nno curl here -u a\nC=\\\n"
    )
    assert pairs(extract_shell(files({"f": text}))) == sorted(
        [
            ("export FOO", "x", "shell", 1),
            ("B", "1  2", "shell", 6),
            ("cURL_Password", "pw", "curl", 7),
            ("cURL_Password", "p w", "curl", 8),
            ("cURL_Password", "b:c", "curl", 9),
        ]
    )


def test_lines(files):
    got = to_lines(files({"a": "x\r\n\ny\r", "b": "", "c": "\n", "d": "z\n"}))
    assert pairs(got, "path", "line", "text") == [
        ("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("c", 1, ""), ("d", 1, "z"),
    ]


def test_uris(spark):
    cases = {
        "http://u:p%40w@h:80/x?a=1&a=2&b=&c": [
            ("URI_Password", "p@w"), ("a", "1"), ("a", "2"), ("b", ""), ("c", ""),
        ],
        "jdbc:mysql://h/db?password=x+y": [("password", "x y")],
        "http://h/?a=%zz&b=1;c&d=%41": [("d", "A")],
        "http://u@h/": [],
        "http://u:@h": [("URI_Password", "")],
        "http://u:p+q@h": [("URI_Password", "p+q")],
        "http://a:b@c@h/?x=1": [("URI_Password", "b@c"), ("x", "1")],
        "http://h:x1/?a=1": [],
        "http://h/%zz?a=1": [],
        "http://h?a=1#f?b=2": [("a", "1")],
        "http://h?a=1#%zz": [],
        "(http://h?a=1": [],
        "1http://h?a=1": [],
        "/p?u=http://h&v=1": [("u", "http://h"), ("v", "1")],
        "//u:p@h/http://x?a=1": [("URI_Password", "p"), ("a", "1")],
        "http://h/a b?c=d": [("c", "d")],
        "http://h h/?c=d": [],
        "http://u<:p@h/?c=d": [],
        "http://[::1]:80/?c=d": [("c", "d")],
        "http://h\x01/?c=d": [],
        "ftp://h/?=v&&k": [("", "v"), ("k", "")],
        "mail:x@y": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    got = {t: [] for t in cases}
    for row in df.select("t", F.inline(uri_items(F.col("t"), "p"))).collect():
        got[row.t].append((row.key, row.value))
    assert {t: sorted(v) for t, v in got.items()} == {t: sorted(v) for t, v in cases.items()}


def test_long_lines_take_linear_time(spark):
    size = 100_000
    lines = [
        "a" * size, "a " * (size // 2), "a1" * (size // 2), '="' * (size // 2), "'" * size,
        "a." * (size // 2), " " * size + "=", "a" * size + " = 'v'", "a=" * (size // 2) + "(",
        "int " * (size // 4) + "x = 'v'", ": " * (size // 2) + "(='\"",
    ]
    table = line_table(spark, lines)
    started = time.time()
    for extractor in LINE_EXTRACTORS.values():
        extract_lines(table, extractor.items).count()
    assert time.time() - started < 120


def test_comments(files):
    texts = {
        "a": "<!-- x --><!----><!-- y\n z --> <!-- open", "b": "--> <!-- ", "c": "<!--1-->2-->",
        "d": "<!-- a <!-- b -->",
    }
    got = extract_documents(files(texts), html_items)
    assert pairs(got, "file_path", "value") == [
        ("a", "x"), ("a", "y\n z"), ("c", "1"), ("d", "a <!-- b"),
    ]
    started = time.time()
    hostile = "<!--a-->" + "<!-- " * 200_000
    assert extract_documents(files({"a": hostile}), html_items).count() == 1
    assert time.time() - started < 30


def test_logins(files):
    texts = {
        "a": '{"auths": {"x": {"auth": "QQ=="}, "y": {"auth": ""}, "z": {}}}', "b": "{'auths': {}}",
        "c": "[]", "d": '{"auths": null}', "e": "", "f": '{"Auths": {"x": {"Auth": "Rg=="}}}',
        "g": '{"auths": {"x": {"auth": 5}, "y": {"auth": "Rw=="}}}',
        "h": '{"auths": {"x": {"auth": "SA=="}}} rest', "i": '{"auths": {"x": {"auth": "SQ=="}}}]',
        "j": '{"auths": {"x": {"auth": "Sg=="}}},{}', "k": ' \n{"auths": {"x": {"auth": "Sw=="}}}\n',
        "l": '{"n": [1, {"m": null}], "auths": {"x": {"auth": null}, "y": null, "z": {"auth": "TA==", "o": {}}}}',
        "m": '{"auths": "none"}', "n": '{"auths": {"x": "none"}}', "o": "5",
        "p": '{"auths": {"x": {"auth": {"auth": "UA=="}}}}',
    }
    got = extract_documents(files(texts), dockercfg_items)
    assert pairs(got, "file_path", "key", "value") == [
        ("a", "Dockercfg", "QQ=="), ("f", "Dockercfg", "Rg=="), ("k", "Dockercfg", "Sw=="),
        ("l", "Dockercfg", "TA=="),
    ]


def test_unusual_lines(spark):
    texts = ["password:", "x:_authToken=", "k = ", "k:", ": v", " = v", "# c: d", "u:", "ENV A"]
    table = line_table(spark, texts)

    def of(name):
        return pairs(extract_lines(table, LINE_EXTRACTORS[name]), "key", "value")

    assert of("pypirc") == [("PyPI password", "")]
    assert of("npmrc") == [("npm authToken", "")]
    assert of("conf") == [("", "v"), ("x:_authToken", "")][:1]
    assert of("pip") == [("", "v"), ("k", ""), ("x:_authToken", "")]
    assert ("", "v") in of("properties") and ("k", "") in of("properties")
    assert of("dockerfile") == []
    assert ("htpasswd Hash", "") in of("htpasswd")
