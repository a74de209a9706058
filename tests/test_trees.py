"""YAML, JSON and XML documents."""

import json
import random
import time
from xml.parsers import expat

from conftest import pairs
from pyspark.sql import functions as F

from keyhound.operators import tree
from keyhound.operators.tree import (
    clean_yaml,
    extract_trees,
    flatten_json_column,
    read_trees,
    read_xml,
    read_yaml,
    tree_errors,
)


def trees(files, fmt, text):
    return extract_trees(files({"f": text}).withColumn("format", F.lit(fmt)))


def test_yaml_tags_aliases_and_first_document(files):
    text = (
        "a: &x !Ref v\nb: *x\nc: !!str 5\nd: !T {e: 1}\n'~': ~\n<<: *x\n? [k, l]\n: m\n"
        "...\n---\nsecond: 1\n"
    )
    got = {(n[1], n[2], n[3]) for n in read_yaml(text) if n[0] == "pair"}
    assert got == {
        ("a", "!Ref v", "a"), ("b", "x", "b"), ("c", "5", "c"), ("d", "!T ", "d"),
        ("e", "1", "d.e"), ("~", "~", "~"), ("<<", "x", "<<"), ("", "m", ""),
    }


def test_yaml_errors_become_rows(spark, files):
    table = files({"a.yaml": "a: [1", "b.yaml": "a: *nope", "c.yaml": "a: 1"})
    nodes = read_trees(table.withColumn("format", F.lit("yaml")))
    assert pairs(tree_errors(nodes), "file_path", "format") == [
        ("a.yaml", "yaml"), ("b.yaml", "yaml"),
    ]
    # No scanned text in messages.
    assert all("nope" not in r.message for r in tree_errors(nodes).collect())


def test_pem_headers_and_templates(files):
    got = trees(files, "yaml", "-----BEGIN KEY-----\na: {{ x }} {% y %}\n# c: d\nb: 'e=f'\n")
    assert pairs(got) == [
        ("a", "{{ x }} ", "a", 2), ("b", "e=f", "b", 4), ("e", "f", "b", 4),
    ] or pairs(got) == [("a", "{{ x }}", "a", 2), ("b", "e=f", "b", 4), ("e", "f", "b", 4)]


def test_json_with_tabs_comments_and_escapes(files):
    text = '// c\n{\n\t"a": "x\\/y", // d\n\t"b": ["p=q", {"c": null}],\n\t"é": 1e5\n}\n'
    assert pairs(trees(files, "json", text)) == sorted(
        [
            ("a", "x/y", "a", 3), ("b", "", "b", 4), ("p", "q", "b", 4),
            ("c", "null", "b.c", 4), ("é", "1e5", "é", 5),
        ]
    )


def test_deep_documents_do_not_overflow(files):
    depth = 2000
    got = trees(files, "json", '{"a":' * depth + "1" + "}" * depth)
    assert got.count() == depth


def test_xml_pieces():
    nodes = read_xml(
        '<?xml version="1.0"?>\n<a:r x:y="1" z="s3://b?k=v">t1<!-- c -->t2\n'
        "<key>K</key><key/><v>1</v><value>\n V=W\n</value><value>X</value></a:r>"
    )
    assert [n for n in nodes if n[0] != "uri"] == [
        ("pair", "y", "1", "r@y", 2),
        ("pair", "z", "s3://b?k=v", "r@z", 2),
        ("pair", "r", "t1", "r", 2),
        ("pair", "r", "t2", "r", 2),
        ("pair", "key", "K", "r.key", 3),
        ("pair", "v", "1", "r.v", 3),
        ("pair", "value", "V=W", "r.value", 4),
        ("embed", "", "V=W", "r.value.embedded", 4),
        ("pair", "K", "V=W", "r.value.pair", 4),
        ("pair", "value", "X", "r.value", 5),
    ]


def test_xml_fragments():
    def pairs_of(text):
        return [n[1:] for n in read_xml(text) if n[0] == "pair"]

    assert pairs_of("<a>1</a>\n<b c='2'/>") == [("a", "1", "a", 1), ("c", "2", "b@c", 2)]
    text = '<?xml version="1.0"\n?>\nnote <a>1</a> end'
    assert pairs_of(text) == [("a", "1", "a", 3)]
    assert pairs_of("") == pairs_of(" \n") == []
    for broken in ("<a>", "<a></b>", "<a>&x;</a>", "</_>", "<a>1</a></_>"):
        try:
            read_xml(broken)
        except (ValueError, expat.ExpatError):
            continue
        raise AssertionError(broken)


def test_xml_that_is_refused(files):
    table = files(
        {
            "open": "<a><b></a>",
            "entity": '<!DOCTYPE a [<!ENTITY e "v">]><a>&e;</a>',
            "encoding": '<?xml version="1.0" encoding="ISO-8859-1"?><a>b</a>',
            "fine": "<a>&lt;&#65;</a>",
        }
    ).withColumn("format", F.lit("xml"))
    nodes = read_trees(table).cache()
    assert pairs(tree_errors(nodes), "file_path") == [("encoding",), ("entity",), ("open",)]
    assert pairs(nodes.filter("kind = 'pair'"), "value") == [("<A",)]


def test_native_and_document_json_agree(spark, files):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(8 if depth < 4 else 5)
        if kind < 5:
            return rng.choice(
                [0, -0.0, 12, 1.5, 1e30, True, None, "", "a", "k=v", " x ", "{", "é", "a/b",
                 "s3://h?q=1", "it's", "#", "\\", '"', "[", "nullable", "a: 1.0"]
            )
        if kind < 7:
            keys = rng.sample(["a", "b", "c d", "e.f", "k=v"], rng.randrange(4))
            return {k: value(depth + 1) for k in keys}
        return [value(depth + 1) for _ in range(rng.randrange(3))]

    texts = [json.dumps({"r": value(1), "s": value(1)}, ensure_ascii=False) for _ in range(300)]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id STRING, t STRING")
    got = flatten_json_column(table, F.col("id"), F.col("t"))
    documents = files({str(i): t for i, t in enumerate(texts)}).withColumn("format", F.lit("json"))
    columns = ("file_path", "key", "value", "kv_path")
    expected = read_trees(documents)
    assert pairs(got, *columns) == pairs(extract_trees(documents), *columns)
    assert expected.filter("kind = 'error'").count() == 0


def _odd_json(rng):
    """Text in and near JSON, as no writer would give it."""
    blank = lambda: rng.choice(["", "", " ", "  ", "\t", "\n", "\u0085", "\u2028", "\ufeff"] if rng.random() < 0.1 else ["", " "])

    def text():
        return rng.choice(["a", "b", "", "k=v", "x\x7fy", "x\u0085y", "{", "}", "a:b", "a, b", "-", "~", "yes", "null", "s3://h?q=1", "y" * 1_100])

    def value(depth):
        kind = rng.randrange(9)
        if kind < 4:
            return f'"{text()}"'
        if kind < 6:
            return rng.choice(["0", "12", "-3", "1.50", "1e3", "007", "true", "false", "null", "NaN", "Infinity", "abc", "+1", "-", "", "1_000", "0x1f"])
        if kind < 8 and depth < 5:
            entries = [f'{blank()}"{text()}"{blank()}:{blank()}{value(depth + 1)}{blank()}' for _ in range(rng.randrange(4))]
            return "{" + rng.choice([",", ", "]).join(entries) + rng.choice(["", "", "", ","]) + "}"
        return f"[{value(depth + 1)}]" if depth < 5 else "1"

    out = value(0)
    while not out.startswith("{"):
        out = value(0)
    return rng.choice(["", " ", ""]) + out + rng.choice(["", "", " ", "x", "}"])


def test_odd_json_texts_agree(spark, files):
    rng = random.Random(77)
    texts = ['{"":{"a":"1"}}', '{"a":"x\x7fy"}', '{"a":"x\u0085y"}', '{"' + "k" * 1_100 + '":"v"}', '{"a":"1","a":"2"}', "{}", "", "{"]
    texts += [_odd_json(rng) for _ in range(1_500)]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id STRING, t STRING")
    got = flatten_json_column(table, F.col("id"), F.col("t"))
    documents = files({str(i): t for i, t in enumerate(texts)}).withColumn("format", F.lit("json"))
    columns = ("file_path", "key", "value", "kv_path")
    assert pairs(got, *columns) == pairs(extract_trees(documents), *columns)


def test_unclosed_template_marks_take_linear_time(spark):
    texts = ["{%" * 500_000, "{{" * 500_000, "a: {% b %}" + "{%" * 500_000, "}}" + "{{" * 500_000]
    table = spark.createDataFrame([(t,) for t in texts], "t STRING")
    started = time.time()
    got = [r.c for r in table.select(clean_yaml(F.col("t")).alias("c")).collect()]
    assert time.time() - started < 20
    assert got == [texts[0], texts[1], "a: " + "{%" * 500_000, texts[3]]
    small = spark.createDataFrame([("a {% b\n %} c <% d %> e %} {% f",)], "t STRING")
    assert small.select(clean_yaml(F.col("t"))).first()[0] == "a  c  e %} {% f"


def test_batches_end_at_a_number_of_characters(files, monkeypatch):
    texts = {f"f{i}": "".join(f"k{j}: v{i}\n" for j in range(50)) for i in range(5)}
    plain = read_trees(files(texts).withColumn("format", F.lit("yaml"))).collect()
    sizes = []

    class Column:
        def __init__(self, values):
            self.values = values

        def __iter__(self):
            return iter(tree.pa.array(self.values, tree.pa.string()))

    batch = {"path": Column(list(texts)), "format": Column(["yaml"] * 5), "clean": Column(list(texts.values())), "raw": Column([None] * 5)}
    monkeypatch.setattr(tree, "_CHARS_PER_BATCH", 200)
    rows = []
    for out in tree._read_batches(iter([batch])):
        sizes.append(out.num_rows)
        rows += [tuple(r.values()) for r in out.to_pylist()]
    assert len(sizes) > 5 and max(sizes) < 50
    assert sorted(rows) == sorted(map(tuple, plain))


def test_numbers_that_are_none_take_the_document_reader(spark, files):
    texts = ['{"a": NaN}', '{"a": Infinity, "b": 1}', '{"a": -Infinity}', '{"a": "NaN"}']
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id STRING, t STRING")
    got = flatten_json_column(table, F.col("id"), F.col("t"))
    documents = files({str(i): t for i, t in enumerate(texts)}).withColumn("format", F.lit("json"))
    columns = ("file_path", "key", "value", "kv_path")
    assert pairs(got, *columns) == pairs(extract_trees(documents), *columns)
    assert ("0", "a", "NaN", "a") in pairs(got, *columns)
