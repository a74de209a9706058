"""Language ID, quality and personal data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keyhound.llm import language, pii, quality
from keyhound.llm import queries as llm

SCHEMA = "doc_id long, text string, lang string, score string, base int"


def edge_docs(spark):
    rows = [
        (1, None, "en", "x", 1),
        (2, "", "en", "x", 1),
        (3, "123 456", None, "x", 1),
        (None, "the house and the garden", "en", "x", 1),
        (4, "the house and the garden", "en", None, None),
        (4, "the house and the garden", "en", None, None),
        (5, "das Haus und der Garten", "de", "x", 1),
        (6, "und " * 60_000, None, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_edge_cases(spark):
    docs = edge_docs(spark)
    languages, matrix = language.train(docs, F.lit(True))
    assert languages == ["de", "en"]
    got = {(r[0], r[1]) for r in language.predict(docs, languages, matrix, ["doc_id"]).select("doc_id", "lang_pred").collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (5, "de"), (6, "de")}
    scores = [r[0] for r in language.predict(docs, languages, matrix, ["doc_id"]).select("score").collect()]
    assert len(scores) == 8 and all(0 <= x <= 1 for x in scores)
    nothing, empty = language.train(docs.where("false"), F.lit(True))
    assert {r[0] for r in language.predict(docs, nothing, empty, ["doc_id"]).select("lang_pred").collect()} == {"und"}
    assert language.predict(docs.where("false"), languages, matrix, ["doc_id"]).count() == 0


def test_language_refuses_a_matrix_without_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.train(edge_docs(spark), F.lit(True))


def test_language_counts_rare_languages_among_many_rows(spark):
    many = spark.range(30_000).selectExpr("id AS doc_id", "'the house and the garden' AS text", "'en' AS lang")
    rare = spark.createDataFrame([(40_000, "жук летит над лесом", "ru"), (40_001, "2024 - 77", "zz")], many.schema)
    languages, matrix = language.train(many.unionByName(rare), F.lit(True))
    assert languages == ["en", "ru"] and len(matrix) == 2
    # The counts are those of every row: 30,000 texts, and one.
    _, one = language.train(many.limit(1).unionByName(rare), F.lit(True))
    seen = one[1] - one[0] > 1
    assert seen.any() and (matrix[1] - matrix[0])[seen].min() > 1
    got = {r["lang_pred"] for r in language.predict(rare.where("lang = 'ru'"), languages, matrix, ["doc_id"]).collect()}
    assert got == {"ru"}


def test_language_of_held_out_documents(spark, tables):
    folder = tables.replace("0.001", "0.01")
    got = llm.op1_language_id(spark, folder).where("held_out").join(llm.table(spark, folder, "documents"), "doc_id")
    right = got.where("lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_quality_edge_cases(spark):
    good = ["the house and the garden are near the river %d" % k for k in range(40)]
    bad = ["BUY!! NOW!! CHEAP!! %d !!" % k for k in range(40)]
    docs = spark.createDataFrame(
        [(k, t, "y") for k, t in enumerate([*good, *bad])] + [(900, None, "y"), (901, "", "y"), (None, "BUY!! NOW!!", "y"), (902, "NOW!! " * 50_000, "y")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame(
        [(k, int(k < 40)) for k in range(80)] + [(3, 1), (None, 0), (5, None)], "doc_id long, quality int"
    )
    weights = quality.train(docs, labels)
    rows = quality.score(docs, weights, ["doc_id"]).collect()
    got = {r[0]: r[1] for r in rows}
    assert len(rows) == 84 and all(0 <= x <= 1 for x in got.values())
    assert min(got[k] for k in range(40)) > max(got[k] for k in range(40, 80))
    assert got[900] == got[901] and got[902] < 0.5 and got[None] < 0.5
    untrained = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, untrained, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.where("false"), weights, ["doc_id"]).count() == 0


def test_quality_learns_from_twelve_thousand_rows():
    assert quality.TRAIN_ROWS >= 12_000 and quality.train.__defaults__[-1] == quality.TRAIN_ROWS


def test_quality_of_held_out_documents(spark, tables):
    folder = tables.replace("0.001", "0.01")
    got = llm.op7_quality(spark, folder).where("held_out").join(llm.table(spark, folder, "labels"), "doc_id")
    right = got.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.95


# The base patterns as stated, for the plain side of the comparison.
_PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    def luhn(x):
        values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(x))]
        return sum(v // 10 + v % 10 for v in values) % 10 == 0

    tests = (
        lambda m: True,
        lambda m: all(int(x) <= 255 for x in m.split(".")),
        lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        lambda m: 9 <= len(digits(m)) <= 15,
    )
    return [(k, *m.span()) for k, pattern in enumerate(_PLAIN) for m in pattern.finditer(text) if tests[k](m[0])]


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(3)
    for signs in ("ab1234.@+- ()0-9@.", "4111 -", "a@.-+", "25.16 "):
        for _ in range(8_000):
            text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("sign", ["1", "a", "1.", "+1", "@", "a@", "1 ", "a.", "+"])
def test_base_spans_are_linear_on_long_texts(sign):
    pii.base_spans(sign * 200_000)


def test_field_adds_repeated_tokens_only(spark):
    phone, mail = "+49 (151) 555-1234", "jane.roe7@example.com"
    text = f"call {phone} or mail {mail} today, jane.roe7 said; her number is 49151-5551234 and 77 is the year 2024."
    rows = [(1, text, 5), (2, "in 2024 there were 49151-5551234 houses", None), (3, None, 1), (4, "", 1), (1, text, 5)]
    rows += [(10 + k, f"call +49 (15{k}) 555-9{k}34 or u{k}.name@mail{k}.example.com from 10.0.0.{k}", 1) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    model = pii.train(docs)
    found = pii.find(docs, model, ["doc_id"]).collect()
    assert len(found) == len(rows)
    spans = {r["doc_id"]: (r["base"], r["spans"]) for r in found}
    base, every = spans[1]
    assert all(x in every for x in base)
    added = [(pii.KINDS[k], text[a:b]) for k, a, b in every if [k, a, b] not in base]
    assert ("phone", "49151-5551234") in added and not any("2024" in x or x == "77" for _, x in added)
    assert spans[2] == spans[3] == spans[4] == ([], [])
    digest = {r["doc_id"]: r for r in pii.digests(pii.find(docs, model, ["doc_id"])).collect()}
    assert digest[1]["n_phone"] == 1 and digest[1]["n_email"] == 1 and digest[3]["spans"] == ""
    out = {r["doc_id"]: r["text"] for r in pii.masked(docs, model).collect()}
    assert phone not in out[1] and mail not in out[1] and "<PHONE>" in out[1] and out[3] is None
    assert pii.find(docs.where("false"), model, ["doc_id"]).count() == 0
    assert pii.train(docs.where("false"))["shape"] == {}


def test_field_counts_all_documents(spark):
    rare = ["1-2", "1@", "+3-4", "a5", "a-6", "a@7", "1.5", "1.5.7", "x1.2.3", "123456", "1234567-8", "+123456.7"]
    plain = spark.range(60_000).selectExpr("id AS doc_id", "'see 7 now' AS text")
    odd = spark.createDataFrame([(100_000 + k, f"see {token} now") for k, token in enumerate(rare)], "doc_id long, text string")
    shapes = pii.train(plain.union(odd))["shape"]
    assert set(shapes) == {pii._shape(token) for token in [*rare, "7"]}


def test_field_adds_repeats_in_other_groups(spark):
    phone, card = "+1 (407) 555-7710", "4111 1111 1111 1111"
    forms = {
        "(407) 555-7710": "phone", "407 555 7710": "phone", "555-7710": "phone", "407.555.7710": "phone",
        "0407 555 77 10": "phone", "1111 1111": "card", "4111 1111 1111": "card", "1111-1111-1111": "card", "11111111": "card",
    }
    rows = [(k, f"call {phone} or pay by {card} now. Later {form}, of 2024 and 31 12 1999 in 12 rooms.") for k, form in enumerate(forms)]
    others = ("407 555 7711", "(407) 555-7701", "7710", "555 77 1", "a555-7710", "4111 1112 1111", "1111")
    rows += [(100 + k, f"call {phone} or pay by {card} now. Later {form}, of 2024.") for k, form in enumerate(others)]
    rows += [(200 + k, f"call +1 (4{k}7) 555-9{k}34 from 10.0.0.{k}, see 17 18 1919{k} 20 of 7 8 9 10 11 12 13") for k in range(90)]
    rows += [(300, f"we called 12 {phone}\n\n12 407 555 7710 13"), (301, "only (407) 555-7710 and 1111 1111 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs, pii.train(docs), ["doc_id"]).collect()
    text = dict(rows)
    added = {r["doc_id"]: [(pii.KINDS[k], text[r["doc_id"]][a:b]) for k, a, b in r["spans"] if [k, a, b] not in r["base"]] for r in found}
    assert {form: added[k] for k, form in enumerate(forms)} == {form: [(kind, form)] for form, kind in forms.items()}
    assert {form: added[100 + k] for k, form in enumerate(others)} == {form: [] for form in others}
    assert added[300] == [("phone", "407 555 7710")] and added[301] == []
    out = {r["doc_id"]: r["text"] for r in pii.masked(docs, pii.train(docs)).collect()}
    assert all(form not in out[k] for k, form in enumerate(forms))


@pytest.mark.parametrize("sign", ["1", "1 ", "1234 ", "555-7710 ", "(407) ", "+1 (407) 555-7710, "])
def test_nodes_are_linear_on_long_texts(sign):
    text = "call +1 (407) 555-7710 or pay by 4111 1111 1111 1111, " + sign * 20_000
    pii.skip_edges(pii.nodes(text, pii.base_spans(text)))


def test_message_passing_spreads_a_label():
    import numpy as np

    unary = np.log(np.array([[0.98, 0.02], [0.4, 0.6], [0.4, 0.6]]))
    table = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))
    edges = np.array([[0, 1], [1, 2]])
    p = pii.marginals(unary, edges, np.stack([table, table]), rounds=30)
    exact = np.zeros((3, 2))
    for a in range(2):
        for b in range(2):
            for c in range(2):
                weight = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + table[a, b] + table[b, c])
                exact[0, a] += weight
                exact[1, b] += weight
                exact[2, c] += weight
    assert np.allclose(p, exact / exact.sum(1, keepdims=True), atol=1e-6)


def test_mask_joins_overlapping_spans():
    assert pii._mask("a 12345 b", [[2, 2, 5], [3, 3, 7]]) == "a <CARD> b"
