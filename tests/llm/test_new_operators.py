"""Sharding, source divergence and whitening against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyhound.llm import divergence, sharding, whitening
from keyhound.llm import queries as llm


def _plain_network(x, n, seed, back=False, sides=None, once=False):
    a, b = sides or sharding.grid(n)
    rounds = list(enumerate(sharding.keys(seed)))
    while True:
        left, right = divmod(x, b)
        for k, key in rounds[::-1] if back else rounds:
            side = right if k % 2 == 0 else left
            h = 1
            for value in key:
                h = h * ((side + value) % sharding.PRIME) % sharding.PRIME
            h = -h if back else h
            left, right = ((left + h) % a, right) if k % 2 == 0 else (left, (right + h) % b)
        x = left * b + right
        if x < n or once:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 101, 1000, 4099])
def test_network_permutes_and_is_undone(spark, n):
    there = sharding.forth(spark.range(n).withColumnRenamed("id", "x"), "x", "y", n, 7)
    rows = sharding.back(there, "y", "z", n, 7).collect()
    assert sorted(r.y for r in rows) == list(range(n))
    assert all(r.x == r.z for r in rows)
    assert all(r.y == _plain_network(r.x, n, 7) for r in rows)


def test_walk_beyond_the_first_steps(spark):
    """The grid is far larger than n here, so most walks are long."""
    n, a, b = 5, 20, 20
    cells = spark.createDataFrame([(x, _plain_network(x, n, 3, sides=(a, b), once=True)) for x in range(n)], "x long, cell long")
    found = cells.select("x", "cell", sharding._walk(F.col("cell"), n, a, b, 3, 1, a * b).alias("y")).collect()
    assert {r.x: r.y for r in found} == {x: _plain_network(x, n, 3, sides=(a, b)) for x in range(n)}
    assert any(r.cell >= n for r in found)


DOCS = "doc_id long, text string, shard int, slot string, row string, number int, place double"


def test_shards_of_hard_rows(spark):
    pairs = [(k, f"text {k}") for k in range(40)] + [(None, None), (None, ""), (3, "text 3"), (3, "other"), (50, "é" * 70_000)]
    pairs += [(7, "same")] * 60
    docs = spark.createDataFrame([(k, t, 1, "s", None, 2, 0.5) for k, t in pairs], DOCS)
    rows = sharding.assign(sharding.sizes(docs), ["doc_id"], 16, 1).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in pairs if k is not None
    )
    places = sorted((r.shard, r.slot) for r in rows)
    n = len(pairs)
    assert places == sorted((p % 16, p // 16) for p in range(n))
    again = sharding.assign(sharding.sizes(docs.repartition(5)), ["doc_id"], 16, 1).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    other = sharding.assign(sharding.sizes(docs), ["doc_id"], 16, 2).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, rows))
    whole = sharding.assign(docs, ["doc_id"], 4, 1, ("new_shard", "new_slot"))
    assert whole.columns == [*docs.columns, "new_shard", "new_slot"] and whole.count() == n


def test_place_follows_from_the_row_number(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in sharding.assign(sharding.sizes(docs), ["doc_id"], 16, 9).collect():
        p = _plain_network(r.doc_id, 300, 9)
        assert (r.shard, r.slot) == (p % 16, p // 16)


def test_no_rows_to_shard(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.assign(sharding.sizes(empty), ["doc_id"]).collect() == []


def test_shard_files(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    placed = sharding.assign(docs, ["doc_id"], 4, 9)
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted(
        (r.doc_id, r.shard, r.slot) for r in placed.collect()
    )


def test_sharding_runs_no_python(spark, tables):
    plan = llm.op12_sharding(spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _matrix(kind, n, draw):
    turn, _ = np.linalg.qr(draw.normal(size=(n, n)))
    if kind == "sample":
        rows = draw.normal(size=(3 * n, n))
        return rows.T @ rows / len(rows)
    values = {
        "equal": np.full(n, 3.0),
        "groups": np.repeat([5.0, 3.0, 3.0, 1.0], n // 4),
        "close": 1 + 1e-9 * np.arange(n),
        "rank": np.where(np.arange(n) < n // 4, 2.0 + np.arange(n), 0.0),
        "steep": 2.0 ** -np.arange(n),
        "zero": np.zeros(n),
    }[kind]
    return turn @ np.diag(values) @ turn.T


@pytest.mark.parametrize("kind", ["sample", "equal", "groups", "close", "rank", "steep", "zero"])
@pytest.mark.parametrize("n", [4, 64])
def test_components_of_matrices(kind, n):
    v = _matrix(kind, n, np.random.default_rng(n))
    values, vectors = whitening.components(v)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh((v + v.T) / 2)[::-1]).max() < 1e-14 * size
    assert np.abs(v @ vectors - vectors * values).max() < 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13


@pytest.mark.parametrize("v", [[[2.0]], [[1.0, 0.5], [0.5, 1.0]], [[0.0, 1.0], [1.0, 0.0]], [[1.0] * 7] * 7])
def test_components_of_small_matrices(v):
    v = np.array(v)
    values, vectors = whitening.components(v)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, v, atol=1e-14)


def test_polar_factor():
    draw = np.random.default_rng(1)
    for scale in (0, 6, 12):
        turn, _ = np.linalg.qr(draw.normal(size=(30, 30)))
        values = np.logspace(0, -scale, 30) * np.where(np.arange(30) % 2, 1, -1)
        factor = whitening.polar(turn @ np.diag(values) @ turn.T)
        assert np.abs(factor @ factor - np.eye(30)).max() < 1e-13
        assert np.abs(factor - turn @ np.diag(np.sign(values)) @ turn.T).max() < 1e-14 * 10 ** (scale + 1)


VECTORS = "vec_id long, embedding array<float>, component string, n int"


def _plain_whitening(rows):
    x = [[int(np.floor(float(c) * 64)) + 1_000_000 for c in v] for _, v in rows]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], vectors[:, ::-1]


def test_whitening_against_plain(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(400, 40)) * np.linspace(0.2, 3, 40)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(0, rows[5][1]), (None, rows[6][1])]
    bad = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 39), (903, [float("-inf")] + [0.0] * 39), (904, [None] + [0.0] * 39)]
    table = spark.createDataFrame([(k, v, "c", 1) for k, v in rows + bad], VECTORS).repartition(6)
    got = whitening.whiten(table).collect()
    n, deviation, centred, values, vectors = _plain_whitening(rows)
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    by_deviation = {}
    for r in got:
        by_deviation.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert set(by_deviation) == {(k, d) for (k, _), d in zip(rows, deviation, strict=True)}
    plain = centred @ vectors[:, :32] / np.sqrt(values[:32])
    order = {(k, d): i for i, ((k, _), d) in enumerate(zip(rows, deviation, strict=True))}
    mine = np.zeros((n, 32))
    for key, found in by_deviation.items():
        for c, r in found.items():
            mine[order[key], c - 1] = r.whitened
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    kept = sorted(set(order.values()))
    signs = np.sign((mine[kept] * plain[kept]).sum(0))
    assert np.abs(mine[kept] * signs - plain[kept]).max() < 1e-8


def test_vectors_without_variance(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0, 3.0], "c", 1) for k in range(5)], VECTORS)
    got = whitening.whiten(same).collect()
    assert len(got) == 15 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], "c", 1) for k in range(5)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r.explained for r in got if r.component == 1} == {1.0}
    assert {r.whitened for r in got if r.component == 2} == {0.0}
    assert whitening.whiten(same.limit(1)).count() == 3


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).columns[:3] == ["vec_id", "component", "n"] and whitening.whiten(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, "c", 1)], VECTORS)
    assert whitening.whiten(nothing).collect() == []


def test_vectors_of_several_lengths(spark):
    mixed = spark.createDataFrame([(1, [1.0], "c", 1), (2, [1.0, 2.0], "c", 1)], VECTORS)
    with pytest.raises(ValueError):
        whitening.whiten(mixed)


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [3.0, 1e30])]
    table = spark.createDataFrame([(k, v, "c", 1) for k, v in rows], VECTORS)
    got = whitening.whiten(table).collect()
    x = [[min(max(int(np.floor(float(np.float32(c)) * 64)), -(1 << 52)), 1 << 52) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert {(r.vec_id, r.deviation) for r in got} == {(k, e if e < 1 << 63 else None) for (k, _), e in zip(rows, exact, strict=True)}


def test_whitening_query(spark, tables):
    got = llm.op13_whitening(spark, tables)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4


# --- source divergence --------------------------------------------------------

TEXTS = "text string, lang string, source string, term string, n long, value string, part string"


def _terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", lower)


def _plain_audit(rows, least=10, top=10):
    n, docs = defaultdict(int), defaultdict(int)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        for t in _terms(text):
            n[lang or "", source or "", t] += 1
            n[lang or "", None, t] += 1
        for t in set(_terms(text)):
            docs[lang or "", t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), d in docs.items() if x == lang and d >= least]
        sources = [s for x, s in groups if x == lang]
        share = {}
        for s in [*sources, None]:
            total = sum(n[lang, s, t] for t in kept)
            share[s] = {t: 1 + 10**9 * (n[lang, s, t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            own = [t for t in kept if n[lang, s, t] and share[s][t] > share[None][t]]
            best = sorted((-f(share[s][t], share[None][t]), t.encode(), t) for t in own)[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(best)]
    return sorted(out)


def _audited(spark, rows, **limits):
    table = spark.createDataFrame([(*r, "t", 1, "v", "p") for r in rows], TEXTS).repartition(3)
    return sorted(map(tuple, divergence.audit(table, **limits).collect()))


def _corpus(seed, size):
    draw = random.Random(seed)
    words = [f"{'abcdefgh' * (k % 3)}{chr(97 + k % 26)}{'é' * (k % 2)}{'x' * (k % 11)}" for k in range(60)]
    words += ["Same", "SAME", "ÀB", "àb", "文字", "a_b", "don't", "x" * 40, "x" * 41, "x" * 48, "x" * 8, "x" * 16]
    rows = []
    for _ in range(size):
        text = draw.choice([" ", ", ", "1"]).join(draw.choices(words, k=draw.randrange(30)))
        rows.append((text, draw.choice(["en", "de", None, "zz"]), draw.choice(["a", "b", "c", None, "é", "Z"])))
    return rows


def test_divergence_against_plain(spark):
    rows = _corpus(1, 300)
    rows += [(None, "en", "a"), ("", "en", "empty"), ("123 !", "fr", "only"), (None, "fr", "other"), (None, None, None)]
    rows += [("same same words here", "en", "a")] * 40 + [("tie one", "it", s) for s in "abcd" for _ in range(10)]
    assert _audited(spark, rows) == _plain_audit(rows)
    assert _audited(spark, rows, least=1, top=3) == _plain_audit(rows, 1, 3)


def test_divergence_in_small_tiles(spark, monkeypatch):
    for name, value in {"TILE": 2, "BLOCK_ROWS": 7, "CELLS": 5, "SLICE_BYTES": 400, "MAX_BROADCAST": 0}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = _corpus(2, 120)
    assert _audited(spark, rows, least=2) == _plain_audit(rows, 2)


def test_long_documents_count_once(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    text = " ".join(random.Random(4).choices(["one", "two", "three", "é" * 60, "y" * 130], k=300))
    batch = pa.record_batch([pa.array([text.encode()]), pa.array(["en"]), pa.array(["s"])], ["text", "lang", "source"])
    got = divergence.count_slice(batch)
    plain = Counter(_terms(text))
    assert dict(zip([t.decode() for t in got["term"].to_pylist()], got["n"].to_pylist(), strict=True)) == dict(plain)
    assert set(got["docs"].to_pylist()) == {1}


@given(st.lists(st.text("abé", min_size=1, max_size=30), max_size=60))
@settings(max_examples=60, deadline=None)
def test_pointers_are_sorted(terms):
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    lengths = np.array([len(t.encode()) for t in terms], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    order, fresh = divergence.sort_pointers(data, starts, starts + lengths)
    expected = sorted(range(len(terms)), key=lambda k: terms[k].encode())
    assert order.tolist() == expected
    assert fresh.tolist() == [k == 0 or terms[expected[k]] != terms[expected[k - 1]] for k in range(len(terms))]


def test_no_rows_to_audit(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert divergence.audit(empty).collect() == []


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 30_000_000_000_001, 7)], "n long, total long, V long")
    got = df.select(divergence._share("n", "total")).first()[0]
    assert got == 1 + 10**9 * 9_000_000_000_002 // (30_000_000_000_001 + 14)
