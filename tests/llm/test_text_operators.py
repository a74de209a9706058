"""Joins, repeats, decontamination, tokens, packing, fingerprints and chat against brute force."""

import hashlib
import json
import random
import time
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyhound.llm import chat, decontaminate, encoding, imatch, ngram_join, packing, repeats, tokens
from keyhound.llm import queries as llm
from keyhound.session import scratch_path

DOCS = "doc_id long, text string, path string, node long, anchor long, hits int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(k, t, "p", 1, 2, None) for k, t in pairs], DOCS)


def prose(draw, count, words=400):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(count))


def similar_docs():
    draw = random.Random(5)
    out = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "One two"), (6, "one two three"), (7, "   ")]
    for k in range(6):
        base = prose(draw, 120).split()
        out.append((100 * (k + 1), " ".join(base)))
        for j in range(1, 12):
            copy = list(base)
            for _ in range(j % 4):
                copy[draw.randrange(len(copy))] = "changed"
            out.append((100 * (k + 1) + j, " ".join(copy)))
    out += [(900, "long " + prose(draw, 60_000)), (None, "one two"), (100, out[7][1])]
    return out


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_join(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[root(k)] = min(name, least.get(root(k), name))
    return sorted(((d, least.get(root(k), d), links[k]) for k, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("small,depth,block", [(64, 4, 512), (2, 3, 3)])
def test_join_equals_all_pairs(spark, monkeypatch, small, depth, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = similar_docs()
    found = ngram_join.join(docs_of(spark, rows), recall=0.9999, small=small, depth=depth).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in found), key=str) == plain_join(rows)


@pytest.mark.parametrize("block,hashes", [(2048, 4_000_000), (150, 4_000_000), (2048, 6_000)])
def test_join_of_a_large_group_equals_all_pairs(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_HASHES", hashes)
    rng = random.Random(5)
    rows = []  # three groups: the second shares a third of the words of the first
    for k in range(500):
        words = [f"w{j}" for j in range(240)] if k % 5 < 3 else [f"w{j}" if j < 80 else f"v{j}" for j in range(200)]
        if k % 5 == 4:
            words = [f"u{j}" for j in range(120)]
        words[rng.randrange(len(words))] = f"x{k % 90}"
        rows.append((k, " ".join(words)))
    rows += [(500 + k, " ".join(f"o{k}_{j}" for j in range(12))) for k in range(40)]
    found = ngram_join.join(docs_of(spark, rows), recall=0.9999).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in found), key=str) == plain_join(rows)


@pytest.mark.parametrize("inner", [True, False])
def test_dense_cells_give_the_pairs_of_plain_ones(monkeypatch, inner):
    rng = np.random.default_rng(3)
    n = 150
    sketch = rng.integers(0, 2, (n, ngram_join.COORDINATES), dtype=np.int32)
    paths = [sorted({50, *rng.integers(1, 30, 3).tolist(), *([7] if k % 2 else [])}) for k in range(n)]
    columns = {
        "cell": pa.array([1] * n),
        "node": pa.array(range(n)),
        "path": pa.array([50] * n),
        "block": pa.array([0 if inner else k % 2 for k in range(n)], pa.int32()),
        "inner": pa.array([inner] * n),
        "sketch": pa.array(list(sketch), pa.list_(pa.int32())),
        "paths": pa.array(paths, pa.list_(pa.int64())),
    }
    table = pa.table(columns)
    out = []
    for dense in (1000, 10):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        monkeypatch.setattr(ngram_join, "TILE", 32)
        monkeypatch.setattr(ngram_join, "SMALL", 20)
        out.append(sorted((a, b) for x, y in ngram_join._candidates(table, 0.5) for a, b in zip(x.tolist(), y.tolist(), strict=True)))
    assert out[0] == out[1] and len(out[0]) > 100


@pytest.mark.parametrize("held", [1_000_000, 300])
def test_overlaps_by_products_equal_set_overlaps(monkeypatch, held):
    monkeypatch.setattr(ngram_join, "_HELD", held)
    monkeypatch.setattr(ngram_join, "_WIDTH", 16)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 80)).astype(np.uint64)) for _ in range(60)]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    plain = [len(set(sets[a].tolist()) & set(sets[b].tolist())) / len({*sets[a].tolist(), *sets[b].tolist()}) for a, b in zip(left, right, strict=True)]
    assert ngram_join._overlaps(sets, left, right).tolist() == plain
    few = rng.integers(0, len(left), 40)
    assert ngram_join._overlaps(sets, left[few], right[few]).tolist() == [plain[k] for k in few]


def test_roots_join_components_step_by_step():
    root = np.arange(8)
    root = ngram_join._roots(root, np.array([5, 3]), np.array([6, 4]))
    assert root.tolist() == [0, 1, 2, 3, 3, 5, 5, 7]
    root = ngram_join._roots(root, np.array([6, 7]), np.array([4, 0]))
    assert root.tolist() == [0, 1, 2, 3, 3, 3, 3, 0]


def test_join_keeps_one_of_each_group(spark):
    rows = similar_docs()
    kept = ngram_join.distinct(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    wanted = {c for d, c, _ in plain_join(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted)


def test_join_of_nothing(spark):
    assert ngram_join.join(docs_of(spark, [(1, "x")]).where("false")).count() == 0
    assert ngram_join.join(docs_of(spark, [(1, "x"), (2, None)])).count() == 2


def test_runs_grow_with_recall():
    assert ngram_join.runs_for(0.8, 0.99) < ngram_join.runs_for(0.8, 0.9999)


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 102: 100}


def plain_repeats(rows, length, later=False):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = defaultdict(list)
    for k in sorted(range(len(data)), key=lambda k: data[k][0]):
        raw = data[k][1]
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]].append((k, p))
    out = []
    for k, (d, raw) in enumerate(data):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            places = seen[raw[p : p + length]]
            if len(places) > 1 and not (later and places[0] == (k, p)):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
        out.append((d, len(raw), sum(gone), runs, kept))
    return sorted(out)


def repeated_docs():
    draw = random.Random(8)
    passage = "é" + prose(draw, 30)
    out = [(1, None), (2, ""), (3, "short"), (4, passage), (5, "x " + passage + " y"), (6, passage + passage), (7, "ab" * 150)]
    for k in range(10, 40):
        cut = draw.randrange(40, len(passage))
        out.append((k, prose(draw, 20) + passage[draw.randrange(30) : cut] + prose(draw, 20)))
    out.append((50, out[12][1]))
    return out


@pytest.mark.parametrize("contexts", [32_768, 1])
@pytest.mark.parametrize("removed", ["all", "later"])
def test_repeats_equal_plain_windows(spark, contexts, removed, monkeypatch):
    monkeypatch.setattr(repeats, "TASK_BYTES", 4096)
    rows = repeated_docs()
    found = repeats.dedup(docs_of(spark, rows), removed, length=60, gram=20, contexts=contexts).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)
    if removed == "all":
        assert got == plain_repeats(rows, 60)
        return
    # One place of each string stays, and which one follows from id, hash of the text and place.
    every = {raw[p : p + 60] for _, t in rows for raw in [(t or "").encode()] for p in range(len(raw) - 59)}
    left = [x[4] for x in got]
    assert sum(x[2] for x in got) < sum(x[2] for x in plain_repeats(rows, 60))
    assert sum(x[2] for x in got) > 0 and every
    assert {x[0]: x[2] for x in got}[4] == {x[0]: x[2] for x in plain_repeats(rows, 60, True)}[4]
    assert len(left) == len(rows)


def test_repeated_rows_repeat_each_other(spark):
    text = prose(random.Random(1), 100)
    got = repeats.dedup(docs_of(spark, [(1, text), (1, text), (None, "tiny")])).collect()
    assert sorted((r["n_removed"], r["n_spans"]) for r in got) == [(0, 0), (len(text), 1), (len(text), 1)]
    assert repeats.dedup(docs_of(spark, [(1, "x")]).where("false")).count() == 0


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        key = "doc_id" if name == "documents" else "item_id"
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return sorted(con.sql(sql).fetchall(), key=str)


@pytest.mark.parametrize("limit", [400_000, 0])
def test_decontamination_equals_sql(spark, limit):
    draw = random.Random(4)
    items = [(k, prose(draw, n, 30)) for k, n in enumerate([40, 25, 10, 9, 3, 1, 0, 12])] + [(8, None), (9, "Ünï wörd-Two")]
    items.append((10, items[0][1]))
    docs = [(1, None), (2, ""), (3, "--"), (4, items[0][1].upper()), (5, "a " + items[3][1] + " b"), (6, "ünï, WÖRD two"), (6, "Ünï wörd; TWO")]
    docs += [(7, items[1][1][5:]), (8, prose(draw, 30_000, 30) + " " + items[2][1]), (4, items[0][1].upper()), (None, items[7][1])]
    docs += [(k, prose(draw, 200, 30)) for k in range(20, 40)]
    found = decontaminate.contamination(
        docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit
    )
    got = found.select(
        "doc_id",
        F.col("n_words").cast("long"),
        decontaminate.hit_words(F.col("hits")).cast("long"),
        F.size("items").cast("long"),
        F.sha2(F.array_join("items", ","), 256),
        F.size("hits") > 0,
    )
    assert sorted(map(tuple, got.collect()), key=str) == oracle(llm.all_oracles()["op10_decontamination"], documents=docs, benchmark=items)


def test_clean_drops_contaminated_rows_only(spark):
    item = prose(random.Random(9), 30)
    docs = docs_of(spark, [(1, "x " + item), (1, "clean text of one"), (2, None), (2, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in decontaminate.clean(docs, bench).collect()) == [(1, "clean text of one"), (2, ""), (2, "")]
    assert decontaminate.clean(docs, bench.where("false")).count() == 4


def same_ids(texts):
    encoder = encoding.Encoder(llm.vocabulary())
    ids, offsets = encoder.encode([x.encode() for x in texts])
    plain = [x.ids for x in encoder.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
    for k, (text, wanted) in enumerate(zip(texts, plain, strict=True)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == wanted, repr(text[:200])
    return encoder


SIGNS = [" ", "  ", "\n", "\r\n", "\t", "a", "The", "é", "1", "23", "'s", "'", "''", "'S", ".", "!?", "(", " ", "　", "\u0085"]
SIGNS += ["\x1c", "᠎", "​", " ", " ", "日本", "😀", "<|endoftext|>", "<|", "|>", "-", "\x00", "internationalization", "x" * 17]


def test_encoder_equals_the_library():
    draw = random.Random(6)
    same_ids(["", " ", "\n", *("".join(draw.choice(SIGNS) for _ in range(draw.randint(1, 30))) for _ in range(6000))])


def test_encoder_on_texts_without_blanks():
    draw = random.Random(8)
    han = "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(200_000))
    code = "".join(draw.choices("abcdefXYZ0123456789+/", k=5_000_000))
    same_ids(["a" * 200_000, han, code, "x " * 300_000, " " * 100_000, "\n" * 50_000 + "end", "é" * 50_000])


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "TABLE_PARTS", 1 << 9)
    monkeypatch.setattr(encoding, "STORE_BYTES", 20_000)
    draw = random.Random(9)
    texts = [" ".join(str(draw.randrange(10**k)) + "w" * draw.randrange(40) for k in draw.choices(range(1, 30), k=60)) for _ in range(300)]
    encoder = encoding.Encoder(llm.vocabulary())
    for k in range(0, 300, 10):
        encoder.encode([x.encode() for x in texts[k : k + 10]])
        assert encoder.table.parts <= 1 << 9 and encoder.longer_bytes <= 20_000 + 600
    same_ids(texts)
    lines = [("字" * 500 + str(k)).encode() for k in range(200)]
    before = encoder.longer_bytes
    encoder.encode(lines)
    assert encoder.longer_bytes - before < 2_000  # long parts are not remembered


def test_decoding_gives_the_texts_back():
    texts = ["", "é\x00 日本 😀<|endoftext|>\n", *SIGNS]
    ids, offsets = encoding.encoder(llm.vocabulary()).encode([x.encode() for x in texts])
    raw, place = encoding.decode(llm.vocabulary(), ids)
    assert [raw[place[a] : place[b]].decode() for a, b in zip(offsets, offsets[1:], strict=False)] == texts


def test_other_tokenizers_get_whole_texts(tmp_path):
    settings = json.loads(open(llm.vocabulary(), encoding="utf-8").read())
    settings["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings), encoding="utf-8")
    encoder = encoding.Encoder(str(path))
    ids, _ = encoder.encode([b"one two"])
    assert not encoder.byte_level and ids.tolist() == encoder.tokenizer.encode("one two", add_special_tokens=False).ids


def token_docs():
    draw = random.Random(7)
    out = [(5, None), (3, ""), (None, "no id"), (9, "Ties."), (9, "ties?"), (9, "Ties."), (4, "word " * 9_000), (11, "x" * 5_000)]
    return out + [(20 + k, prose(draw, draw.randrange(300)).replace("w1", ". W1")) for k in range(60)]


def test_token_files_round_trip(spark):
    rows = token_docs()
    path = scratch_path(spark, "test-tokens")
    tokens.write_tokens(docs_of(spark, rows), path, llm.vocabulary(), end=2)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    plain, start = encoding.load(llm.vocabulary()), 0
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for row, (name, text) in zip(got, wanted, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["ids"]) == (name, start, ids)
        start += len(ids)
    some = tokens.read_tokens(spark, path, 20, 25).collect()
    assert {r["doc_id"]: r["start"] for r in some} == {r["doc_id"]: r["start"] for r in got if r["doc_id"] and 20 <= r["doc_id"] <= 25}
    lengths = tokens.read_lengths(spark, path)
    assert "ids" not in lengths.columns and lengths.agg(F.sum("n_tokens")).first()[0] == start
    empty = scratch_path(spark, "test-tokens")
    tokens.write_tokens(docs_of(spark, rows).where("false"), empty, llm.vocabulary())
    assert tokens.with_crc(tokens.read_tokens(spark, empty)).count() == 0


def test_token_file_layout(spark, monkeypatch):
    """Dictionary and delta encodings, several row groups, page indexes, and reads that touch few of them."""
    monkeypatch.setattr(tokens, "GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(tokens, "PAGE_ROWS", 50)
    rows = [(k, prose(random.Random(k), 40)) for k in range(4_000)]
    path = scratch_path(spark, "test-tokens")
    tokens.write_tokens(docs_of(spark, rows).coalesce(1), path, llm.vocabulary(), end=2)
    files = [x for x in Path(path).glob("*.parquet")]
    groups = [(f, g) for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > len(files)
    for f, g in groups:
        group = pq.ParquetFile(f).metadata.row_group(g)
        columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
        ids = next(x for name, x in columns.items() if name.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings)
        for name in ("doc_id", "n_tokens", "part_start"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not any("DICTIONARY" in e for e in columns[name].encodings)
        assert all(x.has_offset_index and x.has_column_index for x in columns.values())
    few = tokens.read_tokens(spark, path, 100, 109)
    assert few.count() == 10
    scan = spark.read.parquet(path).where("doc_id between 100 and 109")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in scan._jdf.queryExecution().toString()
    lengths = tokens.read_lengths(spark, path)._jdf.queryExecution().toString()
    assert "ReadSchema" in lengths and "ids:array" not in lengths.split("== Physical Plan ==")[1]


def test_free_cut_places_are_32_ids_apart():
    ids = np.zeros(192, np.int64)
    assert packing.cuts(ids, np.array([192]), np.zeros(1, bool), 96) == [96, 192]


@pytest.mark.parametrize("stretch", [1 << 19, 4096])
def test_packing_keeps_every_id_once(spark, monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rows = [x for x in token_docs() if x[0] != 9]
    found = packing.pack(docs_of(spark, rows).coalesce(2), llm.vocabulary()).collect()
    plain = encoding.load(llm.vocabulary())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for name, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[name], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        total = sum(r["length"] for r in own)
        assert total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding <= 0.02 * sum(r["length"] for r in found)
    assert packing.pack(docs_of(spark, rows).where("false"), llm.vocabulary()).count() == 0


def test_stretch_ends_are_no_free_cuts(spark, monkeypatch):
    """One document of many stretches without sentence ends: pieces are whole windows, on the grid or at its end."""
    monkeypatch.setattr(packing, "STRETCH", 8_000)
    text = "word " * 30_000
    found = sorted(packing.pack(docs_of(spark, [(1, text)]).coalesce(1), llm.vocabulary()).collect(), key=lambda r: r["start"])
    assert [x for r in found for x in r["ids"]] == [*encoding.load(llm.vocabulary()).encode(text, add_special_tokens=False).ids, 0]
    assert all(r["offset"] == 0 and r["length"] == 1024 for r in found[:-16])


def test_cuts_are_the_cheapest():
    draw = np.random.default_rng(3)
    for _ in range(30):
        ids = draw.integers(0, 6, 300)
        sentence = np.array([True, False, False, False, False, False])
        ends = np.sort(draw.choice(np.arange(1, 300), 4, replace=False))
        ends = np.append(ends, 300)
        size = 128

        def price(j, ids=ids, sentence=sentence, ends=ends):
            if j in ends:
                return 0.0
            if sentence[ids[j - 1]]:
                return packing.SENTENCE
            return packing.INSIDE if j % packing.GRID == 0 else None

        def window(a, b, size=size):
            plain = size - (b - a)
            return min(plain, packing.SHORT) if b - a in (64,) else plain

        best = {0: 0.0}
        for j in range(1, 301):
            if price(j) is not None:
                options = [best[i] + window(i, j) for i in best if j - i <= size]
                if options:
                    best[j] = min(options) + price(j)
        got = packing.cuts(ids, ends, sentence, size)
        cost = sum(window(a, b) + price(b) for a, b in zip([0, *got], got, strict=False))
        assert got[-1] == 300 and abs(cost - best[300]) < 1e-9


def test_fingerprints_of_edited_texts(spark):
    draw = random.Random(2)
    rows = [(5, None), (4, ""), (3, "é"), (None, "no id"), (8, "same text here"), (7, "same text here"), (1, prose(draw, 40_000, 5_000))]
    rows += [(20 + k, prose(draw, 150, 700)) for k in range(80)]
    got = {r["doc_id"]: r for r in imatch.edited(docs_of(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for k, (name, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        row = got[name]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert got[8]["fingerprint"] == got[7]["fingerprint"] and got[8]["near_next"] == 1
    usual = [got[20 + k] for k in range(80)]
    assert np.mean([r["near_edited"] for r in usual]) > 3 * np.mean([r["near_next"] for r in usual])


def test_fingerprints_of_few_rows(spark):
    one = imatch.edited(docs_of(spark, [(1, "abcdef")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert imatch.edited(docs_of(spark, [(1, "x")]).where("false")).count() == 0


CHAT = "conv_id long, turn long, role string, text string, piece string"


def chat_rows():
    hostile = r"\### Assistant: </turn> ok"
    out = [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    for k in range(30):
        out += [(k, 0, "system", "be kind"), (k, 1, "user", f"q{k % 3}"), (k, 2, "assistant", f"<|end|>\n<|turn|>user\nanswer \\| {k % 7}")]
    out += [(50, 0, None, None), (50, None, "assistant", "first"), (50, 1, "a\nb", "x"), (50, 1, "a\nb", "x"), (None, 0, "user", "é\\\\|")]
    out += [(60, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)] + [(61, 0, "user", "long " * 50_000)]
    return out


def test_chat_round_trip_and_tree(spark):
    rows = chat_rows()
    path = scratch_path(spark, "test-chat")
    chat.write_tree(spark.createDataFrame([(*r, "x") for r in rows], CHAT), path, llm.vocabulary())
    turns = defaultdict(list)
    for name, turn, role, text in rows:
        turns[name].append(((turn is not None, turn or 0), role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(chat.read_conversations(spark, path), llm.vocabulary()).collect()}
    assert set(got) == set(turns)
    for name, own in turns.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        row = got[name]
        assert (row["n_turns"], row["loss_chars"]) == (len(own), len(loss))
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()

    nodes = spark.read.parquet(f"{path}/nodes").orderBy("start").collect()
    by_name = {r["node"]: r for r in nodes}
    stream = [x for r in nodes for x in r["ids"]]
    plain = encoding.load(llm.vocabulary())
    decoded = {r["node"]: plain.decode(r["ids"], skip_special_tokens=False) for r in nodes}
    assert len(by_name) == len(nodes) and sum(x.endswith("be kind<|end|>\n") for x in decoded.values()) == 1
    place, stack = 0, []
    for r in nodes:
        assert r["start"] == place and r["size"] == len(r["ids"])
        place += r["size"]
        above, seen, names = r["parent"], [], []
        while above:
            seen.append((by_name[above]["start"], by_name[above]["size"]))
            names.append(above)
            above = by_name[above]["parent"]
        assert r["depth"] == len(names) and r["position"] == sum(n for _, n in seen)
        covered = [x for a in r["attends"] for x in range(a["from"], a["to"])]
        assert covered == [x for a, n in reversed(seen) for x in range(a, a + n)]
        assert all(a["to"] < b["from"] or b["to"] < a["from"] for a, b in zip(r["attends"], r["attends"][1:], strict=False))
        # Depth first: the parent is on the path of the node before.
        assert not names or names[0] in stack
        stack = [r["node"], *names]
        # A conversation's ids from the stream and the stretches; its loss is the text of the turn.
        way = [stream[x] for x in covered] + r["ids"]
        assert plain.decode(way, skip_special_tokens=False) == "".join(decoded[x] for x in [*names[::-1], r["node"]])
        role, text = chat.parse_turn(decoded[r["node"]])
        under = chat.unescape(plain.decode(r["ids"][r["loss_from"] : r["loss_to"]], skip_special_tokens=False))
        assert under == (text if role == "assistant" else "")


def test_a_very_long_conversation(spark):
    """Work grows with the turns, not with their square."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(20_000)]
    rows += [(2, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(15_000)] + [(2, 15_000, "user", "other")]
    path = scratch_path(spark, "test-chat")
    table = spark.createDataFrame([(*r, "x") for r in rows], CHAT)
    started = time.time()
    chat.write_tree(table, path, llm.vocabulary())
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.read_conversations(spark, path), llm.vocabulary()).collect()}
    assert got == {1: 20_000, 2: 15_001} and time.time() - started < 60
    nodes = spark.read.parquet(f"{path}/nodes")
    assert nodes.count() == 20_001 and nodes.selectExpr("max(size(attends))").first()[0] <= 2


def test_chat_of_nothing(spark):
    path = scratch_path(spark, "test-chat")
    chat.write_tree(spark.createDataFrame([(*r, "x") for r in chat_rows()[:1]], CHAT).where("false"), path, llm.vocabulary())
    assert chat.read_conversations(spark, path).count() == 0


def test_escapes_are_undone():
    draw = random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choice(["\\", "<", "|", "<|", "n", "\n", "end|>", "a"]) for _ in range(draw.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.parse_turn(chat.format_turn(text, text)) == (text, text)
