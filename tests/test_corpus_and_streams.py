"""File trees, custom extractors and live scans."""

import errno
import io
import os
import time
import tracemalloc

import pyarrow as pa
import pytest
from conftest import pairs
from pyarrow import fs
from pyspark.sql import functions as F

from keyhound.operators import tree
from keyhound.operators.dispatch import with_format
from keyhound.operators.match import match
from keyhound.plans import all_queries, catalog_reports
from keyhound.plans.scan import (
    Extractors,
    corpus_errors,
    extract,
    file_errors,
    parse_errors,
    scan,
    scan_corpus,
    scan_corpus_outputs,
)
from keyhound.sources import corpus
from keyhound.sources.corpus import _deal, list_corpus, read_corpus
from keyhound.sources.rules import read_rules
from keyhound.streaming import live
from keyhound.streaming.manifest import Manifest, follow_corpus


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_hidden_files_links_and_exclusions(spark, tmp_path):
    for name in (".env", "_x/y.txt", ".d/.e", "vendor/z", "a.vendor", "n/m/o"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("content")
    os.symlink(tmp_path / ".env", tmp_path / "link")
    os.symlink(tmp_path / "n", tmp_path / "loop")
    root = str(tmp_path)
    assert names(list_corpus(spark, root), root) == [
        ".d/.e", ".env", "_x/y.txt", "a.vendor", "n/m/o", "vendor/z",
    ]
    kept = read_corpus(spark, root, ["vendor", "/m/"])
    assert names(kept, root) == [".d/.e", ".env", "_x/y.txt"]
    assert {bytes(r.content) for r in kept.collect()} == {b"content"}
    assert {r.length for r in kept.collect()} == {7}


def test_exclusion_ignores_folders_above_the_root(spark, tmp_path):
    root = tmp_path / "vendor" / "project"
    root.mkdir(parents=True)
    (root / "a").write_text("x")
    cwd = os.getcwd()
    os.chdir(root)
    try:
        assert list_corpus(spark, ".", ["vendor"]).count() == 1
    finally:
        os.chdir(cwd)
    assert list_corpus(spark, str(root), ["vendor"]).count() == 0


def test_many_folders_become_few_shares(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}" / "s").mkdir(parents=True)
        (tmp_path / f"d{i}" / "s" / "f").write_text("x")
    listing = list_corpus(spark, str(tmp_path))
    assert listing.count() == 300
    assert listing.rdd.getNumPartitions() <= 64
    hands = _deal(list(range(100)), 5)
    assert sorted(sum(hands, [])) == list(range(100)) and len(hands) == 5


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        list_corpus(spark, str(tmp_path / "none")).count()


@pytest.mark.skipif(os.geteuid() == 0, reason="root may read everything")
def test_unreadable_folders_are_skipped(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "closed").mkdir(mode=0)
    assert list_corpus(spark, str(tmp_path)).count() == 1


def test_a_wide_folder_is_dealt_out_by_names(spark, tmp_path, monkeypatch):
    wide = tmp_path / "wide"
    wide.mkdir()
    for i in range(50_000):
        os.close(os.open(wide / f"f{i}", os.O_CREAT))
    (wide / "inner").mkdir()
    (wide / "inner" / "x").write_text("x")
    monkeypatch.setattr(corpus, "WIDE_FOLDER", 1_000)
    listing = corpus._Listing({"path": str(tmp_path), "shares": "16", "wide_folder": "1000"})
    shares = listing.share_out()
    assert all(len(s.found) <= 1_000 for s in shares) and sum(s.wide is not None for s in shares) == 16
    sizes = [sum(1 for _ in listing.rows(s)) for s in shares]
    assert sum(sizes) == 50_001 and max(sizes) < 2 * 50_000 / 16
    tracemalloc.start()
    assert sum(1 for s in shares[:2] for _ in listing.rows(s))
    assert tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()
    found = list_corpus(spark, str(tmp_path))
    assert found.count() == 50_001 and found.select("path").distinct().count() == 50_001


def test_folders_that_cannot_be_listed_are_rows(tmp_path, monkeypatch):
    for name in ("open", "closed", "open/closed"):
        (tmp_path / name).mkdir()
    (tmp_path / "open" / "a").write_text("x")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("closed"):
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    for shares in ("1", "64"):
        listing = corpus._Listing({"path": str(tmp_path), "shares": shares})
        rows = sorted((os.path.relpath(p, tmp_path), problem) for s in listing.share_out() for p, _, problem, _ in listing.rows(s))
        assert rows == [("closed", "PermissionError"), ("open/a", None), ("open/closed", "PermissionError")]


def test_findings_and_errors_from_one_run(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"db_password": "geheim!"}')
    (tmp_path / "b.json").write_text('{"db_password": ')
    (tmp_path / "c.bin").write_text("not analysed")
    os.mkdir(os.fsencode(tmp_path) + b"/d\xff.py")
    root = str(tmp_path)
    hits, errors = scan_corpus_outputs(spark, root)
    assert pairs(hits, "RuleID", "Content", "LineNumber") == pairs(scan_corpus(spark, root), "RuleID", "Content", "LineNumber")
    assert {(os.path.basename(r.file_path), r.format, r.message) for r in errors.collect()} == {
        ("b.json", "json", "ParserError"), ("d\ufffd.py", None, "UnicodeDecodeError"),
    }
    kept, _ = scan_corpus_outputs(spark, root, rules=[])
    assert kept.count() == 0
    assert {r.message for r in corpus_errors(spark, root).collect()} == {"ParserError", "UnicodeDecodeError"}


RANGED = {
    "a.properties": "".join(f"password.{i}=value-{i}!\n" for i in range(200)),
    "b.py": "\n".join(f"password_{i} = 'se{i}cret'" for i in range(150)) + "\r\n\r\n",
    "c.conf": '<?xml version="1.0"?>\n<a>' + "".join(f"<password>p{i}!</password>\n" for i in range(100)) + "</a>",
    "d.conf": "\n" * 300 + "password=at-the-end!",
    "e.sh": "export A=1 \\\n B=2\n" * 100,
    "f.txt": "http://u:pass" + "w" * 3_000 + "@h/ x\nhttp://u:second@h/\n",
    "g.html": "<!-- password: abc123! -->" * 40,
    "h.ini": "",
}


@pytest.mark.parametrize("size", [1, 64, 1_000])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, size):
    for name, text in RANGED.items():
        (tmp_path / name).write_text(text, newline="")
    root = str(tmp_path)
    whole = scan(read_corpus(spark, root), mode="all")
    assert whole.count() > 400
    ranged = scan_corpus(spark, root, mode="all", range_bytes=size)
    assert pairs(ranged, *whole.columns) == pairs(whole, *whole.columns)


def test_ranges_hold_the_lines_that_begin_in_them(tmp_path):
    path = tmp_path / "f"
    local = fs.LocalFileSystem()
    for text in (b"", b"\n", b"a", b"a\nbb\n\nccc", b"\n\n\n", b"x" * 200_000 + b"\ny"):
        path.write_bytes(text)
        for size in (1, 2, 3, 70_000):
            if len(text) // size > 1_000:
                continue
            parts = [corpus._read(local, str(path), k, min(k + size, len(text)))[0] for k in range(0, len(text), size)]
            counts = [corpus._count_lines(local, str(path), k, min(k + size, len(text))) for k in range(0, len(text), size)]
            assert b"".join(parts) == text and counts == [p.count(b"\n") for p in parts]
            assert all(p.endswith(b"\n") for p in parts[:-1] if p and not text.endswith(p))


def test_files_too_large_for_a_value_are_errors(tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "LARGEST_FILE", 10)
    (tmp_path / "a").write_bytes(b"x" * 11)
    (tmp_path / "b").write_bytes(b"x" * 10)
    local = fs.LocalFileSystem()
    assert corpus._read(local, str(tmp_path / "a")) == (None, corpus.TOO_LARGE)
    assert corpus._read(local, str(tmp_path / "b")) == (b"x" * 10, None)


def test_trees_too_large_for_a_row_are_errors(monkeypatch):
    monkeypatch.setattr(tree, "_CHARS_PER_DOCUMENT", 40)
    batch = (pa.array(["json", None, "json"]), pa.array(['{"a": "b"}', None, '{"a": "' + "x" * 50 + '"}']), pa.nulls(3, pa.string()))
    (found,) = tree._read_arrays(iter([batch]))
    assert [None if x is None else [(n["kind"], n["value"]) for n in x] for x in found.to_pylist()] == [
        [("pair", "b")], None, [("error", "TreeTooLarge")],
    ]


def test_node_arrays_come_in_small_batches(monkeypatch):
    monkeypatch.setattr(tree, "_CHARS_PER_BATCH", 30)
    texts = ['{"a": "' + "x" * (k % 40) + '"}' for k in range(200)]
    batch = (pa.array(["json"] * 200), pa.array(texts), pa.nulls(200, pa.string()))
    found = list(tree._read_arrays(iter([batch, batch])))
    assert len(found) > 100 and sum(map(len, found)) == 400


@pytest.mark.parametrize(
    "name,fmt",
    [
        ("a.YAML", "yaml"), (".npmrc.json", "json"), (".npmrc_old", "npmrc"), ("x.bash", "shell"),
        ("x.fish", "shell"), ("Dockerfile", "dockerfile"), ("dockerfile", None),
        ("x.Dockerfile", None), ("config.json", "json"), ("config.json.dist", "json"),
        ("a.pyc", "python"), ("x.htmlx", "html"), ("x.log", None), ("x.jsx", None),
        ("pip.conf", "pip"), ("PIP.CONF", "conf"), (".env", "shell"), ("env", None),
        ("a.template", None), ("a.sh.template", "shell"), ("my.ENV", "shell"),
    ],
)
def test_routing(files, name, fmt):
    assert with_format(files({f"d.py/{name}": "long enough"})).first().format == fmt


def test_small_files_keep_their_names_only(files):
    found = extract(files({"a/.env": "A=b\nC", "b/.env": "A=bcd\nC"}))
    assert pairs(found, "file_path", "key") == [
        ("a/.env", "file"), ("b/.env", "A"), ("b/.env", "file"),
    ]


def test_extended_dispatch(files):
    extractors = Extractors(extended_dispatch=True)
    found = extract(files({"a.ts": "let k = 'value'"}), extractors).filter("key = 'k'")
    assert found.count() == 1


def test_registered_extractors_come_first(files):
    def upper(df):
        return df.select(
            F.col("path").alias("file_path"),
            F.lit("custom").alias("key"),
            F.upper(F.col("content").cast("string")).alias("value"),
            F.lit("c").alias("kv_path"),
            F.lit(1).alias("line"),
        )

    table = files({"a.txt": "http://h?x=1", "b.rb": "anything"})
    found = extract(table, Extractors().register("mine", upper, [".RB", ".txt"]))
    assert pairs(found.filter("key <> 'file'"), "key", "value") == [
        ("custom", "ANYTHING"), ("custom", "HTTP://H?X=1"),
    ]
    replaced = extract(table, Extractors().register("text", upper))
    assert pairs(replaced.filter("key <> 'file'"), "value") == [("HTTP://H?X=1",)]


def test_parse_errors_do_not_stop_a_scan(files):
    table = files({"bad.json": '{"a": [', "good.json": '{"db_password": "geheim!"}'})
    assert pairs(scan(table), "RuleID", "Content") == [("password-variable", "geheim!")]
    assert pairs(parse_errors(table), "file_path", "format") == [("bad.json", "json")]


class _Store:
    """A file system whose files fail so many times before they open."""

    def __init__(self, error, times):
        self.error, self.left = error, times

    def open_input_stream(self, path):
        self.left -= 1
        if self.left >= 0:
            raise self.error
        return io.BytesIO(b"content")


def test_errors_that_may_pass_are_tried_again_and_then_fail(monkeypatch):
    monkeypatch.setattr(corpus, "PAUSES", (0, 0))
    for error in (OSError(errno.EIO, "i/o"), TimeoutError("late"), OSError("AWS Error SLOW_DOWN")):
        assert corpus._read(_Store(error, 2), "f") == (b"content", None)
        with pytest.raises(OSError):
            corpus._read(_Store(error, 9), "f")
    for error in (PermissionError("no"), FileNotFoundError("no"), OSError("AWS Error ACCESS_DENIED")):
        assert corpus._read(_Store(error, 9), "f") == (None, type(error).__name__)


def test_unreadable_files_are_rows_of_the_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"password": "x1y2z3"}')
    (tmp_path / "b.json").write_text('{"password": ')
    gone = str(tmp_path / "gone.json")
    listing = list_corpus(spark, str(tmp_path)).union(spark.createDataFrame([(gone, 9)], "path STRING, length BIGINT"))
    loaded = corpus.load_files(listing, str(tmp_path))
    assert {(r.path, r.error) for r in loaded.collect() if r.content is None} == {(gone, "FileNotFoundError")}
    found = {r.file_path: (r.format, r.message) for r in file_errors(loaded).collect()}
    assert set(found) == {gone, str(tmp_path / "b.json")} and found[gone] == ("json", "FileNotFoundError")
    assert names(corpus.load_content(listing, str(tmp_path)), str(tmp_path)) == ["a.json", "b.json"]
    assert [r.file_path for r in corpus_errors(spark, str(tmp_path)).collect()] == [str(tmp_path / "b.json")]
    stream = live.stream_corpus(spark, str(tmp_path), with_errors=True)
    assert stream.isStreaming and stream.columns == ["path", "length", "content", "error"]


def test_a_stream_over_a_growing_tree(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / ".env").write_text("DB_PASSWORD=first-value\n")
    found = live.live_scan(live.stream_corpus(spark, str(root)))
    query = (
        found.writeStream.format("memory")
        .queryName("tree_findings")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .start()
    )

    def contents():
        return {r.Content for r in spark.table("tree_findings").collect()}

    def wait_for(expected):
        deadline = time.time() + 60
        while contents() != expected and time.time() < deadline:
            time.sleep(0.5)
        assert contents() == expected

    try:
        wait_for({".env", "first-value"})
        (root / "b.ini").write_text("password=second-value\n")
        seen = {".env", "first-value", "b.ini", "second-value"}
        wait_for(seen)
        # Files that arrive with an old time, under a new name, or with other content.
        old = tmp_path / "c.ini"
        old.write_text("password=third-value\n")
        os.utime(old, (1_000_000_000, 1_000_000_000))
        old.rename(root / "c.ini")
        wait_for(seen := seen | {"c.ini", "third-value"})
        (root / "b.ini").rename(root / "d.ini")
        wait_for(seen := seen | {"d.ini"})
        (root / "d.ini").write_text("password=fourth-value\n")
        wait_for(seen | {"fourth-value"})
        found = [r.Content for r in spark.table("tree_findings").collect()]
        assert found.count("first-value") == found.count("third-value") == 1
        assert found.count("second-value") == 2
    finally:
        query.stop()


def test_stream_equals_batch(spark, tables):
    from keyhound.plans.catalog_reports import everything
    from keyhound.sources.tables import files_from_table

    def files_of(df):
        return files_from_table(
            df, F.expr("'t/' || CAST(page_id AS STRING) || '.html'"), F.col("html")
        )

    batch = scan(files_of(spark.read.parquet(f"{tables}/pages.parquet")))
    stream = live.live_scan(files_of(live.stream_table(spark, tables, "pages")))
    written = spark.read.parquet(live.run_to_table(stream, "equal"))
    columns = ("FilePath", "RuleID", "Content", "LineNumber")
    assert pairs(written, *columns) == pairs(batch, *columns)
    assert everything(spark, tables).count() > 0


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"<html><!-- note {k} --></html>", f"x = {k}") for k in range(6)], "page_id INT, html STRING, text STRING")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    rows.selectExpr("page_id AS doc_id", "text").repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    part = rows.coalesce(1).write.parquet(str(tmp_path / "part")) or next((tmp_path / "part").glob("part-*.parquet"))
    os.rename(part, tmp_path / "one" / "pages.parquet")
    queries = all_queries()
    for folder in ("many", "one"):
        events = queries["stream_progress_events"](spark, str(tmp_path / folder)).collect()
        assert sorted(r["data"] for r in events) == [f"pages/{k}.html" for k in range(6)]
    many = str(tmp_path / "many")
    counted = queries["stream_running_counts"](spark, many).collect()
    assert sum(r["findings"] for r in counted) == queries["stream_findings"](spark, many).count()
    assert queries["stream_document_scan"](spark, many).count() == 0


def test_a_stream_of_no_rows_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id INT, html STRING").write.parquet(str(tmp_path / "pages.parquet"))
    queries, folder = all_queries(), str(tmp_path)
    assert queries["stream_findings"](spark, folder).count() == 0
    assert queries["stream_progress_events"](spark, folder).count() == 0
    assert queries["stream_found_events"](spark, folder).count() == 0
    assert queries["stream_reloaded_rules"](spark, folder).count() == 0


def test_progress(spark, tables):
    pages = live.stream_table(spark, tables, "pages")
    seen = []
    listener = live.ProgressListener(seen.append)
    spark.streams.addListener(listener)
    try:
        live.run_to_table(live.with_progress(pages), "progress-test")
        deadline = time.time() + 20
        while sum(seen) < 50 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(seen) == pages.sparkSession.read.parquet(f"{tables}/pages.parquet").count()


def test_kv_of_a_stream_can_be_matched(spark, tables):
    from keyhound.sources.tables import kv_from_table

    orders = live.stream_table(spark, tables, "customer")
    kv = kv_from_table(orders, F.col("c_custkey").cast("string"), ["c_name"], "row")
    assert match(kv, read_rules()).isStreaming


def test_a_manifest_knows_the_tree_and_not_its_history(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "manifest")
    (root / "d").mkdir(parents=True)
    for name in ("a", "b", "d/c", "gone"):
        (root / name).write_text("first")
        os.utime(root / name, (1_000, 1_000))
    seen = []

    def handle(new):
        seen.append(names(new, str(root)))

    def run():
        follow_corpus(spark, str(root), folder, handle)
        return seen[-1], Manifest(spark, folder).seen().count()

    assert run() == (["a", "b", "d/c", "gone"], 4)
    assert run() == ([], 4)
    os.utime(root / "a", (2_000, 2_000))  # replaced, same length
    os.rename(root / "b", root / "moved")  # keeps its time
    os.unlink(root / "gone")
    (root / "new").write_text("x")
    os.utime(root / "new", (10, 10))  # an old time
    assert run() == (["a", "moved", "new"], 4)
    (root / "gone").write_text("first")
    os.utime(root / "gone", (1_000, 1_000))

    def fail(new):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        follow_corpus(spark, str(root), folder, fail)
    assert run() == (["gone"], 5)
    (root / "fresh").write_text("x")
    assert run() == ([], 5)  # still being written, perhaps
    assert len(os.listdir(folder)) <= 2


class _Sized:
    """A file system of one file that remembers how much room a reader asks for."""

    def __init__(self, content):
        self.content, self.rooms = content, []

    def open_input_stream(self, path):
        store = self

        class Stream(io.BytesIO):
            def read(self, room):
                store.rooms.append(room)
                return super().read(room)

        return Stream(self.content)


def test_a_file_gets_room_of_its_listed_length(monkeypatch):
    small = _Sized(b"x" * 100)
    assert corpus._read(small, "f", length=100) == (b"x" * 100, None) and small.rooms == [corpus.READ_BYTES]
    large = _Sized(b"x" * 100_000)
    assert corpus._read(large, "f", length=100_000) == (b"x" * 100_000, None) and large.rooms == [100_001]
    grown = _Sized(b"x" * 100_000)
    assert corpus._read(grown, "f", length=3) == (b"x" * 100_000, None)
    monkeypatch.setattr(corpus, "LARGEST_FILE", 50_000)
    for length in (3, 50_000, 100_000, None):
        assert corpus._read(_Sized(b"x" * 100_000), "f", length=length) == (None, corpus.TOO_LARGE)
        assert corpus._read(_Sized(b"x" * 50_000), "f", length=length) == (b"x" * 50_000, None)


def test_a_listing_opens_its_root_a_fixed_number_of_times(tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.ini").write_text("a=b")
    opened = []
    monkeypatch.setattr(corpus.files, "open_root", lambda root, real=corpus.files.open_root: opened.append(root) or real(root))
    listing = corpus._Listing({"path": str(tmp_path), "shares": "2", "wide_folder": "10", "excluded": "d7"})
    found = [row for share in listing.share_out() for row in listing.rows(share)]
    assert len(found) == 39 and len(opened) < 10


def test_a_settings_tree_is_written_from_one_read(spark, tables, monkeypatch):
    written = []
    monkeypatch.setattr(catalog_reports, "write_files", lambda files, root, real=catalog_reports.write_files: written.append(1) or real(files, root))
    assert all_queries()["scan_corpus_settings"](spark, tables).count() > 0
    assert len(written) == 2  # the tree, and its settings


def test_settings_trees_are_on_the_disk_one_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(k, f"Customer#{k}", "BUILDING") for k in range(40)] + [(7, "Customer#7", "BUILDING"), (None, "nobody", "BUILDING")]
    spark.createDataFrame(rows, "c_custkey BIGINT, c_name STRING, c_mktsegment STRING").write.parquet(f"{tmp_path}/customer.parquet")
    roots, present = [], []

    def noted(files, root, real=catalog_reports.write_files):
        present.append([r for r in roots if r != root and os.path.exists(r)])
        roots.append(root)
        real(files, root)

    monkeypatch.setattr(catalog_reports, "write_files", noted)

    def found():
        return sorted(map(tuple, all_queries()["scan_corpus_settings"](spark, str(tmp_path)).collect()))

    whole = found()
    assert len(roots) == 2 and len(whole) > 80
    roots.clear()
    monkeypatch.setattr(catalog_reports, "SETTINGS_PORTION", 15)
    assert found() == whole
    assert len(set(roots)) == 3 and not any(present) and not any(map(os.path.exists, roots))
