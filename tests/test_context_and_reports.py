"""Context, orderings and report files."""

import csv
import glob
import io
import json
import os

import pytest
from conftest import pairs
from pyspark.sql import functions as F

from keyhound.operators import context, report, sinks
from keyhound.operators.context import parse_context, with_context, with_prompt
from keyhound.sources.tables import to_lines

SCHEMA = (
    "RuleID STRING, Description STRING, FilePath STRING, LineNumber INT, Content STRING, "
    "Severity STRING"
)
ROWS = [
    ("password-variable", "d", "a/b/c.py", 3, 'x"y, <z>', "CRITICAL"),
    ("uri-detection", "d", "d.txt", 0, " two\nlines ", "MAJOR"),
    ("aws-id", "d", "e.go", 1, "", "BLOCKER"),
    ("my-secret-key", "d", "f" * 50, 2, "é", "odd"),
]


@pytest.fixture
def found(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def lines(files):
    return to_lines(files({"a": "\n".join(f"l{i}" for i in range(1, 31)), "b": "one\ntwo\n"}))


def brute_context(number, radius, texts):
    out = []
    for i, text in enumerate(texts, 1):
        if max(1, number - radius) <= i <= number + radius:
            out.append(f"{i}: >>> {text} <<<\n" if i == number else f"{i}: {text}\n")
    return "".join(out), len(out)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("broadcast", [False, True])
def test_context_against_brute_force(spark, lines, monkeypatch, hot, broadcast):
    if hot:
        monkeypatch.setattr(context, "HOT_FINDINGS", 2)
    if not broadcast:
        monkeypatch.setattr(context, "MAX_BROADCAST_PATHS", 0)
    spots = [("a", 1), ("a", 30), ("a", 15), ("a", 15), ("a", 15), ("b", 0), ("b", 9), ("c", 1)]
    spots += [("a", 16)] * 50
    table = spark.createDataFrame(
        [("r", "d", path, line, f"c{i}", "INFO") for i, (path, line) in enumerate(spots)], SCHEMA
    )
    texts = {"a": [f"l{i}" for i in range(1, 31)], "b": ["one", "two"], "c": []}
    got = with_context(table, lines, 2).collect()
    assert len(got) == len(spots)
    for row in got:
        block, count = brute_context(row.LineNumber, 5, texts[row.FilePath])
        assert (row.context_block, row.context_lines) == (block or row.Content, count)
        assert str(count) in row.context_msg if block else "Lv1" in row.context_msg


def test_level_one_and_prompt(found, lines):
    row = with_prompt(with_context(found, lines, 1)).filter("RuleID = 'uri-detection'").first()
    assert row.context_block == row.Content and "Lv1" in row.context_msg
    assert "d.txt" in row.prompt and row.Content in row.prompt


def test_parse_context(spark):
    df = spark.createDataFrame(
        [("a", 2, "1: x\n2: >>> y: 3 <<<\nno number\n 10: z\n")],
        "FilePath STRING, LineNumber INT, context_block STRING",
    )
    assert pairs(parse_context(df), "line", "text", "is_target") == [
        (1, "x", False), (2, ">>> y: 3 <<<", True), (10, "z", False),
    ]


def test_orderings(found):
    def order(**options):
        return [r.Severity for r in report.sort_findings(found, **options).collect()]

    assert order()[:2] == ["CRITICAL", "MAJOR"]
    assert set(order(blocker_rank=4)[:2]) == {"CRITICAL", "BLOCKER"}
    assert order(descending=False)[-2:] == ["MAJOR", "CRITICAL"]
    by_rule = [r.RuleID for r in report.sort_findings(found, "RuleID").collect()]
    assert by_rule == sorted(by_rule, reverse=True)


def test_summaries(found, files):
    assert report.severity_counts(found).first().asDict() == {
        "critical": 1, "major": 1, "minor": 0, "info": 0,
    }
    assert report.critical_total(found).first().asDict() == {"critical_total": 2, "major_total": 1}
    assert pairs(report.rule_type_counts(found), "rule_type", "findings") == [
        ("other", 1), ("password", 1), ("secret", 1), ("uri", 1),
    ]
    summary = report.scan_summary(files({"a": "x", "b": "y"}), found.limit(0)).first()
    assert (summary.files_scanned, summary.findings) == (2, 0)
    assert report.filter_severity(found, "ODD").count() == 1
    assert report.search_text(found, "É").count() == 1


def test_observed_count(found):
    observed, observation = report.observe_findings(found)
    observed.write.format("noop").mode("overwrite").save()
    assert observation.get["findings"] == len(ROWS)


def text_parts(path):
    return [open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{path}/part-*"))]


def test_csv_follows_the_standard(found, tmp_path):
    path = sinks.write_report(found.coalesce(1), str(tmp_path / "r"), "csv")
    assert path.endswith(".csv")
    rows = list(csv.reader(io.StringIO("".join(text_parts(path)))))
    assert rows[0] == ["Severity", "RuleID", "Description", "FilePath", "LineNumber", "Content"]
    assert sorted(rows[1:]) == sorted([r[5], r[0], r[1], r[2], str(r[3]), r[4]] for r in ROWS)


def test_excel_csv(found, tmp_path):
    path = sinks.write_report(found.limit(1), str(tmp_path / "r.csv"), "excel")
    text = "".join(text_parts(path))
    assert text == '\ufeff风险等级,命中规则,文件路径,行号,内容快照\n' \
        'CRITICAL,password-variable,a/b/c.py,3,"x""y, <z>"\n'


def test_json_and_html(found, tmp_path, spark):
    path = sinks.write_report(found, str(tmp_path / "r"), "json")
    assert spark.read.json(path).count() == len(ROWS)
    for parts in (1, 3, 9):
        path = sinks.write_report(found.repartition(parts), str(tmp_path / f"a{parts}"), "json_array")
        rows = json.loads("".join(text_parts(path)))
        assert sorted(tuple(r.values()) for r in rows) == sorted(ROWS)
        assert sorted(map(tuple, sinks.read_json_array(spark, path).collect())) == sorted(ROWS)
    sinks.write_json_array(found.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(text_parts(tmp_path / "none"))) == []
    page = "".join(text_parts(sinks.write_report(found, str(tmp_path / "p"), "html")))
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>\n")
    assert '<span class="badge critical">CRITICAL</span>' in page and "&lt;z&gt;" in page
    assert f'<p class="meta">{len(ROWS)}</p>' in page
    sinks.write_html(found.limit(0), str(tmp_path / "empty"))
    assert '<p class="meta">0</p>' in "".join(text_parts(tmp_path / "empty"))


def test_guard_and_masking(found, tmp_path):
    assert sinks.write_report(found.limit(0), str(tmp_path / "n"), "csv") is None
    assert sinks.write_report(found, str(tmp_path / "n"), "pdf") is None
    assert not (tmp_path / "n.csv").exists()
    path = sinks.write_report(found.limit(1), str(tmp_path / "m"), "csv", mask=True)
    assert "<z>" not in "".join(text_parts(path))


def test_short_paths(spark):
    long = "x" * 45
    df = spark.createDataFrame(
        [("short",), (long,), (f"{long}/a",), (f"r/{long}/a\\b",)], "p STRING"
    )
    from pyspark.sql import functions as F

    got = [r.s for r in df.select(report.short_path(F.col("p")).alias("s")).collect()]
    assert got == ["short", "x" * 40 + "...", "x" * 40 + "...", ".../a/b"]


@pytest.mark.parametrize("fmt", ["json", "json_array", "csv", "excel", "html"])
def test_a_report_computes_its_findings_once(spark, found, tmp_path, fmt):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    path = sinks.write_report(found.mapInArrow(counted, found.schema), str(tmp_path / "r"), fmt)
    assert path and rows.value == len(ROWS)
    none = found.filter("Severity = 'none'").mapInArrow(counted, found.schema)
    before = text_parts(path)
    assert sinks.write_report(none, str(tmp_path / "r"), fmt) is None
    assert text_parts(path) == before and os.listdir(tmp_path) == [os.path.basename(path)]


def test_a_failed_report_leaves_the_last_one(found, tmp_path):
    path = sinks.write_report(found, str(tmp_path / "r"), "csv")
    before = text_parts(path)
    broken = found.withColumn("Content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_report(broken, str(tmp_path / "r"), "csv")
    assert text_parts(path) == before and os.listdir(tmp_path) == ["r.csv"]


def test_findings_are_computed_once_for_their_context(spark, lines, monkeypatch):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([("r", "d", "a", k, "c", "INFO") for k in range(1, 31)], SCHEMA)
    got = with_context(table.mapInArrow(counted, table.schema), lines, 4)
    assert got.count() == 30 and rows.value == 30


def test_a_target_joins_at_most_two_chunks(spark, lines):
    targets = spark.createDataFrame([("a", k) for k in range(0, 60)], "FilePath STRING, LineNumber INT")
    for radius in (5, 20, 50):
        plan = context.context_blocks(targets, lines, radius)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Cartesian" not in plan
        chunks = context.line_chunks(lines, 2 * radius + 1)
        assert chunks.selectExpr("max(size(rows))").first()[0] <= 2 * radius + 1
        width = 2 * radius + 1
        for n in range(60):
            first, last = max(n - radius, 1), n + radius
            assert (last - 1) // width - (first - 1) // width <= 1


@pytest.mark.parametrize("hot", [False, True])
def test_context_over_chunk_ends_and_odd_lines(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(context, "HOT_FINDINGS", 2)
    count = 3 * context._width(5) + 4
    texts = [f"t{i}" for i in range(1, count + 1)]
    gone = {40, 44, 45, 89}  # a line table need not hold every line
    rows = [("a", i, t) for i, t in enumerate(texts, 1) if i not in gone] + [("a", 50, "again"), ("a", None, "x"), (None, 1, "y")]
    table = spark.createDataFrame(rows, "path STRING, line INT, text STRING")
    places = [("a", n) for n in [*range(-6, count + 9), None, 44, 44, 44]] + [(None, 1)]
    found = spark.createDataFrame([("r", "d", p, n, f"c{k}", "INFO") for k, (p, n) in enumerate(places)], SCHEMA)
    got = with_context(found, table, 2).collect()
    assert sorted(r.Content for r in got) == sorted(f"c{k}" for k in range(len(places)))
    for row in got:
        own = [] if row.FilePath is None or row.LineNumber is None else sorted(
            (n, t) for p, n, t in rows if p == "a" and n is not None and 0 < n and row.LineNumber - 5 <= n <= row.LineNumber + 5
        )
        block = "".join(f"{n}: >>> {t} <<<\n" if n == row.LineNumber else f"{n}: {t}\n" for n, t in own)
        assert (row.context_block, row.context_lines) == (block or row.Content, len(own))


def test_blocks_are_not_shuffled(spark, found, lines):
    for framed in (with_context(found, lines, 3), context.context_blocks(found, lines, 20)):
        tree = framed._jdf.queryExecution().optimizedPlan().toString()
        assert tree.count("Join LeftOuter") + tree.count("Join Inner") == 1
        assert "Aggregate" not in tree[: tree.index("Join ")]


def test_a_sort_is_dealt_by_the_size_of_rows(spark, monkeypatch):
    rows = [(f"r{k % 3}", "d", f"p{k % 50}", k % 4, "x" * 20, ["MAJOR", "INFO", "BLOCKER", None][k % 4]) for k in range(2_000)]
    table = spark.createDataFrame([*rows, (None, None, None, None, None, None)], SCHEMA)
    expected = table.orderBy(report.severity_weight(F.col("Severity"), 4).desc(), "FilePath", "LineNumber", "RuleID", "Content").collect()
    assert report.sort_findings(table, blocker_rank=4).rdd.getNumPartitions() == 1
    monkeypatch.setattr(report, "SORT_BYTES", 10_000)
    ordered = report.sort_findings(table, blocker_rank=4)
    got = ordered.collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in expected]
    sizes = [len(x) for x in ordered.rdd.glom().collect()]
    assert len(sizes) >= 20 and max(sizes) * 130 < 4 * 10_000
    assert report.sort_findings(table.limit(0)).count() == 0
