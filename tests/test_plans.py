"""The shape of physical plans."""

import re

from pyspark.sql import functions as F

from keyhound.operators.match import match
from keyhound.plans import all_queries
from keyhound.plans.scan import scan, scan_corpus
from keyhound.sources.rules import read_rules
from keyhound.sources.tables import files_from_table, filename_kv, kv_from_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, tables):
    table = spark.read.parquet(f"{tables}/documents.parquet")
    return files_from_table(
        table, F.expr("'d/' || CAST(doc_id AS STRING) || '.py'"), F.col("text")
    )


def test_a_scan_does_not_shuffle_or_broadcast(spark, tables):
    for mode in ("first", "all"):
        text = plan(scan(documents(spark, tables), mode=mode))
        assert "Exchange" not in text and "Join" not in text


def test_the_flagship_reads_every_table_once(spark, tables):
    text = optimized(all_queries()["scan_everything"](spark, tables))
    scans = re.findall(r"Relation \[([^\]]*)\] parquet", text)
    assert len(scans) == 4, scans  # documents, pages, conversations, events
    text = plan(all_queries()["scan_everything_findings"](spark, tables))
    assert text.count("Exchange") == text.count("Exchange RoundRobinPartitioning") <= 1 and "Join" not in text


def test_a_tree_is_listed_once_and_read_once(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.json").write_text('{"password": "abc!123"}')
    text = plan(scan_corpus(spark, str(tmp_path)))
    assert text.count("FileScan parquet") == 1 and "BatchScan corpus" not in text  # the listing, written once
    assert text.count("MapInArrow read") == 1 and text.count("ArrowEvalPython") == 1
    assert "Join" not in text and "Window" not in text


def test_the_ratio_is_computed_once(spark, tables):
    kv = kv_from_table(
        spark.read.parquet(f"{tables}/orders.parquet"),
        F.col("o_orderkey").cast("string"), ["o_orderstatus"], "row",
    )
    for mode in ("first", "all"):
        found = match(kv, read_rules(), mode)
        assert optimized(found.filter("rule_id <> ''")).count("array_distinct(") == 1


def test_only_needed_columns_are_read(spark, tables):
    text = plan(scan(documents(spark, tables)))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert schemas <= {"doc_id:bigint,text:string", "doc_id:bigint"}
    assert "text" not in plan(filename_kv(documents(spark, tables))).split("ReadSchema")[1]


def test_the_rule_filter_fits_the_compiler(spark, tables):
    kv = kv_from_table(
        spark.read.parquet(f"{tables}/orders.parquet"),
        F.col("o_orderkey").cast("string"), ["o_orderstatus"], "row",
    )
    found = match(kv, read_rules())
    text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_no_query_has_a_cartesian_product(spark, tables):
    for name in ("context_5_lines", "parse_context_lines", "scan_summary", "rules_with_findings"):
        text = plan(all_queries()[name](spark, tables))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
