"""Time the headline queries on one machine and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keyhound.plans import all_queries
from keyhound.session import build_session

HEADLINE = [
    "scan_everything",
    "scan_everything_all_rules",
    "extract_everything",
    "scan_document_assignments",
    "scan_table_columns",
    "match_first",
    "match_all",
    "document_lines",
    "extract_go",
    "extract_java",
    "extract_python_keywords",
    "extract_python_calls",
    "shell_lines_of_documents",
    "extract_html_comments",
    "uri_query_of_pages",
    "flatten_event_props",
    "extract_json_files",
    "extract_yaml_files",
    "extract_xml_files",
    "yaml_of_documents",
    "similarity_ratio",
    "context_5_lines",
    "context_50_lines",
    "findings_per_severity",
    "sorted_findings",
    "report_csv",
    "stream_findings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    only = sys.argv[1:]
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        if only and name not in only:
            continue
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    kv = spark.read.parquet(f"{folder}/customer.parquet").count() * 56
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    rates = {}
    if "match_first" in times:
        rates["pairs_per_sec_first"] = round(kv / times["match_first"])
    if "match_all" in times:
        rates["pairs_per_sec_all"] = round(kv / times["match_all"])
    if "scan_everything" in times:
        rates["documents_per_sec_scan"] = round(documents / times["scan_everything"])
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "cpus": cpus,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
