"""Live scans.

Extraction and matching are narrow, so a streaming scan is the batch scan on a
streaming table, in append mode.  Context, ordering and other shuffles belong in
``foreachBatch`` or in a batch read of what the stream wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from keyhound.operators.report import count_by_severity
from keyhound.plans.scan import Extractors, scan
from keyhound.session import scratch_path
from keyhound.sources.config import ScanConfig
from keyhound.sources.corpus import SETTLE_MS, list_corpus, load_content, load_files
from keyhound.sources.rules import Rule, read_rules


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder as a stream; the table is one file, or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A stream takes a plain path for a folder; a pattern may name either.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def stream_corpus(
    spark: SparkSession,
    root: str,
    excluded: Sequence[str] = (),
    settle_ms: int = SETTLE_MS,
    with_errors: bool = False,
) -> DataFrame:
    """Files of a tree as they appear, hidden ones included.

    Files changed less than ``settle_ms`` ago wait for the next batch, or the next run.
    ``with_errors`` keeps a row with null content and ``error`` for each file that cannot be read.
    """
    load = load_files if with_errors else load_content
    return load(list_corpus(spark, root, excluded, True, settle_ms), root)


def live_scan(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    config: ScanConfig | None = None,
    extractors: Extractors | None = None,
    mode: str = "first",
) -> DataFrame:
    """Findings of a streaming file table, each emitted when found."""
    return scan(files, rules, config, mode, extractors)


def with_progress(files: DataFrame, name: str = "progress") -> DataFrame:
    """Count files while they pass; see ``ProgressListener``."""
    return files.observe(name, F.count(F.lit(1)).alias("files"))


class ProgressListener(StreamingQueryListener):
    """Calls ``on_files`` with the number of files of every finished batch."""

    def __init__(self, on_files: Callable[[int], None], name: str = "progress"):
        self.on_files, self.name = on_files, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is not None:
            self.on_files(metrics["files"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress_events(files: DataFrame) -> DataFrame:
    """One event per file, in the shape of ``found_events``."""
    return files.select(F.lit("progress").alias("type"), F.col("path").alias("data"))


def found_events(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.lit("found").alias("type"), F.to_json(F.struct(*findings.columns)).alias("data")
    )


def running_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity so far; state is one row per severity."""
    return count_by_severity(findings)


def run_to_table(
    stream: DataFrame, name: str, path: str | None = None, progress: str | None = None
) -> str:
    """Run an append stream over everything there is, into parquet; returns its path.

    With the path and the progress folder of an earlier run it goes on from there.  Reading that path afterwards gives the complete list of a finished scan.
    """
    spark = stream.sparkSession
    target = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress or scratch_path(spark, f"{name}-progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)
    return target


def run_counts(stream: DataFrame, name: str, path: str | None = None) -> str:
    """Run a counting stream over everything there is; the table holds the latest counts."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, name)

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)
    return target


def scan_batches(
    files: DataFrame,
    rules_folder: str,
    on_findings: Callable[[DataFrame, int], None],
    config: ScanConfig | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Scan every batch with the rules as they are at that moment."""
    spark = files.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        on_findings(scan(batch, read_rules(rules_folder), config), batch_id)

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "rule-reload"))
        .trigger(availableNow=True)
        .start()
    )


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
