"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "keyhound", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings scans rely on; cluster settings given outside win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # A setting of the JVM's start; the others are set below unless they come from outside.
    # Call sites per expression double the time it takes to build a plan.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # HotSpot does not compile larger methods; Spark then splits the code instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    outside = spark.sparkContext.getConf()
    for key, value in defaults.items():
        if key not in settings and not outside.contains(key):
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares between executors; a local one in local mode only."""
    conf = spark.sparkContext.getConf()
    shared = spark.conf.get(CHECKPOINT_KEY, None) or conf.get(CHECKPOINT_KEY, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="keyhound-")
        spark.conf.set(CHECKPOINT_KEY, shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the scratch folder."""
    return os.path.join(scratch_root(spark), "keyhound", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder: computed once, and safe when executors are lost.

    Use it for findings that are read more than once, as context and sorting do.  The table is
    removed when the application ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work several partitions per core.

    Only inputs of few partitions are repartitioned (a file with a single row group is
    one task, whatever its size), row by row, so no key decides where rows go.  A large
    table has many more partitions than cores and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores * 4:
        return df
    return df.repartition(cores * 2)
