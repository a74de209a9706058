"""A training corpus from ``documents``: quality, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.llm import decontaminate, ngram_join, packing, pii, quality
from keyhound.llm.queries import fold, table, vocabulary
from keyhound.session import written

THRESHOLD = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least ``THRESHOLD``)."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(labelled, table(spark, sf_dir, "labels").where(~fold(4, 2)))
    return quality.score(docs, weights, docs.columns, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word stretches are at least 0.8 similar."""
    return ngram_join.distinct(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.masked(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near copies", no_near_copies),
    ("decontamination", no_benchmark),
    ("personal data", no_personal_data),
    ("packing", packed),
]

#: The classifier, the tagger and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
