"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, shards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchloom import files
from batchloom.llm import decontaminate, mixing, near_dups, quality, sharding
from batchloom.llm.common import table
from batchloom.llm.queries import MIX_WEIGHTS, mix_levels
from batchloom.session import staging_dir

SIMILARITY = 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for quality go; a null text is scored as an empty one, and equal rows have one fate."""
    return quality.good_only(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = None) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return near_dups.one_of_each(docs, similarity=similarity)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same with groups by op3's fingerprints and by five-word shingles that are 0.8 alike or more."""
    return dedupe(spark, docs, sf_dir, similarity=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null and empty texts have none and stay, and equal rows have one fate."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, at the target weights; a document that is taken for several epochs stands several times.

    Documents without a token (null, empty, blank) go. Rows of a leaf with one id, or
    without, are taken together.
    """
    taken = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, mixing.word_count())
    return mixing.repeated(taken, docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it."""
    return sharding.with_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("near duplicates", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: the classifier, SimHash and label propagation are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next.

    What a stage wrote goes once the next one is written; the last one's folder is the caller's.
    """
    folder = f"{staging_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            files.remove(spark, f"{folder}/{number - 1}")
    return docs
