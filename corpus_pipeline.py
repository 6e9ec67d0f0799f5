"""A corpus from raw documents: toxic ones out, one of each near-duplicate class, benchmark leaks out, sources mixed, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.llm import decontamination, mixing, simhash, toxicity
from sitesieve.llm.keys import boxed
from sitesieve.llm.queries import shard_rows, table
from sitesieve.sources.storage import stored


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages give them a probability below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = boxed(docs, toxicity.judge(model).alias("toxicity"))
    return judged.filter(F.col("toxicity.score") < toxicity.THRESHOLD).select("row.*")


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints that link."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, judged by their text."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return shard_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_of_toxicity),
    ("simhash_near_dedup", near_deduplicated),
    ("decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: SQL has neither the trained toxicity model nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
