"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``; the last returns the shards' assignment. A stage's input may be any DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.llm import decontaminate, language_id, mixing, near_dedup, sharding
from spanquarry.llm.storage import Scratch

LEAST_SCORE = 0.5
SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose best language has no half of the labels' mass."""
    model = language_id.fit(docs, "doc_id", "text", "lang")
    found = language_id.annotate(docs, "text", model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, likeness 0.8)."""
    return near_dedup.keep_one(docs, "doc_id", "text")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (five words, containment 0.8)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, "text", items, "item_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the sources' weights ask; every document stays at least once."""
    return mixing.apply(docs, "doc_id", "text", "source")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard_rows(docs, "doc_id", "text", SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL cannot express the language model, the MinHash components and the hash order of the shards' slots.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
