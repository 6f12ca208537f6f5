"""Fusion of ranked lists (query_id, chunk, rank) and set operations on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.operators.shortlist import ranked


def _views(views: list[DataFrame]) -> DataFrame:
    out = None
    for number, view in enumerate(views):
        one = view.select("query_id", "chunk", F.col("rank"), F.lit(number).alias("view"))
        out = one if out is None else out.unionByName(one)
    return out


def ordered_union(views: list[DataFrame], top: int) -> DataFrame:
    """Chunks in the order in which they are first seen, view by view."""
    first = _views(views).groupBy("query_id", "chunk").agg(F.min(F.struct("view", "rank")).alias("at"))
    return ranked(first, ["at"], top).select("query_id", "chunk", "rank")


def borda(views: list[DataFrame], top: int) -> DataFrame:
    """By the sum of top minus places from 0."""
    votes = _views(views).groupBy("query_id", "chunk").agg(F.sum(F.lit(top) - F.col("rank") + 1).alias("votes"))
    return ranked(votes, [F.desc("votes")], top)


def candidate_fusion(hybrid: DataFrame, support: DataFrame, top: int) -> DataFrame:
    """Hybrid candidates and those with gap support, by support first and the hybrid's figures then."""
    names = ["gap_support", "raw_support", "rare_present", "dense_present", "rare_score", "dense_total", "rare_matches"]
    both = hybrid.drop("rank").join(support.drop("rank"), ["query_id", "chunk"], "full_outer").na.fill(0, names)
    return ranked(both.select("query_id", "chunk", *names), [F.desc(n) for n in names], top)


def template_fusion(supports: DataFrame, top: int) -> DataFrame:
    """(query_id, template, chunk, gap_support, raw_support) summed over templates: votes, gaps, hits."""
    sums = supports.groupBy("query_id", "chunk").agg(F.countDistinct("template").alias("votes"), F.sum("gap_support").alias("gaps"), F.sum("raw_support").alias("hits"))
    return ranked(sums, [F.desc("votes"), F.desc("gaps"), F.desc("hits")], top)


def combinations(ranks: DataFrame, size: int) -> DataFrame:
    """(templates, hit1, mrr): all combinations of templates scored by the best rank among them.

    ``ranks`` has template, query_id and the true chunk's rank (null if missed).
    """
    names = ranks.select("template").distinct()
    sets = names.select(F.array("template").alias("templates"), F.col("template").alias("last"))
    for _ in range(size - 1):
        more = names.withColumnRenamed("template", "next")
        sets = sets.join(F.broadcast(more), F.col("next") > F.col("last")).select(F.concat("templates", F.array("next")).alias("templates"), F.col("next").alias("last"))
    rows = sets.select("templates", F.explode("templates").alias("template")).join(ranks, "template")
    best = rows.groupBy("templates", "query_id").agg(F.min("rank").alias("rank"))
    return metrics(best, ["templates"])


def metrics(ranks: DataFrame, keys: list[str], at: tuple[int, ...] = (1, 4, 8, 16)) -> DataFrame:
    """hit@k, MRR and mean rank of (…, rank); a null rank is a miss."""
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}") for k in at]
    return ranks.groupBy(*keys).agg(*hits, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def rank_within(scored: DataFrame, order: list) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "chunk")))
