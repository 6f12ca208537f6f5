"""Feature rows for learning to rank candidates, and a pointwise ranker trained on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def features(parts: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """One row a (query_id, chunk): every figure of the parts, missing ones 0, their ranks within the query and label."""
    joined = reduce(lambda a, b: a.join(b, ["query_id", "chunk"], "full_outer"), (p.select("query_id", "chunk", *(F.col(c).cast("double").alias(f"{name}_{c}") for c in p.columns if c not in ("query_id", "chunk", "label"))) for name, p in parts.items()))
    figures = [c for c in joined.columns if c not in ("query_id", "chunk")]
    rows = joined.na.fill(0.0, figures).join(truth.select("query_id", "chunk", F.lit(1).alias("label")), ["query_id", "chunk"], "left").na.fill(0, ["label"])
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return rows.withColumn("candidates", size.cast("double"))


def train(rows: DataFrame, columns: list[str], seed: int = 7):
    """A gradient-boosted regression on the label; predictions order a query's candidates."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    steps = [VectorAssembler(inputCols=columns, outputCol="vector"), GBTRegressor(featuresCol="vector", labelCol="label", predictionCol="score", maxIter=10, maxDepth=3, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def evaluate(model, rows: DataFrame) -> DataFrame:
    """hit@k, MRR and mean rank of the labelled candidates."""
    from spanquarry.operators.fusion import metrics, rank_within

    scored = rank_within(model.transform(rows).select("query_id", "chunk", "label", "score"), [F.desc("score")])
    best = scored.groupBy("query_id").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("rank"))
    return metrics(best, [])
