"""Queries that arrive as a stream, answered against a fixed corpus.

Each query is answered by itself (append mode, no state): the stream is joined with the corpus, so a batch of
queries costs one pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.functions.binary import count_overlapping, hex_status
from spanquarry.operators import match


def read_queries(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """(query, hex) of text files that appear in a folder, a query a line."""
    lines = spark.readStream.text(path).select(F.trim("value").alias("query")).filter("query <> ''")
    return lines.withColumn("hex", F.lower(F.hex(F.encode("query", charset))))


def answers(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(hex, doc_id, match_count) of documents with a match; refused patterns give no rows."""
    good = queries.filter(hex_status(F.col("hex")) == "OK").withColumn("pattern", F.unhex("hex"))
    met = good.join(corpus.select("doc_id", "content"), F.contains(F.col("content"), F.col("pattern")))
    return met.select("hex", "doc_id", count_overlapping(F.col("content"), F.col("pattern")).alias("match_count"))


def write_answers(queries: DataFrame, corpus: DataFrame, out: str, checkpoint: str, most: int = 100):
    """Starts a stream that appends a summary row a query and batch to ``out``."""

    def batch(rows: DataFrame, number: int) -> None:
        good = rows.filter(hex_status(F.col("hex")) == "OK").select("hex").distinct()
        patterns = good.select(F.col("hex").alias("query_id"), F.unhex("hex").alias("pattern"))
        match.query_result(corpus, patterns, most).withColumnRenamed("query_id", "hex").withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
