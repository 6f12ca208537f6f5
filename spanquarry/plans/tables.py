"""The tables that the registered queries run over, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.functions.binary import utf8
from spanquarry.sources.corpus import from_table

#: Patterns beside the first 20 characters of every benchmark item.
FIXED = [(1000, "the"), (1001, "tion"), (1002, "é"), (1003, "zzqx"), (1004, "ing")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a corpus of short documents."""
    return from_table(table(spark, sf_dir, "benchmark"), "item_id", "text")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("query_id"), utf8(F.substring("text", 1, 20)).alias("pattern"))
    fixed = spark.createDataFrame([(i, p.encode()) for i, p in FIXED], "query_id bigint, pattern binary")
    return head.unionByName(fixed)


def short_patterns(spark: SparkSession) -> DataFrame:
    """Patterns of one to three bytes, for the suffix tables."""
    return spark.createDataFrame([(i, p.encode()) for i, p in enumerate(("e", "th", "er", "the", "zz"))], "query_id bigint, pattern binary")


PAT = "pat AS (SELECT item_id::BIGINT AS query_id, left(text, 20) AS p FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{p}')" for i, p in FIXED) + "))"
DOC = "d AS (SELECT doc_id, text, lower(hex(encode(text))) AS hx, strlen(text)::BIGINT AS n FROM documents)"
#: No pattern overlaps itself, so splitting finds all its places.
OCC = (
    "sp AS (SELECT query_id, doc_id, p, string_split(text, p) AS ps FROM d JOIN pat ON contains(text, p)), "
    "u AS (SELECT query_id, doc_id, p, len(ps) AS np, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM sp), "
    "occ AS (SELECT query_id, doc_id, doc_offset FROM (SELECT query_id, doc_id, k, np, (sum(strlen(piece)) OVER (PARTITION BY query_id, doc_id ORDER BY k) + (k-1)*strlen(p))::BIGINT AS doc_offset FROM u) WHERE k < np)"
)
LOCATE = f"WITH {PAT}, {DOC}, {OCC} "
SUF = """d AS (SELECT item_id AS doc_id, lower(hex(encode(text))) AS hx, strlen(text)::BIGINT AS n FROM benchmark),
s AS (SELECT doc_id, hx, n, unnest(range(n+1))::BIGINT AS off FROM d),
t AS (SELECT doc_id, n, off, substr(hx, 2*off+1) AS suffix, CASE WHEN off = 0 THEN 256 ELSE ('0x' || substr(hx, 2*off-1, 2))::INT END AS bwt FROM s),
sfx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY suffix) - 1 AS sa_row FROM t)"""
#: The first three bytes of every suffix of every document, enough to place patterns of up to three bytes.
PRE = """b AS (SELECT doc_id, unnest(x) AS y, unnest(range(len(x)))::BIGINT AS off FROM (SELECT doc_id, regexp_extract_all(lower(hex(encode(text))), '..') AS x FROM documents)),
pre AS (SELECT doc_id, off, y || coalesce(lead(y) OVER w, '') || coalesce(lead(y, 2) OVER w, '') AS head FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY off) UNION ALL SELECT doc_id, strlen(text)::BIGINT, '' FROM documents)"""
SHORT = "pat AS (SELECT * FROM (VALUES (0,'e'),(1,'th'),(2,'er'),(3,'the'),(4,'zz')) v(query_id, p))"
