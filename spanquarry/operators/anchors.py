"""Retrieval by rare anchors: windows of a query, the chunks in which they occur, and an outcome.

``queries`` has query_id and content, ``corpus`` doc_id and content. A chunk is (doc_id, chunk number) as one
number, ``doc_id * CHUNKS_PER_DOC + offset div CHUNK``. Windows without enough entropy are no anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.functions.binary import entropy, part, starts
from spanquarry.operators import match
from spanquarry.operators.match import flip
from spanquarry.sources.shared import saved

CHUNK = 16384
CHUNKS_PER_DOC = 1 << 20

# The retrieval's defaults.
FRAGMENT, STEP, MOST_WINDOWS, PICK, LEAST_ENTROPY, NON_SELECTIVE, LIMIT, LONGEST = 48, 64, 64, 3, 2.0, 16, 100, 1048576


def windows(queries: DataFrame, length: int = FRAGMENT, step: int = STEP, most: int = MOST_WINDOWS) -> DataFrame:
    """(query_id, start, fragment): the first ``most`` windows of a query."""
    at = F.slice(starts(F.length("content"), length, step), 1, most)
    return queries.select("query_id", F.explode(at).alias("start"), "content").select("query_id", F.col("start").cast("bigint").alias("start"), part(F.col("content"), F.col("start"), length).alias("fragment"))


def anchors(queries: DataFrame, least_entropy: float = LEAST_ENTROPY, **given) -> DataFrame:
    """Windows with their ``entropy`` that carry enough of it."""
    return windows(queries, **given).withColumn("entropy", entropy(F.col("fragment"))).filter(F.col("entropy") >= least_entropy)


def chunk_id(doc_id: Column, offset: Column, size: int = CHUNK) -> Column:
    return doc_id * CHUNKS_PER_DOC + F.floor(offset / size)


def anchor_hits(anchors_: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, start, doc_id, doc_offset, chunk) of every occurrence of every anchor."""
    named = anchors_.withColumn("key", F.struct("query_id", "start"))
    found = match.locate(corpus, named.select(F.col("key").alias("query_id"), F.col("fragment").alias("pattern")))
    found = found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.start").alias("start"), "doc_id", "doc_offset")
    return found.select("query_id", "start", "doc_id", "doc_offset", chunk_id(F.col("doc_id"), F.col("doc_offset")).alias("chunk"))


def picked(anchors_: DataFrame, hits: DataFrame, pick: int = PICK) -> DataFrame:
    """The ``pick`` rarest anchors of a query, (hits, start) ascending; anchors that miss come first."""
    counts = hits.groupBy("query_id", "start").agg(F.count(F.lit(1)).alias("hits"))
    all_ = anchors_.select("query_id", "start").join(counts, ["query_id", "start"], "left").select("query_id", "start", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("hits", "start"))
    return all_.withColumn("rank", rank).filter(F.col("rank") <= pick)


def shortlist(picked_: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, chunk): the union of the picked anchors' chunks."""
    return hits.join(picked_.select("query_id", "start"), ["query_id", "start"], "left_semi").select("query_id", "chunk").distinct()


def votes(hits: DataFrame, least: int) -> DataFrame:
    """(query_id, chunk, votes): chunks that at least ``least`` different anchors hit."""
    counted = hits.select("query_id", "chunk", "start").distinct().groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("votes"))
    return counted.filter(F.col("votes") >= least)


def retrieve(queries: DataFrame, corpus: DataFrame, length: int = FRAGMENT, most_hits: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(query_id, outcome, reason, candidates, truncated, chunks) of every query.

    With ``most_hits`` an anchor of more occurrences makes the query NON_SELECTIVE with a reason.
    """
    found = saved(anchors(queries, length=length), "anchors")
    hits = saved(anchor_hits(found, corpus), "anchor-hits")
    ranked = saved(picked(found, hits, MOST_WINDOWS), "ranked")
    chosen = ranked.filter(F.col("rank") <= PICK)
    sums = ranked.groupBy("query_id").agg(
        F.count(F.when(F.col("rank") <= PICK, 1)).alias("k"), F.min("hits").alias("least"), F.max(F.when(F.col("rank") <= PICK, F.col("hits"))).alias("most"), F.max("hits").alias("any")
    )
    # a query's candidates are counted by chunk; only the first ones of it, in order, become a list
    met = saved(hits.join(chosen.select("query_id", "start"), ["query_id", "start"], "left_semi").groupBy("query_id", "chunk").agg(F.countDistinct("start").alias("p")), "candidates")
    counts = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("placed"))
    first = match.bounded(met.select("query_id", "chunk"), limit, ["chunk"]).groupBy("query_id").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    rows = queries.select("query_id", F.length("content").alias("len"))
    for other in (sums, counts, first):
        rows = rows.join(other, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    wide = F.lit(False) if most_hits is None else F.col("most") > most_hits
    outcome = (
        F.when(F.col("len") == 0, "EMPTY_QUERY").when(F.col("len") > LONGEST, "QUERY_TOO_LONG").when(F.col("len") < length, "TOO_SHORT")
        .when(F.col("k").isNull(), "NON_SELECTIVE").when(F.col("any") == 0, "NO_HIT").when(wide, "NON_SELECTIVE").when(n == 0, "NO_HIT").when(F.col("least") == 0, "INVALID_PARTIAL_HIT")
        .when(n > NON_SELECTIVE, "NON_SELECTIVE").when((n == 1) & (F.col("placed") == F.col("k")), "EXACT_UNIQUE").otherwise("EXACT_MULTI")
    )
    return rows.select("query_id", outcome.alias("outcome"), F.when(wide, "RANGE_TOO_WIDE").alias("reason"), n.cast("bigint").alias("candidates"), (n > limit).alias("truncated"), F.coalesce("chunks", F.array().cast("array<bigint>")).alias("chunks"))


def perturbed(queries: DataFrame) -> DataFrame:
    """Queries with the lowest bit of their middle byte flipped."""
    return queries.withColumn("content", flip(F.col("content"), F.floor(F.length("content") / 2).cast("int")))
