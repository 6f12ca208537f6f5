"""Scored shortlists of chunks for queries of several fragments, from signature indexes.

``fragments`` has query_id, frag and fragment. Each ranking is a join of the fragments' signatures with an
index and two levels of sums: by (query, chunk, fragment), then by (query, chunk). Ranks begin at 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.functions.binary import part
from spanquarry.operators import signatures as S
from spanquarry.sources.shared import saved

# The fragments of a query and the weights of the scores.
FRAGMENTS, FRAGMENT, GAP = 5, 48, 128
W_RARE, W_DENSE, W_MINIMIZER, W_ADJACENT, W_BALANCE = 5.0, 2.0, 0.3, 3.0, 2.0


def fragments(queries: DataFrame, count: int = FRAGMENTS, length: int = FRAGMENT, gap: int = GAP, base: int = 0) -> DataFrame:
    """(query_id, frag, start, fragment): ``count`` fragments ``length + gap`` bytes apart, those that fit."""
    rows = queries.select("query_id", "content", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("frag"))
    rows = rows.withColumn("start", (F.lit(base) + F.col("frag") * (length + gap)).cast("bigint")).filter(F.col("start") + length <= F.length("content"))
    return rows.select("query_id", "frag", "start", part(F.col("content"), F.col("start"), length).alias("fragment"))


def signatures_of(frags: DataFrame, stride: int = 1, distinct: bool = False, length: int = S.LENGTH) -> DataFrame:
    """(query_id, frag, sig) of the fragments."""
    found = S.grams(frags, length, stride, ("query_id", "frag"), "fragment").select("query_id", "frag", "sig")
    return found.distinct() if distinct else found


def ranked(scored: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each query in ``order`` (chunk last), with ``rank``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "chunk"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def _by_fragment(sigs: DataFrame, index: DataFrame, *sums: Column) -> DataFrame:
    return sigs.join(index, "sig").groupBy("query_id", "chunk", "frag").agg(*sums)


def overlap(frags: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """Distinct shared signatures, then their counts."""
    sigs = signatures_of(frags, S.STRIDE, True).select("query_id", "sig").distinct()
    scored = sigs.join(index, "sig").groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("overlap"), F.sum("cnt").alias("weighted"))
    return ranked(scored, [F.desc("overlap"), F.desc("weighted")], top)


def voting(frags: DataFrame, index: DataFrame, top: int, stride: int = S.STRIDE) -> DataFrame:
    """Fragments present, then votes: total, largest and least."""
    votes = _by_fragment(signatures_of(frags, stride), index, F.sum("cnt").alias("v"))
    scored = votes.groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("present"), F.sum("v").alias("total"), F.max("v").alias("most"), F.min("v").alias("least"))
    return ranked(scored, [F.desc(c) for c in ("present", "total", "most", "least")], top)


def idf(df: Column, chunks: int) -> Column:
    return F.log(1.0 + F.lit(float(chunks)) / F.greatest(F.lit(1), df))


def rare_anchors(frags: DataFrame, index: DataFrame, chunks: int, top: int, stride: int = S.RARE_STRIDE, most_df: int | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Fragments present, matches, and their weight cnt * ln(1 + N / df). ``tokens`` replaces the q-grams."""
    sigs = tokens if tokens is not None else signatures_of(frags, stride, True)
    used = index if most_df is None else index.filter(F.col("df") <= most_df)
    votes = _by_fragment(sigs, used, F.count(F.lit(1)).alias("v"), F.sum(F.col("cnt") * idf(F.col("df"), chunks)).alias("w"))
    scored = votes.groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("present"), F.sum("v").alias("matches"), F.round(F.sum("w"), 6).alias("weighted"), F.max("v").alias("most"), F.min("v").alias("least"))
    return ranked(scored, [F.desc(c) for c in ("present", "matches", "weighted", "most", "least")], top)


def minimizer_tokens(frags: DataFrame) -> DataFrame:
    return S.minimizers(frags, keys=("query_id", "frag"), raw="fragment").select("query_id", "frag", "sig").distinct()


def evidence(frags: DataFrame, dense: DataFrame, rare: DataFrame) -> DataFrame:
    """(query_id, chunk, frag, dense, rare, matches): by fragment, signatures at every offset."""
    sigs = signatures_of(frags)
    d = _by_fragment(sigs, dense.select("chunk", "sig", "cnt"), F.sum("cnt").alias("dense"))
    r = _by_fragment(sigs, rare, F.sum(F.col("cnt") / (F.col("df") + 1.0)).alias("rare"), F.count(F.lit(1)).alias("matches"))
    return saved(d.join(r, ["query_id", "chunk", "frag"], "full_outer"), "evidence")  # rankings read it several times


def hybrid(found: DataFrame) -> DataFrame:
    """(query_id, chunk, rare_present, dense_present, rare_score, dense_total, rare_matches) of ``evidence``."""
    return found.groupBy("query_id", "chunk").agg(
        F.count("rare").alias("rare_present"), F.count("dense").alias("dense_present"), F.round(F.coalesce(F.sum("rare"), F.lit(0.0)), 6).alias("rare_score"),
        F.coalesce(F.sum("dense"), F.lit(0)).alias("dense_total"), F.coalesce(F.sum("matches"), F.lit(0)).alias("rare_matches"),
    )


def hybrid_lexicographic(found: DataFrame, top: int) -> DataFrame:
    return ranked(hybrid(found), [F.desc(c) for c in ("rare_present", "dense_present", "rare_score", "dense_total", "rare_matches")], top)


def weighted_score() -> Column:
    return F.col("rare_present") * W_RARE + F.col("dense_present") * W_DENSE + F.col("rare_score")


def hybrid_weighted(found: DataFrame, top: int) -> DataFrame:
    scored = hybrid(found).select("query_id", "chunk", F.round(weighted_score(), 6).alias("score"))
    return ranked(scored, [F.desc("score")], top)


def with_minimizers(found: DataFrame, frags: DataFrame, index: DataFrame, chunks: int, top: int, most_df: int = 64) -> DataFrame:
    """The weighted score and 0.3 times the minimizers' weight."""
    bonus = minimizer_tokens(frags).join(index.filter(F.col("df") <= most_df), "sig").groupBy("query_id", "chunk").agg(F.sum(F.col("cnt") * idf(F.col("df"), chunks)).alias("bonus"))
    both = hybrid(found).join(bonus, ["query_id", "chunk"], "full_outer").na.fill(0)
    return ranked(both.select("query_id", "chunk", F.round(weighted_score() + F.col("bonus") * W_MINIMIZER, 6).alias("score")), [F.desc("score")], top)


def with_proximity(found: DataFrame, top: int) -> DataFrame:
    """The weighted score, 3 for each pair of adjacent fragments and 2 times the balance of strengths."""
    strength = F.coalesce("dense", F.lit(0)) + F.coalesce("rare", F.lit(0.0))
    prior = F.lag("frag").over(Window.partitionBy("query_id", "chunk").orderBy("frag"))
    marked = found.withColumn("strength", strength).withColumn("adjacent", (prior == F.col("frag") - 1).cast("int"))
    extra = marked.groupBy("query_id", "chunk").agg(F.coalesce(F.sum("adjacent"), F.lit(0)).alias("adjacent"), F.when(F.count(F.lit(1)) > 1, F.min("strength") / F.max("strength")).otherwise(0.0).alias("balance"))
    scored = hybrid(found).join(extra, ["query_id", "chunk"])
    score = weighted_score() + F.col("adjacent") * W_ADJACENT + F.col("balance") * W_BALANCE
    return ranked(scored.select("query_id", "chunk", F.round(score, 6).alias("score")), [F.desc("score")], top)


def dense_only(found: DataFrame, top: int) -> DataFrame:
    scored = hybrid(found).filter("dense_present > 0").select("query_id", "chunk", F.round(F.col("dense_present") * 10.0 + F.col("dense_total") * 0.01, 6).alias("score"))
    return ranked(scored, [F.desc("score")], top)


def rare_only(found: DataFrame, top: int) -> DataFrame:
    scored = hybrid(found).filter("rare_present > 0").select("query_id", "chunk", F.round(F.col("rare_present") * 10.0 + F.col("rare_score"), 6).alias("score"))
    return ranked(scored, [F.desc("score")], top)


def branch_union(dense_: DataFrame, rare_: DataFrame, top: int) -> DataFrame:
    """Chunks of both shortlists (by chunk), then those of the rare one alone, then of the dense one alone."""
    both = dense_.select("query_id", "chunk", F.col("rank").alias("d")).join(rare_.select("query_id", "chunk", F.col("rank").alias("r")), ["query_id", "chunk"], "full_outer")
    tier = F.when(F.col("d").isNotNull() & F.col("r").isNotNull(), 0).when(F.col("r").isNotNull(), 1).otherwise(2)
    keyed = both.select("query_id", "chunk", tier.alias("tier"), F.when(tier == 0, 0).when(tier == 1, F.col("r")).otherwise(F.col("d")).alias("within"))
    return ranked(keyed, ["tier", "within"], top).select("query_id", "chunk", "tier", "rank")


def coarse_gate(frags: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """By the number of distinct shared signatures."""
    sigs = signatures_of(frags, S.STRIDE, True).select("query_id", "sig").distinct()
    scored = sigs.join(index, "sig").groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("overlap"))
    return ranked(scored, [F.desc("overlap")], top)


def coarse_gate_weighted(frags: DataFrame, index: DataFrame, chunks: int, top: int) -> DataFrame:
    """By 10 for each fragment hit and the signatures' ln(1 + N / df)."""
    votes = _by_fragment(signatures_of(frags, S.STRIDE, True), index, F.sum(idf(F.col("df"), chunks)).alias("i"))
    sums = votes.groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("coverage"), F.round(F.sum("i"), 6).alias("idf_sum"))
    scored = sums.withColumn("score", F.round(F.col("coverage") * 10.0 + F.col("idf_sum"), 6))
    return ranked(scored, [F.desc("score"), F.desc("coverage"), F.desc("idf_sum")], top)


def gated(found: DataFrame, allowed: DataFrame, top: int) -> DataFrame:
    """The weighted shortlist among allowed (query_id, chunk)."""
    return hybrid_weighted(found.join(allowed.select("query_id", "chunk"), ["query_id", "chunk"], "left_semi"), top)


def histogram(hits: DataFrame, weight: Column, top: int) -> DataFrame:
    """(query_id, chunk, score): occurrences of fragments summed by weight."""
    scored = hits.groupBy("query_id", "chunk").agg(F.round(F.sum(weight), 6).alias("score")).filter("score > 0")
    return ranked(scored, [F.desc("score")], top)


def fusion(hits: DataFrame, chunks: int, top: int) -> DataFrame:
    """Fragments' occurrences (query_id, frag, chunk) fused: presence, idf, least, weighted total, balance, total."""
    counts = saved(hits.groupBy("query_id", "frag", "chunk").agg(F.count(F.lit(1)).alias("v")), "fragment-counts")
    widths = counts.groupBy("query_id", "frag").agg(F.count(F.lit(1)).alias("width"))
    rows = counts.join(widths, ["query_id", "frag"]).withColumn("w", idf(F.col("width"), chunks))
    scored = rows.groupBy("query_id", "chunk").agg(
        F.count(F.lit(1)).alias("present"), F.round(F.sum("w"), 6).alias("presence"), F.min("v").alias("least"), F.round(F.sum(F.col("v") * F.col("w")), 6).alias("weighted"),
        F.round(F.min("v") / F.max("v"), 6).alias("balance"), F.sum("v").alias("total"),
    )
    return ranked(scored, [F.desc(c) for c in ("present", "presence", "least", "weighted", "balance", "total")], top)


def confidence(fused: DataFrame, count: int = FRAGMENTS) -> DataFrame:
    """(query_id, chunk, confidence, label) of the first row of each fused query."""
    parts = ((0.45, F.col("present") / count), (0.25, F.least(F.lit(1.0), F.col("least") / 4.0)), (0.20, F.least(F.lit(1.0), F.col("weighted") / (count * 10.0))), (0.10, F.col("balance")))
    raw = F.round(reduce(lambda a, b: a + b, (x * w for w, x in parts)), 6)
    label = F.when(raw >= 0.88, "high").when(raw >= 0.68, "medium").otherwise("low")
    return fused.filter("rank = 1").select("query_id", "chunk", raw.alias("confidence"), label.alias("label"))


def pair_conjunction(frags: DataFrame, index: DataFrame, top: int, signatures: int = 16, pairs: int = 128, stride: int = S.STRIDE) -> DataFrame:
    """Chunks by the pairs, then the number, of a query's rarest signatures that they hold."""
    sigs = aligned(frags, stride).join(index.select("sig", "df").distinct(), "sig")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "sig"))
    few = sigs.withColumn("r", rank).filter(F.col("r") <= signatures)
    held = few.join(index.select("sig", "chunk"), "sig")
    # the number of the pair (i, j) of n signatures in the order of combinations
    n = F.least(F.max("r").over(Window.partitionBy("query_id")), F.lit(signatures))
    own = few.withColumn("n", n).select("query_id", "r", "n").distinct()
    a = held.join(own, ["query_id", "r"]).select("query_id", "chunk", F.col("r").alias("i"), "n")
    b = held.select("query_id", "chunk", F.col("r").alias("j"))
    place = (F.col("i") - 1) * F.col("n") - (F.col("i") - 1) * F.col("i") / 2 + (F.col("j") - F.col("i"))
    paired = a.join(b, ["query_id", "chunk"]).filter((F.col("i") < F.col("j")) & (place <= pairs)).groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("pairs"))
    singles = held.groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("singles"))
    scored = singles.join(paired, ["query_id", "chunk"], "left").select("query_id", "chunk", F.coalesce("pairs", F.lit(0)).alias("pairs"), "singles")
    return ranked(scored, [F.desc("pairs"), F.desc("singles")], top)


def aligned(frags: DataFrame, stride: int = S.STRIDE) -> DataFrame:
    """(query_id, sig): distinct signatures at offsets of the query that the index's stride can meet."""
    found = S.grams(frags, keys=("query_id", "frag", "start"), raw="fragment", stride=1)
    return found.filter((F.col("start") + F.col("pos")) % stride == 0).select("query_id", "sig").distinct()


def missed_frequencies(frags: DataFrame, index: DataFrame, ranks: DataFrame, top: int) -> DataFrame:
    """(query_id, n, least, median, most): document frequencies of the signatures of queries whose own chunk
    (rank in ``ranks``) is not among the first ``top``."""
    missed = frags.select("query_id").distinct().join(ranks.filter(F.col("rank") <= top), "query_id", "left_anti")
    found = aligned(frags).join(missed, "query_id").join(index.select("sig", "df").distinct(), "sig")
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("least"), F.percentile("df", 0.5).alias("median"), F.max("df").alias("most"))
