"""Exact re-ranking of candidate chunks (query_id, chunk) against a query's bytes or fragments.

``candidates`` are small: a shortlist of each query. They are joined with the chunks' bytes by key, so a chunk
travels once for each query that asks for it.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.functions.binary import byte_array, count_disjoint, count_overlapping, let, part
from spanquarry.sources.shared import saved

# Spans and block lengths of the comparisons.
SPAN, LADDER, PROBE, MIN_RUN, RUN_STEP = 192, (160, 128, 96, 64, 48, 32), 32, 16, 8


def _ordered(rows: DataFrame, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "chunk")))


def fragment_counts(candidates: DataFrame, chunks: DataFrame, fragments: DataFrame, overlapping: bool) -> DataFrame:
    """(query_id, chunk, present, total, least): how often a query's fragments occur in a candidate."""
    rows = candidates.select("query_id", "chunk").join(fragments, "query_id").join(chunks, "chunk")
    n = (count_overlapping if overlapping else count_disjoint)(F.col("raw"), F.col("fragment"))
    counted = rows.select("query_id", "chunk", n.alias("c"))
    sums = counted.groupBy("query_id", "chunk").agg(F.count(F.when(F.col("c") > 0, 1)).alias("present"), F.sum("c").alias("total"), F.coalesce(F.min(F.when(F.col("c") > 0, F.col("c"))), F.lit(0)).cast("bigint").alias("least"))
    return sums


def exact(candidates: DataFrame, chunks: DataFrame, fragments: DataFrame) -> DataFrame:
    """By fragments present and total disjoint occurrences."""
    return _ordered(fragment_counts(candidates, chunks, fragments, False), [F.desc("present"), F.desc("total")]).select("query_id", "chunk", "present", "total", "rank")


def exact_overlapping(candidates: DataFrame, chunks: DataFrame, fragments: DataFrame) -> DataFrame:
    """By present, least, total, then the shortlist's weighted and overlap."""
    counts = fragment_counts(candidates, chunks, fragments, True).join(candidates.select("query_id", "chunk", "weighted", "overlap"), ["query_id", "chunk"])
    return _ordered(counts, [F.desc(c) for c in ("present", "least", "total", "weighted", "overlap")])


def layout(chains: DataFrame, counts: DataFrame, scores: DataFrame) -> DataFrame:
    """By the best chain (length, smaller error and deviation), present, total, fewer chains and the score."""
    rows = counts.join(chains, ["query_id", "chunk"], "left").join(scores.select("query_id", "chunk", "score"), ["query_id", "chunk"], "left")
    zero = F.coalesce("best_length", F.lit(0))
    far = F.lit(10**9)
    rows = rows.select("query_id", "chunk", zero.alias("best_length"), F.when(zero > 0, F.col("gap_error")).otherwise(far).alias("gap_error"), F.when(zero > 0, F.col("gap_mad")).otherwise(far.cast("double")).alias("gap_mad"), "present", "total", F.coalesce("chains", F.lit(0)).alias("chains"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return _ordered(rows, [F.desc("best_length"), F.asc("gap_error"), F.asc("gap_mad"), F.desc("present"), F.desc("total"), F.asc("chains"), F.desc("score")])


def gap_layout(chains: DataFrame, counts: DataFrame) -> DataFrame:
    """By greedy chains: length, adjacent pairs, skips, smaller error, present, total."""
    rows = counts.join(chains, ["query_id", "chunk"], "left").na.fill(0, ["best_length", "skips", "gap_error"])
    rows = rows.withColumn("pairs", F.greatest(F.col("best_length") - 1, F.lit(0)))
    return _ordered(rows.select("query_id", "chunk", "best_length", "pairs", "skips", "gap_error", "present", "total"), [F.desc("best_length"), F.desc("pairs"), F.desc("skips"), F.asc("gap_error"), F.desc("present"), F.desc("total")])


def probes(fragments: DataFrame, queries: DataFrame, length: int = PROBE) -> DataFrame:
    """(query_id, probe): pieces in the middle of the gap after each fragment, and across its end."""
    after = F.lead("start").over(Window.partitionBy("query_id").orderBy("frag"))
    gaps = fragments.select("query_id", "frag", (F.col("start") + F.length("fragment")).alias("end"), after.alias("next")).filter("next IS NOT NULL")
    rows = gaps.join(queries, "query_id")
    middle = F.floor((F.col("end") + F.col("next")) / 2 - length / 2)
    bridge = F.col("end") - F.lit(length // 2)
    both = rows.select("query_id", F.explode(F.array(part(F.col("content"), middle, length), part(F.col("content"), bridge, length))).alias("probe"))
    return both.filter(F.length("probe") == length)


def by_probes(candidates: DataFrame, chunks: DataFrame, probes_: DataFrame) -> DataFrame:
    """(query_id, chunk, probe_hits, rank)."""
    rows = candidates.select("query_id", "chunk").join(chunks, "chunk").join(probes_, "query_id")
    hits = rows.groupBy("query_id", "chunk").agg(F.count(F.when(F.contains(F.col("raw"), F.col("probe")), 1)).alias("probe_hits"))
    return _ordered(hits, [F.desc("probe_hits")])


def _longest_prefix(raw: bytes, span: bytes) -> int:
    """The longest prefix of ``span`` in ``raw``: a prefix of a found prefix is found, so halving finds it."""
    lo, hi = 0, len(span)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if span[:mid] in raw else (lo, mid - 1)
    return lo


def phrase_spans(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, starts: list[int], span: int = SPAN) -> DataFrame:
    """(query_id, chunk, full_hits, best_longest, span_hits, rank) of long spans at the given starts."""

    @F.pandas_udf("full_hits bigint, best_longest bigint, span_hits bigint")
    def measured(raw: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for r, c in zip(raw, content, strict=True):
            spans = [bytes(c[a : a + span]) for a in starts if len(c) - a >= PROBE]
            lengths = [_longest_prefix(bytes(r), s) for s in spans]
            lengths = [n if n >= PROBE else 0 for n in lengths]
            out.append((sum(n == len(s) for n, s in zip(lengths, spans, strict=True)), max(lengths, default=0), sum(n >= max(PROBE, len(s) // 2) for n, s in zip(lengths, spans, strict=True))))
        return pd.DataFrame(out, columns=["full_hits", "best_longest", "span_hits"])

    rows = candidates.select("query_id", "chunk").join(chunks, "chunk").join(queries, "query_id")
    return _ordered(rows.select("query_id", "chunk", measured("raw", "content").alias("m")).select("query_id", "chunk", "m.*"), [F.desc(c) for c in ("full_hits", "best_longest", "span_hits")])


def union_length(intervals: list[tuple[int, int]]) -> int:
    """Bytes covered by half-open intervals."""
    total, reach = 0, None
    for a, b in sorted(intervals):
        start = a if reach is None or a > reach else reach
        total += max(0, b - start)
        reach = b if reach is None else max(reach, b)
    return total


def block_lengths(a: bytes, b: bytes) -> dict[str, int]:
    """The matching blocks of two byte strings: largest, top three, sums and counts of long ones, coverage."""
    blocks = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    sizes = sorted((m.size for m in blocks), reverse=True)
    return {
        "largest": max(sizes, default=0), "top3": sum(sizes[:3]), "sum32": sum(s for s in sizes if s >= 32), "sum64": sum(s for s in sizes if s >= 64),
        "n32": sum(s >= 32 for s in sizes), "n64": sum(s >= 64 for s in sizes), "cover32": union_length([(m.a, m.a + m.size) for m in blocks if m.size >= 32]),
    }


def by_blocks(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk, largest, top3, sum32, sum64, n32, n64, cover32, rank) of the whole query."""
    names = ["largest", "top3", "sum32", "sum64", "n32", "n64", "cover32"]

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names))
    def measured(raw: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([block_lengths(bytes(c), bytes(r)) for r, c in zip(raw, content, strict=True)], columns=names)

    rows = candidates.select("query_id", "chunk").join(chunks, "chunk").join(queries, "query_id")
    found = rows.select("query_id", "chunk", measured("raw", "content").alias("m")).select("query_id", "chunk", "m.*")
    return _ordered(found, [F.desc(c) for c in ("sum64", "top3", "largest", "cover32", "n64", "n32")])


def intervals_union(table: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, covered): total length of the union of [a, b) rows, by islands over running ends."""
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("b").over(w)
    fresh = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(reach, F.col("a"))), F.lit(0))
    return table.select(*keys, fresh.alias("fresh")).groupBy(*keys).agg(F.sum("fresh").cast("bigint").alias("covered"))


def byte_bag(query: Column, candidate: Column) -> Column:
    """The share of the query's bytes whose value occurs in the candidate."""
    bytes_ = byte_array(query)
    found = let(F.array_distinct(byte_array(candidate)), lambda kinds: F.size(F.filter(bytes_, lambda b: F.array_contains(kinds, b))))
    return found / F.greatest(F.lit(1), F.length(query))


def longest_runs(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk, best, count, total, rank): query pieces from every eighth byte that occur, 16 bytes at least."""

    @F.pandas_udf("best bigint, count bigint, total bigint")
    def measured(raw: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for r, c in zip(raw, content, strict=True):
            r, c = bytes(r), bytes(c)
            runs = [_longest_prefix(r, c[i:]) for i in range(0, max(1, len(c) - MIN_RUN + 1), RUN_STEP) if c[i : i + MIN_RUN] in r]
            out.append((max(runs, default=0), len(runs), sum(runs)))
        return pd.DataFrame(out, columns=["best", "count", "total"])

    rows = candidates.select("query_id", "chunk").join(chunks, "chunk").join(queries, "query_id")
    return _ordered(rows.select("query_id", "chunk", measured("raw", "content").alias("m")).select("query_id", "chunk", "m.*"), [F.desc("best"), F.desc("count"), F.desc("total")])


def compressed_delta(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk, delta, rank): bytes that zlib needs for the query with the candidate as dictionary.

    Stands for an external delta coder: smaller means more alike.
    """

    @F.pandas_udf("bigint")
    def measured(raw: pd.Series, content: pd.Series) -> pd.Series:
        import zlib

        def size(r: bytes, c: bytes) -> int:
            coder = zlib.compressobj(9, zdict=bytes(r)[-32768:]) if len(r) else zlib.compressobj(9)
            return len(coder.compress(bytes(c)) + coder.flush())

        return pd.Series([size(r, c) for r, c in zip(raw, content, strict=True)], dtype="int64")

    rows = candidates.select("query_id", "chunk").join(chunks, "chunk").join(queries, "query_id")
    return _ordered(rows.select("query_id", "chunk", measured("raw", "content").alias("delta")), [F.asc("delta")])


def max_sim(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, c, score): for (q, vec) tokens and (c, vec) tokens, each query token's best dot product, summed.

    Vectors are scaled to unit length. The best of a candidate's only token is its dot product, and the sum of these is
    one product with the sum of the query's tokens, so such candidates take no pairs of tokens and any number of
    query tokens. Only for candidates of several tokens ``queries`` are shipped and met one by one.
    """

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    a = queries.select("q", unit(F.col("vec")).alias("qv"))
    b = candidates.select("c", unit(F.col("vec")).alias("cv"))
    places = a.select("q", F.size("qv").alias("n"), F.posexplode_outer("qv").alias("k", "v")).groupBy("q", "n", "k").agg(F.sum("v").alias("v"))
    sums = places.groupBy("q", "n").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("s"))
    by_length = sums.groupBy("q").agg(F.map_from_entries(F.collect_list(F.when(F.col("n") >= 0, F.struct("n", F.transform("s", lambda x: x["v"]))))).alias("s"))

    def of_one(rows: DataFrame) -> DataFrame:
        met = rows.crossJoin(F.broadcast(by_length))
        return met.select("q", "c", F.round(dot(F.try_element_at("s", F.size("cv")), F.col("cv")), 6).alias("score"))

    several = saved(candidates.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("c").alias("of")), "several")
    if several.isEmpty():
        return of_one(b)
    own = b["c"].eqNullSafe(several["of"])
    pairs = b.join(several, own, "left_semi").join(F.broadcast(a.withColumn("token", F.monotonically_increasing_id())), F.lit(True))
    best = pairs.groupBy("q", "token", "c").agg(F.max(dot(F.col("qv"), F.col("cv"))).alias("m"))
    return of_one(b.join(several, own, "left_anti")).unionByName(best.groupBy("q", "c").agg(F.round(F.sum("m"), 6).alias("score")))
