"""Joins of fragment occurrences at fixed or tolerated distances.

``hits`` has query_id, frag, start (of the fragment in the query), doc_id, doc_offset and chunk. Two fragments
of a query agree in a document if doc_offset - start is the same for both, so all pairs of a template come
from one equality join on (query, document, that difference).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.sources.shared import saved

# The distance of neighbouring fragments, its tolerance, the shortest chain and the scan limit.
DISTANCE, TOLERANCE, LEAST_CHAIN, MOST_SCANNED = 176, 32, 3, 20_000


def pairs(hits: DataFrame, most_scanned: int = MOST_SCANNED, template: DataFrame | None = None) -> DataFrame:
    """(query_id, i, j, chunk, hits): agreeing places of fragments i < j by the chunk of i.

    Fragments i of more than ``most_scanned`` occurrences are left out. ``template`` (i, j) restricts pairs.
    """
    hits = saved(hits, "hits")
    anchored = hits.withColumn("anchor", F.col("doc_offset") - F.col("start"))
    counts = hits.groupBy("query_id", "frag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_scanned).select("query_id", F.col("frag"))
    a = anchored.join(counts, ["query_id", "frag"], "left_semi").select("query_id", "doc_id", "anchor", "chunk", F.col("frag").alias("i"))
    b = anchored.select("query_id", "doc_id", "anchor", F.col("frag").alias("j"))
    met = a.join(b, ["query_id", "doc_id", "anchor"]).filter(F.col("i") < F.col("j"))
    if template is not None:
        met = met.join(F.broadcast(template), ["i", "j"], "left_semi")
    return met.groupBy("query_id", "i", "j", "chunk").agg(F.count(F.lit(1)).alias("hits"))


def support(paired: DataFrame) -> DataFrame:
    """(query_id, chunk, gap_support, raw_support, rank): pairs that hit, then hits."""
    sums = paired.groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("gap_support"), F.sum("hits").alias("raw_support"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gap_support"), F.desc("raw_support"), "chunk")))


def variable_fragments(queries: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, template, frag, start, fragment): fragments of the templates' lengths (template, frag, length),
    128 bytes between one and the next."""
    before = F.coalesce(F.sum(F.col("length") + 128).over(Window.partitionBy("template").orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lengths.withColumn("start", before)
    rows = queries.join(F.broadcast(placed), F.length("content") >= F.col("start") + F.col("length"))
    return rows.select("query_id", "template", "frag", F.col("start").cast("bigint").alias("start"), F.substring("content", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("fragment"))


def median_deviation(values: Column) -> Column:
    """The median absolute deviation of an array of numbers; null of none."""

    def median(x: Column) -> Column:
        s, n = F.array_sort(x), F.size(x)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0

    return median(F.transform(values, lambda v: F.abs(v - median(values))))


def _best_chain(lists: list[list[int]], distance: int, tolerance: int, least: int) -> tuple[int, list[int]]:
    """The number of chains from the first fragment on, as far as any fragment extends one, and the best of them.

    Places carry counts and the least error from there on, never chains. Among the chains of the least error only
    one for each place and collection of gaps is followed, since those decide the deviation.
    """

    def reach(place: int, table: list[int]) -> list[int]:
        low = max(place + distance - tolerance, place + 1)
        return table[bisect_left(table, low) : bisect_right(table, place + distance + tolerance)]

    levels = [{p: 1 for p in lists[0]}] if lists and lists[0] else []
    for table in lists[1:]:
        counts: dict[int, int] = {}
        for place, n in levels[-1].items() if levels else ():
            for q in reach(place, table):
                counts[q] = counts.get(q, 0) + n
        if not counts:
            break
        levels.append(counts)
    if len(levels) < max(least, 1):
        return 0, []
    left = [dict.fromkeys(levels[-1], 0)]  # the least error from a place to the last level
    for depth in range(len(levels) - 2, -1, -1):
        costs = {p: [abs(q - p - distance) + left[0][q] for q in reach(p, lists[depth + 1]) if q in left[0]] for p in levels[depth]}
        left.insert(0, {p: min(c) for p, c in costs.items() if c})
    error = min(left[0].values())
    open_: dict[tuple, list[int]] = {(p, ()): [p] for p in sorted(left[0]) if left[0][p] == error}
    for depth in range(len(levels) - 1):
        grown: dict[tuple, list[int]] = {}
        for (p, gaps), chain in open_.items():
            for q in reach(p, lists[depth + 1]):
                if q in left[depth + 1] and abs(q - p - distance) + left[depth + 1][q] == left[depth][p]:
                    key, longer = (q, tuple(sorted((*gaps, q - p)))), [*chain, q]
                    grown[key] = min(grown.get(key, longer), longer)
        open_ = grown
    best = min(open_.items(), key=lambda x: (_mad(list(x[0][1])), x[1]))[1]
    return min(sum(levels[-1].values()), (1 << 63) - 1), best


def _greedy(lists: list[list[int]], distance: int, tolerance: int) -> list[list[int]]:
    """One chain from each first place, by the next place nearest to the distance."""
    out = []
    for p in lists[0] if lists else []:
        chain = [p]
        for places in lists[1:]:
            near = [(abs(x - chain[-1] - distance), x) for x in places if x > chain[-1] and abs(x - chain[-1] - distance) <= tolerance]
            if not near:
                break
            chain.append(min(near)[1])
        out.append(chain)
    return out


def _mad(x: list[int]) -> float:
    return float(np.median(np.abs(np.array(x) - np.median(x)))) if x else 0.0


def _cost(chain: list[int], distance: int) -> tuple[int, float]:
    """The sum of the gaps' errors and their median absolute deviation."""
    gaps = [b - a for a, b in pairwise(chain)]
    return sum(abs(g - distance) for g in gaps), _mad(gaps)


def chains(hits: DataFrame, fragments: int, greedy: bool = False, distance: int = DISTANCE, tolerance: int = TOLERANCE, least: int = LEAST_CHAIN) -> DataFrame:
    """(query_id, chunk, chains, best_length, gap_error, gap_mad, skips): the best chain of each chunk, by length,
    then smaller error, then smaller deviation. ``skips`` are the best chain's pairs of fragments further apart
    that also keep their distance within the tolerance of as many gaps."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lists = [sorted(rows.loc[rows.frag == f, "doc_offset"]) for f in range(fragments)]
        if greedy:
            found = [c for c in _greedy(lists, distance, tolerance) if len(c) >= least]
            count, best = len(found), min(found, key=lambda c: (-len(c), *_cost(c, distance), c), default=[])
        else:
            count, best = _best_chain(lists, distance, tolerance, least)
        error, mad = _cost(best, distance)
        skips = sum(abs(best[j] - best[i] - distance * (j - i)) <= tolerance * (j - i) for i in range(len(best)) for j in range(i + 2, len(best)))
        return pd.DataFrame({"query_id": [key[0]], "chunk": [key[1]], "chains": [count], "best_length": [len(best)], "gap_error": [error], "gap_mad": [mad], "skips": [skips]})

    return hits.groupBy("query_id", "chunk").applyInPandas(run, "query_id bigint, chunk bigint, chains bigint, best_length bigint, gap_error bigint, gap_mad double, skips bigint")


def repeat_distances(grams: DataFrame) -> DataFrame:
    """(doc_id, sig, distance) between consecutive places (doc_id, pos, sig) of the same gram."""
    following = F.lead("pos").over(Window.partitionBy("doc_id", "sig").orderBy("pos"))
    return grams.withColumn("distance", following - F.col("pos")).filter("distance IS NOT NULL").select("doc_id", "sig", "distance")
