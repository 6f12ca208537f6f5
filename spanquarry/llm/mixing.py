"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its share of the tokens (words) to the power of an exponent, normalised. The exponent
is bisected, 2**5 parts at a time, to the largest one whose weights have the target entropy (a share of the
entropy of equal weights), then raised if need be until no source is passed more than ``most_passes`` times
as often as the least repeated one. Each step is one aggregation over the table of sources, of which only
the 33 tried exponents' figures come to the driver.

The weights are realised as passes over each source. A pass is a permutation of its documents by a hash of
id and pass; whole passes take all documents, the last one those that begin within what is left of the
source's budget. A document's place in its source's stream, as a share of the source's budget, is its place
in the mixture; the mixture is cut into blocks of ``block_tokens``, so every block holds every source in its
weight, and within a block the order is by the same hash. By default the budget is the least with which
every document appears at least once, so mixing repeats documents of small sources and drops none.

Places come from token sums of hash buckets of about ``BUCKET_ROWS`` rows and from sums within buckets, so a
source with a third of all rows is spread over many tasks. Rows of one source that are equal in id and size are
counted first and are one row in all sums; they are dealt out again at the end, one after the other along the
mixture, so neither a sum nor a block holds them all.

Defined cases: a null source is the source of the empty name, a null text has no tokens; documents without
tokens and sources without tokens appear in whole passes only; equal hashes are ordered by id, nulls first;
of rows that repeat an id and size, the last pass takes all or none, and those without tokens go to one
block after the other, ``BUCKET_ROWS`` to each; other columns of any name are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.llm.storage import Scratch

ENTROPY = 0.97
MOST_PASSES = 2.0
BLOCK_TOKENS = 1 << 20
BUCKET_ROWS = 4096
PARTS = 32
ROUNDS = 6
BITS = 28
WHITE = "[\\x09-\\x0D\\x20]+"


def tokens(text: Column) -> Column:
    """The number of words of a text: runs other than ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("bigint")


def place(id_: Column, turn: Column) -> Column:
    """A number of ``BITS`` bits: a document's place in the permutation of a pass."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), turn.cast("string"))), 1, BITS // 4), 16, 10).cast("bigint")


def exponent(sources: DataFrame, entropy: float = ENTROPY, most_passes: float = MOST_PASSES) -> float:
    """The exponent for (source, t): bisected to the entropy target, within the limit on passes."""
    total = sources.agg(F.sum("t").alias("t"), F.count(F.when(F.col("t") > 0, 1)).alias("n"), F.max("t").alias("hi"), F.min(F.when(F.col("t") > 0, F.col("t"))).alias("lo")).first()
    if not total["t"] or total["n"] < 2:
        return 1.0
    target, ratio = entropy * math.log(total["n"]), math.log(total["hi"] / total["lo"])
    shares = sources.filter("t > 0").select(F.log(F.col("t") / F.lit(float(total["t"]))).alias("l"))

    def reached(low: float, high: float, keep) -> tuple[float, float]:
        tried = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
        grid = shares.select("l", F.explode(F.array(*map(F.lit, tried))).alias("a"))
        power = F.exp(F.col("a") * F.col("l"))
        sums = {r["a"]: r for r in grid.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("l")).alias("m")).collect()}
        good = [k for k, a in enumerate(tried) if keep(a, math.log(sums[a]["z"]) - sums[a]["m"] / sums[a]["z"])]
        k = min(max(good, default=0), PARTS - 1)
        return tried[k], tried[k + 1] if max(good, default=0) < PARTS else tried[PARTS]

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):  # entropy falls as the exponent grows
        low, high = reached(low, high, lambda a, h: h >= target)
    if high == 1.0:  # the target holds without flattening
        low = 1.0
    found = low
    if ratio > 0 and math.exp((1 - found) * ratio) > most_passes:
        lo, hi = found, 1.0
        for _ in range(60):  # passes fall as the exponent grows
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if math.exp((1 - mid) * ratio) > most_passes else (lo, mid)
        found = hi
    return round(found, 6)


def weigh(sources: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """(source, t, n, weight, quota): the weights at an exponent and each source's budget of tokens."""
    power = F.when(F.col("t") > 0, F.exp(F.lit(alpha) * F.log(F.col("t").cast("double")))).otherwise(0.0)
    with_power = sources.withColumn("power", power)
    sums = with_power.agg(F.sum("power").alias("z"), F.max(F.when(F.col("t") > 0, F.col("t") / F.col("power"))).alias("most")).first()
    z = sums["z"] or 1.0
    least = (sums["most"] or 0.0) * z
    weighed = with_power.withColumn("weight", F.col("power") / F.lit(z))
    quota = F.when(F.col("t") > 0, F.col("weight") * F.lit(float(least if budget is None else budget))).otherwise(0.0)
    return weighed.select("source", "t", "n", "weight", quota.alias("quota"))


def _sources(slim: DataFrame) -> DataFrame:
    return slim.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))


def _with_passes(weighed: DataFrame) -> DataFrame:
    """Whole passes (at least one over a source without tokens) and the tokens left for the last one."""
    whole = F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t") + 1e-9)).otherwise(1).cast("bigint")
    out = weighed.withColumn("whole", whole)
    left = F.when(F.col("t") > 0, F.col("quota") - F.col("whole") * F.col("t")).otherwise(0.0)
    return out.withColumn("left", F.when(left > F.col("t") * 1e-9, left).otherwise(0.0))


def _placed(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document in every pass, with the tokens before it: source, doc_id, n_tokens, m (equal rows), turn, u, before."""
    slim = slim.groupBy("source", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("m"))
    turns = F.sequence(F.lit(0).cast("bigint"), F.col("whole") - F.when(F.col("left") > 0, 0).otherwise(1))
    rows = slim.join(sources, "source").filter((F.col("whole") > 0) | (F.col("left") > 0)).withColumn("turn", F.explode(turns))
    rows = rows.withColumn("u", place(F.col("doc_id"), F.col("turn")))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.shiftright(F.col("u") * buckets, BITS))
    held = F.col("n_tokens") * F.col("m")
    sums = rows.groupBy("source", "turn", "bucket").agg(F.sum(held).alias("bt"))
    along = Window.partitionBy("source", "turn").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("source", "turn", "bucket", (F.sum("bt").over(along) - F.col("bt")).alias("base"))
    within = Window.partitionBy("source", "turn", "bucket").orderBy("u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inner", F.sum(held).over(within) - held)
    return rows.join(sums, ["source", "turn", "bucket"]).withColumn("before", F.col("base") + F.col("inner"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), tokens(F.col(text_col)).alias("n_tokens"))


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, entropy: float = ENTROPY, most_passes: float = MOST_PASSES, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, n_tokens, turn (pass, from 0), block and slot (place in the block, from 0) of the mixture."""
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.save(_slim(docs, id_col, text_col, source_col), "slim")
    sources = scratch.save(_sources(slim), "sources")
    weighed = scratch.save(_with_passes(weigh(sources, exponent(sources, entropy, most_passes), budget)), "weights")
    total = weighed.agg(F.sum("quota").alias("q")).first()["q"] or 0.0
    blocks = max(1, math.ceil(total / block_tokens))
    rows = _placed(slim, weighed)
    rows = rows.filter((F.col("turn") < F.col("whole")) | (F.col("before") < F.col("left")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))  # equal rows again
    reach = F.col("before") + F.col("j") * F.col("n_tokens")
    share = F.when(F.col("quota") > 0, (F.col("turn") * F.col("t") + reach) / F.col("quota")).otherwise(F.col("u") / F.lit(float(1 << BITS)))
    beyond = F.when(F.col("n_tokens") == 0, F.floor(F.col("j") / BUCKET_ROWS)).otherwise(0)
    rows = rows.withColumn("block", F.pmod(F.least(F.floor(share * blocks), F.lit(blocks - 1)) + beyond, F.lit(blocks)).cast("bigint"))
    order = Window.partitionBy("block").orderBy("u", "source", "doc_id", "turn", "n_tokens")
    return rows.select("doc_id", "source", "n_tokens", "turn", "block", (F.row_number().over(order) - 1).cast("bigint").alias("slot"))


def apply(docs: DataFrame, id_col: str, text_col: str, source_col: str, entropy: float = ENTROPY, most_passes: float = MOST_PASSES, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, columns as they are, each as often as the mixture takes it.

    The last pass takes a prefix of its permutation, so one cut for each source tells what it takes, and the
    texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.save(_slim(docs, id_col, text_col, source_col), "slim")
    sources = scratch.save(_sources(slim), "sources")
    weighed = scratch.save(_with_passes(weigh(sources, exponent(sources, entropy, most_passes), budget)), "weights")
    last = _placed(slim, weighed).filter((F.col("turn") == F.col("whole")) & (F.col("before") < F.col("left")))
    cuts = last.groupBy("source").agg(F.max(F.struct("u", F.coalesce("doc_id", F.lit(-(1 << 63) + 1)).alias("i"), "n_tokens")).alias("cut"))
    table = scratch.save(weighed.join(cuts, "source", "left").select("source", "whole", "cut"), "cuts")
    if table.count() <= 10_000:
        table = F.broadcast(table)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    id_ = F.col(f"row.`{id_col}`").cast("bigint")
    keyed = rows.withColumn("source", F.coalesce(F.col(f"row.`{source_col}`").cast("string"), F.lit(""))).join(table, "source")
    own = F.struct(place(id_, F.col("whole")).alias("u"), F.coalesce(id_, F.lit(-(1 << 63) + 1)).alias("i"), tokens(F.col(f"row.`{text_col}`")).alias("n_tokens"))
    times = F.col("whole") + F.when(F.col("cut").isNotNull() & (own <= F.col("cut")), 1).otherwise(0)
    copies = keyed.select("row", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times)).otherwise(F.array().cast("array<bigint>"))).alias("k"))
    return copies.select("row.*")


def mix_sql(entropy: float = ENTROPY, most_passes: float = MOST_PASSES, block_tokens: int = BLOCK_TOKENS) -> str:
    """DuckDB SQL for ``mix`` over ``documents`` with the default budget: plain bisection and plain windows."""
    return f"""
WITH RECURSIVE slim AS (
 SELECT doc_id, coalesce(source,'') AS source, len(regexp_extract_all(coalesce(text,''), '[^\\x09-\\x0D\\x20]+'))::BIGINT AS n_tokens FROM documents),
src AS (SELECT source, sum(n_tokens)::BIGINT AS t, count(*) AS n FROM slim GROUP BY source),
tot AS (SELECT sum(t)::DOUBLE AS tt, ln(max(t)/min(t)::DOUBLE) AS ratio, {entropy}::DOUBLE*ln(count(*)) AS target, list(t::DOUBLE) AS ts FROM src WHERE t > 0),
h(k, lo, hi) AS (
 SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
 SELECT k+1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
  SELECT k, lo, hi, mid, ln(z) - m/z >= target AS ok FROM (
   SELECT k, lo, hi, (lo+hi)/2 AS mid, target,
    list_sum(list_transform(ts, lambda t: exp((lo+hi)/2*ln(t/tt)))) AS z,
    list_sum(list_transform(ts, lambda t: exp((lo+hi)/2*ln(t/tt))*(lo+hi)/2*ln(t/tt))) AS m FROM h, tot WHERE k < 50))),
found AS (SELECT round(greatest(CASE WHEN hi = 1.0 THEN 1.0 ELSE lo END, 1 - ln({most_passes})/ratio), 6) AS a FROM h, tot WHERE k = 50),
wt AS (SELECT source, t, n, exp(a*ln(t)) AS p, sum(exp(a*ln(t))) OVER () AS z, max(t/exp(a*ln(t))) OVER () AS most FROM src, found WHERE t > 0),
q AS (SELECT source, t, n, p/z*(most*z) AS quota FROM wt),
pass AS (SELECT *, floor(quota/t+1e-9)::BIGINT AS whole, CASE WHEN quota - floor(quota/t+1e-9)*t > t*1e-9 THEN quota - floor(quota/t+1e-9)*t ELSE 0 END AS rest FROM q),
turns AS (SELECT slim.*, t, quota, whole, rest, unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS turn FROM slim JOIN pass USING (source)),
u AS (SELECT *, ('0x' || substr(md5(doc_id || ':' || turn), 1, 7))::BIGINT AS u FROM turns),
b AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, turn ORDER BY u, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM u),
kept AS (SELECT * FROM b WHERE turn < whole OR before < rest),
blocks AS (SELECT greatest(1, ceil(sum(quota)/{block_tokens}))::BIGINT AS nb FROM q),
cut AS (SELECT doc_id, source, n_tokens, turn, u, least(floor((turn*t + before)/quota*nb)::BIGINT, nb-1) AS block FROM kept, blocks)
SELECT doc_id, source, n_tokens, turn, block, row_number() OVER (PARTITION BY block ORDER BY u, source, doc_id, turn, n_tokens) - 1 AS slot FROM cut"""
