"""Profiles of contents: byte histograms, entropy, repeats, run statistics, percentiles and simple rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.operators.signatures import grams
from spanquarry.sources.corpus import chunks
from spanquarry.sources.shared import saved

KB64, KB900, MB4 = 64 * 1024, 900 * 1024, 4 * 1024 * 1024
LENGTHS = (8, 12, 16, 24, 32)  # fixed values: the gram lengths of the repeat profiles
MOST_GROUPS = 512


def histogram(corpus: DataFrame) -> DataFrame:
    """(doc_id, byte, n), counted in Arrow batches: a row a byte value leaves them, not a row a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                counts = np.bincount(np.frombuffer(batch.column(1)[at].as_buffer() or b"", dtype=np.uint8), minlength=256)
                kinds = np.flatnonzero(counts)
                ids = batch.column(0).take(pa.array(np.full(len(kinds), at)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(kinds.astype(np.int32)), pa.array(counts[kinds])], names=["doc_id", "byte", "n"])

    return corpus.select("doc_id", F.coalesce("content", F.lit(bytearray(b""))).alias("content")).mapInArrow(run, "doc_id bigint, byte int, n bigint")


def byte_profile(corpus: DataFrame, top: int = 16) -> DataFrame:
    """Counts, alphabet, NUL and newline bytes, printable share, entropy and the most frequent bytes."""
    h = histogram(corpus).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    share = F.col("n") / F.col("total")
    printable = F.col("byte").isin(9, 10, 13) | F.col("byte").between(32, 126)
    return h.groupBy("doc_id").agg(
        F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("alphabet"), F.coalesce(F.sum(F.when(F.col("byte") == 0, F.col("n"))), F.lit(0)).alias("nul"),
        F.coalesce(F.sum(F.when(F.col("byte") == 10, F.col("n"))), F.lit(0)).alias("newlines"), F.round(F.coalesce(F.sum(F.when(printable, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("printable"),
        F.round(F.abs(F.sum(-share * F.log2(share))), 6).alias("entropy"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "byte"))), 1, top), lambda x: x["byte"]).alias("top_bytes"),
    )


def chunk_entropy(corpus: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunks, mean, least, most, range, first) of the chunks' entropies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(2):
                n = np.bincount(np.frombuffer(raw.as_buffer(), dtype=np.uint8))
                n = n[n > 0]
                # entropy from counts alone: log2(total) - sum(n log2 n) / total
                found.append(abs(float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "chunk_no", "e"])

    e = chunks(corpus, size).select("doc_id", "chunk_no", "raw").mapInArrow(run, "doc_id bigint, chunk_no bigint, e double").withColumn("e", F.round("e", 6))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_no") < 16, F.struct("chunk_no", "e")))), lambda x: x["e"])
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("e"), 6).alias("mean"), F.min("e").alias("least"), F.max("e").alias("most"), F.round(F.max("e") - F.min("e"), 6).alias("range"), first.alias("first"))


def _frequencies(corpus: DataFrame, lengths: tuple[int, ...], stride: int) -> tuple[DataFrame, DataFrame]:
    """The grams (doc_id, k, pos, sig) of all lengths and how often each is in its document (doc_id, k, sig, f)."""
    g = None
    for k in lengths:
        one = grams(corpus, k, stride, ("doc_id",), "content").withColumn("k", F.lit(k))
        g = one if g is None else g.unionByName(one)
    return g, g.groupBy("doc_id", "k", "sig").agg(F.count(F.lit(1)).alias("f"))


def _distances(g: DataFrame, f: DataFrame) -> DataFrame:
    lead = F.lead("pos").over(Window.partitionBy("doc_id", "k", "sig").orderBy("pos"))
    return g.join(f.filter("f >= 2"), ["doc_id", "k", "sig"]).withColumn("distance", lead - F.col("pos"))


def _by_length(corpus: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    return corpus.select("doc_id", F.length("content").alias("n"), F.explode(F.array(*map(F.lit, lengths))).alias("k"))


def repeat_profile(corpus: DataFrame, lengths: tuple[int, ...] = LENGTHS, stride: int = 32, most: int = 512) -> DataFrame:
    """(doc_id, k, anchors, pairs, median, far, near) of grams of k bytes that repeat 2 to ``most`` times."""
    d = _distances(*_frequencies(corpus, lengths, stride)).filter(F.col("f") <= most)
    found = d.groupBy("doc_id", "k").agg(
        F.countDistinct("sig").alias("anchors"), F.count("distance").alias("pairs"), F.percentile("distance", 0.5).alias("median"),
        F.round(F.avg((F.col("distance") > KB900).cast("double")), 6).alias("far"), F.round(F.avg((F.col("distance") <= KB64).cast("double")), 6).alias("near"),
    )
    return _by_length(corpus, lengths).drop("n").join(found, ["doc_id", "k"], "left").na.fill(0, ["anchors", "pairs", "far", "near"])


def full_distance_profile(corpus: DataFrame, lengths: tuple[int, ...] = LENGTHS, stride: int = 32, most: int = 512) -> DataFrame:
    """21 measures of all and of useful repeats, by document and gram length; without pairs the percentiles are null."""
    g, f = _frequencies(corpus, lengths, stride)
    again, useful = F.col("f") >= 2, F.col("f").between(2, most)
    keys = f.groupBy("doc_id", "k").agg(
        F.count(F.lit(1)).alias("unique"), F.count(F.when(again, 1)).alias("repeated"), F.count(F.when(useful, 1)).alias("useful"),
        F.coalesce(F.sum(F.when(again, F.col("f"))), F.lit(0)).alias("places"),
    )
    d = saved(_distances(g, f).filter("distance IS NOT NULL").select("doc_id", "k", "f", "distance"), "distances")

    def figures(rows: DataFrame, mark: str, places: dict[str, float]) -> DataFrame:
        far, near = F.avg((F.col("distance") > KB900).cast("double")), F.avg((F.col("distance") <= KB64).cast("double"))
        shares = {"far900k": far, "far4m": F.avg((F.col("distance") > MB4).cast("double")), "near64k": near, "far_to_near": far / F.greatest(F.lit(1e-12), near)}
        sums = rows.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias(f"{mark}pairs"), *(F.round(c, 6).alias(mark + n) for n, c in shares.items()))
        return sums.join(values_at(rows, ["doc_id", "k"], "distance", {mark + n: nearest_place(q) for n, q in places.items()}).drop("least", "most"), ["doc_id", "k"])

    every = figures(d, "", {"p50": 0.5, "p90": 0.9}).drop("far_to_near")
    some = figures(d.filter(F.col("f") <= most), "useful_", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    rows = _by_length(corpus, lengths)
    for part in (keys, every, some):
        rows = rows.join(part, ["doc_id", "k"], "left")
    rows = rows.na.fill(0, [c for c in rows.columns if not c.endswith(("p50", "p90", "p99"))])
    sampled = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("k") + stride) / stride))
    share = {"repeat_key_share": F.col("repeated") / F.greatest(F.col("unique"), F.lit(1)), "useful_key_share": F.col("useful") / F.greatest(F.col("unique"), F.lit(1)), "repeated_share": F.col("places") / sampled}
    return rows.select("*", sampled.alias("sampled"), *(F.round(c, 6).alias(n) for n, c in share.items())).drop("n", "places")


def sampled_distances(corpus: DataFrame, length: int, share: int) -> DataFrame:
    """(doc_id, sig, distance) of patterns picked by hash, one in ``share``: the same at any layout."""
    g = grams(corpus, length, 1, ("doc_id",), "content").filter(F.conv(F.substring(F.md5("sig"), 1, 4), 16, 10).cast("int") % share == 0)
    lead = F.lead("pos").over(Window.partitionBy("doc_id", "sig").orderBy("pos"))
    return g.withColumn("distance", lead - F.col("pos")).filter("distance IS NOT NULL").select("doc_id", "sig", "distance")


def run_statistics(runs: DataFrame) -> DataFrame:
    """(doc_id, n, runs, ratio, mean_run, alphabet, class) of run lengths (doc_id, symbol, length)."""
    s = runs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("runs"), F.countDistinct("symbol").alias("alphabet"))
    ratio = F.col("runs") / F.col("n")
    # The labels and their limits.
    label = (
        F.when(ratio <= 0.001, "extremely_repetitive").when(ratio <= 0.01, "highly_repetitive").when(ratio <= 0.05, "repetitive")
        .when(ratio <= 0.15, "moderately_repetitive").otherwise("not_run_compressible")
    )
    return s.select("doc_id", "n", "runs", "alphabet", F.round(ratio, 6).alias("ratio"), F.round(F.col("n") / F.col("runs"), 6).alias("mean_run"), label.alias("label"))


def varint_size(length: Column) -> Column:
    """Bytes of a ULEB128 number."""
    out = F.lit(5)
    for n in (4, 3, 2, 1):
        out = F.when(length < (1 << (7 * n)), n).otherwise(out)
    return out


def run_sizes(runs: DataFrame) -> DataFrame:
    """(doc_id, varint_bytes, u32_bytes, u64_bytes, most): sizes of the ways to store runs."""
    return runs.groupBy("doc_id").agg(F.sum(1 + varint_size(F.col("length"))).alias("varint_bytes"), (F.count(F.lit(1)) * 8).alias("u32_bytes"), (F.count(F.lit(1)) * 16).alias("u64_bytes"), F.max("length").alias("most"))


def duplicate_blocks(corpus: DataFrame, size: int) -> DataFrame:
    """One row: blocks of ``size`` bytes, distinct ones, duplicates and their share."""
    kinds = chunks(corpus, size).groupBy(F.sha2("raw", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.agg(F.sum("n").alias("blocks"), F.count(F.lit(1)).alias("unique_blocks"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.round((F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 6).alias("share"))


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[round((n - 1) q)], halves to even; null of none."""
    s = F.array_sort(values)
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(q), 0).cast("int"))


def floor_rank(values: Column, q: float) -> Column:
    """sorted[floor((n - 1) q)]."""
    s = F.array_sort(values)
    return F.get(s, F.floor((F.size(s) - 1) * F.lit(q)).cast("int"))


def stumps(table: DataFrame, id_col: str, label_col: str, features: list[str]) -> DataFrame:
    """(feature, direction, threshold, correct, total) of every rule "1 if value >= (or <=) threshold".

    Values are counted by label first; sums over the ordered values give all thresholds of a feature at once.
    """
    return _rules(_by_value(table, label_col, features, []), [])


def _by_value(table: DataFrame, label_col: str, features: list[str], keys: list[str]) -> DataFrame:
    """(*keys, feature, value, ones, n): rows of each value, and how many of them have label 1."""
    long = table.select(*keys, F.col(label_col).alias("y"), *features).unpivot([*keys, "y"], features, "feature", "value").filter("value IS NOT NULL")
    return long.groupBy(*keys, "feature", "value").agg(F.sum(F.col("y").cast("bigint")).alias("ones"), F.count(F.lit(1)).alias("n"))


def _rules(by_value: DataFrame, keys: list[str]) -> DataFrame:
    every = Window.partitionBy(*keys, "feature")
    up = every.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = by_value.select(*keys, "feature", "value", "ones", "n", F.sum("ones").over(up).alias("ones_le"), F.sum("n").over(up).alias("n_le"), F.sum("ones").over(every).alias("ones_all"), F.sum("n").over(every).alias("total"))
    below_zeros = (F.col("n_le") - F.col("n")) - (F.col("ones_le") - F.col("ones"))
    ge = (F.col("ones_all") - F.col("ones_le") + F.col("ones")) + below_zeros
    le = F.col("ones_le") + (F.col("total") - F.col("n_le")) - (F.col("ones_all") - F.col("ones_le"))
    rules = F.explode(F.array(F.struct(F.lit("ge").alias("direction"), ge.alias("correct")), F.struct(F.lit("le").alias("direction"), le.alias("correct"))))
    return s.select(*keys, "feature", F.col("value").alias("threshold"), "total", rules.alias("r")).select(*keys, "feature", "r.direction", "threshold", "r.correct", "total")


def best_stump(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rule with the most correct rows, ties by feature, direction and threshold."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("correct"), "feature", "direction", "threshold")
    return rules.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def leave_one_group_out(table: DataFrame, label_col: str, features: list[str], group_col: str) -> DataFrame:
    """(held, feature, direction, threshold, correct, total): rules learned without a group, tried on it.

    The groups are those of the data, at most ``MOST_GROUPS`` (more are refused); rows without one are neither
    learned from nor tried. Values are counted by group first, and the counts are dealt to the other groups.
    """
    known = table.filter(F.col(group_col).isNotNull()).withColumn("held", F.col(group_col))
    groups = [r[0] for r in known.select("held").distinct().limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError("TOO_MANY_GROUPS")
    counts = saved(_by_value(known, label_col, features, ["held"]), "by-group")
    names = F.array(*map(F.lit, groups)).cast(f"array<{known.schema['held'].dataType.simpleString()}>")
    others = counts.select(F.explode(F.filter(names, lambda g: g != F.col("held"))).alias("held"), "feature", "value", "ones", "n")
    learned = others.groupBy("held", "feature", "value").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    rule = best_stump(_rules(learned, ["held"]), ["held"]).select("held", "feature", "direction", "threshold")
    tried = counts.join(F.broadcast(rule), ["held", "feature"])
    said = F.when(F.col("direction") == "ge", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    right = F.when(said, F.col("ones")).otherwise(F.col("n") - F.col("ones"))
    return tried.groupBy("held", "feature", "direction", "threshold").agg(F.sum(right).alias("correct"), F.sum("n").alias("total"))


def parameters(size: Column) -> Column:
    """Of a source of ``size`` bytes: versions, MiB of a version, and the shifts without and with overlap; null below 5 MiB."""
    mib = F.floor(size / (1 << 20))
    version = F.least(F.lit(16).cast("bigint"), F.floor(mib / 4))
    shift = F.greatest(F.lit(1).cast("bigint"), F.floor(version / 8))
    return F.when(mib >= 5, F.struct(F.lit(4).alias("versions"), version.alias("version_mib"), version.alias("nonoverlap_shift_mib"), shift.alias("overlap_shift_mib")))


def values_at(table: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(*keys, each place): the value at a 0-based place, a column of the number ``n``, of a key's ordered values.

    Equal values are counted first, so a key costs its distinct values and no list is made.
    """
    counts = table.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("reach", F.sum("c").over(along)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("reach") > at, F.col(value))).alias(name) for name, at in places.items()), F.min(value).alias("least"), F.max(value).alias("most"))


def nearest_place(q: float) -> Column:
    return F.bround((F.col("n") - 1) * F.lit(q), 0)


def floor_place(q: float) -> Column:
    return F.floor((F.col("n") - 1) * F.lit(q))


def repeatability(samples: DataFrame) -> DataFrame:
    """(name, p50, p95, p99, verdict) of repeated measurements (name, value)."""
    v = values_at(samples, ["name"], "value", {"p50": floor_place(0.5), "p95": floor_place(0.95), "p99": floor_place(0.99)})
    ratio = F.col("most") / F.col("least")
    verdict = F.when(ratio < 1.5, "LAW_CONFIRMED").when(ratio < 2.0, "LIKELY_STABLE").otherwise("UNSTABLE_INVESTIGATE")  # fixed values
    return v.select("name", "p50", "p95", "p99", verdict.alias("verdict"))
