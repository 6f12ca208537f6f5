"""Exact matching of byte patterns inside documents: count, locate, bounds, summaries and checks.

``corpus`` has doc_id and content, ``patterns`` query_id and pattern (both BINARY). A match never crosses a
document. All patterns are looked up in one pass over a document by an Aho-Corasick automaton, so the work is
that of the bytes and of the matches, whatever the number of patterns. The distinct patterns are read on the
driver and shipped in automata of about ``MOST_BYTES``; more patterns than that make further passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanquarry.functions.binary import byte_at, hex_status, latin1, part
from spanquarry.sources.shared import small_batches

MOST_BYTES = 4 << 20  # patterns of one automaton, some fifty times that in a worker's memory
MOST_SHIPPED = 100_000  # queries that are shipped to name the matches
HITS = 1 << 17  # matches held at once
STRETCH = 1 << 16  # bytes of a document whose occurrences are opened together
PARTS = 64  # parts of a query's occurrences that are cut to a bound before they meet


def patterns_from_hex(table: DataFrame, column: str) -> DataFrame:
    """All columns with ``status`` and, where that is OK, the decoded ``pattern``."""
    status = hex_status(F.col(column))
    return table.withColumn("status", status).withColumn("pattern", F.when(F.col("status") == "OK", F.unhex(F.col(column))))


def _groups(patterns: DataFrame) -> tuple[list[list[bytes]], bool]:
    """The distinct patterns in groups of about ``MOST_BYTES``, and whether the queries are few; empty patterns match nothing."""
    good = patterns.filter(F.length("pattern") > 0).select("pattern")
    sums = good.agg(F.sum(F.length("pattern")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    count = -(-(sums["bytes"] or 0) // MOST_BYTES)
    of = F.pmod(F.xxhash64("pattern"), F.lit(max(count, 1)))
    groups = [sorted({bytes(r["pattern"]) for r in good.filter(of == g).collect()}) for g in range(count)]
    return [g for g in groups if g], sums["n"] <= MOST_SHIPPED


def _automaton(group: list[bytes]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n, p in enumerate(group):
        found.add_word(p.decode("latin-1"), n)
    found.make_automaton()
    return found


def _hits(automaton: ahocorasick.Automaton, content: bytes | None, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pattern numbers, offsets) of all matches, by their ends, ``HITS`` at a time."""
    found = automaton.iter((content or b"").decode("latin-1"))
    while block := list(islice(found, HITS)):
        pairs = np.fromiter(chain.from_iterable(block), np.int64, 2 * len(block)).reshape(-1, 2)
        yield pairs[:, 1], pairs[:, 0] + 1 - sizes[pairs[:, 1]]


def _searched(corpus: DataFrame, patterns: DataFrame, of, schema: str) -> DataFrame:
    """query_id and ``schema`` of what ``of`` (batches, automaton, group, first number) finds by pattern number ``n``."""
    spark = corpus.sparkSession
    small_batches(spark)
    groups, few = _groups(patterns)
    kind = T.StructType([patterns.schema["query_id"]])
    if not groups:
        return spark.createDataFrame([], T.StructType([*kind, *T.StructType.fromDDL(schema)]))
    docs, out, numbers = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "content"), None, []
    for group in groups:
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, base=len(numbers)) -> Iterator[pa.RecordBatch]:
            yield from of(batches, _automaton(shared.value), shared.value, base)

        one = docs.mapInArrow(run, f"n bigint, {schema}")
        out = one if out is None else out.unionByName(one)
        numbers += group
    table = spark.createDataFrame(pa.table({"n": pa.array(range(len(numbers)), pa.int64()), "pattern": pa.array(numbers, pa.binary())}))
    named = patterns.select("query_id", "pattern").join(F.broadcast(table) if few else table, "pattern").select("n", "query_id")
    return out.join(F.broadcast(named) if few else named, "n").drop("n")


def _overlaps_itself(pattern: bytes) -> bool:
    return any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def _disjoint(numbers: np.ndarray, offsets: np.ndarray, group: list[bytes], periodic: set[int], ends: dict[int, int]) -> np.ndarray:
    """Which matches stay if those of a pattern are taken from left to right without overlap; ``ends`` carries on."""
    keep = np.ones(len(numbers), dtype=bool)
    for n in periodic.intersection(np.unique(numbers).tolist()):
        size = len(group[n])
        for k in np.flatnonzero(numbers == n):
            keep[k] = offsets[k] >= ends.get(n, 0)
            if keep[k]:
                ends[n] = int(offsets[k]) + size
    return keep


def _counted(overlapping: bool, by_document: bool):
    """Counts by pattern and document, or by pattern over all documents of a task."""

    def of(batches: Iterator[pa.RecordBatch], automaton, group: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in group])
        periodic = set() if overlapping else {n for n, p in enumerate(group) if _overlaps_itself(p)}
        every = np.zeros(len(group), dtype=np.int64)
        for batch in batches:
            numbers, rows, counts = [], [], []
            for r, content in enumerate(batch.column(1)):
                own, ends = {}, {}
                for ns, offsets in _hits(automaton, content.as_py(), sizes):
                    if periodic:
                        ns = ns[_disjoint(ns, offsets, group, periodic, ends)]
                    kinds, times = np.unique(ns, return_counts=True)
                    if by_document:
                        for n, c in zip(kinds.tolist(), times.tolist(), strict=True):
                            own[n] = own.get(n, 0) + c
                    else:
                        every[kinds] += times
                numbers += [n + base for n in own]
                counts += own.values()
                rows += [r] * len(own)
            if by_document:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(counts, pa.int64())], names=["n", "doc_id", "match_count"])
        if not by_document:
            kinds = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(kinds + base), pa.array(every[kinds])], names=["n", "match_count"])

    return of


def count_by_document(corpus: DataFrame, patterns: DataFrame, overlapping: bool = True) -> DataFrame:
    """(query_id, doc_id, match_count) of documents with a match."""
    return _searched(corpus, patterns, _counted(overlapping, True), "doc_id bigint, match_count bigint").select("query_id", "doc_id", "match_count")


def count(corpus: DataFrame, patterns: DataFrame, overlapping: bool = True) -> DataFrame:
    """(query_id, match_count) of every pattern, 0 included."""
    found = _searched(corpus, patterns, _counted(overlapping, False), "match_count bigint").groupBy("query_id").agg(F.sum("match_count").alias("match_count"))
    return patterns.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("match_count", F.lit(0)).alias("match_count"))


def _located(batches: Iterator[pa.RecordBatch], automaton, group: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(p) for p in group])
    for batch in batches:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            numbers, rows, offsets = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(numbers + base), batch.column(0).take(pa.array(rows)), pa.array(offsets)], names=["n", "doc_id", "doc_offset"])

        for r, content in enumerate(batch.column(1)):
            for numbers, offsets in _hits(automaton, content.as_py(), sizes):
                held.append((numbers, np.full(len(numbers), r), offsets))
                size += len(numbers)
                if size >= HITS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()


def locate(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_offset) of every occurrence."""
    return _searched(corpus, patterns, _located, "doc_id bigint, doc_offset bigint").select("query_id", "doc_id", "doc_offset")


def bounded(occurrences: DataFrame, most: int, order: list[str] | None = None) -> DataFrame:
    """The first ``most`` occurrences of each query in canonical order (or another given one).

    Parts of a query's occurrences are cut to the bound first, so a common pattern is no single task's work.
    """
    keys = order or ["doc_id", "doc_offset"]
    part_ = F.pmod(F.xxhash64(*keys), F.lit(PARTS))
    early = occurrences.withColumn("part", part_).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*keys)))
    early = early.filter(F.col("rank") <= most).drop("rank", "part")
    ranked = early.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))
    return ranked.filter(F.col("rank") <= most).drop("rank")


def _first(most: int):
    """The first ``most`` matches of each pattern among a task's documents."""
    least = -(1 << 63)

    def of(batches: Iterator[pa.RecordBatch], automaton, group: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in group])
        kept = [np.empty(0, dtype=np.int64)] * 3
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def cut() -> list[np.ndarray]:
            numbers, docs, offsets = (np.concatenate(x) for x in zip(kept, *held, strict=True))
            order = np.lexsort((offsets, docs, numbers))
            numbers = numbers[order]
            place = np.arange(len(numbers)) - np.searchsorted(numbers, numbers)
            order = order[place < most]
            return [numbers[place < most], docs[order], offsets[order]]

        for batch in batches:
            ids = batch.column(0).fill_null(least).to_numpy()
            for r, content in enumerate(batch.column(1)):
                for numbers, offsets in _hits(automaton, content.as_py(), sizes):
                    held.append((numbers, np.full(len(numbers), ids[r]), offsets))
                    size += len(numbers)
                    if size >= HITS:
                        kept, held, size = cut(), [], 0
        kept = cut()
        docs = pa.array(kept[1], mask=kept[1] == least)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0] + base), docs, pa.array(kept[2])], names=["n", "doc_id", "doc_offset"])

    return of


def locate_bounded(corpus: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """As ``bounded``, in one pass: no task gives more rows than the bound for a pattern."""
    found = _searched(corpus, patterns, _first(most), "doc_id bigint, doc_offset bigint")
    return bounded(found.select("query_id", "doc_id", "doc_offset"), most)


def summary(occurrences: DataFrame) -> DataFrame:
    """(query_id, doc_id, match_count, first_offset, last_offset)."""
    return occurrences.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("match_count"), F.min("doc_offset").alias("first_offset"), F.max("doc_offset").alias("last_offset"))


def query_result(corpus: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """One row a pattern: match_count, matched_documents, returned_count, bounded and offsets_complete."""
    sums = count_by_document(corpus, patterns).groupBy("query_id").agg(F.sum("match_count").alias("m"), F.count(F.lit(1)).alias("d"))
    zero = F.lit(0).cast("bigint")
    out = patterns.select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("m", zero).alias("match_count"), F.coalesce("d", zero).alias("matched_documents"))
    out = out.withColumn("returned_count", F.least(F.col("match_count"), F.lit(most).cast("bigint")))
    return out.withColumn("bounded", F.col("returned_count") < F.col("match_count")).withColumn("offsets_complete", ~F.col("bounded"))


def opened(corpus: DataFrame, occurrences: DataFrame, start: Column, length: Column, *more: str) -> DataFrame:
    """Occurrences (query_id, doc_id, doc_offset) with ``found``: the document's ``length`` bytes from ``start``.

    The occurrences within ``STRETCH`` bytes of a document share a row, so its content travels once for them;
    ``more`` are further columns of the corpus.
    """
    rows = occurrences.select("query_id", "doc_id", "doc_offset", start.cast("int").alias("a"), length.cast("int").alias("k"))
    rows = rows.groupBy("doc_id", F.floor(F.col("doc_offset") / STRETCH).alias("g")).agg(F.collect_list(F.struct("query_id", "doc_offset", "a", "k")).alias("at"))
    met = rows.join(corpus.select("doc_id", "content", *more), "doc_id")
    each = F.transform("at", lambda x: F.struct(x["query_id"].alias("query_id"), x["doc_offset"].alias("doc_offset"), part(F.col("content"), x["a"], x["k"]).alias("found")))
    return met.select("doc_id", *more, F.explode(each).alias("x")).select("x.query_id", "doc_id", "x.doc_offset", "x.found", *more)


def byte_checked(corpus: DataFrame, patterns: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences with ``byte_check``: whether the corpus holds the pattern there, inside one document."""
    sizes = patterns.select("query_id", "pattern")
    rows = occurrences.join(sizes.select("query_id", F.length("pattern").alias("size")), "query_id")
    inside = F.greatest(F.col("doc_offset"), F.lit(0))
    found = opened(corpus, rows, inside, F.col("size")).join(sizes, "query_id")
    same = (F.col("doc_offset") >= 0) & (F.length("found") == F.length("pattern")) & (F.col("found") == F.col("pattern"))
    return found.select("query_id", "doc_id", "doc_offset", same.alias("byte_check"))


def cross_check(counts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(query_id, doc_id, problem) where counts and located offsets disagree or offsets repeat."""
    located = occurrences.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_offset").alias("k"))
    both = counts.join(located, ["query_id", "doc_id"], "full_outer")
    problem = F.when(~F.col("match_count").eqNullSafe(F.col("n")), "COUNT").when(F.col("n") != F.col("k"), "DUPLICATE")
    return both.select("query_id", "doc_id", problem.alias("problem")).filter("problem IS NOT NULL")


def verified_count(corpus: DataFrame, records: DataFrame, patterns: DataFrame) -> DataFrame:
    """Counts over a corpus only if every document agrees with its manifest record; else an error at run time."""
    from spanquarry.sources.corpus import verify

    bad = verify(corpus, records).agg(F.count(F.lit(1)).alias("bad"))
    gate = F.when(F.col("bad") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("MANIFEST_MISMATCH")).cast("boolean"))
    return count(corpus, patterns).join(F.broadcast(bad.select(gate.alias("verified"))), F.lit(True)).select("query_id", "match_count", "verified")


def snippets(corpus: DataFrame, patterns: DataFrame, occurrences: DataFrame, before: int = 80, after: int = 160) -> DataFrame:
    """Occurrences with the ISO-8859-1 text from ``before`` bytes before to ``after`` bytes after the offset."""
    start = F.greatest(F.col("doc_offset") - before, F.lit(0))
    return opened(corpus, occurrences, start, F.col("doc_offset") + after - start).select("query_id", "doc_id", "doc_offset", latin1(F.col("found")).alias("snippet"))


def sharded(corpus: DataFrame, shard: Column, patterns: DataFrame) -> DataFrame:
    """(query_id, shard_id, match_count) with a grand total a query in the row of the null shard."""
    shards = corpus.select("doc_id", shard.alias("shard_id"))
    return count_by_document(corpus, patterns).join(shards, "doc_id").rollup("query_id", "shard_id").agg(F.sum("match_count").alias("match_count")).filter("query_id IS NOT NULL")


def flip(pattern: Column, offset: Column | int) -> Column:
    """The pattern with the lowest bit of one byte flipped."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    changed = F.unhex(F.lpad(F.hex(byte_at(pattern, offset).bitwiseXOR(F.lit(1)).cast("bigint")), 2, "0"))
    return F.concat(part(pattern, 0, offset), changed, part(pattern, offset + 1, F.length(pattern)))
