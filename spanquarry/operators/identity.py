"""Digests that identify corpora, results and index tables; Merkle commitments and proofs; evidence.

An identity over many documents is SHA-256 of one small record a document in order. The format fixes one hash
over all of them, so the records (some 50 bytes a document) pass through one task at the end, which sorts them with
spilling and hashes them as they stream by, never held together. ``large_corpus_identity`` is the form without that task: runs of ``RUN``
documents are hashed where they stand, and runs of runs in turn, so the digest depends neither on partitions
nor on the size of any task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.functions.binary import latin1, part, u64be

RUN = 1 << 16
CORPUS_TAG, MANIFEST_TAG, INDEX_TAG, RESULT_TAG = (bytearray(f"{name}_IDENTITY_V1\0".encode()) for name in ("CORPUS", "MANIFEST", "INDEX", "RESULT"))

# Prefixes of leaves and inner nodes.
LEAF, NODE = b"\x00", b"\x01"


def _streamed(records: DataFrame, head: Column, order: list[str], separator: bytes = b"") -> DataFrame:
    """One row ``identity``: SHA-256 of ``head`` (of the count ``n``) and the records ``rec`` in order, which stream through one task."""
    total = records.agg(F.count(F.lit(1)).alias("n")).select(head.alias("rec"))
    begin = total.select(F.lit(0).alias("level"), *(F.lit(None).cast(records.schema[c].dataType).alias(c) for c in order), "rec")
    rows = begin.unionByName(records.select(F.lit(1).alias("level"), *order, "rec")).repartition(1).sortWithinPartitions("level", *order, "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen = hashlib.sha256(), 0
        for batch in batches:
            for rec in batch.column(0):
                digest.update((separator if seen > 1 else b"") + rec.as_py())
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["identity"])

    return rows.select("rec").mapInArrow(run, "identity string")


def _folded(records: DataFrame, tag: bytearray) -> DataFrame:
    """One row ``identity`` of (id, rec): SHA-256 of the tag, the count and all records in order of id."""
    return _streamed(records, F.concat(F.lit(tag), u64be(F.col("n"))), ["id"])


def _document(path: bool) -> Column:
    fields = [u64be(F.col("doc_id"))]
    if path:
        fields += [u64be(F.length("path")), F.col("path")]
    return F.concat(*fields, u64be(F.length("content")), F.unhex(F.sha2("content", 256)))


def corpus_identity(corpus: DataFrame) -> DataFrame:
    return _folded(corpus.select(F.col("doc_id").alias("id"), _document(False).alias("rec")), CORPUS_TAG)


def manifest_identity(corpus: DataFrame) -> DataFrame:
    return _folded(corpus.select(F.col("doc_id").alias("id"), _document(True).alias("rec")), MANIFEST_TAG)


def large_corpus_identity(corpus: DataFrame, run: int = RUN) -> DataFrame:
    """An identity over any number of documents: runs of ``run`` ids, and runs of as many runs, until one is left."""
    level = corpus.select(F.col("doc_id").alias("id"), _document(False).alias("rec"))
    top = corpus.agg(F.max("doc_id").alias("m")).first()["m"] or 0
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "rec"))), lambda x: F.concat(F.hex(x["id"]), F.lit(":"), F.hex(x["rec"]))), ",")
    while top > 0:
        level = level.groupBy(F.floor(F.col("id") / run).alias("g")).agg(F.unhex(F.sha2(body, 256)).alias("rec")).select(F.col("g").alias("id"), "rec")
        top //= run
    return _folded(level, CORPUS_TAG)


def index_identity(tables: dict[str, DataFrame], parameters: str) -> DataFrame:
    """Of the row count and an order-free check sum of each index table, and the parameters."""
    parts = []
    for name in sorted(tables):
        t = tables[name]
        row = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(t.columns)))), 1, 12), 16, 10).cast("decimal(20,0)")
        parts.append(t.agg(F.concat_ws(":", F.lit(name), F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("string")).alias("line")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    joined = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    return joined.select(F.sha2(F.concat(F.lit(INDEX_TAG), F.encode(F.concat(F.lit(parameters + "\n"), "body"), "UTF-8")), 256).alias("identity"))


def document_digests(occurrences: DataFrame) -> DataFrame:
    """(query_id, doc_id, digest): SHA-256 of the JSON list of a document's offsets, ascending."""
    offsets = F.array_join(F.transform(F.array_sort(F.collect_list("doc_offset")), lambda o: o.cast("string")), ",")
    return occurrences.groupBy("query_id", "doc_id").agg(F.sha2(F.concat(F.lit("["), offsets, F.lit("]")), 256).alias("digest"))


def result_identity(occurrences: DataFrame) -> DataFrame:
    """(query_id, identity) of the documents' digests in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "digest"))), lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["digest"])), "\n")
    return document_digests(occurrences).groupBy("query_id").agg(F.sha2(F.concat(F.lit(RESULT_TAG), F.encode(lines, "UTF-8")), 256).alias("identity"))


def leaves(corpus: DataFrame, size: int = 4096) -> DataFrame:
    """(doc_id, i, digest): the leaf of each chunk of a document."""
    from spanquarry.sources.corpus import chunks

    return chunks(corpus, size).select("doc_id", F.col("chunk_no").alias("i"), F.unhex(F.sha2(F.concat(F.lit(bytearray(LEAF)), "raw"), 256)).alias("digest"))


def merkle_roots(level: DataFrame) -> DataFrame:
    """(doc_id, root): pairs are hashed level by level, a last odd node rises as it is.

    Each level is one aggregation over half as many rows; the loop runs log2 of the longest document's leaves.
    """
    longest = level.agg(F.max("i").alias("m")).first()["m"]
    width = 0 if longest is None else longest + 1
    while width > 1:
        pairs = level.groupBy("doc_id", F.floor(F.col("i") / 2).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("p"))
        two = F.unhex(F.sha2(F.concat(F.lit(bytearray(NODE)), F.get("p", 0)["digest"], F.get("p", 1)["digest"]), 256))
        level = pairs.select("doc_id", "i", F.when(F.size("p") == 2, two).otherwise(F.get("p", 0)["digest"]).alias("digest"))
        width = (width + 1) // 2
    return level.select("doc_id", F.lower(F.hex("digest")).alias("root"))


def commitment(corpus: DataFrame, tables: DataFrame, parameters: dict) -> DataFrame:
    """(doc_id, corpus_root, index_root, commitment): of the document's chunks, its suffix offsets and the build's parameters."""
    spec = hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    flat = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sa_row", "off"))).alias("s"))
    packed = flat.select("doc_id", F.unhex(F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x["off"]), 8, "0")), "")).alias("content"))
    both = merkle_roots(leaves(corpus)).withColumnRenamed("root", "corpus_root").join(merkle_roots(leaves(packed)).withColumnRenamed("root", "index_root"), "doc_id")
    return both.withColumn("commitment", F.sha2(F.concat("corpus_root", "index_root", F.lit(spec)), 256))


def membership_path(digests: list[bytes], i: int) -> list[tuple[str, str]]:
    """The sides and hex digests that lead from leaf ``i`` to the root."""
    out = []
    while len(digests) > 1:
        mate = i ^ 1
        if mate < len(digests):
            out.append(("left" if mate < i else "right", digests[mate].hex()))
        digests = [hashlib.sha256(NODE + digests[k] + digests[k + 1]).digest() if k + 1 < len(digests) else digests[k] for k in range(0, len(digests), 2)]
        i //= 2
    return out


def check_membership(chunk: bytes, path: list[tuple[str, str]], root: str) -> bool:
    node = hashlib.sha256(LEAF + chunk).digest()
    for side, mate in path:
        other = bytes.fromhex(mate)
        node = hashlib.sha256(NODE + (other + node if side == "left" else node + other)).digest()
    return node.hex() == root


def absence_witnesses(table: DataFrame, corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, doc_id, row_below, row_above) for patterns that do not occur: the suffixes around their place.

    The witnesses are neighbours (row_above is row_below + 1, or null past the last), which a verifier checks too.
    """
    rows = table.join(corpus.select("doc_id", "content"), "doc_id").join(F.broadcast(patterns), F.lit(True))
    suffix = F.substring(F.col("content"), F.col("off").cast("int") + 1, F.length("content"))
    rows = rows.select("query_id", "doc_id", "sa_row", "pattern", suffix.alias("suffix"))
    hit = F.max((F.substring("suffix", 1, F.length("pattern")) == F.col("pattern")).cast("int"))
    out = rows.groupBy("query_id", "doc_id").agg(hit.alias("hit"), F.max(F.when(F.col("suffix") < F.col("pattern"), F.col("sa_row"))).alias("row_below"), F.min(F.when(F.col("suffix") >= F.col("pattern"), F.col("sa_row"))).alias("row_above"))
    return out.filter("hit = 0").drop("hit")


def evidence(corpus: DataFrame, patterns: DataFrame, occurrences: DataFrame, before: int = 24, after: int = 24) -> DataFrame:
    """Occurrences with the document's digest (computed once a document), the bytes found and their surroundings."""
    from spanquarry.operators.match import opened

    known = patterns.select("query_id", "pattern", F.length("pattern").alias("size"))
    rows = occurrences.join(known.drop("pattern"), "query_id")
    start = F.greatest(F.col("doc_offset") - before, F.lit(0))
    hashed = corpus.select("doc_id", "content", F.sha2("content", 256).alias("source_sha256"))
    met = opened(hashed, rows, start, F.col("doc_offset") + F.col("size") + after - start, "source_sha256").join(known, "query_id")
    found = part(F.col("found"), F.least(F.col("doc_offset"), F.lit(before)), F.col("size"))
    return met.select("query_id", "doc_id", "doc_offset", "source_sha256", F.lower(F.hex(found)).alias("observed_hex"), (found == F.col("pattern")).alias("byte_check"), latin1(F.col("found")).alias("context"))


def replay(corpus: DataFrame, patterns: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of evidence that a fresh computation does not give, or gives besides; none if it holds."""
    from spanquarry.operators.match import locate

    columns = ["query_id", "doc_id", "doc_offset", "source_sha256", "observed_hex"]
    fresh = evidence(corpus, patterns, locate(corpus, patterns)).select(*columns)
    old = kept.select(*columns)
    return old.exceptAll(fresh).withColumn("side", F.lit("kept")).unionByName(fresh.exceptAll(old).withColumn("side", F.lit("fresh")))


def inventory(files: DataFrame) -> DataFrame:
    """(name, length, sha256) of (name, content)."""
    return files.select("name", F.length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("sha256"))


def check_bundle(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem): files that are missing, unexpected or changed against an inventory.

    A name may stand for several files. Of these, equal ones are paired first and then changed ones, so that a file
    gives one row at most; only counts by name and digest are met.
    """
    one = inventory(files).select("name", "sha256", F.lit(1).alias("n")).unionByName(manifest.select("name", "sha256", F.lit(-1).alias("n")))
    left = one.groupBy("name", "sha256").agg(F.sum("n").alias("n"))
    sums = left.groupBy("name").agg(F.sum(F.greatest(F.col("n"), F.lit(0))).cast("int").alias("more"), F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("int").alias("less"))
    both = F.least("more", "less")
    problems = F.concat(F.array_repeat(F.lit("DIGEST"), both), F.array_repeat(F.lit("MISSING"), F.col("less") - both), F.array_repeat(F.lit("UNEXPECTED"), F.col("more") - both))
    return sums.select("name", F.explode(problems).alias("problem"))


def bundle_root(manifest: DataFrame) -> DataFrame:
    """One row ``root`` over an inventory in order of name."""
    line = F.concat("name", F.lit(" "), F.col("length").cast("string"), F.lit(" "), "sha256")
    rows = manifest.select("name", "length", "sha256", F.encode(line, "UTF-8").alias("rec"))
    return _streamed(rows, F.lit(bytearray(b"BUNDLE_V1\n")), ["name", "length", "sha256"], b"\n").withColumnRenamed("identity", "root")


def capabilities(spark: SparkSession) -> dict[str, str]:
    """What the engine runs on."""
    import pyarrow
    import pyspark

    return {"spark": pyspark.__version__, "arrow": pyarrow.__version__, "java": spark._jvm.System.getProperty("java.version")}

