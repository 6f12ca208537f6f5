"""MinHash near-dedup: documents whose sets of word shingles are alike share a component.

1. One Arrow pass over whole texts makes each document's shingle set, a digest of it, and a MinHash
   signature by one-permutation hashing: a shingle's hash picks one of ``BINS`` bins, each bin keeps its
   smallest value, and an empty bin takes the value of the first filled bin in a random order of its own
   (optimal densification). ``ROWS`` bins make a band.
2. Documents of one digest are one class and need no pairs. Classes that share a band meet in a bucket.
   Each bucket is a star: every class is paired with the bucket's centre, the class that meets the most
   others over all its bands (in a family of edits that is the text they were made from), so a bucket of m
   classes gives m - 1 candidates. Sizes that exclude the wanted likeness drop a candidate.
3. Candidates are confirmed on their full shingle sets, and the links' components are found by repeated
   contraction of the graph.
4. A bucket whose classes are still in several components may hide links that no star has tried. Its
   classes outside its largest component are compared with all of it in blocks of bounded size, each pair in
   the first band that it shares (the centre's pairs are known already). A block holds a byte of each bin and
   the sets of at most ``SMALL`` shingles, no others: larger sets are alike in so many bins that only a pair of
   no fewer (eight standard deviations below the mean, a chance of 1e-10) goes on to be confirmed on full sets.
   What that finds is added and components are found once more.

Nothing that grows with the documents comes to the driver. Tables between the steps are written to the
shared folder, so a lost executor costs only the step under way.

Defined cases: a document without words has no shingles, no links and is its own component; one of fewer
words than a shingle has its whole sequence as the only one; copies share a component whatever their
number; rows that repeat an id are taken for versions of one document and share a component, which links
all that is like one of them; a row without an id can be linked, and where no member of a component has an
id the component is null; ``part`` tells components apart by their texts alone, with or without ids; other
columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanquarry.llm.storage import Scratch
from spanquarry.llm.textarrays import Words, mix, slices

BINS = 96
ROWS = 4
BANDS = BINS // ROWS
BLOCK = 512
SMALL = 256
U = np.uint64
_EMPTY = np.uint64(1 << 32)
_ORDERS = np.stack([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def shingle_sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[first[r] : first[r + 1]]) for r in range(len(first) - 1)]


def bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of each non-empty set, ``BANDS`` 64-bit numbers that hold the band's number, and a byte of each bin."""
    signature = np.full((len(sets), BINS), _EMPTY, dtype=np.uint64)
    if not sets:
        return np.empty((0, BANDS), dtype=np.uint64), np.empty((0, BINS), dtype=np.uint8)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    np.minimum.at(signature.reshape(-1), row * BINS + ((every >> U(32)) % U(BINS)).astype(np.int64), every & U(0xFFFFFFFF))
    short = np.flatnonzero((signature == _EMPTY).any(1))
    given = signature[short]
    for attempt in range(BINS):
        if not len(short):
            break
        own = signature[short]
        other = given[:, _ORDERS[:, attempt]]
        own = np.where(own == _EMPTY, other, own)
        signature[short] = own
        open_rows = (own == _EMPTY).any(1)
        short, given = short[open_rows], given[open_rows]
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for lane in range(ROWS):
        keys = mix(keys * U(31) + signature[:, lane::ROWS] + U(lane + 1))
    return mix(keys ^ (np.arange(BANDS, dtype=np.uint64) << U(56))), mix(signature).astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), bands, bins and the column ``carry`` of every row."""
    more = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(*Words(data, offsets).shingles(width))
                full = [r for r, s in enumerate(sets) if len(s)]
                keys, short = bands([sets[r] for r in full])
                keys = _signed(keys)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists: list = [None] * len(sets)
                bins: list = [None] * len(sets)
                for k, r in enumerate(full):
                    lists[r], bins[r] = keys[k], short[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(bins, pa.binary()),
                     *(batch.column(2 + c).slice(lo, hi - lo) for c in range(len(more)))],
                    names=["doc_id", "n_shingles", "digest", "bands", "bins", *more],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *more)
    schema = T.StructType().add("doc_id", T.LongType()).add("n_shingles", T.LongType()).add("digest", T.BinaryType()).add("bands", T.ArrayType(T.LongType())).add("bins", T.BinaryType())
    for c in more:
        schema = schema.add(docs.schema[c])
    return rows.mapInArrow(run, schema)


def _row_key(id_col: str, text_col: str) -> Column:
    """A number of a row's id and text; a null id is none."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))


def _sets_of(docs: DataFrame, width: int) -> DataFrame:
    """rep and its shingle hashes, from (rep, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(*Words(data, offsets).shingles(width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))], names=["rep", "hashes"])

    return docs.mapInArrow(run, "rep bigint, hashes array<bigint>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of the edges (a, b); nodes share a label if a path joins them.

    Each round moves every node to its neighbour of the smallest hash, if that is smaller than its own, and
    contracts the edges. The order by hash keeps chains short, so the edges are gone after about log(n) rounds.
    """
    edges = scratch.save(edges.filter("a <> b").distinct(), "edges")
    nodes = scratch.save(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        smaller = (F.col("m.h") < F.xxhash64("v")) | ((F.col("m.h") == F.xxhash64("v")) & (F.col("m.b") < F.col("v")))
        parent = scratch.save(near.select("v", F.when(smaller, F.col("m.b")).otherwise(F.col("v")).alias("p")), "parents")
        one = edges.join(parent.withColumnsRenamed({"v": "a", "p": "pa"}), "a")
        two = one.join(parent.withColumnsRenamed({"v": "b", "p": "pb"}), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = scratch.save(two.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        moved = nodes.join(parent, nodes.label == parent.v, "left").select("node", F.coalesce("p", "label").alias("label"))
        nodes = scratch.save(moved, "labels")
    return nodes


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a")
    two = one.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return two.filter(shared * 100 >= (F.size("ha") + F.size("hb") - shared) * percent).select("a", "b")


def _fits(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _in_blocks(open_members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b, sure) between components within buckets, a block of members against a block.

    ``open_members``: key, rep, n, comp, outer (outside the bucket's largest component), m (bucket size), bands,
    bins and hashes (null beyond ``SMALL``). A pair is sure if it was compared on its sets.
    """
    share = percent / 100
    least = BINS * share - 8 * (BINS * share * (1 - share)) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        part = {c: np.array(table.column(c).to_pylist()) for c in ("side", "rep", "comp", "n")}
        keys = np.array(table.column("bands").to_pylist())
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        column = table.column("hashes").combine_chunks()
        left, right = np.flatnonzero(part["side"] == 0), np.flatnonzero(part["side"] == 1)
        found_a, found_b, sure = [], [], []
        for x in left:
            n = part["n"][right]
            ok = (part["comp"][right] != part["comp"][x]) & (np.minimum(n, part["n"][x]) * 100 >= np.maximum(n, part["n"][x]) * percent)
            mates = right[ok]
            if not len(mates):
                continue
            same = keys[mates] == keys[x]
            mates = mates[keys[x][same.argmax(1)] == key]  # others meet in an earlier band
            exact = (part["n"][x] <= SMALL) & (part["n"][mates] <= SMALL)
            close = mates[~exact & ((bins[mates] == bins[x]).sum(1) >= least)]
            found_a += [int(part["rep"][x])] * len(close)
            found_b += part["rep"][close].tolist()
            sure += [False] * len(close)
            if not exact.any():
                continue
            own = column[int(x)].values.to_numpy()
            for y in mates[exact]:
                shared = len(np.intersect1d(own, column[int(y)].values.to_numpy(), assume_unique=True))
                if shared * 100 >= (part["n"][x] + part["n"][y] - shared) * percent:
                    found_a.append(int(part["rep"][x]))
                    found_b.append(int(part["rep"][y]))
                    sure.append(True)
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    g = F.ceil(F.col("m") / block).cast("int")
    rows = open_members.withColumn("g", g).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    span = F.sequence(F.lit(0), F.col("g") - 1)
    outer = rows.filter("outer").select("*", F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(span).alias("j"))
    inner = rows.select("*", F.lit(1).alias("side"), F.explode(span).alias("i"), F.col("own").alias("j"))
    return outer.unionByName(inner).groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint, sure boolean")


def link(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, block: int = BLOCK) -> tuple[DataFrame, Scratch]:
    """doc_id, n_shingles, component_id, kept, digest, part and row key ``k`` of every row; links need ``percent`` per cent likeness."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    base = docs.select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), _row_key(id_col, text_col).alias("k"))
    # a class is named by its digest, as ids may be null or repeat
    name = F.when(F.col("digest").isNotNull(), F.xxhash64("digest"))
    signed = scratch.save(sign(base, "i", "t", width, carry="k").withColumn("rep", name), "signed")
    named = signed.filter("digest is not null")
    ids = named.groupBy("rep").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bins").alias("bins"), F.min("k").alias("k"))
    classes = scratch.save(ids, "classes")
    placed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    members = scratch.save(placed.join(shared.select("key", "m"), "key"), "members")
    weight = members.groupBy("rep").agg(F.sum("m").alias("w"))
    weighted = scratch.save(members.join(weight, "rep"), "weighted")
    centre = weighted.groupBy("key").agg(F.max(F.struct("w", "rep", "n")).alias("c"))
    centre = scratch.save(centre.select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("cn")), "centres")
    star = members.join(centre, "key").filter((F.col("rep") != F.col("centre")) & _fits("n", "cn", percent))
    star = scratch.save(star.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct(), "star")
    # one row stands for its class; rows of one id and text are made one before they are dealt out
    wanted = members.select("rep").distinct().join(classes.select("rep", "k"), "rep").hint("merge")  # it grows with the documents, so at no size is it shipped
    source = base.select("k", "t").groupBy("k").agg(F.first("t").alias("t"))
    texts = source.join(wanted, "k").select("rep", "t")
    sets = scratch.save(_sets_of(texts, width), "sets")
    links = scratch.save(_confirmed(star, sets, percent), "links")
    labels = components(links, scratch)
    # the centre has met all of its bucket; do the others of a bucket belong to several components yet?
    others = members.join(centre.select("key", F.col("centre").alias("rep")), ["key", "rep"], "left_anti")
    known = others.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", "rep", "n", "m", F.coalesce("label", "rep").alias("comp"))
    parts = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    several = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    rest = known.join(several.select("key", F.col("most.comp").alias("main")), "key").withColumn("outer", F.col("comp") != F.col("main"))
    small = sets.filter(F.size("hashes") <= SMALL)
    rest = rest.join(classes.select("rep", "bands", "bins"), "rep").join(small, "rep", "left").select("key", "rep", "n", "m", "comp", "outer", "bands", "bins", "hashes")
    met = scratch.save(_in_blocks(rest, percent, block), "met")
    unsure = met.filter(~F.col("sure")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = scratch.save(_confirmed(unsure, sets, percent).union(met.filter("sure").select("a", "b")), "more")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links, scratch)
    repeated = named.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi")
    repeated = scratch.save(repeated.select("doc_id", "a"), "repeated")
    whole = labels
    if not repeated.isEmpty():
        versions = named.select("doc_id", "rep").join(repeated, "doc_id").select("a", F.col("rep").alias("b"))
        whole = components(links.union(versions), scratch)
    lowest = whole.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("component"))
    group = whole.join(lowest, "label").select(F.col("node").alias("rep"), "component", F.lit(True).alias("linked"))
    part = labels.select(F.col("node").alias("rep"), F.col("label").alias("part"))
    by_class = classes.select("rep", "least").join(group, "rep", "left").join(part, "rep", "left")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("least"))
    by_class = scratch.save(by_class.select("rep", component.alias("component"), F.coalesce("part", "rep").alias("part")), "by-class")
    joined = signed.select("doc_id", "n_shingles", "digest", "rep", "k").join(by_class, "rep", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"), "digest", "part", "k")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "digest", "part", "k"), scratch


def keep_one(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, columns as they are, that stand for their component.

    Components are those of the texts (``part``), so rows that only share an id, or have none, are not taken
    for copies. The row of the smallest id stays, any id before none; of several such rows the one of the
    smallest digest. Rows without words are no one's copies and all stay.
    """
    linked, _ = link(docs, id_col, text_col, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "k", "rows")
    same = linked.filter("digest is not null").groupBy("part", "doc_id", "digest", "k").agg(F.count(F.lit(1)).alias("rows"))
    best = same.groupBy("part").agg(F.min(order).alias("best")).select("best.k", "best.rows")
    told = Scratch(docs.sparkSession, "keep-one").save(best, "kept")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        _row_key(id_col, text_col).alias("k"),
        (~F.coalesce(F.col(text_col), F.lit("")).rlike("[^\\x09-\\x0D\\x20]")).alias("blank"),
    )
    pool = rows.filter(~F.col("blank")).select("k", "row")
    if not told.filter("rows > 1").isEmpty():
        pool = pool.groupBy("k").agg(F.first("row").alias("row"))  # rows of one id and text are one
    kept = pool.join(told.select("k").hint("merge"), "k", "left_semi")
    return kept.select("row.*").unionByName(rows.filter("blank").select("row.*"))


def link_sql(width: int = 3, percent: int = 85) -> str:
    """DuckDB SQL that joins all documents on all shingles and spreads the smallest id along the links."""
    low = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{width - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-{width - 1}, 1)+1)) AS i FROM cut WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100*c >= {percent}*(x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, lab) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.lab FROM r JOIN e ON r.node = e.a WHERE r.lab < e.b),
c AS (SELECT node, min(lab) AS c FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id"""
