"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest of a text's distinct shingle hashes, so the sketch of a union is made of
the sketches of its parts (``merge``). From it come the distinct shingle count, the resemblance of two
texts and the containment of one in another. Shingles are runs of five words (a shorter text is one
shingle), words are runs other than ASCII white space with A-Z lowered.

``fingerprint_edits`` compares every text with an edit of it that borrows from the next document. Documents
are dealt to ranges of (descending id, hash of the text) once, as many as the session has shuffle partitions and
one for every ``ROWS_PER_RANGE`` documents at least, and the first document of each range is also dealt to the range before it, so that every document meets its next one
in a task that holds a few rows at a time. Rows that share an id, or have none, are split between ranges by
their texts' hashes. The ranges' limits come from a bounded sample of the keys, of which the driver holds two
numbers a row; which row begins a range reaches the documents by a join with a row a range.

Defined cases: a null or empty text has an empty sketch, likeness 1 to another empty one and 0 to any
other; ids are ordered descending with nulls last and equal ids by a hash of the text, so repeated rows follow
each other; a single document is its own next one; a text of any length is one row that a task holds with its
next one and their edit; other columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.llm.storage import Scratch
from spanquarry.llm.textarrays import SLICE_BYTES, Words, raw

K = 128
WIDTH = 5
BITS = 48
SAMPLE = 20
ROWS_PER_RANGE = 1 << 16


def sketches(texts: list[bytes], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The ``k`` smallest distinct shingle hashes of each text, ascending, of ``BITS`` bits."""
    data, offsets = raw(pa.array(texts, pa.large_binary()))
    hashes, first = Words(data, offsets).shingles(width)
    hashes >>= np.uint64(64 - BITS)
    out = []
    for r in range(len(texts)):
        own = hashes[first[r] : first[r + 1]]
        if len(own) > 4 * k:  # most long texts need no full sort
            small = np.unique(own[own <= np.partition(own, 2 * k)[2 * k]])
            own = small if len(small) >= k else own
        out.append(np.unique(own)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[-1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard likeness; exact where the union has at most ``k`` shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def dumps(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def loads(s: str) -> np.ndarray:
    part = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = part
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_distinct", pa.float64()), ("distinct_both", pa.float64()), ("kept_share", pa.float64())]
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, distinct_both double, kept_share double"


def _rows(pending: list[tuple]) -> pa.RecordBatch:
    """Result rows of (id, text, next text) triples."""
    changed = [edited(t, n).encode() for _, t, n in pending]
    own = sketches([t.encode() for _, t, _ in pending])
    # the next text is mostly the following triple's own one
    other = [own[i + 1] if i + 1 < len(pending) and pending[i + 1][1] is pending[i][2] else sketches([pending[i][2].encode()])[0] for i in range(len(pending))]
    new = sketches(changed)
    columns = [
        [i for i, _, _ in pending],
        [len(t) for _, t, _ in pending],
        [hashlib.sha256(c).hexdigest() for c in changed],
        [dumps(a) for a in own],
        [dumps(a) for a in new],
        [resemblance(a, b) for a, b in zip(own, new, strict=True)],
        [resemblance(a, b) for a, b in zip(own, other, strict=True)],
        [distinct(a) for a in own],
        [distinct(merge(a, b)) for a, b in zip(own, new, strict=True)],
        [containment(a, b) for a, b in zip(own, new, strict=True)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ghost, id, text) in order: each row's next one is the row after it within its range."""
    last = None
    pending: list[tuple] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for where, ghost, i, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                if last is not None and last[0] == where and not last[1]:
                    pending.append((last[2], last[3], text))
                    held += len(text)
                    if held >= SLICE_BYTES // 2:
                        yield _rows(pending)
                        pending, held = [], 0
                last = (where, ghost, i, text)
    if pending:
        yield _rows(pending)


def _cuts(keys: DataFrame, n: int, ranges: int) -> list[tuple[int, int]]:
    """At most ``ranges`` - 1 keys that split the ``n`` keys (a, h) into ranges of like size, from a sample of
    ``SAMPLE`` a range. It decides how even the ranges are, nothing else."""
    if ranges < 2:
        return []
    share = F.lit(min(1.0, 2.0 * SAMPLE * ranges / n))
    picked = keys.filter(F.pmod(F.xxhash64("a", "h", F.lit("cut")), F.lit(1 << 20)) < share * (1 << 20)).limit(4 * SAMPLE * ranges).toArrow()
    a, h = (picked.column(c).to_numpy() for c in ("a", "h"))
    order = np.lexsort((h, a))
    at = sorted({int(k * len(order) / ranges) for k in range(1, ranges)}) if len(order) else []
    return sorted({(int(a[order[k]]), int(h[order[k]])) for k in at})


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are at or below (a, h). The cuts are one constant of the plan, looked up in two levels."""
    if not cuts:
        return F.lit(0)
    size = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    table = F.from_json(F.lit(json.dumps([[{"a": a, "h": h} for a, h in g] for g in groups])), "array<array<struct<a:bigint,h:bigint>>>")
    own = F.struct("a", "h")
    group = F.size(F.filter(table, lambda g: F.get(g, 0) <= own))  # of the groups that begin at or below, the last
    inner = F.size(F.filter(F.get(table, F.greatest(group - 1, F.lit(0))), lambda c: c <= own))
    return F.when(group == 0, 0).otherwise((group - 1) * size + inner).cast("int")


def fingerprint_edits(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row, with
    n_distinct (estimated distinct shingles), distinct_both (of the text and its edit together, from merged
    sketches) and kept_share (estimated share of the text's shingles that the edit has)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # descending ids are ascending complements, those of null ids last
    key = F.coalesce(F.bitwise_not(F.col(id_col).cast("bigint")), F.lit((1 << 63) - 1)).alias("a")
    rows = docs.select(key, F.xxhash64(text).alias("h"), F.col(id_col).cast("bigint").alias("i"), text.alias("t"))
    keys = scratch.save(rows.select("a", "h"), "keys")
    n = keys.count()
    cuts = _cuts(keys, max(n, 1), ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE)))
    rows = rows.withColumn("r", _range_of(cuts))
    firsts = scratch.save(keys.withColumn("r", _range_of(cuts)).groupBy("r").agg(F.min(F.struct("a", "h")).alias("first")), "firsts")
    # the range before a range also gets that range's first row; the last range gets that of the first
    order = Window.orderBy("r")  # a row a range
    before = firsts.select("first.a", "first.h", F.coalesce(F.lag("r").over(order), F.max("r").over(Window.partitionBy())).alias("ghost"))
    dealt = rows.join(F.broadcast(before), ["a", "h"], "left")
    places = F.array_compact(F.array(F.struct("r", F.lit(0).alias("g")), F.when(F.col("ghost").isNotNull(), F.struct(F.col("ghost").alias("r"), F.lit(1).alias("g")))))
    dealt = dealt.select(F.explode(places).alias("p"), "a", "h", "i", "t").select("p.r", "p.g", "a", "h", "i", "t")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("r")).sortWithinPartitions("r", "g", "a", "h", "t")
    return dealt.select("r", "g", "i", "t").mapInArrow(_walk, _SCHEMA)
