"""Removal of repeated byte windows, by most-significant-digit passes over content-chosen suffixes.

A window is the first ``depth`` bytes of a suffix. Sorting all suffixes only through that depth makes equal
groups exactly the repeated windows, and a radix sort from the most significant digit may drop every group
of one after each pass. Shipping every suffix of the corpus for the first pass would cost some twenty times
the input, so the first digit is taken where the content says: of the ``gram``-byte strings in a window the
one of the smallest hash (the leftmost of equals) is its anchor. Equal windows have equal anchors at equal
places, and neighbouring windows mostly share one, so a run of windows is one row.

1. First digit, the anchor: anchors that occur once anywhere leave (most do).
2. Second digit, the bytes that a run of windows with one anchor covers: runs that agree in all of them are
   repeated as a whole and need no further pass.
3. Third digit, for runs whose anchor is repeated but whose bytes are not, the ends of repeated passages:
   they are opened into blocks of ``BLOCK`` windows, aligned to the anchor. The bytes that all windows of a
   block share are the digit; blocks alone in it hold no repeated window and leave, and blocks that agree in
   all bytes are repeated as a whole.
4. Last digit, the window itself, for the blocks left: those in which a repeated passage begins or ends.
   In passes 3 and 4 one run or block stands for all that are equal.

Groups are counted, never gathered: a passage that a third of all documents share is a few counters. Copies
of a text are merged before their texts are shuffled, which happens once and only for the last pass and the
cutting. Digits are 64-bit hashes and are compared together with the anchor's (128 bits).

Defined cases: a null text is empty; a text shorter than a window loses nothing; copies of a text lose
everything that a window covers; rows that repeat an id are separate documents; a null id stays null; other
columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.storage import Scratch
from spanquarry.llm.textarrays import PRIME, mix, powers, slices, small_powers

DEPTH = 200
GRAM = 64
BLOCK = 8
FLUSH = 1_000_000
SUMMED = 1 << 24  # so many terms of at most 256 * 2**31 stay below 2**63
U = np.uint64
_HIGH, _LOW = U(0xFFFFFFFF00000000), U(0xFFFFFFFF)


class Hashes:
    """Hashes of any byte range of a slice, by prefix sums.

    ``of`` is a polynomial modulo 2**64, for the anchors: that has colliding strings of a thousand bytes, not of
    ``GRAM``. ``strong`` adds one modulo a prime, which those do not meet; digits that stand for bytes use it.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        wide = data.astype(np.uint64) + U(1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(wide * up[:n], out=self.sums[1:])
        self.wide = wide
        self.small: np.ndarray | None = None

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def strong(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.small is None:
            n = len(self.wide)
            up, self.small_down = small_powers(n + 1)
            terms = self.wide * up[:n]
            if n >= SUMMED:
                terms %= U(PRIME)
            self.small = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(terms, out=self.small[1:])
        other = (self.small[end] - self.small[start]) % U(PRIME) * self.small_down[start] % U(PRIME)
        return mix(self.of(start, end) + other * U(0x9E3779B97F4A7C15))


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int, bodies: bool = True) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, start (in the row), length, off (from start to anchor), anchor and, if asked for, body (hashes)."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < depth:
        return {"row": none, "start": none, "length": none, "off": none, "anchor": none.astype(np.uint64), "body": none.astype(np.uint64)}
    hashes = Hashes(data)
    grams = hashes.of(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    keyed = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    place = (_window_min(keyed, depth - gram + 1) & _LOW).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long = sizes >= depth
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - depth + 1, -1)
    inside = np.cumsum(inside)[: len(place)] > 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    starts_of_rows = offsets[:-1][long]
    fresh[starts_of_rows[starts_of_rows < len(fresh)]] = True
    start = np.flatnonzero(fresh)
    row = np.searchsorted(offsets, start, side="right") - 1
    # a run ends before the next one or with the row's last window
    end = np.minimum(np.append(start[1:], len(data)), offsets[row + 1] - depth + 1)
    at = place[start]
    found = {"row": row, "start": start - offsets[row], "length": end - start, "off": at - start, "anchor": grams[at]}
    if not bodies:
        return found
    body = hashes.strong(start, end - 1 + depth)
    body = mix(body ^ ((at - start).astype(np.uint64) << U(32)) ^ (end - start).astype(np.uint64))
    return found | {"body": body}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _distinct(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The first row of each (key, check) of a batch, and the number of its copies."""
    both = np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)
    _, first, n = np.unique(both, axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    return batch.take(pa.array(first[order])), n[order].astype(np.int64)


def _anchors(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """(anchor, n) over (key, check, t), summed within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, size = [], [], 0

        def out() -> pa.RecordBatch:
            kinds, which = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(which, np.concatenate(times), len(kinds)).astype(np.int64)
            return pa.RecordBatch.from_arrays([_signed(kinds), pa.array(n)], names=["anchor", "n"])

        for batch in batches:
            batch, copies = _distinct(batch)
            for lo, _, data, offsets in slices(batch.column(2)):
                found = runs(data, offsets, depth, gram, bodies=False)
                held.append(found["anchor"])
                times.append(copies[lo + found["row"]])
                size += len(found["anchor"])
                if size > FLUSH:
                    yield out()
                    held, times, size = [], [], 0
        if size:
            yield out()

    return texts.mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _runs(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """(key, check, start, length, off, anchor, body, n) over (key, check, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, copies = _distinct(batch)
            key, check = (batch.column(c).to_numpy() for c in (0, 1))
            for lo, _, data, offsets in slices(batch.column(2)):
                r = runs(data, offsets, depth, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo + r["row"]]), pa.array(check[lo + r["row"]]), pa.array(r["start"].astype(np.int32)), pa.array(r["length"].astype(np.int32)), pa.array(r["off"].astype(np.int32)), _signed(r["anchor"]), _signed(r["body"]), pa.array(copies[lo + r["row"]])],
                    names=["key", "check", "start", "length", "off", "anchor", "body", "n"],
                )

    return texts.mapInArrow(run, "key bigint, check bigint, start int, length int, off int, anchor bigint, body bigint, n bigint")


def _opened(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges, and the range of each."""
    which = np.repeat(np.arange(len(starts)), lengths)
    return starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths), which


def _each(table: DataFrame, schema: str, names: list[str], of) -> DataFrame:
    """``of(bytes, ranges)`` (columns of equal length) for every (key, check, t, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key, check, text = (batch.column(c)[r].as_py() for c in range(3))
                ranges = batch.column(3).slice(r, 1).flatten()
                fields = {f.name: ranges.field(f.name).to_numpy(zero_copy_only=False) for f in ranges.type}
                columns = of(np.frombuffer(text.encode(), dtype=np.uint8), fields)
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, check)), *columns], names=["key", "check", *names])

    return table.mapInArrow(run, f"key bigint, check bigint, {schema}")


def _blocks(table: DataFrame, depth: int, block: int) -> DataFrame:
    """Blocks of ``block`` windows of the runs: anchor, j (number of the block, from the anchor), core, start, length, off, body, n."""

    def of(data: np.ndarray, r: dict) -> list[pa.Array]:
        hashes = Hashes(data)
        start, length, off = (r[c].astype(np.int64) for c in ("start", "length", "off"))
        # offsets of a run's windows from the anchor go from off down to off - length + 1
        high, low = off // block, (off - length + 1) // block
        j, which = _opened(low, high - low + 1)
        pos = (start + off)[which]
        first = pos - np.minimum(j * block + block - 1, off[which])
        last = pos - np.maximum(j * block, (off - length + 1)[which])
        own = pos - first
        core = hashes.strong(pos - j * block, pos - j * block - block + 1 + depth)
        body = mix(hashes.strong(first, last + depth) ^ (own.astype(np.uint64) << U(32)) ^ (last - first).astype(np.uint64))
        return [pa.array(r["anchor"][which]), pa.array(j.astype(np.int32)), _signed(core), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(own.astype(np.int32)), _signed(body), pa.array(r["n"][which])]

    return _each(table, "anchor bigint, j int, core bigint, start int, length int, off int, body bigint, n bigint", ["anchor", "j", "core", "start", "length", "off", "body", "n"], of)


def _windows(table: DataFrame, depth: int) -> DataFrame:
    """Windows of the blocks: anchor, start, window (hash), n."""

    def of(data: np.ndarray, r: dict) -> list[pa.Array]:
        at, which = _opened(r["start"].astype(np.int64), r["length"].astype(np.int64))
        return [pa.array(r["anchor"][which]), pa.array(at.astype(np.int32)), _signed(Hashes(data).strong(at, at + depth)), pa.array(r["n"][which])]

    return _each(table, "anchor bigint, start int, window bigint, n bigint", ["anchor", "start", "window", "n"], of)


def _settle(kinds: DataFrame, group: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of (group, body, key, check, start, length, off, n): the members of repeated bodies, and one member of
    each body of the groups that have several bodies, one of them alone, with n for all its equals."""
    body = kinds.groupBy(*group, "body").agg(F.sum("n").alias("nb"), F.min(F.struct("key", "check", "start")).alias("first"))
    body = scratch.save(body, f"{name}-bodies")
    split = body.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.min("nb").alias("least")).filter("k > 1 AND least = 1").select(*group)
    whole = kinds.join(body.filter("nb > 1").select(*group, "body"), [*group, "body"], "left_semi").select("key", "check", "start", "length")
    stands = body.join(split, group, "left_semi").select(*group, "body", "nb", *(F.col(f"first.{c}").alias(c) for c in ("key", "check", "start")))
    stands = kinds.drop("n").join(stands, [*group, "body", "key", "check", "start"]).withColumnRenamed("nb", "n")
    return whole, scratch.save(stands, f"{name}-stands")


def cut(data: bytes, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and the rest, for runs of repeated windows."""
    edges = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths - 1 + depth, -1)
    gone = np.cumsum(edges)[:-1] > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


def _cuts(found: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, check, text, ranges in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                removed, spans, rest = cut(text.encode(), np.array([r["start"] for r in ranges]), np.array([r["length"] for r in ranges]), depth)
                rows.append((key, check, removed, spans, hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "check", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "key bigint, check bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, depth: int = DEPTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    gram = gram or max(1, min(GRAM, depth // 3))
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t"))
    keyed = rows.select("doc_id", F.xxhash64("t").alias("key"), F.crc32(F.col("t").cast("binary")).alias("check"), "t")
    enough = keyed.filter(F.octet_length("t") >= depth)
    # first digit
    repeated = scratch.save(_anchors(enough.select("key", "check", "t"), depth, gram).filter("n > 1").select("anchor"), "anchors")
    # second digit; copies of a text are counted here and merged
    every = _runs(enough.select("key", "check", "t"), depth, gram).join(repeated, "anchor")
    every = every.repartition("anchor", "body", "key")  # of its own, so that the join above may split a hot anchor
    kinds = scratch.save(every.groupBy("anchor", "body", "key", "check", "start", "length", "off").agg(F.sum("n").alias("n")), "runs")
    whole, stands = _settle(kinds, ["anchor"], scratch, "run")
    wanted = kinds.select("key", "check").distinct()
    texts = keyed.groupBy("key", "check").agg(F.first("t").alias("t")).join(wanted, ["key", "check"], "left_semi")
    texts = scratch.save(texts, "texts")

    def with_text(rows: DataFrame, *columns: str) -> DataFrame:
        ranges = rows.groupBy("key", "check").agg(F.collect_list(F.struct(*columns)).alias("ranges"))
        return texts.join(ranges, ["key", "check"]).select("key", "check", "t", "ranges")

    # third digit
    blocks = scratch.save(_blocks(with_text(stands, "start", "length", "off", "anchor", "n"), depth, min(BLOCK, depth - gram + 1)), "blocks")
    whole_blocks, left = _settle(blocks, ["anchor", "j", "core"], scratch, "block")
    # last digit
    windows = scratch.save(_windows(with_text(left, "start", "length", "anchor", "n"), depth), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "window")
    single = windows.join(twice, ["anchor", "window"], "left_semi").select("key", "check", "start", F.lit(1).alias("length"))
    found = with_text(whole.unionByName(whole_blocks).unionByName(single), "start", "length")
    cuts = scratch.save(_cuts(found, depth), "cuts")
    plain = keyed.select("doc_id", "key", "check", F.octet_length("t").cast("bigint").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("full"))
    joined = plain.join(cuts, ["key", "check"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "full").alias("kept_sha256"))


def remove_repeats_sql(depth: int = DEPTH) -> str:
    """DuckDB SQL that counts every window of every document and joins touching ones to runs."""
    return f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text,'')))) AS hx, strlen(coalesce(text,''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, pos, md5(substr(hx, 2*pos+1, {2 * depth})) AS h FROM (SELECT doc_id, hx, unnest(range(0, n-{depth - 1})) AS pos FROM d)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM w SEMI JOIN m USING (h)),
k AS (SELECT doc_id, pos, sum(CASE WHEN prior IS NULL OR pos > prior + {depth} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM r),
i AS (SELECT doc_id, k, min(pos) AS a, max(pos) + {depth} AS b FROM k GROUP BY ALL),
g AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS open FROM i),
t AS (SELECT doc_id, count(*) AS spans, sum(b-a)::BIGINT AS gone, max(b) AS last, string_agg(substr(hx, 2*open+1, 2*(a-open)), '' ORDER BY k) AS rest FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, '') || substr(hx, 2*coalesce(last, 0)+1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
