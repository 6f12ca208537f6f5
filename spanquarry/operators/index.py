"""Suffix tables of documents and what is derived from them: BWT, C and Occ tables, jumps, run lengths.

Suffixes are local to a document and ordered by unsigned bytes with the end of the document lowest, so row
0 is the empty suffix. The symbol before the whole document is ``SENTINEL``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.functions.binary import byte_at

SENTINEL = 256
MOST_BYTES = 4 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1 << 18


def suffixes(corpus: DataFrame) -> DataFrame:
    """(doc_id, sa_row, off, bwt) by sorting the suffixes themselves; for documents of some kilobytes."""
    rows = corpus.select("doc_id", "content", F.posexplode(F.array_sort(F.transform(F.sequence(F.lit(0), F.length("content")), lambda i: F.struct(F.substring(F.col("content"), i + 1, F.length("content")).alias("suffix"), i.alias("off"))))).alias("sa_row", "s"))
    return rows.select("doc_id", F.col("sa_row").cast("bigint").alias("sa_row"), F.col("s.off").cast("bigint").alias("off"), _before(F.col("content"), F.col("s.off")).alias("bwt"))


def _before(content: Column, off: Column) -> Column:
    return F.when(off == 0, SENTINEL).otherwise(byte_at(content, off - 1)).cast("int")


def suffix_order(data: bytes) -> np.ndarray:
    """The suffix array with the empty suffix first, by prefix doubling from seven bytes on.

    A rank is the first row of its group. Only groups of several suffixes are sorted again; theirs are no
    shorter than ``width``, as the end of the document differs from every byte.
    """
    n = len(data)
    symbols = np.zeros(n + 7, dtype=np.int64)
    symbols[:n] = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    key = np.zeros(n + 1, dtype=np.int64)
    for k in range(7):
        key = key * 257 + symbols[k : k + n + 1]
    order = np.argsort(key, kind="stable")
    rows, width = np.arange(n + 1), 7
    rank = np.empty(n + 1, dtype=np.int64)
    key = key[order]
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        rows = rows[~(first & np.concatenate([first[1:], [True]]))]
        if not len(rows):
            return order
        own = order[rows]
        key = rank[own] * (n + 1) + rank[own + width]
        by = np.argsort(key, kind="stable")
        order[rows] = own[by]
        key = key[by]
        width *= 2


def suffixes_long(corpus: DataFrame) -> DataFrame:
    """As ``suffixes``, a document at a time in Arrow batches; for documents of any length that fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py() or b""
                order = suffix_order(data)
                n = len(order)
                ids = batch.column(0).take(pa.array(np.full(n, at)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(n)), pa.array(order), pa.array(_symbols_before(data, order))], names=["doc_id", "sa_row", "off", "bwt"])

    return corpus.select("doc_id", "content").mapInArrow(run, "doc_id bigint, sa_row bigint, off bigint, bwt int")


def _symbols_before(data: bytes, off: np.ndarray) -> np.ndarray:
    symbols = np.concatenate([[SENTINEL], np.frombuffer(data, dtype=np.uint8)]).astype(np.int32)
    return symbols[off]


def _violations(table: DataFrame, corpus: DataFrame, wrong) -> DataFrame:
    """(doc_id, sa_row) of the rows that ``wrong`` (content, offsets, symbols, in row order) marks, a document at a time.

    A document's content meets its rows once; it is not carried by every row.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "sa_row": pa.array([], pa.int64())})
        left = left.sort_by("sa_row")
        bad = wrong(right.column("content")[0].as_py() or b"", left.column("off").to_numpy(), left.column("bwt").to_numpy())
        return left.select(["doc_id", "sa_row"]).filter(pa.array(bad))

    rows = table.select("doc_id", "sa_row", "off", F.coalesce("bwt", F.lit(-1)).alias("bwt"))
    return rows.groupBy("doc_id").cogroup(corpus.select("doc_id", "content").groupBy("doc_id")).applyInArrow(run, "doc_id bigint, sa_row bigint")


def order_violations(table: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows whose suffix is not above that of the row before, or whose offset is outside the document (an empty suffix)."""

    def wrong(data: bytes, off: np.ndarray, _: np.ndarray) -> np.ndarray:
        place = np.empty(len(data) + 1, dtype=np.int64)
        place[suffix_order(data)] = np.arange(len(data) + 1)
        outside = (off < 0) | (off > len(data))
        own = place[np.where(outside, len(data), off)]
        return outside | np.concatenate([[False], own[1:] <= own[:-1]])

    return _violations(table, corpus, wrong)


def bwt_violations(table: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows whose symbol is not the byte before their offset, or whose offset is outside the document."""

    def wrong(data: bytes, off: np.ndarray, bwt: np.ndarray) -> np.ndarray:
        outside = (off < 0) | (off > len(data))
        return outside | (bwt != _symbols_before(data, np.where(outside, 0, off)))

    return _violations(table, corpus, wrong)


def c_table(table: DataFrame) -> DataFrame:
    """(doc_id, symbol, n, c): symbol counts and how many symbols of the document are lower, the sentinel lowest."""
    order = F.when(F.col("symbol") == SENTINEL, -1).otherwise(F.col("symbol"))
    counts = table.groupBy("doc_id", F.col("bwt").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("c", F.coalesce(below, F.lit(0)))


def occ_table(table: DataFrame, step: int = 32) -> DataFrame:
    """(doc_id, block, symbol, before): occurrences of a symbol in the rows before each of its blocks of ``step`` rows."""
    counts = table.groupBy("doc_id", F.floor(F.col("sa_row") / step).alias("block"), F.col("bwt").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("doc_id", "symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("doc_id", "block", "symbol", "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))


def rank(table: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, symbol, pos, occ): occurrences of ``symbol`` in BWT rows before ``pos``."""
    hits = queries.join(table, (queries.doc_id == table.doc_id) & (queries.symbol == table.bwt) & (table.sa_row < queries.pos), "left")
    return hits.groupBy(queries.doc_id, queries.symbol, queries.pos).agg(F.count("sa_row").alias("occ"))


def intervals(table: DataFrame, corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, doc_id, l, r) of patterns that occur: rows l to r - 1 are the suffixes that begin with them."""
    rows = table.join(corpus.select("doc_id", "content"), "doc_id").join(F.broadcast(patterns.filter(F.length("pattern") > 0)), F.lit(True))
    starts = F.substring(F.col("content"), F.col("off").cast("int") + 1, F.length("pattern")) == F.col("pattern")
    return rows.filter(starts).groupBy("query_id", "doc_id").agg(F.min("sa_row").alias("l"), (F.max("sa_row") + 1).alias("r"))


class Runs:
    """Rank and LF over the runs of one document's BWT, by prefix sums at the runs' beginnings."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        order = np.where(symbols == SENTINEL, -1, symbols).astype(np.int16)
        by = np.argsort(order, kind="stable")
        kinds = order[by]
        begin = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        below = np.concatenate([[0], np.cumsum(lengths[by])]).astype(np.int64)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # symbol: its runs, and how many symbols are lower or in its runs before each
        self.first: dict[int, int] = {}  # symbol: symbols that are lower
        self.step = np.empty(len(symbols), dtype=np.int64)  # the row that the first row of a run leads to
        self.step[by] = below[:-1]
        for symbol, x, y in zip(kinds[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(by)], strict=True):
            self.of[symbol], self.first[symbol] = (by[x:y], below[x : y + 1]), int(below[x])

    def rank(self, symbol: int, row: int) -> int:
        """Occurrences of a symbol in the rows before ``row``."""
        if symbol not in self.of:
            return 0
        which, before = self.of[symbol]
        k = int(np.searchsorted(self.start[which], row))
        inside = min(row, int(self.start[which[k - 1] + 1])) - int(self.start[which[k - 1]]) if k else 0
        return int(before[k - 1] - before[0]) + inside if k else 0

    def steps(self) -> np.ndarray:
        """The row that each row leads to, the row of offset 0 to -1."""
        lengths = np.diff(self.start)
        out = np.repeat(self.step - self.start[:-1], lengths) + np.arange(self.start[-1])
        out[self.start[self.of[-1][0][0]]] = -1
        return out

    def search(self, pattern: bytes) -> tuple[int, int]:
        """The rows [l, r) of the suffixes that begin with the pattern, a byte at a time from its end."""
        l, r = 0, int(self.start[-1])
        for b in reversed(pattern):
            if b not in self.first:
                return 0, 0
            l, r = self.first[b] + self.rank(b, l), self.first[b] + self.rank(b, r)
            if l >= r:
                return 0, 0
        return l, r

    def walk(self, rows: np.ndarray, sampled: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of rows and the steps to the nearest sampled row before them in the text; row of offset 0 ends a walk."""
        known = np.array(sorted(sampled), dtype=np.int64)
        value = np.array([sampled[k] for k in known.tolist()], dtype=np.int64)
        origin = int(self.start[self.of[-1][0][0]])
        at, steps, base = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            now = at[open_]
            place = np.minimum(np.searchsorted(known, now), max(len(known) - 1, 0))
            hit = (known[place] == now) if len(known) else np.zeros(len(now), dtype=bool)
            base[open_[hit]] = value[place[hit]]
            begin = ~hit & (now == origin)
            base[open_[begin]] = 0
            open_, now = open_[~hit & ~begin], now[~hit & ~begin]
            run = np.searchsorted(self.start, now, side="right") - 1
            at[open_] = self.step[run] + now - self.start[run]
            steps[open_] += 1
        return base + steps, steps


def _few(patterns: DataFrame) -> list[tuple]:
    """The patterns on the driver; they are the small side, of a checked size."""
    good = patterns.filter(F.length("pattern") > 0).select("query_id", "pattern")
    if (good.agg(F.sum(F.length("pattern") + 64).alias("n")).first()["n"] or 0) > MOST_BYTES:
        raise ValueError("TOO_MANY_PATTERNS")
    return [(r["query_id"], bytes(r["pattern"])) for r in good.collect()]


def backward_search(runs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, doc_id, l, r) by backward search over the run-length BWT (doc_id, run_id, symbol, length)."""
    wanted = runs.sparkSession.sparkContext.broadcast(_few(patterns))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("run_id")
        index = Runs(table.column("symbol").to_numpy(), table.column("length").to_numpy())
        doc = table.column("doc_id")[0].as_py()
        found = [(q, doc, *index.search(p)) for q, p in wanted.value]
        found = [f for f in found if f[3] > f[2]]
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(("query_id", "doc_id", "l", "r"))})

    return runs.groupBy("doc_id").applyInArrow(run, "query_id bigint, doc_id bigint, l bigint, r bigint")


def walk(runs: DataFrame, samples: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, sa_row, off, steps) of ``rows`` (doc_id, sa_row) by LF steps to rows of ``samples`` (doc_id, sa_row, off).

    Only the runs and the samples are read: no other offset is stored.
    """
    both = samples.select("doc_id", "sa_row", "off").unionByName(rows.select("doc_id", "sa_row", F.lit(None).cast("bigint").alias("off")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("doc_id", "sa_row", "off", "steps")
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        left = left.sort_by("run_id")
        index = Runs(left.column("symbol").to_numpy(), left.column("length").to_numpy())
        off = right.column("off").combine_chunks()
        at = right.column("sa_row").to_numpy()
        kept = off.is_valid().to_numpy(zero_copy_only=False)
        sampled = dict(zip(at[kept].tolist(), off.drop_null().to_pylist(), strict=True))
        offsets, steps = index.walk(at[~kept], sampled)
        doc = left.column("doc_id")[0].as_py()
        return pa.table({"doc_id": pa.array([doc] * len(steps), pa.int64()), "sa_row": pa.array(at[~kept]), "off": pa.array(offsets), "steps": pa.array(steps)})

    return runs.groupBy("doc_id").cogroup(both.groupBy("doc_id")).applyInArrow(run, "doc_id bigint, sa_row bigint, off bigint, steps bigint")


def _planes(values: np.ndarray) -> list[bytes]:
    """The lowest bytes of all values, then the next; no further planes than the largest needs. Apart, they compress well."""
    most = int(values.max())
    return [(values >> 8 * k).astype(np.uint8).tobytes() if not k or most >> 8 * k else b"" for k in range(4)]


def _from_planes(planes: list[bytes]) -> np.ndarray:
    out = np.frombuffer(planes[0], dtype=np.uint8).astype(np.int64)
    for k, plane in enumerate(planes[1:], 1):
        if plane:
            out |= np.frombuffer(plane, dtype=np.uint8).astype(np.int64) << 8 * k
    return out


def _walk_along(to: np.ndarray, step: int, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Offsets of rows from those of every ``step``-th row; a row leads to row ``to``, that of offset 0 to -1."""
    off, at, open_, steps = np.empty(len(rows), dtype=np.int64), rows, np.arange(len(rows)), 0
    while len(open_):
        hit = at % step == 0
        off[open_[hit]] = known[at[hit] // step] + steps
        open_, at, steps = open_[~hit], to[at[~hit]], steps + 1
        begin = at < 0
        off[open_[begin]] = steps - 1
        open_, at = open_[~begin], at[~begin]
    return off


PACKED = ["symbols", *(f"length{k}" for k in range(4)), *(f"offset{k}" for k in range(4))]


def packed(corpus: DataFrame, step: int = 1) -> DataFrame:
    """One row a document: the runs of its BWT and the offsets of every ``step``-th row of its suffix table.

    ``sentinel`` is the run of the sentinel, whose byte in ``symbols`` is 0. Numbers stand as planes of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size = [], [], 0
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py() or b""
                order = suffix_order(data)
                bwt = _symbols_before(data, order)
                begin = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
                symbols = bwt[begin]
                lengths = np.diff(np.append(begin, len(bwt)))
                ids.append(batch.column(0)[at].as_py())
                rows.append((int(np.argmax(symbols == SENTINEL)), (symbols & 255).astype(np.uint8).tobytes(), *_planes(lengths), *_planes(order[::step])))
                size += sum(map(len, rows[-1][1:]))
                if size > BATCH_BYTES or at + 1 == batch.num_rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["doc_id", "sentinel", *PACKED])
                    ids, rows, size = [], [], 0

    return corpus.select("doc_id", "content").mapInArrow(run, "doc_id bigint, sentinel bigint, " + ", ".join(f"{c} binary" for c in PACKED))


def locate_packed(index: DataFrame, patterns: DataFrame, step: int = 1) -> DataFrame:
    """(query_id, doc_id, doc_offset) from ``packed`` documents alone: rows by backward search over the runs, their
    offsets from the stored ones or, where only every ``step``-th is stored, by LF steps to these.

    The walks of many documents go on together. Their rows are numbered one after the other, each document's from a
    multiple of ``step``.
    """
    wanted = index.sparkSession.sparkContext.broadcast(_few(patterns))

    def placed(queries: list, docs: list, rows: list, known: list, to: list) -> pa.RecordBatch:
        at, stored = np.concatenate(rows), np.concatenate(known)
        off = stored[at] if step == 1 else _walk_along(np.concatenate(to), step, stored, at)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries), pa.int64()), pa.array(np.concatenate(docs), pa.int64()), pa.array(off)], names=["query_id", "doc_id", "doc_offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, base, size = [[] for _ in range(5)], 0, 0
            for at in range(batch.num_rows):
                doc, sentinel, symbols, *planes = (c[at].as_py() for c in batch.columns)
                symbols = np.frombuffer(symbols, dtype=np.uint8).astype(np.int32)
                symbols[sentinel] = SENTINEL
                runs = Runs(symbols, _from_planes(planes[:4]))
                found = [f for f in ((q, *runs.search(p)) for q, p in wanted.value) if f[2] > f[1]]
                if found:
                    rows = np.concatenate([np.arange(l, r) for _, l, r in found]) + base
                    known, to = _from_planes(planes[4:]), np.empty(0, dtype=np.int64)
                    if step > 1:
                        to = np.full(len(known) * step, -1)
                        steps = runs.steps()
                        to[: len(steps)] = np.where(steps < 0, -1, steps + base)
                    for part, own in zip(held, (np.repeat([q for q, _, _ in found], [r - l for _, l, r in found]), np.full(len(rows), doc), rows, known, to), strict=True):
                        part.append(own)
                    base += len(known) * step
                    size += len(rows)
                if size and (max(base, size) > BATCH_ROWS or at + 1 == batch.num_rows):
                    yield placed(*held)
                    held, base, size = [[] for _ in range(5)], 0, 0

    return index.mapInArrow(run, "query_id bigint, doc_id bigint, doc_offset bigint")


def jumps(table: DataFrame, distance: int) -> DataFrame:
    """(doc_id, sa_row, to_row): the row of the suffix ``distance`` bytes later; null beyond the end."""
    later = table.select(F.col("doc_id"), (F.col("off") - distance).alias("off"), F.col("sa_row").alias("to_row"))
    return table.select("doc_id", "off", "sa_row").join(later, ["doc_id", "off"], "left").select("doc_id", "sa_row", "to_row")


def run_lengths(table: DataFrame) -> DataFrame:
    """(doc_id, run_id, symbol, length) of the BWT's runs."""
    w = Window.partitionBy("doc_id").orderBy("sa_row")
    new = F.when(F.lag("bwt").over(w).eqNullSafe(F.col("bwt")), 0).otherwise(1)
    runs = table.withColumn("new", new).withColumn("run_id", F.sum("new").over(w) - 1)
    return runs.groupBy("doc_id", "run_id").agg(F.first("bwt").alias("symbol"), F.count(F.lit(1)).alias("length"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, sa_row, bwt) back from run lengths."""
    w = Window.partitionBy("doc_id").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("base", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return placed.select("doc_id", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("length") - 1)).alias("sa_row"), F.col("symbol").alias("bwt"))


def run_checkpoints(table: DataFrame, step: int) -> DataFrame:
    """(doc_id, block, symbol, before, runs_before) at every ``step`` rows, over runs."""
    w = Window.partitionBy("doc_id").orderBy("sa_row")
    new = F.when(F.lag("bwt").over(w).eqNullSafe(F.col("bwt")), 0).otherwise(1)
    blocks = table.withColumn("new", new).groupBy("doc_id", F.floor(F.col("sa_row") / step).alias("block")).agg(F.sum("new").alias("new"))
    along = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.select("doc_id", "block", F.coalesce(F.sum("new").over(along), F.lit(0)).alias("runs_before"))
    return occ_table(table, step).join(runs, ["doc_id", "block"]).select("doc_id", "block", "symbol", "before", "runs_before")


def chunk_of(table: DataFrame, size: int) -> DataFrame:
    """(doc_id, sa_row, chunk_no): the fixed-size chunk of each row's offset; none for the empty suffix."""
    return table.filter(F.col("bwt").isNotNull()).select("doc_id", "sa_row", F.floor(F.col("off") / size).alias("chunk_no"))


def chunk_lookup(offsets: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """(query_id, position, chunk_id) by ranges [global_start, global_end), bucketed by ``width`` so that the
    join has an equality; a chunk enters every bucket it touches."""
    spread = chunks.select("chunk_id", "global_start", "global_end", F.explode(F.sequence(F.floor(F.col("global_start") / width), F.floor((F.col("global_end") - 1) / width))).alias("bucket"))
    keyed = offsets.withColumn("bucket", F.floor(F.col("position") / width))
    met = keyed.join(spread, "bucket").filter((F.col("global_start") <= F.col("position")) & (F.col("position") < F.col("global_end")))
    return met.select("query_id", "position", "chunk_id")


def sampled_locate(table: DataFrame, wanted: DataFrame, step: int) -> DataFrame:
    """(doc_id, sa_row, off, steps): offsets of ``wanted`` rows found from every ``step``-th row, as an index
    that stores only those would: the distance back to the nearest sampled row along the text."""
    at = F.when(F.col("sa_row") % step == 0, F.col("off"))
    prior = F.last(at, True).over(Window.partitionBy("doc_id").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = table.select("doc_id", "sa_row", "off", prior.alias("base"))
    return marked.join(wanted, ["doc_id", "sa_row"], "left_semi").select("doc_id", "sa_row", "off", F.when(F.col("base").isNotNull(), F.col("off") - F.col("base")).otherwise(F.col("off")).alias("steps"))


def build(corpus: DataFrame, step: int = 32, long: bool = True) -> dict[str, DataFrame]:
    """All index tables of a corpus."""
    table = suffixes_long(corpus) if long else suffixes(corpus)
    return {"suffixes": table, "c": c_table(table), "occ": occ_table(table, step), "runs": run_lengths(table)}
