"""Language-model scores by Brown's class-based bigrams.

Words are counted over all training documents. The ``DICTIONARY`` most frequent words (words tied at the
limit stay out) and their counts travel to the workers; counts of all other words stay in a table and reach
the documents by a join, so no part of the vocabulary is left out and nothing grows on the driver. The
``CLUSTERED`` most frequent words are assigned to ``CLASSES`` classes by exchange: each word in turn moves
to the class that raises the likelihood of the corpus' class bigrams most, until a sweep moves none. Every
other dictionary word then takes one step of the same exchange against these classes: its bigrams with them are
counted in Spark over all training documents, a row a word and neighbouring class, and the word's class is found
on the executors. The class bigrams are counted over all training documents once all words have their class;
words beyond the dictionary share one class, the end of a text has its own.

The model's probability of a token is that of its class after the last token's class (smoothed by the class
frequencies) times that of the token in its class (add-``ADD`` with one place for unseen words). A text begins
after an end.

Defined cases: a null or empty text is one token, the end; a null id counts as the text of no characters in
the hold-out rule; without training documents all counts are 0; every input row gives one output row,
repeated rows included; other columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.storage import Scratch
from spanquarry.llm.textarrays import Words, slices

ADD = 0.1
BACK_OFF = 1.0
DICTIONARY = 1 << 18
CLUSTERED = 2048
CLASSES = 48
SWEEPS = 10
FLUSH = 2_000_000
END = np.uint64(0x9D3779B97F4A7C21)
TAIL, RARE, STOP = 0, 1, 2  # symbols after the clustered words, and classes after the found ones; TAIL: not assigned yet


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, which = np.unique(np.concatenate(hashes), return_inverse=True)
    return kinds, np.bincount(which, np.concatenate(counts), len(kinds)).astype(np.int64)


def count_words(training: DataFrame) -> DataFrame:
    """(h, c): the count of each word's hash over the texts (t), with the end of a text as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, docs = [], [], 0, 0

        def out() -> pa.RecordBatch:
            kinds, sums = _merged(hashes, counts)
            return pa.RecordBatch.from_arrays([pa.array(_signed(kinds)), pa.array(sums)], names=["h", "c"])

        for batch in batches:
            docs += batch.num_rows
            for _, _, data, offsets in slices(batch.column(0)):
                kinds, sums = np.unique(Words(data, offsets).hash, return_counts=True)
                hashes.append(kinds)
                counts.append(sums)
                held += len(kinds)
                if held > FLUSH:
                    kinds, sums = _merged(hashes, counts)
                    hashes, counts, held = [kinds], [sums], len(kinds)
                    if held > FLUSH // 2:
                        yield out()
                        hashes, counts, held = [], [], 0
        if docs:
            hashes.append(np.array([END]))
            counts.append(np.array([docs]))
            yield out()

    return training.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def dictionary(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` hashes with the highest counts, in order of hash, and their counts."""
    top = 1 << 16
    by_count = counts.groupBy(F.least("c", F.lit(top)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    limit, taken = top, 0
    for r in by_count:
        if taken + r["n"] > most:
            break
        limit, taken = r["c"], taken + r["n"]
    found = counts.filter(F.col("c") >= limit) if taken else counts.limit(0)
    table = found.filter(F.col("h") != int(_signed(np.array([END]))[0])).toArrow()
    h, c = (table.column(k).to_numpy() for k in ("h", "c"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], c[order]


def lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of ``hashes`` in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def symbols(words: Words, table: np.ndarray, kinds: np.ndarray, rare: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all tokens with an end after each text, the tokens' offsets by row, and the words' places."""
    uniques, which = np.unique(words.hash, return_inverse=True)
    places = lookup(table, uniques)
    counts = words.counts()
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], stop, dtype=np.int64)
    found = np.where(places >= 0, kinds[np.maximum(places, 0)], rare) if len(kinds) else np.full(len(places), rare)
    row = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(row)) + row] = found[which]
    return out, first, places[which]


def count_bigrams(training: DataFrame, shared, size: int) -> np.ndarray:
    """The square table of bigram counts between symbols; ``shared``: (sorted hashes, their symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds = shared.value
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                now, _, _ = symbols(Words(data, offsets), table, kinds, size - 3 + RARE, size - 3 + STOP)
                before = np.concatenate([[size - 3 + STOP], now[:-1]])
                total += np.bincount(before * size + now, minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], names=["p", "c"])

    found = training.mapInArrow(run, "p int, c bigint").groupBy("p").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size * size)
    out[found.column("p").to_numpy()] = found.column("c").to_numpy()
    return out.reshape(size, size)


def count_neighbours(training: DataFrame, shared) -> DataFrame:
    """(w, x, c): how often a word without a class (its place in the dictionary) stands before (x even) or after
    (odd) class x // 2; ``shared``: (sorted hashes, classes of the words, their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds, every = shared.value
        width, held, size = 2 * every, [], 0

        def out() -> pa.RecordBatch:
            pairs, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((pairs // width).astype(np.int32)), pa.array((pairs % width).astype(np.int32)), pa.array(c.astype(np.int64))], names=["w", "x", "c"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words = Words(data, offsets)
                now, first, places = symbols(words, table, kinds, every - 3 + RARE, every - 3 + STOP)
                row = np.repeat(np.arange(len(first) - 1), words.counts())
                at = np.arange(len(row)) + row  # the words' tokens; every text ends with a token of its own
                open_ = np.flatnonzero((places >= 0) & (now[at] == every - 3 + TAIL))
                before = np.concatenate([[every - 3 + STOP], now[:-1]])
                held += [places[open_] * width + 2 * now[at[open_] + 1], places[open_] * width + 2 * before[at[open_]] + 1]
                size += 2 * len(open_)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return training.mapInArrow(run, "w int, x int, c bigint").groupBy("w", "x").agg(F.sum("c").alias("c"))


def best_classes(after: np.ndarray, before: np.ndarray, joint: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams most; rows of ``after`` and
    ``before`` are the word's counts by class."""
    gain = np.zeros((len(after), classes))
    base, rows, columns = _xlogx(joint), joint.sum(1)[:classes], joint.sum(0)[:classes]
    for counts, table, sums, plain in ((after, joint[:classes], rows, base[:classes]), (before, joint.T[:classes], columns, base.T[:classes])):
        w, x = np.nonzero(counts)
        np.add.at(gain, w, (_xlogx(table[:, x] + counts[w, x]) - plain[:, x]).T)
        gain -= _xlogx(sums + counts.sum(1, keepdims=True)) - _xlogx(sums)
    return gain.argmax(1)


def assign(neighbours: DataFrame, joint: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in ``neighbours`` and their classes, found where their counts stand."""
    every = len(joint)
    shared = neighbours.sparkSession.sparkContext.broadcast(joint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                wide = np.zeros((part.num_rows, 2 * every))
                xs = part.column(1)
                row = np.repeat(np.arange(part.num_rows), np.diff(xs.offsets.to_numpy()))
                wide[row, xs.flatten().field("x").to_numpy()] = xs.flatten().field("c").to_numpy()
                found = best_classes(wide[:, 0::2], wide[:, 1::2], shared.value, classes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.int32))], names=["w", "k"])

    lists = neighbours.groupBy("w").agg(F.collect_list(F.struct("x", "c")).alias("xs"))  # at most two a class
    found = lists.mapInArrow(run, "w int, k int").toArrow()
    return found.column("w").to_numpy(), found.column("k").to_numpy()


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each symbol: exchanged for all but the last three, which have classes of their own."""
    size = len(bigrams)
    free = size - 3
    k = min(classes, max(free, 1))
    every = k + 3
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:free], kind="stable")
    kind = np.empty(size, dtype=np.int64)
    kind[order] = np.arange(free) % k
    kind[free:] = k + np.arange(3)
    member = np.zeros((size, every))
    member[np.arange(size), kind] = 1
    after, before = bigrams @ member, bigrams.T @ member
    joint = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = kind[w], bigrams[w, w]
            r, left = after[w].copy(), before[w].copy()
            r[a] -= own
            left[a] -= own
            joint[a] -= r
            joint[:, a] -= left
            joint[a, a] -= own
            rows, columns = joint.sum(1) + left, joint.sum(0) + r  # as they are wherever the word goes
            gain = (_xlogx(joint + r) - _xlogx(joint)).sum(1) + (_xlogx(joint + left[:, None]) - _xlogx(joint)).sum(0)
            diagonal = joint.diagonal()
            gain += _xlogx(diagonal + r + left + own) + _xlogx(diagonal) - _xlogx(diagonal + r) - _xlogx(diagonal + left)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(columns + left.sum() + own) - _xlogx(columns)
            b = int(gain[:k].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += r
            joint[:, b] += left
            joint[b, b] += own
            if b != a:
                moved += 1
                kind[w] = b
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[:, a] -= bigrams[w]
                before[:, b] += bigrams[w]
        if not moved:
            break
    return kind


def score(docs: DataFrame, id_col: str, text_col: str, most_words: int = DICTIONARY, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    text = F.coalesce(F.col(text_col), F.lit(""))
    training = docs.filter(~held_out(id_col)).select(text.alias("t"))
    counts = scratch.save(count_words(training), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = sums["n"] or 0, sums["v"]
    end = counts.filter(F.col("h") == int(_signed(np.array([END]))[0])).first()
    ends = end["c"] if end else 0
    table, c = dictionary(counts, most_words)
    # symbols: the clustered words by rank, then TAIL, RARE and STOP
    chosen = np.lexsort((table, -c))[:clustered]
    size = len(chosen) + 3
    symbol = np.full(len(table), size - 3 + TAIL, dtype=np.int64)
    symbol[chosen] = np.arange(len(chosen))
    bigrams = count_bigrams(training, spark.sparkContext.broadcast((table, symbol)), size)
    kind = exchange(bigrams, classes)
    every = int(kind[-1]) + 1
    member = np.zeros((size, every))
    member[np.arange(size), kind] = 1
    joint = member.T @ bigrams @ member
    symbol = kind[symbol]  # from here on a word's symbol is its class
    if len(table) > len(chosen) > 0:
        words, found = assign(count_neighbours(training, spark.sparkContext.broadcast((table, symbol, every))), joint, every - 3)
        symbol[words] = found
        joint = count_bigrams(training, spark.sparkContext.broadcast((table, symbol)), every)
    prior = (joint.sum(0) + 1e-3) / (joint.sum() + 1e-3 * every)
    step = np.log10((joint + BACK_OFF * prior) / (joint.sum(1, keepdims=True) + BACK_OFF))
    held = np.bincount(symbol, c, every) if len(c) else np.zeros(every)
    types = np.bincount(symbol, minlength=every).astype(float) if len(c) else np.zeros(every)
    held[-1], types[-1] = ends, 1
    held[-2], types[-2] = total - ends - c.sum(), kinds - bool(ends) - len(c)
    room = held + ADD * (types + 1)
    base_room = total + ADD * (kinds + 1)
    emit = np.log10((c + ADD) / room[symbol]) if len(c) else np.zeros(0)
    base = np.log10((c + ADD) / base_room) if len(c) else np.zeros(0)
    end_emit, end_base = np.log10((ends + ADD) / room[-1]), np.log10((ends + ADD) / base_room)
    rare_room = float(room[-2])
    shared = spark.sparkContext.broadcast((table, symbol, step, emit, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, symbol, step, emit, base = shared.value
        emit0, base0 = np.append(emit, 0.0), np.append(base, 0.0)  # place -1: by the join
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets)
                now, first, places = symbols(words, table, symbol, every - 3 + RARE, every - 3 + STOP)
                path = step[np.concatenate([[every - 1], now[:-1]]), now]
                model = np.add.reduceat(path, first[:-1]) + end_emit
                n = words.counts()
                row = np.repeat(np.arange(len(n)), n)
                model += np.bincount(row, emit0[places], len(n))
                plain = np.bincount(row, base0[places], len(n)) + end_base
                known = np.bincount(row[places >= 0], minlength=len(n)) + (ends > 0)
                rare = np.flatnonzero(places < 0)
                by_row = np.lexsort((words.hash[rare], row[rare]))
                owner, own = row[rare][by_row], words.hash[rare][by_row]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(own))).astype(np.int32)
                spans = np.searchsorted(owner[at], np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(plain), pa.array(model),
                     pa.ListArray.from_arrays(pa.array(spans), pa.array(_signed(own[at]))), pa.ListArray.from_arrays(pa.array(spans), pa.array(times))],
                    names=["doc_id", "held_out", "n_tokens", "known", "plain", "model", "hs", "ts"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("t"))
    parts = rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, plain double, model double, hs array<bigint>, ts array<int>")
    parts = scratch.save(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("hs", "ts")).alias("x")).select("row", F.col("x.hs").alias("h"), F.col("x.ts").alias("times"))
    met = rare.join(counts, "h", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10((F.col("c") + ADD) / F.lit(base_room))).alias("b"),
        F.sum(F.col("times") * F.log10((F.col("c") + ADD) / F.lit(rare_room))).alias("m"),
    )
    joined = parts.drop("hs", "ts").join(more, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("plain") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("m", F.lit(0.0))).alias("score"),
    )
