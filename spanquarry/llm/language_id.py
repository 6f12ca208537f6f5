"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label, so code-switched text is followed word by word. A word's features are
hashed: its byte n-grams of two to four with marks at both ends (those with a mark are its affixes) and the
whole word (the lexicon). Transition weights between the labels are learned with the feature weights by
maximum likelihood; forward-backward gives the expected labels in training and the labels' marginals in
prediction. A document's language is the label with the largest mean marginal, its score that mean.

Training takes at most ``DOCS_PER_LABEL`` documents of each label, spread over all labelled rows of any length by a hash of
id and text (rows equal in both count once), and ``PARTS_PER_DOC`` stretches from all over each, joined into sequences that switch language.
The stretches are cut on the executors; where they exceed ``PART_BYTES``, their longest words give eight pieces each.
Every label is learned. Beyond ``FULL_LABELS`` labels, the weights' hash dimension and the documents of a
label shrink so that the model and the sample stay the size they have there; beyond ``MOST_LABELS``, ``fit`` raises.
Prediction reads whole texts and works on packed arrays, a slice of rows at a time.

Defined cases: a null text or one without any letter is ``und`` with score 0; without any labelled row all
are ``und``; rows with a null language are never learned from; a null id counts as the text of no
characters in the hold-out rule; equal marginals go to the first label in sorted order; every input row
gives one output row; other columns of any name are kept apart in a struct; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanquarry.llm.storage import small_batches
from spanquarry.llm.textarrays import SLICE_BYTES, Words, mix, raw, slices

DIMENSIONS = 1 << 18
GRAMS = (2, 3, 4)
DOCS_PER_LABEL = 250
FULL_LABELS = 64
MOST_LABELS = 512
PARTS_PER_DOC = 8
PART_WORDS = 12
PART_BYTES = 1 << 15
SEQUENCE_PARTS = 4
EPOCHS = 3
RATE = 0.15
UNKNOWN = "und"
U = np.uint64


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words at ``start``..``end`` of ``data``, and the offsets of each word's."""
    size = end - start + 2
    first = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=first[1:])
    marked = np.empty(first[-1], dtype=np.uint64)
    marked[first[:-1]] = 1
    marked[first[1:] - 1] = 2
    inner = np.arange(first[-1]) - np.repeat(first[:-1], size)
    body = (inner > 0) & (inner < np.repeat(size, size) - 1)
    marked[body] = data[(np.repeat(start - 1, size) + inner)[body]].astype(np.uint64) + U(3)
    left = np.repeat(first[1:], size) - np.arange(first[-1])  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(size)), size)
    numbers, owners = [mix(hashes ^ U(0x5BD1E995))], [np.arange(len(size))]
    code = marked
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * U(259) + marked[n - 1 :]
        if n in GRAMS:
            whole = left[: len(code)] >= n
            numbers.append(mix(code[whole] + U(n << 56)))
            owners.append(owner[: len(code)][whole])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    offsets = np.searchsorted(who[order], np.arange(len(size) + 1))
    return (np.concatenate(numbers)[order] & U(dimensions - 1)).astype(np.int64), offsets


def marginals(potentials: np.ndarray, first: np.ndarray, begin: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences packed one after the other (rows ``first[k]``..``first[k + 1]``).

    ``potentials`` are exp scores of labels by word, ``begin`` and ``step`` exp start and transition scores.
    Gives the label marginals by word and the expected number of transitions between labels. Sequences
    advance together, longest first, so the number of steps is the longest length.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    labels = potentials.shape[1]
    out = np.empty_like(potentials)
    moves = np.zeros((labels, labels))
    if not len(order):
        return out, moves
    sizes = lengths[order]
    longest = int(sizes[0])
    active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
    at = np.zeros(longest + 1, dtype=np.int64)
    np.cumsum(active, out=at[1:])
    rank = np.repeat(np.arange(len(sizes)), sizes)
    time = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source = np.repeat(first[order], sizes) + time
    packed = at[time] + rank
    e = np.empty((at[-1], labels))
    e[packed] = potentials[source]
    alpha, gamma = np.empty_like(e), np.empty_like(e)
    a = begin * e[: active[0]]
    a /= a.sum(1, keepdims=True)
    alpha[: active[0]] = a
    for t in range(1, longest):
        lo, n = at[t], active[t]
        a = (a[:n] @ step) * e[lo : lo + n]
        a /= a.sum(1, keepdims=True)
        alpha[lo : lo + n] = a
    beta = np.ones((active[-1], labels))
    back = step.T.copy()
    for t in range(longest - 1, -1, -1):
        lo, n = at[t], active[t]
        if t < longest - 1:
            below = e[at[t + 1] : at[t + 2]] * beta
            m = len(below)
            prior = alpha[lo : lo + m]
            joint = prior @ step
            norm = (joint * below).sum(1, keepdims=True)
            moves += (prior / norm).T @ below
            grown = np.ones((n, labels))
            grown[:m] = below @ back
            grown[:m] /= grown[:m].sum(1, keepdims=True)
            beta = grown
        g = alpha[lo : lo + n] * beta
        gamma[lo : lo + n] = g / g.sum(1, keepdims=True)
    out[source] = gamma[packed]
    return out, moves * step


def _parts(lo: int, hi: int) -> list[tuple[int, int]]:
    """At most ``PARTS_PER_DOC`` stretches of the words ``lo`` to ``hi``, spread over them."""
    cuts = list(range(lo, hi, PART_WORDS))
    if len(cuts) > PARTS_PER_DOC:
        cuts = [cuts[int(i)] for i in np.linspace(0, len(cuts) - 1, PARTS_PER_DOC)]
    return [(c, min(c + PART_WORDS, hi)) for c in cuts]


def _piece(word: bytes, most: int) -> bytes:
    """The word, or eight pieces from all over it that together have at most ``most`` bytes."""
    if len(word) <= most:
        return word
    size = most // 8
    return b"".join(word[int(a) : int(a) + size] for a in np.linspace(0, len(word) - size, 8))


def stretches(docs: DataFrame) -> DataFrame:
    """(l, h, t): the words of a document's stretches in place of its text ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                words, out = Words(data, offsets), []
                for r in range(hi - lo):
                    own = [data[words.start[k] : words.end[k]].tobytes() for a, b in _parts(int(words.first[r]), int(words.first[r + 1])) for k in range(a, b)]
                    if sum(map(len, own)) > PART_BYTES:
                        own = [_piece(w, PART_BYTES // len(own)) for w in own]
                    out.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(out, pa.binary())], names=["l", "h", "t"])

    return docs.select("l", "h", "t").mapInArrow(run, "l string, h bigint, t binary")


def train(texts: list[bytes], labels: np.ndarray, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by feature and label, start scores and transition scores."""
    rng = np.random.default_rng(seed)
    dimensions = DIMENSIONS
    while dimensions * count > DIMENSIONS * FULL_LABELS:
        dimensions //= 2
    words = Words(*raw(pa.array(texts, pa.large_binary())))
    parts: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    for k in range(len(texts)):
        parts[labels[k]].extend(_parts(int(words.first[k]), int(words.first[k + 1])))
    every = [(label, part) for label, own in enumerate(parts) for part in own]
    # features of the chosen stretches alone, which from here on are ranges of the chosen words
    chosen = np.concatenate([np.arange(*part) for _, part in every]) if every else np.empty(0, dtype=np.int64)
    ends = np.cumsum([b - a for _, (a, b) in every])
    every = [(label, (int(end) - (b - a), int(end))) for (label, (a, b)), end in zip(every, ends, strict=True)]
    number, offsets = features(words.data, words.start[chosen], words.end[chosen], words.hash[chosen], dimensions)
    del words
    weights, begin, step = np.zeros((dimensions, count)), np.zeros(count), np.zeros((count, count))
    squares = [np.full(x.shape, 1e-2) for x in (weights, begin, step)]
    for _ in range(EPOCHS):
        rng.shuffle(every)
        for low in range(0, len(every), 64 * SEQUENCE_PARTS):
            chosen = every[low : low + 64 * SEQUENCE_PARTS]
            index = np.concatenate([np.arange(*part) for _, part in chosen])
            truth = np.concatenate([np.full(part[1] - part[0], label) for label, part in chosen])
            sizes = np.array([part[1] - part[0] for _, part in chosen])
            ends = np.cumsum(sizes)
            first = np.concatenate([[0], ends[SEQUENCE_PARTS - 1 :: SEQUENCE_PARTS]])
            first = first if first[-1] == ends[-1] else np.append(first, ends[-1])
            spans = offsets[index + 1] - offsets[index]
            rows = np.repeat(np.arange(len(index)), spans)
            feats = number[np.repeat(offsets[index], spans) + np.arange(len(rows)) - np.repeat(np.cumsum(spans) - spans, spans)]
            scores = np.add.reduceat(weights[feats], np.cumsum(spans) - spans, axis=0)
            gamma, moves = marginals(np.exp(scores - scores.max(1, keepdims=True)), first, np.exp(begin), np.exp(step))
            seen = np.zeros((count, count))
            inside = np.ones(len(index), dtype=bool)
            inside[first[:-1]] = False
            np.add.at(seen, (truth[:-1][inside[1:]], truth[1:][inside[1:]]), 1)
            gamma[np.arange(len(truth)), truth] -= 1
            touched, slot = np.unique(feats, return_inverse=True)
            slope = np.stack([np.bincount(slot, gamma[rows, label], len(touched)) for label in range(count)], axis=1)
            squares[0][touched] += slope**2
            weights[touched] -= RATE * slope / np.sqrt(squares[0][touched])
            for x, g, s in ((begin, gamma[first[:-1]].sum(0), squares[1]), (step, moves - seen, squares[2])):
                s += g**2
                x -= RATE * g / np.sqrt(s)
    return weights.astype(np.float32), begin, step


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_label: int = DOCS_PER_LABEL) -> dict:
    """A model from a bounded sample of the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    usable = docs.filter(~held_out(id_col) & text.rlike("[^\\x09-\\x0D\\x20]") & F.col(lang_col).isNotNull())
    usable = usable.select(F.xxhash64(F.col(id_col), text, F.lit("language")).alias("h"), text.alias("t"), F.col(lang_col).alias("l"))
    totals = usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LABELS + 1).collect()
    if len(totals) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in column {lang_col}")
    names = sorted(r["l"] for r in totals)
    if not names:
        return {"labels": []}
    docs_per_label = max(1, min(docs_per_label, docs_per_label * FULL_LABELS // len(names)))
    scale = 1 << 30
    share = F.create_map(*(F.lit(x) for r in totals for x in (r["l"], min(scale, 2 * scale * docs_per_label // max(r["n"], 1) + 1))))
    sample = usable.filter(F.pmod("h", F.lit(scale)) <= F.element_at(share, F.col("l")))
    first = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(scale)), "h")
    sample = stretches(sample).dropDuplicates(["l", "h"]).withColumn("k", F.row_number().over(first))
    rows = sample.filter(F.col("k") <= docs_per_label).orderBy("l", "k").collect()
    texts, labels = [bytes(r["t"]) for r in rows], [names.index(r["l"]) for r in rows]
    if not texts:
        return {"labels": []}
    weights, begin, step = train(texts, np.array(labels), len(names))
    return {"labels": names, "weights": weights, "begin": np.exp(begin), "step": np.exp(step)}


def predict(column: pa.Array, lettered: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of an Arrow column."""
    names = model["labels"]
    langs, score = [UNKNOWN] * len(column), np.zeros(len(column))
    if not names:
        return langs, score
    for lo, hi, data, offsets in slices(column, SLICE_BYTES * 16 // max(16, len(names))):  # the marginals grow with the labels
        words = Words(data, offsets)
        if not len(words.hash):
            continue
        kinds, example, which = np.unique(words.hash, return_index=True, return_inverse=True)
        number, first = features(words.data, words.start[example], words.end[example], kinds, len(model["weights"]))
        emission = np.add.reduceat(model["weights"][number], first[:-1], axis=0).astype(np.float64)
        emission = np.exp(emission - emission.max(1, keepdims=True))
        gamma, _ = marginals(emission[which], words.first, model["begin"], model["step"])
        sums = np.zeros((len(gamma) + 1, len(names)))
        np.cumsum(gamma, axis=0, out=sums[1:])
        counts = words.counts()
        mean = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(1)
        for r in np.flatnonzero((counts > 0) & lettered[lo:hi]):
            langs[lo + r] = names[best[r]]
            score[lo + r] = min(1.0, max(0.0, mean[r, best[r]]))
    return langs, score


def annotate(docs: DataFrame, text_col: str, model: dict) -> DataFrame:
    """Every row as a struct ``row``, with ``lang_pred`` and ``score`` beside it."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by DIMENSIONS and FULL_LABELS
    kinds = T.StructType([T.StructField("row", docs.schema, False), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lettered = np.asarray(part.column(1).to_pylist(), dtype=bool)
                langs, score = predict(part.column(0).field(place), lettered, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    place = docs.columns.index(text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.rlike(r"\p{L}").alias("lettered")).mapInArrow(run, kinds)


def identify(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model fitted on the table itself."""
    small_batches(docs.sparkSession)
    model = fit(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    text = F.coalesce(F.col("t"), F.lit(""))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = np.asarray(batch.column(3).to_pylist(), dtype=bool)
            langs, score = predict(batch.column(2), lettered, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = slim.select("doc_id", "held_out", text.alias("t"), text.rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
