"""Inverted indexes of byte signatures (q-grams and minimizers) over chunks (chunk, raw).

A chunk's signatures are counted where the chunk stands, in Arrow batches, so a row a distinct signature
leaves it; the counted table is written once, as its document frequencies are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.functions.binary import part, starts
from spanquarry.sources.shared import saved, small_batches

# Default lengths, strides and caps of the indexes.
LENGTH, STRIDE, TOP, DENSE_DF = 8, 8, 256, 32
RARE_STRIDE, RARE_DF, RARE_TOP = 4, 16, 128
MIN_K, MIN_W, MIN_TOP = 8, 24, 512


def grams(chunks: DataFrame, length: int = LENGTH, stride: int = STRIDE, keys: tuple[str, ...] = ("chunk",), raw: str = "raw") -> DataFrame:
    """(*keys, pos, sig) of the windows of ``length`` bytes every ``stride`` bytes."""
    rows = chunks.select(*keys, F.col(raw), F.explode(starts(F.length(raw), length, stride)).alias("pos"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), part(F.col(raw), F.col("pos"), length).alias("sig"))


def _words(content: bytes, length: int, stride: int) -> np.ndarray:
    """The windows of at most eight bytes as numbers that sort as their bytes do."""
    data = np.frombuffer(content, dtype=np.uint8)
    if len(data) < length:
        return np.empty(0, dtype=np.uint64)
    wide = np.zeros(((len(data) - length) // stride + 1, 8), dtype=np.uint8)
    wide[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[::stride]
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def _bytes(words: np.ndarray, length: int) -> pa.Array:
    packed = np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :length])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(words), [None, pa.py_buffer(packed)]).cast(pa.binary())


def _least_of_runs(words: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of ``w`` words, or of all if there are fewer."""
    if len(words) <= w:
        return words.min(keepdims=True) if len(words) else words
    return np.lib.stride_tricks.sliding_window_view(words, w).min(axis=1)


def _counted(chunks: DataFrame, length: int = LENGTH, stride: int = STRIDE, w: int | None = None) -> DataFrame:
    """(chunk, sig, cnt, first_pos): a chunk's distinct signatures, or minimizers of runs of ``w``; up to eight bytes."""
    small_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows, kinds, counts, first = [], [], [], []
                for r in range(at, min(at + 64, batch.num_rows)):
                    words = _words(batch.column(1)[r].as_py() or b"", length, stride if w is None else 1)
                    own, place, n = np.unique(words if w is None else _least_of_runs(words, w), return_index=True, return_counts=True)
                    rows.append(np.full(len(own), r))
                    kinds.append(own)
                    counts.append(n)
                    first.append(place * stride if w is None else place)
                chunk = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([chunk, _bytes(np.concatenate(kinds), length), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(first).astype(np.int64))], names=["chunk", "sig", "cnt", "first_pos"])

    if length > 8:
        raise ValueError("signatures have at most eight bytes")
    return chunks.select("chunk", "raw").mapInArrow(run, "chunk bigint, sig binary, cnt bigint, first_pos bigint")


def _with_df(counted: DataFrame) -> DataFrame:
    """With ``df``, the number of chunks of a signature: counted by a shuffle of its own, so a signature that
    all chunks have is one counter and not one task's group."""
    counted = saved(counted, "signatures")
    frequency = counted.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(frequency, "sig")


def top_signatures(chunks: DataFrame, most: int = TOP) -> DataFrame:
    """(chunk, sig, cnt): the most frequent ones of a chunk, equal counts by first place."""
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("cnt"), "first_pos"))
    return _counted(chunks).withColumn("r", rank).filter(F.col("r") <= most).select("chunk", "sig", "cnt")


def dense(chunks: DataFrame, length: int = LENGTH, stride: int = STRIDE, most_df: int = DENSE_DF) -> DataFrame:
    """(chunk, sig, cnt, df) of signatures of at most ``most_df`` chunks."""
    return _with_df(_counted(chunks, length, stride)).filter(F.col("df") <= most_df).select("chunk", "sig", "cnt", "df")


def rare(chunks: DataFrame, length: int = LENGTH, stride: int = RARE_STRIDE, most_df: int = RARE_DF, top: int = RARE_TOP) -> DataFrame:
    """(chunk, sig, cnt, df): a chunk's rarest signatures, by (df, -cnt, sig)."""
    kept = _with_df(_counted(chunks, length, stride)).filter(F.col("df") <= most_df)
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy("df", F.desc("cnt"), "sig"))
    return kept.withColumn("r", rank).filter(F.col("r") <= top).select("chunk", "sig", "cnt", "df")


def minimizers(chunks: DataFrame, k: int = MIN_K, w: int = MIN_W, keys: tuple[str, ...] = ("chunk",), raw: str = "raw") -> DataFrame:
    """(*keys, pos, sig): the least k-gram of each run of ``w`` k-grams, or of all if there are fewer."""
    tokens = F.transform(starts(F.length(raw), k), lambda i: F.substring(F.col(raw), i + 1, k))
    rows = chunks.select(*keys, tokens.alias("t")).filter(F.size("t") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - w, F.lit(0))), lambda i: F.array_min(F.slice("t", i + 1, w)))
    found = rows.select(*keys, F.posexplode(runs).alias("pos", "sig"))
    return found.select(*keys, F.col("pos").cast("bigint").alias("pos"), "sig")


def minimizer_index(chunks: DataFrame, k: int = MIN_K, w: int = MIN_W, top: int = MIN_TOP) -> DataFrame:
    """(chunk, sig, cnt, df): a chunk's minimizers, by (-cnt, df, sig)."""
    counted = _with_df(_counted(chunks, k, w=w))
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("cnt"), "df", "sig"))
    return counted.withColumn("r", rank).filter(F.col("r") <= top).select("chunk", "sig", "cnt", "df")


def coarse(chunks: DataFrame, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """(chunk, sig, df) of all distinct signatures."""
    return _with_df(_counted(chunks, length, stride)).select("chunk", "sig", "df")


def statistics(index: DataFrame) -> DataFrame:
    """One row: postings, signatures, chunks and the largest document frequency."""
    return index.agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("sig").alias("signatures"), F.countDistinct("chunk").alias("chunks"), F.max("df").alias("most_df"))
