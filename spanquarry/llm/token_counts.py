"""Token counts of whole texts by a public tokenizer.

``count_tokens`` encodes in an Arrow function that returns lengths only. Batches for the encoder are
balanced by bytes, and a long text is cut at safe boundaries: a single space between two ASCII letters.
A pre-tokenizer that begins a new piece at such a space, with no special token that holds a space, makes the
parts' counts add up to the count of the whole text. ``cuttable`` tries that on the given tokenizer; texts of
any other one, sentencepiece models (``.model``) among them, are encoded whole.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null; every input row gives
one output row, repeated rows included; other columns of any name are ignored; an empty table gives an
empty result; a long text without a safe boundary is encoded as one part.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 19
PIECE_CHARS = 1 << 15
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_loaded: dict[str, object] = {}


def tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary file: a path, or the name of a file among the public tokenizers."""
    if vocabulary not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary
        if os.sep not in path:
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            _loaded[vocabulary] = SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            _loaded[vocabulary] = made
    return _loaded[vocabulary]


def counter(vocabulary: str):
    """Token counts of a list of texts, without begin, end or added special tokens."""
    made = tokenizer(vocabulary)
    if hasattr(made, "encode_batch_fast"):
        return lambda texts: [len(e) for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    return lambda texts: [len(made.encode(t, add_bos=False, add_eos=False)) for t in texts]


@functools.cache
def cuttable(vocabulary: str) -> bool:
    """Whether pieces of the tokenizer end before a space between two letters, and no special token holds a space."""
    made = tokenizer(vocabulary)
    if getattr(made, "pre_tokenizer", None) is None or any(" " in t.content for t in made.get_added_tokens_decoder().values()):
        return False

    def cut(text: str) -> list[str]:
        if made.normalizer is not None:
            text = made.normalizer.normalize_str(text)
        return [piece for piece, _ in made.pre_tokenizer.pre_tokenize_str(text)]

    return all(cut(f"{a} {b}") == cut(a) + cut(f" {b}") for a in ("ab", "1x", "don't Go") for b in ("cd", "It's 9", "z"))


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of ``text`` of about ``most`` code points, cut at safe boundaries only."""
    at = 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def lengths(texts: list[str], vocabulary: str, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    """Token counts of ``texts``, encoded in batches of about ``batch_bytes``."""
    count = counter(vocabulary)
    whole = not cuttable(vocabulary)
    out = np.zeros(len(texts), dtype=np.int64)
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, n in zip(owners, count(batch), strict=True):
            out[owner] += n
        batch.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in [text] if whole else pieces(text, piece_chars):
            batch.append(part)
            owners.append(i)
            held += len(part) * (1 if part.isascii() else 2)
            if held >= batch_bytes:
                flush()
    if batch:
        flush()
    return out


def count_tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512  # a few rows at a time as Python strings
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tokens = lengths(part.column(1).to_pylist(), vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), text.alias("t"), F.octet_length(text).cast("bigint").alias("b"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
