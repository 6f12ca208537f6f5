"""Files of chunks, deterministic archives, and Parquet layouts of an index."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The container's header (version, count) and chunk header (size), little-endian, after a magic of
# six bytes that callers may give for files of other writers.
MAGIC = b"CHUNK1"
HEADER, SIZE = struct.Struct("<BH"), struct.Struct("<I")


def pack_chunks(parts: list[bytes], version: int = 1, magic: bytes = MAGIC) -> bytes:
    """A container of zlib-compressed chunks."""
    out = [magic, HEADER.pack(version, len(parts))]
    for raw in parts:
        block = zlib.compress(raw)
        out += [SIZE.pack(len(block)), block]
    return b"".join(out)


def unpack_chunks(blob: bytes, magic: bytes = MAGIC) -> list[bytes]:
    if blob[: len(magic)] != magic:
        raise ValueError("BAD_MAGIC")
    _, count = HEADER.unpack_from(blob, len(magic))
    at, out = len(magic) + HEADER.size, []
    for _ in range(count):
        (size,) = SIZE.unpack_from(blob, at)
        at += SIZE.size
        out.append(zlib.decompress(blob[at : at + size]))
        at += size
    if at != len(blob):
        raise ValueError("TRAILING_BYTES")
    return out


def read_containers(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """(path, chunk_id, raw) of the chunk containers below ``path``, a file a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = unpack_chunks(blob, magic)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["path", "chunk_id", "raw"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, chunk_id bigint, raw binary")


def round_trip(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, raw) packed into a container a document and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                back = unpack_chunks(pack_chunks([p["raw"] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(back), pa.int64()), pa.array([p["chunk_no"] for p in parts], pa.int64()), pa.array(back, pa.binary())], names=["doc_id", "chunk_no", "raw"])

    packed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "raw"))).alias("parts"))
    return packed.mapInArrow(run, "doc_id bigint, chunk_no bigint, raw binary")


def deterministic_tar(files: dict[str, bytes]) -> bytes:
    """A .tar.gz that depends on names and contents alone."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(files[name]), 0, 0o644
            tar.addfile(info, io.BytesIO(files[name]))
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as gz:
        gz.write(raw.getvalue())
    return out.getvalue()


def read_tar(blob: bytes) -> dict[str, bytes]:
    with tarfile.open(fileobj=io.BytesIO(blob), mode="r:gz") as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """An index as one Parquet folder a table."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
