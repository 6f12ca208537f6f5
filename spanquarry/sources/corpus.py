"""Document collections: tables or directories as (doc_id, path, content), and their layouts as chunks."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanquarry.functions.binary import latin1, part, utf8
from spanquarry.sources.shared import small_batches

CHUNK = 16384
MOST_DIRECT = 64 << 20
MOST_WHOLE, PIECE = 16 << 20, 32 << 10


def from_table(table: DataFrame, id_col: str, text_col: str, path: Column | None = None) -> DataFrame:
    """(doc_id, path, content, byte_length) of a table's texts; a null text is empty."""
    content = utf8(F.coalesce(F.col(text_col), F.lit("")))
    name = path if path is not None else F.format_string("doc_%08d.bin", F.col(id_col))
    return table.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(name).alias("path"), content.alias("content"), F.length(content).cast("bigint").alias("byte_length"))


def _listed(spark: SparkSession, root: str) -> tuple[list[tuple[bytes, int]], object]:
    """(raw relative path, length) of every regular file below ``root``, hidden ones too; other kinds are refused."""
    if root.startswith("/"):
        if os.path.islink(root):
            raise ValueError("ROOT_IS_SYMLINK")
        top = os.fsencode(root)
        if not os.path.isdir(root):
            return [(os.path.basename(top), os.lstat(top).st_size)], None
        out = []
        for folder, dirs, names in os.walk(top):
            for name in dirs + names:
                found = os.lstat(os.path.join(folder, name))
                if not (stat.S_ISREG(found.st_mode) or stat.S_ISDIR(found.st_mode)):
                    raise ValueError(f"NOT_A_REGULAR_FILE: {os.fsdecode(name)}")
                if stat.S_ISREG(found.st_mode):
                    out.append((os.path.relpath(os.path.join(folder, name), top), found.st_size))
        return out, None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base, files, out = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/", fs.listFiles(path, True), []
    while files.hasNext():
        found = files.next()
        full = found.getPath().toUri().getPath()
        out.append((full[len(base) :].encode() if full.startswith(base) else os.path.basename(full).encode(), found.getLen()))
    return out, fs


def _direct(spark: SparkSession, root: str, names: list[bytes], fs) -> list[tuple]:
    """Rows of files that Spark's reader passes over."""
    rows = []
    for name in names:
        if fs is None:
            with open(os.path.join(os.fsencode(root), name), "rb") as f:
                content = f.read()
        else:
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(root, name.decode()))
            content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
        rows.append((bytearray(name), len(content), bytearray(content)))
    return rows


def from_directory(spark: SparkSession, root: str) -> DataFrame:
    """A snapshot of all regular files below ``root``: doc_id is the rank of the raw relative path.

    Only paths and lengths are listed on the driver. Contents are read by Spark's reader where they are needed;
    it passes over empty files and names that begin with a dot or an underscore, which the driver reads itself,
    ``MOST_DIRECT`` bytes at most. An unsafe path, another kind of file or more hidden bytes is an error, so no
    file is left out.
    """
    files, hidden, fs = _checked(spark, root)
    kind = "path binary, byte_length bigint, content binary"
    rows = spark.createDataFrame(_direct(spark, root, hidden, fs), kind)
    if len(hidden) < len(files):
        seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rows = seen.select(utf8(_relative(spark, root, fs, F.col("path"))).alias("path"), F.col("length").alias("byte_length"), "content").unionByName(rows)
    return _numbered(spark, files, rows, "content")


def _checked(spark: SparkSession, root: str) -> tuple[list[tuple[bytes, int]], list[bytes], object]:
    """The listing and the names in it that Spark's reader passes over."""
    files, fs = _listed(spark, root)
    unsafe = [p for p, _ in files if not safe_name(p)]
    if unsafe:
        raise ValueError(f"UNSAFE_PATH: {unsafe[0]!r}")

    def passed_over(path: bytes, size: int) -> bool:
        return not size or any(c.startswith((b".", b"_")) for c in path.split(b"/"))

    hidden = sorted(p for p, n in files if passed_over(p, n))
    if sum(n for p, n in files if passed_over(p, n)) > MOST_DIRECT:
        raise ValueError("TOO_MANY_HIDDEN_BYTES")
    return files, hidden, fs


def _relative(spark: SparkSession, root: str, fs, path: Column) -> Column:
    if fs is not None:
        base = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toString().rstrip("/") + "/"
        return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.substring_index(path, "/", -1))
    base = root.rstrip("/") + "/"
    return F.when(F.contains(path, F.lit(base)), F.substring_index(path, base, -1)).otherwise(F.substring_index(path, "/", -1))


def _numbered(spark: SparkSession, files: list[tuple[bytes, int]], rows: DataFrame, value: str) -> DataFrame:
    """(doc_id, path, ``value``, byte_length) of all listed files; an error for one of which ``rows`` have nothing or another length."""
    table = spark.createDataFrame([(bytearray(p), k, n) for k, (p, n) in enumerate(sorted(files))], "path binary, doc_id bigint, listed bigint")
    met = table.join(rows, "path", "left")
    same = F.when(F.col(value).isNull() | (F.col("byte_length") != F.col("listed")), F.raise_error(F.concat(F.lit("FILE_NOT_READ: "), F.hex("path")))).otherwise(F.col("byte_length"))
    return met.select("doc_id", "path", value, same.cast("bigint").alias("byte_length"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, start, k, piece) of the lines (path, size, start, line) of a task's parts of files, in order."""
    k = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names, start = batch.column(0).dictionary_encode(), batch.column(2).to_numpy()
        which = names.indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1]), [True]])).tolist()
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            data = b"\n".join(batch.column(3).slice(x, y - x).to_pylist()) + b"\n"
            parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            for i in range(0, len(parts), 256):
                own = parts[i : i + 256]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[x].as_py()] * n, pa.string()), pa.array([batch.column(1)[x].as_py()] * n, pa.int64()), pa.array([int(start[x])] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array(own, pa.binary())], names=["path", "size", "start", "k", "piece"])
                k += n


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, byte_length, sha256) of files whose pieces stream by in order; sha256 is null for a file that they do not make up.

    The line reader drops a byte order mark at a file's beginning, and every line came with an end; the length tells.
    """
    names = ["path", "byte_length", "sha256"]
    now, size, total, held, digests = None, 0, 0, b"", []

    def done() -> pa.RecordBatch:
        found = None
        for digest, missing in zip(digests, (0, 3), strict=True):
            if total + missing == size:
                digest.update(held)
            if total + missing in (size, size + 1):
                found = digest.hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([size], pa.int64()), pa.array([found], pa.string())], names=names)

    for batch in batches:
        for path, own, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if path != now:
                if now is not None:
                    yield done()
                now, size, total, held, digests = path, own, 0, b"", [hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")]
            for digest in digests:
                digest.update(held)
                digest.update(memoryview(piece)[:-1])
            total, held = total + len(piece), piece[-1:]
    if now is not None:
        yield done()


def directory_digests(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, sha256, byte_length) of the files of ``from_directory``, none of them held whole if above ``MOST_WHOLE`` bytes.

    Of a large file Spark's line reader gives the bytes, in parts; they are dealt by file, sorted (with spilling) and
    hashed as they stream by. It would unpack a file named like a packed one, so such a file is read whole.
    """
    files, hidden, fs = _checked(spark, root)
    rows = spark.createDataFrame([(p, n, hashlib.sha256(c).hexdigest()) for p, n, c in _direct(spark, root, hidden, fs)], "path binary, byte_length bigint, sha256 string")
    passed = set(hidden)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    large = [p for p, n in files if n > MOST_WHOLE and p not in passed]
    packed = [p.decode("utf-8", "replace") for p in large if codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path("/" + p.decode("utf-8", "replace")))]

    def seen(kind: str, **options: str) -> tuple[DataFrame, Column]:
        read = spark.read.format(kind).options(recursiveFileLookup="true", **options).load(root)
        shown = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # of an encoded URI
        return read, _relative(spark, root, fs, shown)

    def whole(keep: Column, read: DataFrame) -> DataFrame:
        return read.filter(keep).select(utf8(_relative(spark, root, fs, F.col("path"))).alias("path"), F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"))

    if len(hidden) + len(large) < len(files):
        read, _ = seen("binaryFile")
        rows = rows.unionByName(whole(F.col("length") <= MOST_WHOLE, read))
    if packed:
        read, name = seen("binaryFile")
        rows = rows.unionByName(whole((F.col("_metadata.file_size") > MOST_WHOLE) & name.isin(packed), read))
    if len(packed) < len(large):
        small_batches(spark)
        read, name = seen("text", lineSep="\n")
        lines = read.filter((F.col("_metadata.file_size") > MOST_WHOLE) & ~name.isin(packed) if packed else F.col("_metadata.file_size") > MOST_WHOLE)
        lines = lines.select(name.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
        pieces = lines.mapInArrow(_pieces, "path string, size bigint, start bigint, k bigint, piece binary")
        dealt = pieces.repartition("path").sortWithinPartitions("path", "start", "k").select("path", "size", "piece")
        found = dealt.mapInArrow(_hashed, "path string, byte_length bigint, sha256 string")
        rows = rows.unionByName(found.select(utf8(F.col("path")).alias("path"), "byte_length", "sha256"))
    return _numbered(spark, files, rows, "sha256")


def safe_name(path: bytes) -> bool:
    """``functions.binary.safe_path`` for one path."""
    return bool(path) and b"\0" not in path and all(c not in (b"", b".", b"..") for c in path.split(b"/"))


def manifest(corpus: DataFrame) -> DataFrame:
    """The document records of a corpus."""
    return corpus.select(
        "doc_id",
        F.lower(F.hex("path")).alias("relative_path_bytes_hex"),
        F.lit("regular").alias("document_type"),
        F.length("content").cast("bigint").alias("byte_length"),
        F.sha2("content", 256).alias("sha256"),
        F.format_string("documents/doc_%08d.bin", F.col("doc_id")).alias("snapshot_path"),
    )


def verify(corpus: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (doc_id, problem) where a corpus and its manifest differ; none if they agree."""
    now = manifest(corpus).select("doc_id", F.col("byte_length").alias("n"), F.col("sha256").alias("h"))
    both = now.join(records.select("doc_id", "byte_length", "sha256"), "doc_id", "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "MISSING").when(F.col("byte_length").isNull(), "UNEXPECTED").when(F.col("n") != F.col("byte_length"), "LENGTH").when(F.col("h") != F.col("sha256"), "DIGEST")
    )
    return both.select("doc_id", problem.alias("problem")).filter("problem IS NOT NULL")


def chunks(corpus: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, chunk_no, start, raw): slices of ``size`` bytes, the last may be short; none of no bytes."""
    count = F.ceil(F.length("content") / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    cut = corpus.select("doc_id", "content", F.explode(numbers).alias("chunk_no"))
    return cut.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), (F.col("chunk_no") * size).cast("bigint").alias("start"), part(F.col("content"), F.col("chunk_no") * size, size).alias("raw"))


def chunk_manifest(corpus: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk_id, doc_id, raw_len, global_start, global_end) over the corpus in order of doc_id.

    The running offset comes from document lengths, then from places within a document: the window over all
    documents sees one number for each.
    """
    sizes = corpus.select("doc_id", F.length("content").cast("bigint").alias("n"))
    along = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    count = F.ceil(F.col("n") / size)
    placed = sizes.select("doc_id", "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"), F.coalesce(F.sum(count).over(along), F.lit(0)).alias("first"))
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / size) - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = placed.select("*", F.explode(numbers).alias("k"))
    start = F.col("base") + F.col("k") * size
    length = F.least(F.lit(size).cast("bigint"), F.col("n") - F.col("k") * size)
    return rows.select((F.col("first") + F.col("k")).cast("bigint").alias("chunk_id"), "doc_id", length.alias("raw_len"), start.alias("global_start"), (start + length).alias("global_end"))


def without_nul(corpus: DataFrame) -> DataFrame:
    """The documents that hold no zero byte."""
    return corpus.filter(~F.contains(latin1(F.col("content")), F.lit("\0")))


def concatenated(corpus: DataFrame, separator: bytes = b"\n") -> DataFrame:
    """One row: the contents in order of path with a separator between (for small collections)."""
    rows = corpus.agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("r"))
    glue = F.lit(bytearray(separator))
    joined = F.aggregate("r", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["content"]).otherwise(F.concat(a, glue, x["content"])))
    return rows.select(F.coalesce(joined, F.lit(bytearray(b""))).alias("content"))


def versions(corpus: DataFrame, window: int, step: int) -> DataFrame:
    """(doc_id, version, start, content): overlapping windows of each document between boundary markers."""
    count = F.when(F.length("content") <= window, 1).otherwise(F.ceil((F.length("content") - window) / step) + 1).cast("int")
    rows = corpus.select("doc_id", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("v"))
    body = part(F.col("content"), F.col("v") * step, window)
    framed = F.concat(utf8(F.format_string("[[BEGIN %d:%d]]\n", F.col("doc_id"), F.col("v"))), body, utf8(F.format_string("\n[[END %d:%d]]\n", F.col("doc_id"), F.col("v"))))
    return rows.select("doc_id", F.col("v").cast("bigint").alias("version"), (F.col("v") * step).cast("bigint").alias("start"), framed.alias("content"))


def text_queries(lines: DataFrame, column: str = "value", charset: str = "UTF-8") -> DataFrame:
    """(line, hex) of the trimmed lines that are not blank."""
    kept = lines.select(F.trim(F.col(column)).alias("line")).filter("line <> ''")
    return kept.select("line", F.lower(F.hex(F.encode("line", charset))).alias("hex"))


def stable_pattern(path: str) -> bytes:
    """The bytes of a pattern file that is regular, not empty, and the same when read twice."""
    before = os.lstat(path)
    if not stat.S_ISREG(before.st_mode):
        raise ValueError("NOT_A_REGULAR_FILE")
    with open(path, "rb") as f:
        one = f.read()
    with open(path, "rb") as f:
        two = f.read()
    after = os.lstat(path)
    if one != two or (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino):
        raise ValueError("PATTERN_FILE_CHANGED")
    if not one:
        raise ValueError("EMPTY_QUERY")
    return one
