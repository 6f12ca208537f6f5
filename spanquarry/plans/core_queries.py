"""Queries of the sources, the suffix tables and exact matching."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import functions as F

from spanquarry.functions import binary as B
from spanquarry.operators import index as X
from spanquarry.operators import match as M
from spanquarry.plans import tables as T
from spanquarry.plans.registry import query
from spanquarry.sources import containers, corpus
from spanquarry.sources.shared import saved

RECORD = "SELECT doc_id, lower(hex(encode(printf('doc_%08d.bin', doc_id)))) AS relative_path_bytes_hex, 'regular' AS document_type, strlen(text)::BIGINT AS byte_length, sha256(text) AS sha256, printf('documents/doc_%08d.bin', doc_id) AS snapshot_path FROM documents"


@query(RECORD)
def s1_document_snapshot(spark, d):
    return corpus.manifest(T.documents(spark, d))


@query()
def s1_directory_scan(spark, d):
    """The tables' own folder, as a tree of files."""
    files = corpus.directory_digests(spark, d)
    return files.select("doc_id", B.display_path(F.col("path")).alias("path"), "byte_length", "sha256")


@query("SELECT url, length(url) > 0 AND left(url,1) <> '/' AND len(list_filter(string_split(url,'/'), lambda c: c IN ('','.','..'))) = 0 AS safe FROM pages")
def s2_path_safety(spark, d):
    return T.table(spark, d, "pages").select("url", B.safe_path(B.utf8(F.col("url"))).alias("safe"))


@query("SELECT doc_id, lower(hex(encode(source || '/' || doc_id))) AS hex, source || '/' || doc_id AS shown FROM documents")
def s3_path_codecs(spark, d):
    raw = B.utf8(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    coded = T.table(spark, d, "documents").select("doc_id", F.lower(F.hex(raw)).alias("hex"))
    return coded.select("doc_id", "hex", B.display_path(F.unhex("hex")).alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'MISSING' WHEN doc_id % 10 = 1 THEN 'DIGEST' ELSE 'LENGTH' END AS problem FROM documents WHERE doc_id % 10 < 3")
def s4_snapshot_verify(spark, d):
    """A snapshot in which every tenth document is missing, one altered and one lengthened."""
    docs = T.documents(spark, d)
    k = F.col("doc_id") % 10
    flipped = F.concat(F.lit(bytearray(b"\x01")), B.part(F.col("content"), 1, F.length("content")))
    changed = docs.filter(k != 0).withColumn("content", F.when(k == 1, flipped).when(k == 2, F.concat("content", F.lit(bytearray(b"x")))).otherwise(F.col("content")))
    return corpus.verify(changed, corpus.manifest(docs))


@query("SELECT doc_id, strlen(text)::BIGINT AS byte_length, md5(text) AS md5 FROM documents")
def s5_raw_reader(spark, d):
    return T.documents(spark, d).select("doc_id", "byte_length", F.md5("content").alias("md5"))


CHUNKS = "WITH d AS (SELECT doc_id, lower(hex(encode(text))) AS hx, strlen(text) AS n FROM documents), c AS (SELECT *, unnest(range((n + 16383) // 16384))::BIGINT AS chunk_no FROM d) "


@query(CHUNKS + "SELECT doc_id, chunk_no, chunk_no*16384 AS start, md5(unhex(substr(hx, chunk_no*32768+1, 32768))) AS md5 FROM c")
def s6_fixed_chunks(spark, d):
    return corpus.chunks(T.documents(spark, d)).select("doc_id", "chunk_no", "start", F.md5("raw").alias("md5"))


@query(CHUNKS + "SELECT doc_id, chunk_no, sha256(unhex(substr(hx, chunk_no*32768+1, 32768))) AS sha256 FROM c")
def s7_chunk_container(spark, d):
    return containers.round_trip(corpus.chunks(T.documents(spark, d))).select("doc_id", "chunk_no", F.sha2("raw", 256).alias("sha256"))


@query("""WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents), c AS (SELECT doc_id, n, unnest(range((n + 16383) // 16384))::BIGINT AS k FROM d),
l AS (SELECT doc_id, k, least(16384, n - k*16384)::BIGINT AS raw_len FROM c)
SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS chunk_id, doc_id, raw_len, (sum(raw_len) OVER (ORDER BY doc_id, k) - raw_len)::BIGINT AS global_start, (sum(raw_len) OVER (ORDER BY doc_id, k))::BIGINT AS global_end FROM l""")
def s8_chunk_manifest(spark, d):
    return corpus.chunk_manifest(T.documents(spark, d))


@query("SELECT item_id, array_to_string(list_transform(range(strlen(text)), lambda i: (('0x' || substr(hex(encode(text)), 2*i+1, 2))::INT + 1)::VARCHAR), ',') || ',0' AS prepared FROM benchmark")
def s9_shifted_chunks(spark, d):
    """Every byte one higher with a 0 at the end, as symbols (255 has no place in a byte)."""
    shifted = F.transform(B.byte_array(F.col("content")), lambda b: (b + 1).cast("string"))
    return T.items(spark, d).select(F.col("doc_id").alias("item_id"), F.array_join(F.concat(shifted, F.array(F.lit("0"))), ",").alias("prepared"))


@query("SELECT doc_id, strlen(text)::BIGINT + 1 AS byte_length, md5(unhex(hex(encode(text)) || '00')) AS md5 FROM documents WHERE NOT contains(text, chr(0))")
def s10_sentinel_corpus(spark, d):
    closed = corpus.without_nul(T.documents(spark, d)).select("doc_id", F.concat("content", F.lit(bytearray(b"\0"))).alias("content"))
    return closed.select("doc_id", F.length("content").cast("bigint").alias("byte_length"), F.md5("content").alias("md5"))


@query("SELECT item_id, list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2*i+1, 2))::INT) || [256] AS symbols FROM benchmark")
def s11_symbol_corpus(spark, d):
    return T.items(spark, d).select(F.col("doc_id").alias("item_id"), F.concat(B.byte_array(F.col("content")), F.array(F.lit(256))).alias("symbols"))


def _saved_suffixes(spark, d, docs=None):
    """The suffix table (of the items if not told otherwise), written to the shared folder and read back."""
    return saved(X.suffixes(T.items(spark, d)) if docs is None else X.suffixes_long(docs), "suffixes")


@query(f"WITH {T.SUF} SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS documents, sum(off)::BIGINT AS offsets, sum(bwt*sa_row)::BIGINT AS weighted FROM sfx")
def s12_index_tables(spark, d):
    """The written and reread suffix table, as totals (s12 to s15, s18 to s20 share one Parquet layout)."""
    t = _saved_suffixes(spark, d)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("documents"), F.sum("off").alias("offsets"), F.sum(F.col("bwt") * F.col("sa_row")).alias("weighted"))


@query("SELECT doc_id, strlen(text)::BIGINT + 1 AS entries, strlen(text)::BIGINT + 1 AS expected FROM documents")
def s14_suffix_container_size(spark, d):
    docs = T.documents(spark, d)
    t = _saved_suffixes(spark, d, docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"))
    return t.join(docs, "doc_id").select("doc_id", "entries", (F.col("byte_length") + 1).alias("expected"))


@query(f"WITH {T.SUF} SELECT doc_id, sa_row, off // 64 AS chunk_no FROM sfx")
def s15_chunk_map(spark, d):
    return X.chunk_of(_saved_suffixes(spark, d), 64)


@query("SELECT doc_id, array_to_string(list_transform(range((strlen(text) + 16383) // 16384), lambda k: (k*16384)::VARCHAR), ',') AS starts FROM documents WHERE strlen(text) > 0")
def s16_chunk_starts(spark, d):
    starts = corpus.chunks(T.documents(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list("start")).alias("s"))
    return starts.select("doc_id", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("starts"))


@query(f"WITH {T.SUF} SELECT doc_id, sa_row, off, bwt FROM sfx WHERE sa_row % 8 = 0")
def s18_compact_runtime(spark, d):
    """Without the suffixes: sampled offsets with their symbols."""
    return _saved_suffixes(spark, d).filter("sa_row % 8 = 0")


RUNS = T.SUF + """, f AS (SELECT *, CASE WHEN lag(bwt) OVER (PARTITION BY doc_id ORDER BY sa_row) IS NOT DISTINCT FROM bwt THEN 0 ELSE 1 END AS new FROM sfx),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sa_row) - 1 AS run_id FROM f),
runs AS (SELECT doc_id, run_id::BIGINT AS run_id, any_value(bwt) AS symbol, count(*) AS length FROM g GROUP BY ALL)"""


@query(f"WITH {RUNS} SELECT doc_id, count(*) AS runs, sum(length)::BIGINT AS symbols FROM runs GROUP BY doc_id")
def s19_run_length_runtime(spark, d):
    return X.run_lengths(_saved_suffixes(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("symbols"))


@query(f"WITH {T.SUF} SELECT doc_id, sa_row, off FROM sfx WHERE sa_row % 4 = 0")
def s20_locate_samples(spark, d):
    return _saved_suffixes(spark, d).filter("sa_row % 4 = 0").select("doc_id", "sa_row", "off")


@query("SELECT trim(text) AS line, lower(hex(encode(trim(text)))) AS hex FROM conversations WHERE trim(text) <> ''")
def s21_text_queries(spark, d):
    return corpus.text_queries(T.table(spark, d, "conversations"), "text")


@query("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'EMPTY_QUERY' ELSE lower(hex(encode(text))) END AS hex FROM benchmark")
def s22_stable_queries(spark, d):
    """Every item as a query file of its own, each read twice; every fifth file is empty."""
    with tempfile.TemporaryDirectory() as folder:  # query files are the driver's own input
        rows = []
        for r in T.table(spark, d, "benchmark").select("item_id", "text").toLocalIterator():
            path = f"{folder}/{r['item_id']}"
            with open(path, "wb") as f:
                f.write(b"" if r["item_id"] % 5 == 0 else r["text"].encode())
            try:
                rows.append((r["item_id"], corpus.stable_pattern(path).hex()))
            except ValueError as e:
                rows.append((r["item_id"], str(e)))
    return spark.createDataFrame(rows, "item_id bigint, hex string")


@query("SELECT 'item-' || item_id AS name, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM benchmark")
def s25_deterministic_archive(spark, d):
    """All items in one archive, listed from what was packed; a second packing in another order gives the same bytes."""
    files = {f"item-{r['item_id']}": r["text"].encode() for r in T.table(spark, d, "benchmark").select("item_id", "text").toLocalIterator()}
    blob = containers.deterministic_tar(files)
    if blob != containers.deterministic_tar(dict(reversed(files.items()))):
        raise ValueError("ARCHIVE_DIFFERS")
    return spark.createDataFrame([(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in containers.read_tar(blob).items()], "name string, size bigint, sha256 string")


@query("""WITH d AS (SELECT doc_id, lower(hex(encode(text))) AS hx, strlen(text) AS n FROM documents),
v AS (SELECT *, unnest(range(CASE WHEN n <= 4096 THEN 1 ELSE (n - 4096 + 2047) // 2048 + 1 END))::BIGINT AS version FROM d)
SELECT doc_id, version, version*2048 AS start, md5(unhex(hex(encode(printf('[[BEGIN %d:%d]]' || chr(10), doc_id, version))) || substr(hx, version*4096+1, 8192) || hex(encode(printf(chr(10) || '[[END %d:%d]]' || chr(10), doc_id, version))))) AS md5 FROM v""")
def s23_version_collection(spark, d):
    return corpus.versions(T.documents(spark, d), 4096, 2048).select("doc_id", "version", "start", F.md5("content").alias("md5"))


@query("SELECT sha256(string_agg(text, chr(10) ORDER BY item_id)) AS sha256, sum(strlen(text))::BIGINT + count(*) - 1 AS byte_length FROM benchmark WHERE NOT contains(text, chr(0))")
def s24_concatenated_subset(spark, d):
    one = corpus.concatenated(corpus.without_nul(T.items(spark, d)))
    return one.select(F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("byte_length"))


SFX = f"WITH {T.SUF} "


@query(SFX + "SELECT doc_id, sa_row, off FROM sfx")
def x1_suffix_array(spark, d):
    return X.suffixes(T.items(spark, d)).select("doc_id", "sa_row", "off")


@query()
def x1_suffix_array_long(spark, d):
    """All documents, whole texts: a check sum of each document's suffix array."""
    return X.suffixes_long(T.documents(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("off") * (F.col("sa_row") % 1009)).alias("checksum"))


@query(SFX + "SELECT doc_id, sa_row, off FROM sfx")
def x2_suffix_array_arrow(spark, d):
    return X.suffixes_long(T.items(spark, d)).select("doc_id", "sa_row", "off")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END::BIGINT AS sa_row FROM documents WHERE doc_id % 3 < 2 AND strlen(text) >= 3")
def x3_suffix_order_check(spark, d):
    """Tables in which every third document has an offset beyond its end and the next two rows exchanged."""
    docs = T.documents(spark, d)
    k, row = F.col("doc_id") % 3, F.col("sa_row")
    table = X.suffixes_long(docs.filter(F.length("content") >= 3))
    moved = F.when((k == 1) & (row == 2), 3).when((k == 1) & (row == 3), 2).otherwise(row)
    bad = table.withColumn("sa_row", moved.cast("bigint")).withColumn("off", F.when((k == 0) & (row == 1), 1 << 30).otherwise(F.col("off")).cast("bigint"))
    return X.order_violations(bad, docs)


@query(SFX + "SELECT doc_id, sa_row, bwt FROM sfx")
def x4_bwt(spark, d):
    return X.suffixes(T.items(spark, d)).select("doc_id", "sa_row", "bwt")


@query(SFX + "SELECT doc_id, sa_row, CASE WHEN bwt = 256 THEN 0 ELSE bwt END AS bwt FROM sfx")
def x5_bwt_byte_sentinel(spark, d):
    """The byte alphabet with an appended zero byte: the same rows, the sentinel shown as 0."""
    return X.suffixes(T.items(spark, d)).select("doc_id", "sa_row", F.when(F.col("bwt") == X.SENTINEL, 0).otherwise(F.col("bwt")).alias("bwt"))


@query("SELECT doc_id, unnest(range(0, strlen(text) + 1, 5))::BIGINT AS sa_row FROM documents WHERE doc_id % 2 = 0")
def x6_bwt_validation(spark, d):
    """Tables in which every fifth symbol of every second document is another one."""
    docs = T.documents(spark, d)
    wrong = (F.col("doc_id") % 2 == 0) & (F.col("sa_row") % 5 == 0)
    return X.bwt_violations(X.suffixes_long(docs).withColumn("bwt", F.when(wrong, F.col("bwt") + 1).otherwise(F.col("bwt"))), docs)


@query("WITH c AS (SELECT doc_id, ('0x' || y)::INT AS symbol, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS y FROM documents) GROUP BY ALL UNION ALL SELECT doc_id, 256, 1 FROM documents) SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY CASE WHEN symbol = 256 THEN -1 ELSE symbol END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM c")
def x7_c_table(spark, d):
    return X.c_table(X.suffixes_long(T.documents(spark, d)))


OCC_SQL = ", b AS (SELECT doc_id, sa_row // 32 AS block, bwt AS symbol, count(*) AS n FROM sfx GROUP BY ALL) SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, symbol ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b"


@query(SFX + OCC_SQL)
def x8_occ_checkpoints(spark, d):
    return X.occ_table(X.suffixes(T.items(spark, d)), 32)


@query(SFX + "SELECT a.doc_id, a.sa_row, b.sa_row AS to_row FROM sfx a LEFT JOIN sfx b ON a.doc_id = b.doc_id AND b.off = a.off + 48")
def x9_jump_index(spark, d):
    return X.jumps(X.suffixes(T.items(spark, d)), 48)


@query("SELECT doc_id, off // 64 AS chunk_no, count(*) AS suffixes FROM (SELECT doc_id, unnest(range(strlen(text) + 1))::BIGINT AS off FROM documents) GROUP BY ALL")
def x10_rows_by_chunk(spark, d):
    return X.chunk_of(X.suffixes_long(T.documents(spark, d)), 64).groupBy("doc_id", "chunk_no").agg(F.count(F.lit(1)).alias("suffixes"))


@query("""WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents), c AS (SELECT doc_id, n, unnest(range((n + 16383) // 16384))::BIGINT AS k FROM d),
l AS (SELECT doc_id, k, least(16384, n - k*16384)::BIGINT AS raw_len FROM c),
m AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS chunk_id, sum(raw_len) OVER (ORDER BY doc_id, k) - raw_len AS a, sum(raw_len) OVER (ORDER BY doc_id, k) AS b FROM l),
q AS (SELECT o_orderkey AS query_id, o_orderkey * 40 AS position FROM orders)
SELECT query_id, position, chunk_id FROM q JOIN m ON a <= position AND position < b""")
def x11_chunk_lookup(spark, d):
    offsets = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") * 40).alias("position"))
    return X.chunk_lookup(offsets, corpus.chunk_manifest(T.documents(spark, d)), corpus.CHUNK)


@query(f"WITH {RUNS} SELECT doc_id, run_id, symbol, length FROM runs")
def x12_run_lengths(spark, d):
    return X.run_lengths(X.suffixes(T.items(spark, d)))


@query(SFX + "SELECT doc_id, sa_row, bwt FROM sfx")
def x12_run_lengths_decoded(spark, d):
    return X.expand_runs(X.run_lengths(X.suffixes(T.items(spark, d))))


@query(f"WITH {RUNS}, nb AS (SELECT doc_id, sa_row // 32 AS block, sum(new) AS new FROM f GROUP BY ALL), r AS (SELECT doc_id, block, coalesce(sum(new) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS runs_before FROM nb), o AS (WITH b AS (SELECT doc_id, sa_row // 32 AS block, bwt AS symbol, count(*) AS n FROM sfx GROUP BY ALL) SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, symbol ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b) SELECT doc_id, block, symbol, before, runs_before FROM o JOIN r USING (doc_id, block)")
def x13_run_checkpoints(spark, d):
    return X.run_checkpoints(X.suffixes(T.items(spark, d)), 32)


@query(f"WITH {RUNS}, c AS (SELECT DISTINCT doc_id, bwt FROM sfx), o AS (SELECT DISTINCT doc_id, sa_row // 128, bwt FROM sfx) SELECT 'suffixes' AS name, count(*) AS n FROM sfx UNION ALL SELECT 'c', count(*) FROM c UNION ALL SELECT 'occ', count(*) FROM o UNION ALL SELECT 'runs', count(*) FROM runs")
def x14_index_build(spark, d):
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in X.build(T.items(spark, d), 128).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(SFX + ", o AS (SELECT doc_id, count(DISTINCT sa_row // 32) AS blocks, count(DISTINCT bwt) AS alphabet, count(*) AS n_rows FROM sfx GROUP BY doc_id) SELECT o.*, sha256(text) AS sha256 FROM o JOIN benchmark ON doc_id = item_id")
def x15_document_runtimes(spark, d):
    t = X.suffixes_long(T.items(spark, d)).groupBy("doc_id").agg(F.countDistinct(F.floor(F.col("sa_row") / 32)).alias("blocks"), F.countDistinct("bwt").alias("alphabet"), F.count(F.lit(1)).alias("n_rows"))
    return t.join(T.items(spark, d).select("doc_id", F.sha2("content", 256).alias("sha256")), "doc_id")


@query("SELECT p AS hex, CASE WHEN p = '' THEN 'EMPTY_QUERY' WHEN len(p) % 2 = 1 THEN 'ODD_LENGTH' WHEN NOT regexp_full_match(p, '[0-9a-f]+') THEN 'INVALID_HEX' ELSE 'OK' END AS status FROM (SELECT CASE doc_id % 4 WHEN 0 THEN lower(hex(encode(source))) WHEN 1 THEN hex(encode(source)) WHEN 2 THEN '' ELSE left(lower(hex(encode(source))), 7) END AS p FROM documents)")
def p1_pattern_parser(spark, d):
    low = F.lower(F.hex(B.utf8(F.col("source"))))
    k = F.col("doc_id") % 4
    given = T.table(spark, d, "documents").select(F.when(k == 0, low).when(k == 1, F.upper(low)).when(k == 2, "").otherwise(F.substring(low, 1, 7)).alias("hex"))
    return M.patterns_from_hex(given, "hex").select("hex", "status")


@query(SFX + ", q AS (SELECT item_id AS doc_id, s AS symbol, p AS pos FROM benchmark, (VALUES (101), (256), (122)) a(s), (VALUES (0), (10), (100)) b(p)) SELECT q.doc_id, symbol, pos, count(sa_row) AS occ FROM q LEFT JOIN sfx ON q.doc_id = sfx.doc_id AND bwt = symbol AND sa_row < pos GROUP BY ALL")
def p3_rank(spark, d):
    docs = T.items(spark, d)
    asked = docs.select("doc_id", F.explode(F.array(F.lit(101), F.lit(256), F.lit(122))).alias("symbol")).withColumn("pos", F.explode(F.array(F.lit(0), F.lit(10), F.lit(100))))
    return X.rank(X.suffixes(docs), asked)


INTERVALS = SFX + f", {T.SHORT}, iv AS (SELECT query_id::BIGINT AS query_id, doc_id, min(sa_row) AS l, max(sa_row) + 1 AS r FROM sfx JOIN pat ON starts_with(suffix, lower(hex(encode(p)))) GROUP BY ALL) "


# a suffix is below, at or above a pattern of three bytes or fewer by its own first three
PLACED = f"WITH {T.PRE}, {T.SHORT}, iv AS (SELECT query_id::BIGINT AS query_id, doc_id, count(*) FILTER (WHERE head < hx) AS l, count(*) FILTER (WHERE head < hx OR starts_with(head, hx)) AS r FROM pre, (SELECT query_id, lower(hex(encode(p))) AS hx FROM pat) GROUP BY ALL) "
FOUND = f"WITH {T.PRE}, {T.SHORT} SELECT query_id::BIGINT AS query_id, doc_id, off AS doc_offset FROM pre JOIN pat ON starts_with(head, lower(hex(encode(p))))"


@query(PLACED + "SELECT * FROM iv WHERE r > l")
def p4_suffix_interval(spark, d):
    """By backward search over the run-length BWT of all documents."""
    return X.backward_search(X.run_lengths(X.suffixes_long(T.documents(spark, d))), T.short_patterns(spark))


@query(T.LOCATE + "SELECT query_id, doc_id, count(*) AS match_count FROM occ GROUP BY ALL")
def p5_count_by_document(spark, d):
    return M.count_by_document(T.documents(spark, d), T.patterns(spark, d))


@query(T.LOCATE + "SELECT pat.query_id, count(doc_id) AS match_count FROM pat LEFT JOIN occ USING (query_id) GROUP BY ALL")
def p6_count_batch(spark, d):
    return M.count(T.documents(spark, d), T.patterns(spark, d))


@query(T.LOCATE + "SELECT * FROM occ")
def p7_locate_all(spark, d):
    return M.locate(T.documents(spark, d), T.patterns(spark, d))


BOUNDED = T.LOCATE + "SELECT query_id, doc_id, doc_offset FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, doc_offset) AS r FROM occ) WHERE r <= 100"


@query(BOUNDED)
def p8_locate_bounded(spark, d):
    return M.bounded(M.locate(T.documents(spark, d), T.patterns(spark, d)), 100)


@query(INTERVALS + ", o AS (SELECT query_id::BIGINT AS query_id, sfx.doc_id, sa_row, off AS doc_offset, row_number() OVER (PARTITION BY query_id, sfx.doc_id ORDER BY sa_row) AS k FROM sfx JOIN pat ON starts_with(suffix, lower(hex(encode(p))))) SELECT query_id, doc_id, doc_offset FROM o WHERE k <= 3")
def p9_locate_suffix_order(spark, d):
    """The first rows of the suffix order in each document instead of the first offsets."""
    docs = T.items(spark, d)
    table = X.suffixes(docs)
    rows = X.intervals(table, docs, T.short_patterns(spark)).filter(F.col("r") > F.col("l")).withColumn("sa_row", F.explode(F.sequence("l", F.least("r", F.col("l") + 3) - 1)))
    return rows.join(table, ["doc_id", "sa_row"]).select("query_id", "doc_id", F.col("off").alias("doc_offset"))


@query(T.LOCATE + "SELECT query_id, doc_id, count(*) AS match_count, min(doc_offset) AS first_offset, max(doc_offset) AS last_offset FROM occ GROUP BY ALL")
def p10_locate_summary(spark, d):
    return M.summary(M.locate(T.documents(spark, d), T.patterns(spark, d)))


@query(SFX + ", m AS (SELECT doc_id, sa_row, off, max(CASE WHEN sa_row % 8 = 0 THEN off END) OVER (PARTITION BY doc_id ORDER BY off) AS base FROM sfx) SELECT doc_id, sa_row, off, off - coalesce(base, 0) AS steps FROM m")
def p11_sampled_locate(spark, d):
    """Every row's offset by LF steps to a kept row; the other offsets are not read."""
    table = _saved_suffixes(spark, d)
    return X.walk(X.run_lengths(table.drop("off")), table.filter("sa_row % 8 = 0"), table)


@query(FOUND)
def p12_locate_from_rows(spark, d):
    """Rows by backward search, offsets from the stored suffix table, of which a document's is one row."""
    return X.locate_packed(saved(X.packed(T.documents(spark, d)), "packed"), T.short_patterns(spark))


@query(PLACED + "SELECT query_id, doc_id, r - l AS match_count FROM iv WHERE r > l")
def p13_count_run_lengths(spark, d):
    """Counts from run lengths alone."""
    runs = saved(X.run_lengths(X.suffixes_long(T.documents(spark, d))), "runs")
    return X.backward_search(runs, T.short_patterns(spark)).select("query_id", "doc_id", (F.col("r") - F.col("l")).alias("match_count"))


@query(FOUND)
def p14_locate_run_lengths(spark, d):
    """Offsets from run lengths and every fourth offset alone: backward search, then LF steps."""
    return X.locate_packed(saved(X.packed(T.documents(spark, d), 4), "packed"), T.short_patterns(spark), 4)


@query(BOUNDED)
def p15_multi_document_locate(spark, d):
    return M.locate_bounded(T.documents(spark, d), T.patterns(spark, d), 100)


@query(T.LOCATE + ", c AS (SELECT query_id, doc_id, count(*) AS m FROM occ GROUP BY ALL), s AS (SELECT query_id, sum(m)::BIGINT AS m, count(*) AS dd FROM c GROUP BY ALL) SELECT query_id, coalesce(m,0) AS match_count, coalesce(dd,0) AS matched_documents, least(coalesce(m,0),100) AS returned_count, coalesce(m,0) > 100 AS bounded, coalesce(m,0) <= 100 AS offsets_complete FROM pat LEFT JOIN s USING (query_id)")
def p15_query_result(spark, d):
    return M.query_result(T.documents(spark, d), T.patterns(spark, d), 100)


@query(T.LOCATE + "SELECT *, true AS byte_check FROM occ")
def p16_byte_check(spark, d):
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    return M.byte_checked(docs, pats, M.locate(docs, pats))


@query(T.LOCATE + "SELECT query_id, doc_id, CASE WHEN query_id = 1000 THEN 'COUNT' ELSE 'DUPLICATE' END AS problem FROM occ WHERE query_id IN (1000, 1001) GROUP BY ALL HAVING query_id = 1000 OR count(*) > 1")
def p17_cross_validation(spark, d):
    """One pattern's counts are one too high, another's offsets are all the same."""
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    counts = M.count_by_document(docs, pats).withColumn("match_count", F.col("match_count") + (F.col("query_id") == 1000).cast("bigint"))
    return M.cross_check(counts, M.locate(docs, pats).withColumn("doc_offset", F.when(F.col("query_id") == 1001, 7).otherwise(F.col("doc_offset"))))


@query(T.LOCATE + "SELECT pat.query_id, count(doc_id) AS match_count, true AS verified FROM pat LEFT JOIN occ USING (query_id) GROUP BY ALL")
def p18_verified_query(spark, d):
    docs = T.documents(spark, d)
    return M.verified_count(docs, corpus.manifest(docs), T.patterns(spark, d))


@query(T.LOCATE + "SELECT query_id, doc_id, doc_offset, lower(substr(hx, greatest(doc_offset-80,0)*2+1, (doc_offset+160-greatest(doc_offset-80,0))*2)) AS snippet_hex FROM occ JOIN d USING (doc_id)")
def p19_snippets(spark, d):
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    found = M.snippets(docs, pats, M.locate(docs, pats))
    return found.select("query_id", "doc_id", "doc_offset", F.lower(F.hex(F.encode("snippet", "ISO-8859-1"))).alias("snippet_hex"))


@query(T.LOCATE + "SELECT query_id, doc_id % 4 AS shard_id, count(*) AS match_count FROM occ GROUP BY ALL UNION ALL SELECT query_id, NULL, count(*) FROM occ GROUP BY ALL")
def p20_sharded_count(spark, d):
    return M.sharded(T.documents(spark, d), F.col("doc_id") % 4, T.patterns(spark, d))


@query(f"WITH {T.PAT} SELECT query_id, doc_id, ((len(text) - len(replace(text, p, ''))) // len(p))::BIGINT AS match_count FROM documents JOIN pat ON contains(text, p)")
def p21_disjoint_count(spark, d):
    return M.count_by_document(T.documents(spark, d), T.patterns(spark, d), overlapping=False)


@query("SELECT query_id::BIGINT AS query_id, page_id AS doc_id, len(list_filter(range(len(html)), lambda i: substr(html, i+1, len(p)) = p)) AS match_count FROM pages JOIN (VALUES (0,'<p>'),(1,'</'),(2,'aa')) v(query_id, p) ON contains(html, p)")
def p22_overlapping_count(spark, d):
    from spanquarry.sources.corpus import from_table

    pats = spark.createDataFrame([(0, b"<p>"), (1, b"</"), (2, b"aa")], "query_id bigint, pattern binary")
    return M.count_by_document(from_table(T.table(spark, d, "pages"), "page_id", "html"), pats)
