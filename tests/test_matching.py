"""Count, locate and suffix tables against scans of small corpora with awkward bytes."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from spanquarry.functions import binary as B
from spanquarry.operators import identity as V
from spanquarry.operators import index as X
from spanquarry.operators import match as M
from spanquarry.plans import registry
from spanquarry.plans import tables as T
from spanquarry.sources import corpus as S

CORPORA = {
    "empty": [], "one empty": [b""], "runs": [b"aa"], "nuls": [b"\0\0"], "high": [b"\xff\0"], "twins": [b"a", b"a"], "prefix": [b"ab", b"abc"],
    "periodic": [b"abababab"], "all bytes": [bytes(range(256))], "mixed": [b"", b"\0", b"\xff\0", b"", b"\0\xff", b"\0\xff"],
    "tree": [b"", b"banana\0\xff", b"anaana", b"LEFT-AB", b"CD-RIGHT", bytes(range(256)), b"same", b"same", b"\x80\x81A\0B\xfe\xff"],
    "regex": [rb"a.b*c\Q[]\E$^", b"line\nline\r\n", b"aaaa"],
}
PATTERNS = [b"ana", b"A\0B", b"\xff", b"\x80\x81", bytes(range(256)), b"same", b"not-present", b"ABCD-R", b"aa", b"a", b"\0", b".", b"*", rb"\E", b"\n", b"ab"]


def table(spark, docs):
    return spark.createDataFrame([(i, f"p{i}".encode(), bytes(d), len(d)) for i, d in enumerate(docs)], "doc_id bigint, path binary, content binary, byte_length bigint")


def wanted(spark, patterns=PATTERNS):
    return spark.createDataFrame([(k, p) for k, p in enumerate(patterns)], "query_id bigint, pattern binary")


def scan(docs, patterns=PATTERNS):
    return sorted((k, i, o) for k, p in enumerate(patterns) for i, d in enumerate(docs) for o in range(len(d) - len(p) + 1) if d[o : o + len(p)] == p)


@pytest.mark.parametrize("name", CORPORA)
def test_locate_and_count(spark, name):
    docs = CORPORA[name]
    corpus, pats = table(spark, docs), wanted(spark)
    want = scan(docs)
    assert sorted(map(tuple, M.locate(corpus, pats).collect())) == want
    assert dict(map(tuple, M.count(corpus, pats).collect())) == {k: sum(w[0] == k for w in want) for k in range(len(PATTERNS))}
    disjoint = {(r[0], r[1]): r[2] for r in M.count_by_document(corpus, pats, overlapping=False).collect()}
    assert disjoint == {(k, i): d.count(p) for k, p in enumerate(PATTERNS) for i, d in enumerate(docs) if p in d}


def test_bounds_keep_the_canonical_prefix(spark):
    docs = CORPORA["tree"]
    corpus, pats = table(spark, docs), wanted(spark)
    for most in (0, 1, 2, 3, 100):
        kept = [w for k in range(len(PATTERNS)) for w in [x for x in scan(docs) if x[0] == k][:most]]
        assert sorted(map(tuple, M.locate_bounded(corpus, pats, most).collect())) == kept
        assert sorted(map(tuple, M.bounded(M.locate(corpus, pats), most).collect())) == kept
        result = {r["query_id"]: r for r in M.query_result(corpus, pats, most).collect()}
        assert all(r["bounded"] == (r["match_count"] > most) == (not r["offsets_complete"]) for r in result.values())


def test_layout_of_partitions_changes_nothing(spark):
    docs = CORPORA["tree"]
    one, two = table(spark, docs), table(spark, docs).repartition(5)
    pats = wanted(spark)
    assert V.result_identity(M.locate(one, pats)).orderBy("query_id").collect() == V.result_identity(M.locate(two, pats)).orderBy("query_id").collect()
    assert V.corpus_identity(one).first() == V.corpus_identity(two).first()
    assert V.corpus_identity(one.filter("doc_id <> 3")).first() != V.corpus_identity(one).first()


@pytest.mark.parametrize("name", CORPORA)
def test_suffix_tables(spark, name):
    docs = CORPORA[name]
    corpus = table(spark, docs)
    want = [(i, r, o, 256 if o == 0 else d[o - 1]) for i, d in enumerate(docs) for r, o in enumerate(sorted(range(len(d) + 1), key=lambda o: d[o:]))]
    for make in (X.suffixes, X.suffixes_long):
        found = make(corpus)
        assert sorted(map(tuple, found.collect())) == want
    back = X.expand_runs(X.run_lengths(found))
    assert sorted(map(tuple, back.collect())) == [(i, r, b) for i, r, _, b in want]
    assert X.order_violations(found, corpus).count() == X.bwt_violations(found, corpus).count() == 0


def test_altered_suffix_table_is_refused(spark):
    corpus = table(spark, [b"banana"])
    bad = X.suffixes(corpus).withColumn("off", F.when(F.col("sa_row") == 1, 3).when(F.col("sa_row") == 2, 5).otherwise(F.col("off")).cast("bigint"))
    assert X.order_violations(bad, corpus).count() > 0 and X.bwt_violations(bad.withColumn("bwt", F.lit(0)), corpus).count() > 0


def test_every_short_pattern(spark):
    docs = [b"abracadabra\0\xff", b"cab"]
    pats = [bytes([x]) for x in range(256)] + [bytes([x, y]) for x in b"abcdr\0\xff" for y in b"abcdr\0\xff"]
    assert sorted(map(tuple, M.locate(table(spark, docs), wanted(spark, pats)).collect())) == scan(docs, pats)


def test_golden_mini_corpus(spark):
    corpus = table(spark, [b"error 500 test log\nwarning disk slow\nerror 404 test log\n"])
    pats = wanted(spark, [b"error", b"warning", b"404"])
    got = {r["query_id"]: (r["l"], r["r"]) for r in X.intervals(X.suffixes(corpus), corpus, pats).collect()}
    assert got == {0: (20, 22), 1: (56, 57), 2: (16, 17)}


def test_pattern_parser(spark):
    rows = spark.createDataFrame([("",), ("a",), ("AB",), ("0x61",), ("6g",), ("6100ff",), (None,)], "h string")
    assert [r["status"] for r in M.patterns_from_hex(rows, "h").collect()] == ["EMPTY_QUERY", "ODD_LENGTH", "INVALID_HEX", "INVALID_HEX", "INVALID_HEX", "OK", "EMPTY_QUERY"]
    assert M.count(table(spark, [b"aa"]), spark.createDataFrame([(0, b"")], "query_id bigint, pattern binary")).first()["match_count"] == 0


def test_safe_paths(spark):
    paths = [b"a/b", b"", b"/a", b"a//b", b"a/../b", b"./a", b"a\0b", b"a\xff/c"]
    rows = spark.createDataFrame([(p,) for p in paths], "p binary").select(B.safe_path(F.col("p")).alias("s"), B.display_path(F.col("p")).alias("d")).collect()
    assert [r["s"] for r in rows] == [True, False, False, False, False, False, False, True] and rows[-1]["d"] == "a\\xff/c"


def test_directory_snapshot(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in (("b", b"two"), ("a", b"\0\xff"), ("sub/c", b""), ("B", b"x")):
        (tmp_path / "in" / name).write_bytes(content)
    got = [(r["doc_id"], bytes(r["path"]), bytes(r["content"])) for r in S.from_directory(spark, str(tmp_path / "in")).orderBy("doc_id").collect()]
    assert got == [(0, b"B", b"x"), (1, b"a", b"\0\xff"), (2, b"b", b"two"), (3, b"sub/c", b"")]
    (tmp_path / "in" / "link").symlink_to(tmp_path / "in" / "a")
    with pytest.raises(ValueError, match="NOT_A_REGULAR_FILE"):
        S.from_directory(spark, str(tmp_path / "in"))


def test_directory_snapshot_leaves_no_file_out(spark, tmp_path):
    root = tmp_path / "in"
    names = [".hidden", "_x", "_sub/y", "a.txt", "b c.txt", ".blank", "d+e %41é", ".git/deep/z"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == ".blank" else name.encode())
    got = {bytes(r["path"]).decode(): (r["doc_id"], bytes(r["content"]), r["byte_length"]) for r in S.from_directory(spark, str(root)).collect()}
    assert got == {n: (k, b"" if n == ".blank" else n.encode(), 0 if n == ".blank" else len(n.encode())) for k, n in enumerate(sorted(names, key=str.encode))}
    by_uri = {bytes(r["path"]).decode() for r in S.from_directory(spark, f"file://{root}").collect()}
    assert by_uri == set(names)


def test_many_automata_give_the_same(spark, monkeypatch):
    corpus, pats = table(spark, CORPORA["tree"]), wanted(spark, [*PATTERNS, b"a", b""])
    monkeypatch.setattr(M, "MOST_BYTES", 9)
    monkeypatch.setattr(M, "HITS", 3)
    want = scan(CORPORA["tree"], [*PATTERNS, b"a"])
    assert sorted(map(tuple, M.locate(corpus, pats).collect())) == want
    assert sorted(map(tuple, M.locate_bounded(corpus, pats, 2).collect())) == [w for k in range(len(PATTERNS) + 1) for w in [x for x in want if x[0] == k][:2]]
    assert dict(map(tuple, M.count(corpus, pats).collect())) == {k: sum(w[0] == k for w in want) for k in range(len(PATTERNS) + 2)}
    disjoint = {(r[0], r[1]): r[2] for r in M.count_by_document(corpus, pats, overlapping=False).collect()}
    assert disjoint == {(k, i): d.count(p) for k, p in enumerate([*PATTERNS, b"a"]) for i, d in enumerate(CORPORA["tree"]) if p in d}


@pytest.mark.parametrize("name", ["tree", "periodic", "mixed", "regex", "one empty"])
def test_searches_over_runs(spark, name):
    docs = CORPORA[name]
    corpus, pats = table(spark, docs), wanted(spark)
    full = X.suffixes(corpus)
    runs = X.run_lengths(full)
    want = X.intervals(full, corpus, pats)
    assert sorted(map(tuple, X.backward_search(runs, pats).collect())) == sorted(map(tuple, want.collect()))
    for step in (1, 3, 1000):
        walked = {(r["doc_id"], r["sa_row"]): (r["off"], r["steps"]) for r in X.walk(runs, full.filter(F.col("sa_row") % step == 0), full).collect()}
        rows = full.collect()
        assert {k: v[0] for k, v in walked.items()} == {(r["doc_id"], r["sa_row"]): r["off"] for r in rows}
        kept = {(r["doc_id"], r["off"]) for r in rows if r["sa_row"] % step == 0}
        for (doc, _), (off, steps) in walked.items():
            assert steps == next(k for k in range(off + 1) if (doc, off - k) in kept or k == off)


def test_stable_pattern(tmp_path):
    (tmp_path / "p").write_bytes(b"ab\0")
    assert S.stable_pattern(str(tmp_path / "p")) == b"ab\0"
    (tmp_path / "e").write_bytes(b"")
    with pytest.raises(ValueError, match="EMPTY_QUERY"):
        S.stable_pattern(str(tmp_path / "e"))


@pytest.mark.parametrize("step", [1, 3, 4, 1000])
def test_packed_documents(spark, monkeypatch, step):
    """Places from one stored row a document, with walks that begin anew after every few rows or not."""
    docs = [d for own in CORPORA.values() for d in own] + [b"a" * 700, b"banana" * 200, bytes(range(256)) * 3]
    want = scan(docs)
    for rows, size in ((1, 1), (X.BATCH_ROWS, X.BATCH_BYTES)):
        monkeypatch.setattr(X, "BATCH_ROWS", rows)
        monkeypatch.setattr(X, "BATCH_BYTES", size)
        index = X.packed(table(spark, docs), step)
        assert index.count() == len(docs)
        assert sorted(map(tuple, X.locate_packed(index, wanted(spark), step).collect())) == want


@pytest.mark.parametrize("name", ["p12_locate_from_rows", "p14_locate_run_lengths"])
def test_located_rows_take_less_disk_than_budgeted(spark, tmp_path, name):
    """The stored index stays below four times its input, and its rows are not shuffled."""
    d = "/root/testdata/sf0.001"
    before = spark.conf.get("spanquarry.shared.dir", None)
    spark.conf.set("spanquarry.shared.dir", f"file://{tmp_path}")
    try:
        found = registry.queries()[name](spark, d)
    finally:
        spark.conf.unset("spanquarry.shared.dir")
        if before:
            spark.conf.set("spanquarry.shared.dir", before)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 4 * os.path.getsize(f"{d}/documents.parquet")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.exceptAll(M.locate(T.documents(spark, d), T.short_patterns(spark))).isEmpty()


def test_digests_of_a_directory_hold_no_large_file(spark, tmp_path, monkeypatch):
    """Above a size, bytes are read in parts: ends of lines, a byte order mark, odd names, names of packed files."""
    root, noise = tmp_path / "in", random.Random(5).randbytes(300_000)
    files = {"a": b"", "b": b"x\n", "s/c d+e %41é": noise, "d": b"\n" * 5000, "e": b"\xef\xbb\xbf" + noise + b"\n", "f": b"\xef\xbb\xbf" + noise, "g": noise + b"\r\n", "h.gz": gzip.compress(noise), "i.gz": noise, "_h": noise, "j": b"z" * 200_000, "k": b"\xef\xbb\xbf"}
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    want = [(k, n, len(files[n]), hashlib.sha256(files[n]).hexdigest()) for k, n in enumerate(sorted(files, key=str.encode))]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for most, part in ((100, "30000"), (1 << 20, before)):
            monkeypatch.setattr(S, "MOST_WHOLE", most)
            spark.conf.set(key, part)
            for top in (str(root), f"file://{root}"):
                got = S.directory_digests(spark, top).select("doc_id", F.decode("path", "UTF-8"), "byte_length", "sha256")
                assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set(key, before)
