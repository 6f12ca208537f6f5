"""Containers, retrieval outcomes, chains, proofs, bundles, the facade, the stream and the registry."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanquarry.operators import anchors as A
from spanquarry.operators import gaps as J
from spanquarry.operators import identity as V
from spanquarry.operators import index as X
from spanquarry.operators import match as M
from spanquarry.operators import profile as K
from spanquarry.operators import rerank as R
from spanquarry.plans import registry
from spanquarry.plans.engine import Collection
from spanquarry.sources import containers as C
from spanquarry.streaming import query_stream
from tests.test_matching import table, wanted


def test_containers(spark, tmp_path):
    parts = [b"one" * 100, b"", bytes(range(256))]
    blob = C.pack_chunks(parts)
    assert C.unpack_chunks(blob) == parts
    for bad in (b"X" + blob[1:], blob + b"!"):
        with pytest.raises(ValueError):
            C.unpack_chunks(bad)
    (tmp_path / "c.bin").write_bytes(blob)
    assert [bytes(r["raw"]) for r in C.read_containers(spark, str(tmp_path)).orderBy("chunk_id").collect()] == parts
    assert C.deterministic_tar({"b": b"1", "a": b"2"}) == C.deterministic_tar({"a": b"2", "b": b"1"})


def test_outcomes(spark):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(0, 256, 4000, dtype=np.uint8))
    common = bytes(rng.integers(0, 256, 200, dtype=np.uint8))
    docs = [text, common + b"x", b"y" + common]
    mutated = bytearray(text[:400])
    mutated[70] ^= 1
    mutated[200] ^= 1
    queries = {
        b"": "EMPTY_QUERY", b"short": "TOO_SHORT", b"A" * 128: "NON_SELECTIVE", b"AT" * 64: "NON_SELECTIVE", bytes(rng.integers(0, 256, 256, dtype=np.uint8)): "NO_HIT",
        text: "EXACT_UNIQUE", common: "EXACT_MULTI", bytes(mutated): "INVALID_PARTIAL_HIT", b"A" * (1 << 20): "NON_SELECTIVE", b"A" * ((1 << 20) + 1): "QUERY_TOO_LONG",
    }
    rows = spark.createDataFrame([(k, bytes(q)) for k, q in enumerate(queries)], "query_id bigint, content binary")
    got = {r["query_id"]: r["outcome"] for r in A.retrieve(rows, table(spark, docs)).collect()}
    assert [got[k] for k in range(len(queries))] == list(queries.values())


def chains_by_hand(lists, distance, tolerance):
    best = []
    for size in range(len(lists), 0, -1):
        best = [c for c in itertools.product(*lists[:size]) if all(b > a and abs(b - a - distance) <= tolerance for a, b in itertools.pairwise(c))]
        if best:
            break
    return best


def test_chains_against_all_combinations(spark):
    rng = np.random.default_rng(2)
    lists = [sorted({int(x) for x in rng.integers(0, 300, 12)}) for _ in range(4)]
    hits = spark.createDataFrame([(0, f, 7, o) for f, own in enumerate(lists) for o in own], "query_id bigint, frag int, chunk bigint, doc_offset bigint")
    got = J.chains(hits, 4, distance=60, tolerance=15, least=2).first()
    best = [c for c in chains_by_hand(lists, 60, 15) if len(c) >= 2]
    assert got["chains"] == len(best) and got["best_length"] == max((len(c) for c in best), default=0)
    if best:
        assert got["gap_error"] == min(sum(abs(b - a - 60) for a, b in itertools.pairwise(c)) for c in best)
    greedy = J.chains(hits, 4, greedy=True, distance=60, tolerance=15, least=2).first()
    assert greedy["best_length"] <= got["best_length"]


def test_repetitive_chains_need_no_list_of_them(spark):
    """Every byte a place: far more chains than could be kept."""
    hits = spark.createDataFrame([(0, f, 7, o) for f in range(8) for o in range(300)], "query_id bigint, frag int, chunk bigint, doc_offset bigint")
    got = J.chains(hits, 8, distance=20, tolerance=6).first()
    counts = dict.fromkeys(range(300), 1)
    for _ in range(7):
        counts = {q: sum(counts.get(q - g, 0) for g in range(14, 27)) for q in range(300)}
    assert (got["chains"], got["best_length"], got["gap_error"], got["gap_mad"]) == (sum(counts.values()), 8, 0, 0.0)


def test_service(spark):
    from urllib.error import HTTPError

    from spanquarry.plans.service import asked

    c = Collection(spark, table(spark, [b"aaaa", b"", b"ba"]))
    assert asked(c, "/query", {"text": "aa"})["match_count"] == 3
    assert [r["status"] for r in asked(c, "/query_batch", {"queries": [{"hex": "61"}, {"hex": "6"}]})["results"]] == ["OK", "ODD_LENGTH"]
    assert asked(c, "/locate", {"queries": [{"hex": "6161"}], "most": 2}) == {"occurrences": [[0, 0, 0], [0, 0, 1]]}
    assert asked(c, "/histogram", {"queries": [{"hex": "61"}]})["chunks"] == [[0, 4], [2 << 20, 1]]
    for path, given, status, seconds in (("/none", {}, 404, 5), ("/query", {}, 400, 5), ("/query", {"text": "a"}, 504, 0.001)):
        with pytest.raises(HTTPError) as e:
            asked(c, path, given, seconds)
        assert e.value.code == status


def test_identities_of_large_collections(spark):
    docs = table(spark, [bytes([k % 7]) * k for k in range(50)])
    found = {V.large_corpus_identity(d, 4).first()["identity"] for d in (docs, docs.repartition(5), docs.filter("doc_id <> 9"))}
    assert len(found) == 2
    assert V.corpus_identity(docs.limit(0)).first()["identity"]


def test_spans_blocks_and_runs(spark):
    raw, query = b"xx" + b"abcdefgh" * 12 + b"yy", b"abcdefgh" * 12 + b"zzzz"
    candidates = spark.createDataFrame([(0, 1)], "query_id bigint, chunk bigint")
    chunks = spark.createDataFrame([(1, raw)], "chunk bigint, raw binary")
    queries = spark.createDataFrame([(0, query)], "query_id bigint, content binary")
    assert R.phrase_spans(candidates, chunks, queries, [0], 96).first()["full_hits"] == 1
    assert R.longest_runs(candidates, chunks, queries).first()["best"] == 96
    assert R.by_blocks(candidates, chunks, queries).first()["largest"] == 96
    assert R.union_length([(0, 5), (3, 8), (10, 12), (11, 11)]) == 10
    assert R.compressed_delta(candidates, chunks, queries).first()["delta"] < len(query)


def test_merkle_proofs(spark):
    for n in (1, 2, 3, 5, 8, 9):
        parts = [bytes([k]) * 40 for k in range(n)]
        root = V.merkle_roots(V.leaves(table(spark, [b"".join(parts)]), 40)).first()["root"]
        digests = [hashlib.sha256(V.LEAF + p).digest() for p in parts]
        for i, p in enumerate(parts):
            path = V.membership_path(digests, i)
            assert V.check_membership(p, path, root) and not V.check_membership(p + b"!", path, root)


def test_absence_witnesses_are_neighbours(spark):
    docs = table(spark, [b"banana", b"", b"zz"])
    rows = V.absence_witnesses(X.suffixes(docs), docs, wanted(spark, [b"an", b"nb", b"zzz"])).collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == {(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)}
    assert all(r["row_above"] is None or r["row_above"] == r["row_below"] + 1 for r in rows)


def test_percentiles(spark):
    rows = spark.createDataFrame([([5.0, 1.0, 3.0, 2.0],), ([1.0],), ([],)], "v array<double>")
    got = rows.select(K.nearest_rank(F.col("v"), 0.5).alias("a"), K.floor_rank(F.col("v"), 0.5).alias("b"), J.median_deviation(F.col("v")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(3.0, 2.0, 1.0), (1.0, 1.0, 0.0), (None, None, None)]


def test_collection(spark, tmp_path):
    c = Collection(spark, table(spark, [b"aaaa", b"", b"ba"]))
    assert c.info() == {"documents": 3, "bytes": 6}
    assert c.document(0)["byte_length"] == 4 and c.document(9) is None
    hexes = ["6161", "", "6", "6162"]
    assert c.lines(hexes, 2) == ["OK\t3\t2\t1\t0:0,0:1", "ERR\tEMPTY_QUERY", "ERR\tODD_LENGTH", "OK\t0\t0\t0\t"]
    assert '"match_count":3' in c.json(hexes)
    assert set(c.build(str(tmp_path / "i"))) == {"suffixes", "c", "occ", "runs"}
    done = c.run(["6161"], str(tmp_path / "w"))
    assert done["rows"] == 3 and done["complete"]


def test_verified_query_refuses_a_changed_corpus(spark):
    from spanquarry.sources.corpus import manifest

    docs, pats = table(spark, [b"aaaa", b"b"]), wanted(spark, [b"a"])
    records = manifest(docs)
    assert M.verified_count(docs, records, pats).first()["match_count"] == 4
    with pytest.raises(Exception, match="MANIFEST_MISMATCH"):
        M.verified_count(docs.withColumn("content", F.lit(bytearray(b"a"))), records, pats).collect()


def test_query_stream(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.txt").write_text("aa\n\n  ana \nmissing\n")
    docs = table(spark, [b"aaaa", b"banana"])
    stream = query_stream.read_queries(spark, str(tmp_path / "q"))
    query_stream.write_answers(stream, docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["hex"]: r["match_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {b"aa".hex(): 3, b"ana".hex(): 2, b"missing".hex(): 0}
    run = query_stream.answers(stream, docs).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["hex"], r["doc_id"], r["match_count"]) for r in spark.table("answers").collect()} == {(b"aa".hex(), 0, 3), (b"ana".hex(), 1, 2)}


def test_registry_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


def test_sharded_totals(spark):
    docs, pats = table(spark, [b"aa", b"a", b""]), wanted(spark, [b"a"])
    got = {r["shard_id"]: r["match_count"] for r in M.sharded(docs, F.col("doc_id") % 2, pats).collect()}
    assert got == {0: 2, 1: 1, None: 3}


def test_suffix_order_against_sorted_suffixes():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"aa", b"\x00\x00", b"\xff\x00", b"abababab" * 9, b"a" * 300, bytes(range(256)), b"abc" * 40 + b"abd" + b"abc" * 40]
    texts += [bytes(rng.integers(0, kinds, size).astype(np.uint8)) for kinds in (2, 3, 256) for size in (7, 8, 50, 999)]
    for text in texts:
        assert X.suffix_order(text).tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])


def test_violations_are_named_row_by_row(spark):
    corpus = table(spark, [b"banana", b"", b"aaaa"])
    good = X.suffixes_long(corpus)
    swapped = F.when(F.col("sa_row") == 2, 3).when(F.col("sa_row") == 3, 2).otherwise(F.col("sa_row")).cast("bigint")
    bad = good.withColumn("sa_row", F.when(F.col("doc_id") == 0, swapped).otherwise(F.col("sa_row")))
    bad = bad.withColumn("off", F.when((F.col("doc_id") == 2) & (F.col("sa_row") == 4), 9).otherwise(F.col("off")).cast("bigint"))
    assert {tuple(r) for r in X.order_violations(bad, corpus).collect()} == {(0, 3), (2, 4)}
    nulls = good.withColumn("bwt", F.when(F.col("sa_row") > 0, F.col("bwt")))
    assert {tuple(r) for r in X.bwt_violations(nulls, corpus).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_distance_profile_by_hand(spark):
    text = b"0123456789abcdef" * 12 + b"x"
    rows = {(r["doc_id"], r["k"]): r for r in K.full_distance_profile(table(spark, [text, b"short", b""]), stride=16).collect()}
    assert len(rows) == 15
    one, none = rows[0, 8], rows[1, 32]
    assert (one["sampled"], one["unique"], one["pairs"], one["p50"], one["useful_p99"], one["near64k"], one["useful_far_to_near"]) == (12, 1, 11, 16, 16, 1.0, 0.0)
    assert (one["repeat_key_share"], one["repeated_share"]) == (1.0, 1.0)
    assert (none["sampled"], none["unique"], none["pairs"], none["p50"], none["useful_p90"], none["far4m"]) == (1, 0, 0, None, None, 0.0)


def test_groups_held_out_are_those_of_the_data(spark, monkeypatch):
    rows = [(k, "ab"[k % 2], k % 3 // 2, float(k % 7)) for k in range(40)] + [(99, None, 1, 3.0)]
    data = spark.createDataFrame(rows, "id bigint, g string, y int, v double")
    got = {r["held"]: r for r in K.leave_one_group_out(data, "y", ["v"], "g").collect()}
    for held in "ab":
        rules = []
        for way, t in itertools.product(("ge", "le"), sorted({v for _, g, _, v in rows if g not in (held, None)})):
            said = {True: lambda v, t=t: int(v >= t), False: lambda v, t=t: int(v <= t)}[way == "ge"]
            rules.append((-sum(said(v) == y for _, g, y, v in rows if g not in (held, None)), way, t, sum(said(v) == y for _, g, y, v in rows if g == held)))
        best = min(rules)
        assert (got[held]["direction"], got[held]["threshold"], got[held]["correct"], got[held]["total"]) == (best[1], best[2], best[3], 20)
    monkeypatch.setattr(K, "MOST_GROUPS", 1)
    with pytest.raises(ValueError, match="TOO_MANY_GROUPS"):
        K.leave_one_group_out(data, "y", ["v"], "g")


def test_bundle_of_repeated_names(spark):
    """Names that stand for several files: one row a file, none for equal ones in any order."""
    kind = "name string, content binary"
    old = [("a", b"1"), ("a", b"2"), ("a", b"2"), ("a", b"3"), ("b", b"1"), ("c", b"1"), ("c", b"1"), (None, b"5"), (None, b"6")]
    new = [("a", b"3"), ("a", b"2!"), ("a", b"2"), ("c", b"1"), ("c", b"1"), ("c", b"1"), ("d", b""), (None, b"6"), (None, b"5!")]
    got = V.check_bundle(spark.createDataFrame(new, kind), V.inventory(spark.createDataFrame(old, kind)))
    want = [("a", "DIGEST"), ("a", "MISSING"), ("b", "MISSING"), ("c", "UNEXPECTED"), ("d", "UNEXPECTED"), (None, "DIGEST")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("tokens", [1, 3])
def test_max_sim_against_all_pairs(spark, tokens):
    """Candidates of one token need no pair of tokens; those of several are met with each."""
    rng = np.random.default_rng(4)
    asked = [(q, rng.normal(size=5)) for q in (0, 0, 0, 1, 1)] + [(1, np.zeros(5))]
    given = [(c, rng.normal(size=5)) for c in range(7) for _ in range(1 + c % tokens)] + [(8, np.zeros(5))]
    rows = [spark.createDataFrame([(k, v.tolist()) for k, v in r], f"{n} int, vec array<float>") for r, n in ((asked, "q"), (given, "c"))]
    odd = spark.createDataFrame([(9, None), (10, [1.0])], "c int, vec array<float>")
    found = R.max_sim(rows[0], rows[1].unionByName(odd))
    assert ("token" in found._jdf.queryExecution().executedPlan().toString()) == (tokens > 1)
    got = {(r["q"], r["c"]): r["score"] for r in found.collect()}

    def unit(v):
        v = v.astype(np.float32).astype(float)
        return v / (np.linalg.norm(v) or 1)

    want = {(q, c): sum(max(unit(x) @ unit(y) for k, y in given if k == c) for k, x in asked if k == q) for q in (0, 1) for c in {c for c, _ in given}}
    assert {k for k, v in got.items() if v is None} == {(q, c) for q in (0, 1) for c in (9, 10)}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want, abs=1e-6)
