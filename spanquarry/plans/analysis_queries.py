"""Queries of re-ranking, fusion, profiles, learning to rank, identities, evidence and the facade."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanquarry.functions import binary as B
from spanquarry.operators import fusion as U
from spanquarry.operators import gaps as J
from spanquarry.operators import identity as V
from spanquarry.operators import index as X
from spanquarry.operators import ltr as L
from spanquarry.operators import match as M
from spanquarry.operators import profile as K
from spanquarry.operators import rerank as R
from spanquarry.operators import shortlist as C
from spanquarry.operators import signatures as S
from spanquarry.plans import retrieval_queries as Q
from spanquarry.plans import tables as T
from spanquarry.plans.engine import Collection
from spanquarry.plans.registry import query
from spanquarry.plans.service import asked
from spanquarry.sources import corpus
from spanquarry.sources.shared import Scratch, saved


def _candidates(spark, d):
    """The overlap shortlist: query_id, chunk, overlap, weighted, rank."""
    return C.overlap(Q.fragments(spark, d), S.dense(Q.chunks(spark, d)), Q.TOP)


CAND = f"WITH {Q.DENSE}, {Q.FR}, {Q.sigs(8, 's')}, ov AS (SELECT query_id, chunk, count(*) AS overlap, sum(cnt)::BIGINT AS weighted FROM (SELECT DISTINCT query_id, sig FROM s) JOIN dense USING (sig) GROUP BY ALL), cand AS ({Q.top('ov', 'overlap, weighted', 'overlap DESC, weighted DESC')}), "
COUNTS = CAND + "fc AS (SELECT query_id, chunk, frag, ((len(raw) - len(replace(raw, fragment, ''))) // len(fragment))::BIGINT AS c FROM cand JOIN fr USING (query_id) JOIN ch USING (chunk)), cn AS (SELECT query_id, chunk, count(*) FILTER (WHERE c > 0) AS present, sum(c)::BIGINT AS total, coalesce(min(c) FILTER (WHERE c > 0), 0) AS least FROM fc GROUP BY ALL)"


def ranked(source: str, columns: str, order: str) -> str:
    return f" SELECT query_id, chunk, {columns}, row_number() OVER (PARTITION BY query_id ORDER BY {order}, chunk) AS rank FROM {source}"


@query(COUNTS + ranked("cn", "present, total", "present DESC, total DESC"))
def r1_exact_rerank(spark, d):
    return R.exact(_candidates(spark, d), Q.chunks(spark, d), Q.fragments(spark, d))


@query(COUNTS + ", cw AS (SELECT * FROM cn JOIN (SELECT query_id, chunk, weighted, overlap FROM cand) USING (query_id, chunk))" + ranked("cw", "present, total, least, weighted, overlap", "present DESC, least DESC, total DESC, weighted DESC, overlap DESC"))
def r2_exact_overlapping_rerank(spark, d):
    return R.exact_overlapping(_candidates(spark, d), Q.chunks(spark, d), Q.fragments(spark, d))


def _counts(spark, d):
    return R.fragment_counts(_candidates(spark, d), Q.chunks(spark, d), Q.fragments(spark, d), False)


REST = COUNTS[COUNTS.index("WITH ") + 5 :].replace(Q.FR + ", ", "", 1)


@query(Q.CHAIN + Q.BEST_CHAIN + ", " + REST + ", hs AS (SELECT query_id, chunk, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS k FROM (SELECT query_id, chunk, count(*)::DOUBLE AS score FROM fh GROUP BY ALL)) WHERE k <= 16), ly AS (SELECT query_id, chunk, coalesce(best_length, 0) AS best_length, CASE WHEN best_length > 0 THEN gap_error ELSE 1000000000 END AS gap_error, CASE WHEN best_length > 0 THEN gap_mad ELSE 1e9::DOUBLE END AS gap_mad, present, total, coalesce(chains, 0) AS chains, coalesce(score, 0.0::DOUBLE) AS score FROM cn LEFT JOIN cn0 USING (query_id, chunk) LEFT JOIN hs USING (query_id, chunk))" + ranked("ly", "best_length, gap_error, gap_mad, present, total, chains, score", "best_length DESC, gap_error, gap_mad, present DESC, total DESC, chains, score DESC"))
def r3_layout_rerank(spark, d):
    chains = J.chains(Q.fragment_hits(spark, d), 5, distance=32, tolerance=4)
    scores = C.histogram(Q.fragment_hits(spark, d), F.lit(1.0), Q.TOP)
    return R.layout(chains, _counts(spark, d), scores)


@query(Q.GREEDY + Q.BEST_CHAIN + ", " + REST + ", gl AS (SELECT query_id, chunk, coalesce(best_length, 0) AS best_length, greatest(coalesce(best_length, 0) - 1, 0) AS pairs, coalesce(skips, 0) AS skips, coalesce(gap_error, 0) AS gap_error, present, total FROM cn LEFT JOIN cn0 USING (query_id, chunk))" + ranked("gl", "best_length, pairs, skips, gap_error, present, total", "best_length DESC, pairs DESC, skips DESC, gap_error, present DESC, total DESC"))
def r4_gap_layout_rerank(spark, d):
    return R.gap_layout(J.chains(Q.fragment_hits(spark, d), 5, greedy=True, distance=32, tolerance=4), _counts(spark, d))


@query(CAND + f"{Q.Q}, g AS (SELECT query_id, start + 24 AS e, lead(start) OVER (PARTITION BY query_id ORDER BY frag) AS nx FROM fr), p AS (SELECT query_id, unnest([substr(qx, floor((e+nx)/2.0 - 4)::BIGINT*2+1, 16), substr(qx, (e-4)*2+1, 16)]) AS probe FROM g JOIN q USING (query_id) WHERE nx IS NOT NULL), h AS (SELECT query_id, chunk, count(*) FILTER (WHERE contains(raw, probe)) AS probe_hits FROM cand JOIN ch USING (chunk) JOIN p USING (query_id) WHERE len(probe) = 16 GROUP BY ALL)" + ranked("h", "probe_hits", "probe_hits DESC"))
def r5_probe_rerank(spark, d):
    return R.by_probes(_candidates(spark, d), Q.chunks(spark, d), R.probes(Q.fragments(spark, d), Q._queries(spark, d), 8))


@query()
def r6_phrase_span_rerank(spark, d):
    return R.phrase_spans(_candidates(spark, d), Q.chunks(spark, d), Q._queries(spark, d), [0, 64], 96)


@query()
def r7_block_rerank(spark, d):
    return R.by_blocks(_candidates(spark, d), Q.chunks(spark, d), Q._queries(spark, d))


@query("WITH x AS (SELECT o_custkey, o_orderkey AS a, o_orderkey + 500 AS b FROM orders), i AS (SELECT o_custkey, a, b, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x) SELECT o_custkey, sum(greatest(0, b - greatest(a, coalesce(r, a))))::BIGINT AS covered FROM i GROUP BY ALL")
def r8_interval_union(spark, d):
    t = T.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 500).alias("b"))
    return R.intervals_union(t, ["o_custkey"])


@query(CAND + f"{Q.Q}, bb AS (SELECT query_id, chunk, regexp_extract_all(qx, '..') AS qb, list_distinct(regexp_extract_all(raw, '..')) AS cb FROM cand JOIN ch USING (chunk) JOIN q USING (query_id)) SELECT query_id, chunk, round(len(list_filter(qb, lambda x: list_contains(cb, x)))/greatest(1, len(qb))::DOUBLE, 6) AS score FROM bb")
def r9_byte_bag(spark, d):
    rows = _candidates(spark, d).join(Q.chunks(spark, d), "chunk").join(Q._queries(spark, d), "query_id")
    return rows.select("query_id", "chunk", F.round(R.byte_bag(F.col("content"), F.col("raw")), 6).alias("score"))


@query()
def r10_delta_size_rerank(spark, d):
    return R.compressed_delta(_candidates(spark, d), Q.chunks(spark, d), Q._queries(spark, d))


@query("WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE*y::DOUBLE)))) AS v FROM embeddings), a AS (SELECT vec_id, v FROM u WHERE label = 0), m AS (SELECT a.vec_id AS t, u.vec_id AS c, list_sum(list_transform(range(1, len(a.v)+1), lambda i: a.v[i]*u.v[i])) AS s FROM a, u) SELECT 0 AS q, c, round(sum(s), 6) AS score FROM m GROUP BY ALL")
def r11_max_sim(spark, d):
    """The vectors of label 0 as one query's tokens, every vector as a candidate of one token."""
    e = T.table(spark, d, "embeddings")
    return R.max_sim(e.filter("label = 0").select(F.lit(0).alias("q"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("c"), F.col("embedding").alias("vec")))


@query()
def r12_longest_runs(spark, d):
    return R.longest_runs(_candidates(spark, d), Q.chunks(spark, d), Q._queries(spark, d))


TWO = Q.EV + Q.ONLY + f", td AS ({Q.top('wd', 'score', 'score DESC')}), tr AS ({Q.top('wr', 'score', 'score DESC')}), vw AS (SELECT query_id, chunk, rank, 0 AS v FROM td UNION ALL SELECT query_id, chunk, rank, 1 FROM tr), "


def _views(spark, d):
    found = Q._evidence(spark, d)
    return [C.dense_only(found, Q.TOP), C.rare_only(found, Q.TOP)]


@query(TWO + "fs AS (SELECT query_id, chunk, min(v*1000 + rank) AS a FROM vw GROUP BY ALL) SELECT query_id, chunk, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, chunk) AS rank FROM fs) WHERE rank <= 16")
def u1_ordered_union(spark, d):
    return U.ordered_union(_views(spark, d), Q.TOP)


@query(TWO + "vt AS (SELECT query_id, chunk, sum(17 - rank)::BIGINT AS votes FROM vw GROUP BY ALL)" + Q.top("vt", "votes", "votes DESC"))
def u2_borda(spark, d):
    return U.borda(_views(spark, d), Q.TOP)


HYB = Q.EV + f", hl AS ({Q.top('hy', 'rare_present, dense_present, rare_score, dense_total, rare_matches', 'rare_present DESC, dense_present DESC, rare_score DESC, dense_total DESC, rare_matches DESC')}), "
FH = Q.FHIT[Q.FHIT.index("fh AS"):]
PR = Q.PAIRS[Q.PAIRS.index("nf AS"):]


@query(HYB + Q.D + ", " + FH + ", " + PR + ", su AS (SELECT query_id, chunk, count(*) AS gap_support, sum(hits)::BIGINT AS raw_support FROM pr GROUP BY ALL), cf AS (SELECT query_id, chunk, coalesce(gap_support,0) AS gap_support, coalesce(raw_support,0) AS raw_support, coalesce(rare_present,0) AS rare_present, coalesce(dense_present,0) AS dense_present, coalesce(rare_score,0) AS rare_score, coalesce(dense_total,0) AS dense_total, coalesce(rare_matches,0) AS rare_matches FROM hl FULL JOIN su USING (query_id, chunk))" + " SELECT query_id, chunk, gap_support, raw_support, rare_present, dense_present, rare_score, dense_total, rare_matches, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap_support DESC, raw_support DESC, rare_present DESC, dense_present DESC, rare_score DESC, dense_total DESC, rare_matches DESC, chunk) AS rank FROM cf) WHERE rank <= 32")
def u3_candidate_fusion(spark, d):
    hybrid = C.hybrid_lexicographic(Q._evidence(spark, d), Q.TOP)
    return U.candidate_fusion(hybrid, J.support(J.pairs(Q.fragment_hits(spark, d))), 32)


@query(Q.PAIRS + ", t AS (SELECT query_id, j - i AS template, chunk, count(*) AS gs, sum(hits) AS rs FROM pr GROUP BY ALL), f AS (SELECT query_id, chunk, count(DISTINCT template) AS votes, sum(gs)::BIGINT AS gaps, sum(rs)::BIGINT AS hits FROM t GROUP BY ALL)" + Q.top("f", "votes, gaps, hits", "votes DESC, gaps DESC, hits DESC"))
def u4_template_fusion(spark, d):
    pairs = J.pairs(Q.fragment_hits(spark, d)).withColumn("template", F.col("j") - F.col("i"))
    supports = pairs.groupBy("query_id", "template", "chunk").agg(F.count(F.lit(1)).alias("gap_support"), F.sum("hits").alias("raw_support"))
    return U.template_fusion(supports, Q.TOP)


RANKS = "WITH r AS (SELECT template, query_id, CASE WHEN rank <= 20 THEN rank END AS rank FROM (SELECT doc_id % 4 AS template, n_chars AS query_id, min(doc_id % 29 + 1) AS rank FROM documents GROUP BY ALL)), "
METRICS = "round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 4 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit4, round(avg(CASE WHEN rank <= 8 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit8, round(avg(CASE WHEN rank <= 16 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit16, round(avg(coalesce(1.0::DOUBLE/rank, 0.0)), 6) AS mrr, round(avg(rank), 6) AS mean_rank"


def _ranks(spark, d):
    t = T.table(spark, d, "documents").groupBy((F.col("doc_id") % 4).alias("template"), F.col("n_chars").alias("query_id")).agg(F.min(F.col("doc_id") % 29 + 1).alias("rank"))
    return t.withColumn("rank", F.when(F.col("rank") <= 20, F.col("rank")))


@query(RANKS + f"n AS (SELECT DISTINCT template AS t FROM r), c AS (SELECT [a.t, b.t] AS templates FROM n a, n b WHERE a.t < b.t UNION ALL SELECT [a.t, b.t, c.t] FROM n a, n b, n c WHERE a.t < b.t AND b.t < c.t), e AS (SELECT templates, unnest(templates) AS template FROM c), b AS (SELECT templates, query_id, min(rank) AS rank FROM e JOIN r USING (template) GROUP BY ALL) SELECT templates, {METRICS} FROM b GROUP BY templates")
def u5_template_combinations(spark, d):
    """All pairs and triples."""
    ranks = _ranks(spark, d)
    return U.combinations(ranks, 2).unionByName(U.combinations(ranks, 3))


@query(Q.ANCHOR + "SELECT DISTINCT query_id, chunk FROM hit WHERE start = 0 INTERSECT SELECT DISTINCT query_id, chunk FROM hit WHERE start = 64")
def u6_chunk_set_intersection(spark, d):
    hits = Q._hits(spark, d)[1]
    return hits.filter("start = 0").select("query_id", "chunk").intersect(hits.filter("start = 64").select("query_id", "chunk"))


BYTES = "WITH b AS (SELECT doc_id, ('0x' || x)::INT AS byte, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM b) "


@query(BYTES + "SELECT doc_id, sum(n)::BIGINT AS bytes, count(*) AS alphabet, coalesce(sum(n) FILTER (WHERE byte = 0), 0)::BIGINT AS nul, coalesce(sum(n) FILTER (WHERE byte = 10), 0)::BIGINT AS newlines, round(coalesce(sum(n) FILTER (WHERE byte IN (9,10,13) OR byte BETWEEN 32 AND 126), 0)/sum(n), 6) AS printable, round(abs(sum(-n/total*log2(n/total))), 6) AS entropy, (list(byte ORDER BY n DESC, byte))[1:16] AS top_bytes FROM t GROUP BY doc_id")
def k1_byte_profile(spark, d):
    return K.byte_profile(T.documents(spark, d))


@query("WITH c AS (SELECT doc_id, x, n, count(*)::DOUBLE AS c FROM (SELECT item_id AS doc_id, strlen(text) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM benchmark) GROUP BY ALL) SELECT doc_id, round(abs(sum(-c/n*log2(c/n))), 6) AS entropy FROM c GROUP BY doc_id")
def k2_entropy(spark, d):
    return T.items(spark, d).select("doc_id", F.round(B.entropy(F.col("content")), 6).alias("entropy"))


@query("WITH d AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS n FROM documents), c AS (SELECT doc_id, hx, unnest(range((n + 65535)//65536))::BIGINT AS k FROM d), b AS (SELECT doc_id, k, x, count(*)::DOUBLE AS m FROM (SELECT doc_id, k, unnest(regexp_extract_all(substr(hx, k*131072+1, 131072), '..')) AS x FROM c) GROUP BY ALL), s AS (SELECT *, sum(m) OVER (PARTITION BY doc_id, k) AS t FROM b), e AS (SELECT doc_id, k, round(abs(sum(-m/t*log2(m/t))), 6) AS e FROM s GROUP BY ALL) SELECT doc_id, count(*) AS chunks, round(avg(e), 6) AS mean, min(e) AS least, max(e) AS most, round(max(e)-min(e), 6) AS range, (list(e ORDER BY k))[1:16] AS first FROM e GROUP BY doc_id")
def k3_chunk_entropy(spark, d):
    return K.chunk_entropy(T.documents(spark, d), 65536)


PG = "WITH ks AS (SELECT doc_id, hx, n, unnest([8, 12, 16, 24, 32]) AS k FROM (SELECT page_id AS doc_id, lower(hex(encode(html))) AS hx, strlen(html)::BIGINT AS n FROM pages)), g AS (SELECT doc_id, k, pos, substr(hx, 2*pos+1, 2*k) AS sig FROM (SELECT doc_id, k, hx, unnest(range(0, n - k + 1, 32))::BIGINT AS pos FROM ks)), f AS (SELECT doc_id, k, sig, count(*) AS f FROM g GROUP BY ALL), dd AS (SELECT doc_id, k, sig, f, lead(pos) OVER (PARTITION BY doc_id, k, sig ORDER BY pos) - pos AS distance FROM g JOIN f USING (doc_id, k, sig) WHERE f >= 2) "


def _pages(spark, d):
    return corpus.from_table(T.table(spark, d, "pages"), "page_id", "html")


@query(PG + "SELECT doc_id, k, coalesce(anchors, 0) AS anchors, coalesce(pairs, 0) AS pairs, median, coalesce(far, 0) AS far, coalesce(near, 0) AS near FROM (SELECT doc_id, k FROM ks) LEFT JOIN (SELECT doc_id, k, count(DISTINCT sig) AS anchors, count(distance) AS pairs, quantile_cont(distance, 0.5) AS median, round(avg(CASE WHEN distance > 921600 THEN 1.0::DOUBLE WHEN distance IS NOT NULL THEN 0.0 END), 6) AS far, round(avg(CASE WHEN distance <= 65536 THEN 1.0::DOUBLE WHEN distance IS NOT NULL THEN 0.0 END), 6) AS near FROM dd WHERE f <= 512 GROUP BY ALL) USING (doc_id, k)")
def k4_repeat_profile(spark, d):
    return K.repeat_profile(_pages(spark, d))


def place_sql(q: float) -> str:
    return f"(list(distance ORDER BY distance))[round_even((count(*)-1)*{q}, 0)::BIGINT+1]"


PAIRED = f"SELECT doc_id, k, count(*) AS pairs, {place_sql(0.5)} AS p50, {place_sql(0.9)} AS p90, {place_sql(0.99)} AS p99, avg((distance > 921600)::INT::DOUBLE) AS far900k, avg((distance > 4194304)::INT::DOUBLE) AS far4m, avg((distance <= 65536)::INT::DOUBLE) AS near64k FROM dd WHERE distance IS NOT NULL"


@query(PG + f", a AS ({PAIRED} GROUP BY ALL), u AS ({PAIRED} AND f <= 512 GROUP BY ALL), kk AS (SELECT doc_id, k, count(*) AS kinds, count(*) FILTER (WHERE f >= 2) AS again, count(*) FILTER (WHERE f BETWEEN 2 AND 512) AS fit, coalesce(sum(f) FILTER (WHERE f >= 2), 0) AS places FROM f GROUP BY ALL) SELECT ks.doc_id, ks.k, greatest(1, (n - ks.k + 32)//32)::BIGINT AS sampled, coalesce(kinds, 0) AS \"unique\", coalesce(again, 0) AS repeated, coalesce(fit, 0) AS useful, round(coalesce(again/kinds, 0), 6) AS repeat_key_share, round(coalesce(fit/kinds, 0), 6) AS useful_key_share, round(coalesce(places, 0)::DOUBLE/greatest(1, (n - ks.k + 32)//32), 6) AS repeated_share, " + ", ".join(f"coalesce({t}.pairs, 0) AS {m}pairs, {t}.p50 AS {m}p50, {t}.p90 AS {m}p90, round(coalesce({t}.far900k, 0), 6) AS {m}far900k, round(coalesce({t}.far4m, 0), 6) AS {m}far4m, round(coalesce({t}.near64k, 0), 6) AS {m}near64k" for t, m in (("a", ""), ("u", "useful_"))) + ", u.p99 AS useful_p99, round(coalesce(u.far900k/greatest(1e-12, u.near64k), 0), 6) AS useful_far_to_near FROM ks LEFT JOIN kk ON kk.doc_id = ks.doc_id AND kk.k = ks.k LEFT JOIN a ON a.doc_id = ks.doc_id AND a.k = ks.k LEFT JOIN u ON u.doc_id = ks.doc_id AND u.k = ks.k")
def k5_distance_profile(spark, d):
    return K.full_distance_profile(_pages(spark, d))


@query("WITH g AS (SELECT page_id AS doc_id, pos, substr(hx, 2*pos+1, 48) AS sig FROM (SELECT page_id, lower(hex(encode(html))) AS hx, unnest(range(0, strlen(html) - 23))::BIGINT AS pos FROM pages)), k AS (SELECT * FROM g WHERE ('0x' || substr(md5(unhex(sig)), 1, 4))::INT % 16 = 0) SELECT doc_id, sig, distance FROM (SELECT doc_id, sig, lead(pos) OVER (PARTITION BY doc_id, sig ORDER BY pos) - pos AS distance FROM k) WHERE distance IS NOT NULL")
def k6_sampled_distances(spark, d):
    return K.sampled_distances(_pages(spark, d), 24, 16).withColumn("sig", F.lower(F.hex("sig")))


from spanquarry.plans.core_queries import RUNS  # noqa: E402


@query(f"WITH {RUNS}, st AS (SELECT doc_id, sum(length)::BIGINT AS n, count(*) AS runs, count(DISTINCT symbol) AS alphabet FROM runs GROUP BY doc_id) SELECT *, round(runs/n::DOUBLE, 6) AS ratio, round(n/runs::DOUBLE, 6) AS mean_run, CASE WHEN runs/n::DOUBLE <= 0.001 THEN 'extremely_repetitive' WHEN runs/n::DOUBLE <= 0.01 THEN 'highly_repetitive' WHEN runs/n::DOUBLE <= 0.05 THEN 'repetitive' WHEN runs/n::DOUBLE <= 0.15 THEN 'moderately_repetitive' ELSE 'not_run_compressible' END AS label FROM st")
def k7_run_statistics(spark, d):
    return K.run_statistics(X.run_lengths(X.suffixes(T.items(spark, d))))


@query(f"WITH {RUNS} SELECT doc_id, sum(1 + CASE WHEN length < 128 THEN 1 WHEN length < 16384 THEN 2 ELSE 3 END)::BIGINT AS varint_bytes, count(*)*8 AS u32_bytes, count(*)*16 AS u64_bytes, max(length) AS most FROM runs GROUP BY doc_id")
def k8_run_sizes(spark, d):
    return K.run_sizes(X.run_lengths(X.suffixes(T.items(spark, d))))


@query("WITH d AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS n FROM documents), c AS (SELECT hx, unnest(range((n + 511)//512))::BIGINT AS k FROM d), h AS (SELECT substr(hx, k*1024+1, 1024) AS b, count(*) AS n FROM c GROUP BY ALL) SELECT sum(n)::BIGINT AS blocks, count(*) AS unique_blocks, (sum(n)-count(*))::BIGINT AS duplicates, round((sum(n)-count(*))/sum(n), 6) AS share FROM h")
def k9_duplicate_blocks(spark, d):
    return K.duplicate_blocks(T.documents(spark, d), 512)


def _prices(spark, d, place):
    t = T.table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("v"))
    return K.values_at(t, ["l_suppkey"], "v", {"p90": place}).select("l_suppkey", "p90")


@query("SELECT l_suppkey, (list(l_extendedprice::DOUBLE ORDER BY l_extendedprice))[round_even((count(*)-1)*0.9, 0)::BIGINT+1] AS p90 FROM lineitem GROUP BY ALL")
def k10_percentile_nearest(spark, d):
    return _prices(spark, d, K.nearest_place(0.9))


@query("SELECT l_suppkey, (list(l_extendedprice::DOUBLE ORDER BY l_extendedprice))[floor((count(*)-1)*0.9)::BIGINT+1] AS p90 FROM lineitem GROUP BY ALL")
def k10b_percentile_floor(spark, d):
    return _prices(spark, d, K.floor_place(0.9))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL")
def k10c_percentile_linear(spark, d):
    return T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.percentile(F.col("l_extendedprice").cast("double"), 0.9), 6).alias("p90"))


def _labelled(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.regexp_count("text", F.lit("\n")).cast("double").alias("lines"), F.col("lang"))
    return docs.join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


LAB = "WITH x AS (SELECT doc_id, quality AS y, n_chars::DOUBLE AS n_chars, (len(text) - len(replace(text, chr(10), '')))::DOUBLE AS lines, lang FROM documents JOIN labels USING (doc_id)), "


def stump_sql(source: str) -> str:
    return f"(SELECT feature, direction, threshold, sum(CASE WHEN (CASE WHEN direction = 'ge' THEN value >= threshold ELSE value <= threshold END)::INT = y THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total FROM (SELECT doc_id, y, lang, 'n_chars' AS feature, n_chars AS value FROM {source} UNION ALL SELECT doc_id, y, lang, 'lines', lines FROM {source}) v JOIN (SELECT DISTINCT 'n_chars' AS feature, n_chars AS threshold FROM {source} UNION SELECT DISTINCT 'lines', lines FROM {source}) t USING (feature), (VALUES ('ge'), ('le')) dr(direction) GROUP BY ALL)"


@query(LAB + f"a AS {stump_sql('x')} SELECT * FROM a")
def k11_stumps(spark, d):
    return K.stumps(_labelled(spark, d), "doc_id", "quality", ["n_chars", "lines"])


RIGHT = "sum(((CASE WHEN direction = 'ge' THEN value >= threshold ELSE value <= threshold END)::INT = y)::INT)::BIGINT AS correct"


@query(LAB + f"g AS (SELECT DISTINCT lang AS held FROM x WHERE lang IS NOT NULL), v AS (SELECT y, lang, 'n_chars' AS feature, n_chars AS value FROM x UNION ALL SELECT y, lang, 'lines', lines FROM x), t AS (SELECT DISTINCT held, feature, value AS threshold FROM v JOIN g ON lang <> held), s AS (SELECT held, feature, direction, threshold, {RIGHT} FROM t JOIN v USING (feature), (VALUES ('ge'), ('le')) dr(direction) WHERE lang <> held GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY correct DESC, feature, direction, threshold) AS r FROM s) SELECT held, feature, direction, threshold, {RIGHT}, count(*) AS total FROM (SELECT held, feature, direction, threshold FROM b WHERE r = 1) JOIN v USING (feature) WHERE lang = held GROUP BY ALL")
def k12_leave_one_out(spark, d):
    return K.leave_one_group_out(_labelled(spark, d), "quality", ["n_chars", "lines"], "lang")


@query("WITH m AS (SELECT o_orderkey, floor(o_totalprice::DOUBLE*200/1048576)::BIGINT AS mib FROM orders) SELECT o_orderkey, CASE WHEN mib >= 5 THEN least(16, mib//4) END AS version_mib, CASE WHEN mib >= 5 THEN greatest(1, least(16, mib//4)//8) END AS overlap_shift_mib FROM m")
def k13_parameters(spark, d):
    p = K.parameters(F.col("o_totalprice").cast("double") * 200)
    return T.table(spark, d, "orders").select("o_orderkey", p["version_mib"].alias("version_mib"), p["overlap_shift_mib"].alias("overlap_shift_mib"))


@query(RANKS + f"z AS (SELECT 1) SELECT template, {METRICS} FROM r GROUP BY template")
def k14_retrieval_metrics(spark, d):
    return U.metrics(_ranks(spark, d), ["template"])


@query("SELECT l_returnflag AS name, (list(v ORDER BY v))[floor((count(*)-1)*0.5)::BIGINT+1] AS p50, (list(v ORDER BY v))[floor((count(*)-1)*0.95)::BIGINT+1] AS p95, (list(v ORDER BY v))[floor((count(*)-1)*0.99)::BIGINT+1] AS p99, CASE WHEN max(v)/min(v) < 1.5 THEN 'LAW_CONFIRMED' WHEN max(v)/min(v) < 2 THEN 'LIKELY_STABLE' ELSE 'UNSTABLE_INVESTIGATE' END AS verdict FROM (SELECT l_returnflag, l_quantity::DOUBLE + 30 AS v FROM lineitem) GROUP BY ALL")
def k15_repeatability(spark, d):
    return K.repeatability(T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), (F.col("l_quantity").cast("double") + 30).alias("value")))


def _features(spark, d):
    found = Q._evidence(spark, d)
    parts = {"hybrid": C.hybrid_lexicographic(found, Q.TOP), "overlap": _candidates(spark, d), "support": J.support(J.pairs(Q.fragment_hits(spark, d)))}
    truth = M.locate(T.documents(spark, d), Q._queries(spark, d).select("query_id", F.col("content").alias("pattern")))
    return L.features(parts, truth.select("query_id", (F.col("doc_id") * (1 << 20) + F.floor(F.col("doc_offset") / 16384)).alias("chunk")).distinct())


@query()
def l1_features(spark, d):
    """By candidate: the hybrid's, the overlap's and the gap support's figures with the truth."""
    return _features(spark, d)


@query()
def l2_learned_ranking(spark, d):
    """Trained on queries of even number, measured on the others."""
    rows = _features(spark, d).withColumn("fold", F.col("query_id") % 2).cache()
    columns = [c for c in rows.columns if c not in ("query_id", "chunk", "label", "fold")]
    return L.evaluate(L.train(rows.filter("fold = 0"), columns), rows.filter("fold = 1"))


def u64(x: str) -> str:
    return f"lpad(lower(to_hex(({x})::UBIGINT)), 16, '0')"


def folded_sql(tag: str, record: str) -> str:
    return f"SELECT sha256(unhex('{tag.encode().hex()}00' || {u64('count(*)')} || string_agg({record}, '' ORDER BY doc_id))) AS identity FROM documents"


@query(folded_sql("CORPUS_IDENTITY_V1", f"{u64('doc_id')} || {u64('strlen(text)')} || sha256(text)"))
def v1_corpus_identity(spark, d):
    return V.corpus_identity(T.documents(spark, d))


@query(folded_sql("MANIFEST_IDENTITY_V1", f"{u64('doc_id')} || {u64('strlen(printf($$doc_%08d.bin$$, doc_id))')} || lower(hex(encode(printf('doc_%08d.bin', doc_id)))) || {u64('strlen(text)')} || sha256(text)"))
def v2_manifest_identity(spark, d):
    return V.manifest_identity(T.documents(spark, d))


@query()
def v3_index_identity(spark, d):
    return V.index_identity(X.build(T.items(spark, d)), "step=32")


DIGEST = T.LOCATE + ", dg AS (SELECT query_id, doc_id, sha256('[' || string_agg(doc_offset::VARCHAR, ',' ORDER BY doc_offset) || ']') AS digest FROM occ GROUP BY ALL) "


@query(DIGEST + "SELECT * FROM dg")
def v4_document_digests(spark, d):
    return V.document_digests(M.locate(T.documents(spark, d), T.patterns(spark, d)))


@query(DIGEST + f"SELECT query_id, sha256(unhex('{b'RESULT_IDENTITY_V1'.hex()}00' || hex(encode(string_agg(doc_id || ':' || digest, chr(10) ORDER BY doc_id))))) AS identity FROM dg GROUP BY query_id")
def v5_result_identity(spark, d):
    return V.result_identity(M.locate(T.documents(spark, d), T.patterns(spark, d)))


@query("WITH c AS (SELECT doc_id, hx, unnest(range((n + 4095)//4096))::BIGINT AS i FROM (SELECT doc_id, lower(hex(encode(text))) AS hx, strlen(text) AS n FROM documents)), l AS (SELECT doc_id, i, sha256(unhex('00' || substr(hx, i*8192+1, 8192))) AS h FROM c)" + "".join(f", l{k + 1} AS (SELECT doc_id, i//2 AS i, CASE WHEN count(*) = 2 THEN sha256(unhex('01' || string_agg(h, '' ORDER BY i))) ELSE any_value(h) END AS h FROM l{k or ''} GROUP BY doc_id, i//2)" for k in range(8)) + " SELECT doc_id, h AS root FROM l8")
def v6_merkle_roots(spark, d):
    return V.merkle_roots(V.leaves(T.documents(spark, d)))


@query()
def v6_commitment(spark, d):
    docs = T.items(spark, d)
    return V.commitment(docs, X.suffixes(docs), {"version": 1, "chunk_size": 4096, "hash": "sha256"})


@query("SELECT doc_id, true AS verified FROM documents WHERE strlen(text) > 0")
def v7_membership_proof(spark, d):
    """The first chunk of every document is proved against its root, in Arrow batches."""
    import pyarrow as pa

    leaves = V.leaves(T.documents(spark, d)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]).alias("l"))
    first = corpus.chunks(T.documents(spark, d), 4096).filter("chunk_no = 0").select("doc_id", "raw")
    rows = leaves.join(first, "doc_id").join(V.merkle_roots(V.leaves(T.documents(spark, d))), "doc_id").select("doc_id", "l", "raw", "root")

    def run(batches):
        for b in batches:
            ok = [V.check_membership(bytes(raw), V.membership_path([bytes(x) for x in digests], 0), root) for digests, raw, root in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], names=["doc_id", "verified"])

    return rows.mapInArrow(run, "doc_id bigint, verified boolean")


@query(f"WITH {T.SUF}, {T.SHORT}, a AS (SELECT query_id::BIGINT AS query_id, doc_id, max(starts_with(suffix, lower(hex(encode(p))))::INT) AS hit, max(sa_row) FILTER (WHERE suffix < lower(hex(encode(p)))) AS row_below, min(sa_row) FILTER (WHERE suffix >= lower(hex(encode(p)))) AS row_above FROM sfx, pat GROUP BY ALL) SELECT query_id, doc_id, row_below, row_above FROM a WHERE hit = 0")
def v8_absence_witnesses(spark, d):
    docs = T.items(spark, d)
    return V.absence_witnesses(X.suffixes(docs), docs, T.short_patterns(spark))


@query(T.LOCATE + "SELECT query_id, doc_id, doc_offset, sha256(text) AS source_sha256, lower(hex(encode(p))) AS observed_hex, true AS byte_check FROM occ JOIN d USING (doc_id) JOIN pat USING (query_id)")
def v9_evidence(spark, d):
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    return V.evidence(docs, pats, M.locate(docs, pats)).drop("context")


@query(T.LOCATE + "SELECT query_id, doc_id, doc_offset, 'fresh' AS side FROM occ WHERE doc_id % 10 < 2 UNION ALL SELECT query_id, doc_id, doc_offset, 'kept' FROM occ WHERE doc_id % 10 = 0")
def v9_evidence_replay(spark, d):
    """Evidence in which every tenth document's bytes are others and every tenth document is missing."""
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    kept = saved(V.evidence(docs, pats, M.locate(docs, pats)), "evidence").filter("doc_id % 10 <> 1")
    kept = kept.withColumn("observed_hex", F.when(F.col("doc_id") % 10 == 0, F.lit("00")).otherwise(F.col("observed_hex")))
    return V.replay(docs, pats, kept).select("query_id", "doc_id", "doc_offset", "side")


@query(T.LOCATE + "SELECT query_id, count(*) AS verified_offsets, count(DISTINCT doc_id) AS documents FROM occ GROUP BY ALL")
def v10_audit(spark, d):
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    checked = M.byte_checked(docs, pats, M.locate(docs, pats))
    return checked.groupBy("query_id").agg(F.count(F.when(F.col("byte_check"), 1)).alias("verified_offsets"), F.countDistinct("doc_id").alias("documents"))


@query(T.LOCATE + "SELECT query_id, doc_id, doc_offset, substr(hx, greatest(doc_offset-24,0)*2+1, (doc_offset+strlen(p)+24-greatest(doc_offset-24,0))*2) AS context_hex FROM occ JOIN d USING (doc_id) JOIN pat USING (query_id)")
def v11_evidence_context(spark, d):
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    found = V.evidence(docs, pats, M.locate(docs, pats))
    return found.select("query_id", "doc_id", "doc_offset", F.lower(F.hex(F.encode("context", "ISO-8859-1"))).alias("context_hex"))


@query(T.LOCATE + "SELECT query_id, doc_id, doc_offset, lower(hex(encode(p))) AS observed_hex FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, doc_offset) AS r FROM occ) JOIN pat USING (query_id) WHERE r <= 10")
def v12_bounded_evidence(spark, d):
    docs, pats = T.documents(spark, d), T.patterns(spark, d)
    return V.evidence(docs, pats, M.locate_bounded(docs, pats, 10)).select("query_id", "doc_id", "doc_offset", "observed_hex")


@query("SELECT url AS name, 'DIGEST' AS problem FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT url, 'MISSING' FROM pages WHERE page_id % 7 = 1")
def v13_bundle_check(spark, d):
    """A bundle of all pages in which every seventh file changed and every seventh is missing."""
    files = T.table(spark, d, "pages").select("page_id", F.col("url").alias("name"), B.utf8(F.coalesce(F.col("html"), F.lit(""))).alias("content"))
    k = F.col("page_id") % 7
    now = files.filter(k != 1).withColumn("content", F.when(k == 0, F.concat("content", F.lit(bytearray(b"!")))).otherwise(F.col("content")))
    return V.check_bundle(now.select("name", "content"), V.inventory(files.select("name", "content")))


@query("SELECT sha256('BUNDLE_V1' || chr(10) || string_agg(url || ' ' || strlen(html) || ' ' || sha256(html), chr(10) ORDER BY url, strlen(html), sha256(html))) AS root FROM pages")
def v13_bundle_root(spark, d):
    files = T.table(spark, d, "pages").select(F.col("url").alias("name"), B.utf8(F.col("html")).alias("content"))
    return V.bundle_root(V.inventory(files))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def v15_fingerprint_replay(spark, d):
    """Profiles computed twice, the second time over other partitions and with a byte more in every tenth document."""
    docs = T.documents(spark, d)
    changed = docs.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(bytearray(b"x")))).otherwise(F.col("content")))
    one, two = K.byte_profile(docs), K.byte_profile(changed.repartition(7, "content"))
    return one.exceptAll(two).unionByName(two.exceptAll(one)).select("doc_id").distinct()


@query(folded_sql("CORPUS_IDENTITY_V1", f"{u64('doc_id')} || {u64('strlen(text)')} || sha256(text)").replace("AS identity FROM documents", "AS identity, (SELECT sum((len(text) - len(replace(text, 'the', '')))//3)::BIGINT FROM documents) AS rows, 0::BIGINT AS problems, 0::BIGINT AS changed, true AS complete FROM documents"))
def v16_workflow(spark, d):
    """Snapshot, query, evidence and replay, all written and read back."""
    c = Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text")
    done = c.run([b"the".hex()], Scratch(spark, "workflow").root)
    return spark.createDataFrame([done], "identity string, rows bigint, problems bigint, changed bigint, complete boolean")


@query()
def v17_capabilities(spark, d):
    return spark.createDataFrame(sorted(V.capabilities(spark).items()), "name string, value string")


HEXES = [p.encode().hex() for _, p in T.FIXED] + ["", "ABC", "zz"]


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{bytes.fromhex(h).decode()}', '{h}')" for i, h in enumerate(HEXES[:5])) + ") v(query_id, p, hex)), c AS (SELECT query_id, sum((len(text) - len(replace(text, p, '')))//len(p))::BIGINT AS m FROM documents JOIN p ON contains(text, p) GROUP BY ALL) SELECT query_id, hex, 'OK' AS status, coalesce(m, 0) AS match_count FROM p LEFT JOIN c USING (query_id) UNION ALL VALUES (5, '', 'EMPTY_QUERY', NULL), (6, 'ABC', 'ODD_LENGTH', NULL), (7, 'zz', 'INVALID_HEX', NULL)")
def w1_line_queries(spark, d):
    c = Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text")
    return c.query(HEXES).select("query_id", "hex", "status", "match_count")


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{bytes.fromhex(h).decode()}')" for i, h in enumerate(HEXES[:5])) + ") v(query_id, p)), c AS (SELECT query_id, sum((len(text) - len(replace(text, p, '')))//len(p))::BIGINT AS m FROM documents JOIN p ON contains(text, p) GROUP BY ALL) SELECT query_id, coalesce(m, 0) AS match_count, least(coalesce(m, 0), 100) AS returned_count FROM p LEFT JOIN c USING (query_id)")
def w2_http_queries(spark, d):
    """The batch route of the service, asked over HTTP; answered with the served counts."""
    c = Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text")
    found = asked(c, "/query_batch", {"queries": [{"hex": h} for h in HEXES[:5]]})["results"]
    return spark.createDataFrame([(r["query_id"], r["match_count"], r["returned_count"]) for r in found], "query_id bigint, match_count bigint, returned_count bigint")


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{bytes.fromhex(h).decode()}')" for i, h in enumerate(HEXES[:5])) + ") v(query_id, p)), d AS (SELECT doc_id, text FROM documents), " + T.OCC.replace("JOIN pat", "JOIN p AS pat") + " SELECT doc_id*1048576 + doc_offset//16384 AS chunk, count(*) AS n FROM occ GROUP BY ALL ORDER BY n DESC, chunk LIMIT 16")
def w6_http_histogram(spark, d):
    """The service's histogram route: the sixteen chunks with most occurrences."""
    c = Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text")
    found = asked(c, "/histogram", {"queries": [{"hex": h} for h in HEXES[:5]], "most": 16})["chunks"]
    return spark.createDataFrame([tuple(r) for r in found], "chunk bigint, n bigint")


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{bytes.fromhex(h).decode()}')" for i, h in enumerate(HEXES[:5])) + ") v(query_id, p)), d AS (SELECT doc_id, text FROM documents), " + T.OCC.replace("JOIN pat", "JOIN p AS pat") + " SELECT query_id, doc_id, doc_offset FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, doc_offset) AS r FROM occ) WHERE r <= 100")
def w4_bounded_locate(spark, d):
    return Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text").locate(HEXES, 100)


@query("SELECT count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents")
def w7_collection_info(spark, d):
    c = Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text")
    return c.corpus.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{bytes.fromhex(h).decode()}')" for i, h in enumerate(HEXES[:5])) + ") v(query_id, p)), d AS (SELECT doc_id, text FROM documents), " + T.OCC.replace("JOIN pat", "JOIN p AS pat") + " SELECT query_id, count(*) AS checked, 0::BIGINT AS failed FROM occ GROUP BY ALL")
def v14_offset_replay(spark, d):
    """Located offsets are read back from the corpus and compared."""
    c = Collection.from_table(T.table(spark, d, "documents"), "doc_id", "text")
    pats = c.patterns(HEXES).filter("status = 'OK'").select("query_id", "pattern")
    rows = M.byte_checked(c.corpus, pats, M.locate(c.corpus, pats))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(~F.col("byte_check"), 1)).alias("failed"))
