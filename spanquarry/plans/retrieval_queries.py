"""Queries of anchors, signature indexes, shortlists and distance joins.

The corpus is ``documents`` in chunks, the queries are the ``benchmark`` items; shortlists take five fragments
of 24 bytes, 32 bytes apart, of each item, and keep 16 chunks a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanquarry.operators import anchors as A
from spanquarry.operators import gaps as J
from spanquarry.operators import match as M
from spanquarry.operators import shortlist as C
from spanquarry.operators import signatures as S
from spanquarry.plans import tables as T
from spanquarry.plans.registry import query
from spanquarry.sources import corpus
from spanquarry.sources.shared import saved

TOP = 16


def _queries(spark, d):
    return T.items(spark, d).select(F.col("doc_id").alias("query_id"), "content")


def chunks(spark, d):
    return corpus.chunks(T.documents(spark, d)).select((F.col("doc_id") * A.CHUNKS_PER_DOC + F.col("chunk_no")).alias("chunk"), "raw")


def fragments(spark, d):
    return C.fragments(_queries(spark, d), 5, 24, 8)


def _count(spark, d):
    return chunks(spark, d).count()


D = "d AS (SELECT doc_id, lower(hex(encode(text))) AS hx, strlen(text)::BIGINT AS n FROM documents)"
Q = "q AS (SELECT item_id AS query_id, lower(hex(encode(text))) AS qx, strlen(text)::BIGINT AS n FROM benchmark)"
WIN = f"{Q}, win AS (SELECT query_id, s AS start, substr(qx, 2*s+1, 96) AS fragment FROM (SELECT *, unnest(range(0, n-47, 64))::BIGINT AS s FROM q))"
ENT = "ent AS (SELECT query_id, start, fragment, -sum(c/48.0*log2(c/48.0)) AS entropy FROM (SELECT query_id, start, fragment, b, count(*) AS c FROM (SELECT *, unnest(regexp_extract_all(fragment, '..')) AS b FROM win) GROUP BY ALL) GROUP BY ALL)"
HIT = "hit AS (SELECT query_id, start, doc_id, o AS doc_offset, doc_id*1048576 + o//16384 AS chunk FROM (SELECT query_id, start, doc_id, unnest(list_filter(range(d.n-47), lambda i: substr(hx, 2*i+1, 96) = fragment))::BIGINT AS o FROM d JOIN ent ON contains(hx, fragment) WHERE entropy >= 2))"
ANCHOR = f"WITH {D}, {WIN}, {ENT}, {HIT}, an AS (SELECT query_id, start, count(doc_id) AS hits FROM (SELECT query_id, start FROM ent WHERE entropy >= 2) e LEFT JOIN hit USING (query_id, start) GROUP BY ALL), pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits, start) AS rank FROM an) WHERE rank <= 3), sl AS (SELECT DISTINCT query_id, chunk FROM hit JOIN pick USING (query_id, start)) "


@query(f"WITH {WIN} SELECT query_id, start, fragment AS hex FROM win")
def a1_windows(spark, d):
    return A.windows(_queries(spark, d)).select("query_id", "start", F.lower(F.hex("fragment")).alias("hex"))


@query(f"WITH {WIN}, {ENT} SELECT query_id, start, round(entropy, 6) AS entropy FROM ent")
def a2_entropy(spark, d):
    return A.anchors(_queries(spark, d), -1.0).select("query_id", "start", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {WIN}, {ENT} SELECT query_id, start FROM ent WHERE entropy >= 4")
def a3_entropy_filter(spark, d):
    return A.anchors(_queries(spark, d), 4.0).select("query_id", "start")


def _hits(spark, d):
    found = A.anchors(_queries(spark, d))
    return found, saved(A.anchor_hits(found, T.documents(spark, d)), "anchor-hits")


@query(ANCHOR + "SELECT query_id, start, hits, rank FROM pick")
def a4_rarest_anchors(spark, d):
    return A.picked(*_hits(spark, d))


@query(ANCHOR + "SELECT DISTINCT query_id, start, chunk FROM hit")
def a5_anchor_chunks(spark, d):
    return _hits(spark, d)[1].select("query_id", "start", "chunk").distinct()


@query(ANCHOR + "SELECT query_id, chunk FROM sl")
def a6_shortlist(spark, d):
    found, hits = _hits(spark, d)
    return A.shortlist(A.picked(found, hits), hits)


OUTCOME = ANCHOR + """, s AS (SELECT query_id, count(*) AS k, min(hits) AS lo, max(hits) AS hi FROM pick GROUP BY ALL), e AS (SELECT query_id, max(hits) AS any_ FROM an GROUP BY ALL),
pl AS (SELECT query_id, count(*) AS placed FROM (SELECT DISTINCT query_id, start, chunk FROM hit JOIN pick USING (query_id, start)) GROUP BY ALL), l AS (SELECT query_id, count(*) AS n, list_sort(list(chunk)) AS cs FROM sl GROUP BY ALL),
j AS (SELECT query_id, q.n AS len, k, lo, hi, any_, placed, coalesce(l.n, 0) AS c, coalesce(cs, []) AS cs FROM q LEFT JOIN s USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN pl USING (query_id) LEFT JOIN l USING (query_id))
SELECT query_id, CASE WHEN len = 0 THEN 'EMPTY_QUERY' WHEN len > 1048576 THEN 'QUERY_TOO_LONG' WHEN len < 48 THEN 'TOO_SHORT' WHEN k IS NULL THEN 'NON_SELECTIVE' WHEN any_ = 0 THEN 'NO_HIT' WHEN {capped} THEN 'NON_SELECTIVE' WHEN c = 0 THEN 'NO_HIT' WHEN lo = 0 THEN 'INVALID_PARTIAL_HIT' WHEN c > 16 THEN 'NON_SELECTIVE' WHEN c = 1 AND placed = k THEN 'EXACT_UNIQUE' ELSE 'EXACT_MULTI' END AS outcome,
CASE WHEN {capped} THEN 'RANGE_TOO_WIDE' END AS reason, c AS candidates, c > 100 AS truncated, cs[1:100] AS chunks FROM j"""


@query(OUTCOME.replace("{capped}", "false"))
def a7_outcomes(spark, d):
    return A.retrieve(_queries(spark, d), T.documents(spark, d))


@query(OUTCOME.replace("{capped}", "coalesce(hi > 1, false)"))
def a8_range_cap(spark, d):
    return A.retrieve(_queries(spark, d), T.documents(spark, d), most_hits=1).na.fill({"truncated": False})


@query(ANCHOR + "SELECT query_id, shard, chunk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shard, chunk) AS r FROM (SELECT DISTINCT query_id, doc_id % 4 AS shard, chunk FROM hit)) WHERE r <= 100")
def a9_sharded_retrieval(spark, d):
    """Chunks by shard, merged in order of shard, the first hundred a query; one pass serves all shards."""
    hits = A.anchor_hits(A.anchors(_queries(spark, d)), T.documents(spark, d))
    merged = hits.select("query_id", (F.col("doc_id") % 4).alias("shard"), "chunk").distinct()
    return M.bounded(merged, 100, ["shard", "chunk"])


@query(ANCHOR + "SELECT query_id, chunk, count(DISTINCT start) AS votes FROM hit GROUP BY ALL HAVING count(DISTINCT start) >= 2")
def a11_votes(spark, d):
    return A.votes(_hits(spark, d)[1], 2)


@query(f"WITH {Q}, f AS (SELECT query_id, n//2 AS m, qx FROM q) SELECT query_id, substr(qx, 1, 2*m) || lower(printf('%02x', xor(('0x' || substr(qx, 2*m+1, 2))::INT, 1))) || substr(qx, 2*m+3) AS hex FROM f")
def a12_perturbed_queries(spark, d):
    return A.perturbed(_queries(spark, d)).select("query_id", F.lower(F.hex("content")).alias("hex"))


@query(f"WITH {Q} SELECT query_id, round(sum(c*c)/max(n*n), 6) AS simpson FROM (SELECT query_id, n, b, count(*)::DOUBLE AS c FROM (SELECT query_id, n, unnest(regexp_extract_all(qx, '..')) AS b FROM q) GROUP BY ALL) GROUP BY ALL")
def a13_simpson(spark, d):
    from spanquarry.functions.binary import simpson

    return _queries(spark, d).select("query_id", F.round(simpson(F.col("content")), 6).alias("simpson"))


CH = "ch AS (SELECT doc_id*1048576 + k AS chunk, substr(hx, k*32768+1, 32768) AS raw FROM (SELECT doc_id, lower(hex(encode(text))) AS hx, unnest(range((strlen(text)+16383)//16384))::BIGINT AS k FROM documents))"


def grams(stride: int) -> str:
    return f"{CH}, g{stride} AS (SELECT chunk, pos, substr(raw, 2*pos+1, 16) AS sig FROM (SELECT chunk, raw, unnest(range(0, len(raw)//2 - 7, {stride}))::BIGINT AS pos FROM ch)), c{stride} AS (SELECT chunk, sig, count(*) AS cnt, min(pos) AS fp FROM g{stride} GROUP BY ALL), i{stride} AS (SELECT chunk, sig, cnt, fp, df FROM c{stride} JOIN (SELECT sig, count(*) AS df FROM c{stride} GROUP BY ALL) USING (sig))"


DENSE = grams(8) + ", dense AS (SELECT chunk, sig, cnt, df FROM i8 WHERE df <= 32)"
RARE = grams(4) + ", rare AS (SELECT chunk, sig, cnt, df FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY df, cnt DESC, sig) AS r FROM i4 WHERE df <= 16) WHERE r <= 128)"
BOTH = DENSE + RARE[len(CH):]
MIN = CH + ", tok AS (SELECT chunk, pos, substr(raw, 2*pos+1, 16) AS t, len(raw)//2 - 7 AS nt FROM (SELECT chunk, raw, unnest(range(0, len(raw)//2 - 7))::BIGINT AS pos FROM ch)), mw AS (SELECT chunk, pos, nt, min(t) OVER (PARTITION BY chunk ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS sig FROM tok), mt AS (SELECT chunk, sig, count(*) AS cnt FROM mw WHERE pos <= greatest(nt - 24, 0) GROUP BY ALL), mi AS (SELECT chunk, sig, cnt, df FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY cnt DESC, df, sig) AS r FROM mt JOIN (SELECT sig, count(*) AS df FROM mt GROUP BY ALL) USING (sig)) WHERE r <= 512)"


@query(f"WITH {grams(8)} SELECT chunk, pos, sig FROM g8")
def f1_grams(spark, d):
    return S.grams(chunks(spark, d)).select("chunk", "pos", F.lower(F.hex("sig")).alias("sig"))


@query(f"WITH {grams(8)} SELECT chunk, sig, cnt FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY cnt DESC, fp) AS r FROM c8) WHERE r <= 256")
def f2_top_signatures(spark, d):
    return S.top_signatures(chunks(spark, d)).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {DENSE} SELECT * FROM dense")
def f3_dense_index(spark, d):
    return S.dense(chunks(spark, d)).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {RARE} SELECT * FROM rare")
def f4_rare_index(spark, d):
    return S.rare(chunks(spark, d)).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {MIN} SELECT * FROM mi")
def f5_minimizer_index(spark, d):
    return S.minimizer_index(chunks(spark, d)).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {BOTH} SELECT 'dense' AS kind, chunk, count(*) AS postings FROM dense GROUP BY ALL UNION ALL SELECT 'rare', chunk, count(*) FROM rare GROUP BY ALL")
def f6_hybrid_container(spark, d):
    c = chunks(spark, d)
    both = S.dense(c).select(F.lit("dense").alias("kind"), "chunk").unionByName(S.rare(c).select(F.lit("rare").alias("kind"), "chunk"))
    return both.groupBy("kind", "chunk").agg(F.count(F.lit(1)).alias("postings"))


@query(f"WITH {grams(8)} SELECT chunk, sig, df FROM i8")
def f7_coarse_index(spark, d):
    return S.coarse(chunks(spark, d)).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {DENSE} SELECT count(*) AS postings, count(DISTINCT sig) AS signatures, count(DISTINCT chunk) AS chunks, max(df) AS most_df FROM dense")
def f8_index_statistics(spark, d):
    return S.statistics(S.dense(chunks(spark, d)))


@query(f"WITH {CH}, l AS (SELECT unnest([24, 32, 40]) AS length), g AS (SELECT DISTINCT length, chunk, substr(raw, 2*pos+1, 2*length) AS sig FROM (SELECT length, chunk, raw, unnest(range(0, len(raw)//2 - length + 1, length//2)) AS pos FROM ch, l)), f AS (SELECT length, sig, count(*) AS df FROM g GROUP BY ALL) SELECT length, count(*) AS windows, min(df) AS least, quantile_cont(df, 0.5) AS median, quantile_cont(df, 0.9) AS p90, max(df) AS most, round(avg(df), 6) AS mean FROM f GROUP BY length")
def f9_long_substring_frequency(spark, d):
    """Windows of 24, 32 and 40 bytes, each half its length apart."""
    found = None
    for length in (24, 32, 40):
        one = S.grams(chunks(spark, d), length, length // 2).select(F.lit(length).alias("length"), "chunk", "sig").distinct()
        found = one if found is None else found.unionByName(one)
    f = found.groupBy("length", "sig").agg(F.count(F.lit(1)).alias("df"))
    return f.groupBy("length").agg(F.count(F.lit(1)).alias("windows"), F.min("df").alias("least"), F.percentile("df", 0.5).alias("median"), F.percentile("df", 0.9).alias("p90"), F.max("df").alias("most"), F.round(F.avg("df"), 6).alias("mean"))


FR = "fr AS (SELECT item_id AS query_id, f AS frag, f*32 AS start, substr(lower(hex(encode(text))), f*64+1, 48) AS fragment FROM benchmark, range(5) t(f) WHERE f*32 + 24 <= strlen(text))"


def sigs(stride: int, name: str) -> str:
    return f"{name} AS (SELECT query_id, frag, start, pos, substr(fragment, 2*pos+1, 16) AS sig FROM (SELECT *, unnest(range(0, 17, {stride})) AS pos FROM fr))"


NCH = "(SELECT count(*) FROM ch)"


def top(source: str, columns: str, order: str) -> str:
    return f" SELECT query_id, chunk, {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, chunk) AS rank FROM {source}) WHERE rank <= {TOP}"


@query(f"WITH {FR} SELECT query_id, frag, start, fragment FROM fr")
def c1_fragments(spark, d):
    return fragments(spark, d).withColumn("fragment", F.lower(F.hex("fragment")))


@query(f"WITH {DENSE}, {FR}, {sigs(8, 's')}, r AS (SELECT query_id, chunk, count(*) AS overlap, sum(cnt)::BIGINT AS weighted FROM (SELECT DISTINCT query_id, sig FROM s) JOIN dense USING (sig) GROUP BY ALL)" + top("r", "overlap, weighted", "overlap DESC, weighted DESC"))
def c2_overlap(spark, d):
    return C.overlap(fragments(spark, d), S.dense(chunks(spark, d)), TOP)


@query(f"WITH {DENSE}, {FR}, {sigs(8, 's')}, v AS (SELECT query_id, chunk, frag, sum(cnt)::BIGINT AS v FROM s JOIN dense USING (sig) GROUP BY ALL), r AS (SELECT query_id, chunk, count(*) AS present, sum(v)::BIGINT AS total, max(v) AS most, min(v) AS least FROM v GROUP BY ALL)" + top("r", "present, total, most, least", "present DESC, total DESC, most DESC, least DESC"))
def c3_voting(spark, d):
    return C.voting(fragments(spark, d), S.dense(chunks(spark, d)), TOP)


RANKED = ", v AS (SELECT query_id, chunk, frag, count(*) AS v, sum(cnt*ln(1.0 + {n}/greatest(1, df)::DOUBLE)) AS w FROM (SELECT DISTINCT query_id, frag, sig FROM s) JOIN {index} USING (sig) GROUP BY ALL), r AS (SELECT query_id, chunk, count(*) AS present, sum(v)::BIGINT AS matches, round(sum(w), 6) AS weighted, max(v) AS most, min(v) AS least FROM v GROUP BY ALL)" + top("r", "present, matches, weighted, most, least", "present DESC, matches DESC, weighted DESC, most DESC, least DESC")


@query(f"WITH {RARE}, {FR}, {sigs(4, 's')}" + RANKED.format(n=NCH, index="rare"))
def c4_rare_anchors(spark, d):
    return C.rare_anchors(fragments(spark, d), S.rare(chunks(spark, d)), _count(spark, d), TOP)


FMIN = "s AS (SELECT query_id, frag, list_min([substr(fragment, 2*p+1, 16) FOR p IN range(17)]) AS sig FROM fr)"


@query(f"WITH {MIN}, {FR}, {FMIN}, few AS (SELECT * FROM mi WHERE df <= 64)" + RANKED.format(n=NCH, index="few"))
def c5_minimizers(spark, d):
    frags = fragments(spark, d)
    return C.rare_anchors(frags, S.minimizer_index(chunks(spark, d)), _count(spark, d), TOP, most_df=64, tokens=C.minimizer_tokens(frags))


EV = f"""WITH {BOTH}, {FR}, {sigs(1, 's')}, dd AS (SELECT query_id, chunk, frag, sum(cnt)::BIGINT AS dense FROM s JOIN dense USING (sig) GROUP BY ALL),
rr AS (SELECT query_id, chunk, frag, sum(cnt/(df+1.0::DOUBLE)) AS rare, count(*) AS matches FROM s JOIN rare USING (sig) GROUP BY ALL),
ev AS (SELECT * FROM dd FULL JOIN rr USING (query_id, chunk, frag)),
hy AS (SELECT query_id, chunk, count(rare) AS rare_present, count(dense) AS dense_present, round(coalesce(sum(rare), 0.0::DOUBLE), 6) AS rare_score, coalesce(sum(dense), 0)::BIGINT AS dense_total, coalesce(sum(matches), 0)::BIGINT AS rare_matches FROM ev GROUP BY ALL)"""


def _evidence(spark, d):
    c = chunks(spark, d)
    return C.evidence(fragments(spark, d), S.dense(c), S.rare(c))


@query(EV + top("hy", "rare_present, dense_present, rare_score, dense_total, rare_matches", "rare_present DESC, dense_present DESC, rare_score DESC, dense_total DESC, rare_matches DESC"))
def c6_hybrid(spark, d):
    return C.hybrid_lexicographic(_evidence(spark, d), TOP)


WEIGHTED = ", w AS (SELECT query_id, chunk, round(rare_present*5.0::DOUBLE + dense_present*2.0::DOUBLE + rare_score, 6) AS score FROM hy)"


@query(EV + WEIGHTED + top("w", "score", "score DESC"))
def c7_hybrid_weighted(spark, d):
    return C.hybrid_weighted(_evidence(spark, d), TOP)


@query(EV + MIN[len(CH):] + ", " + FMIN.replace("s AS", "ms AS", 1) + f", bo AS (SELECT query_id, chunk, sum(cnt*ln(1.0 + {NCH}/df::DOUBLE)) AS bonus FROM (SELECT DISTINCT query_id, frag, sig FROM ms) JOIN (SELECT * FROM mi WHERE df <= 64) USING (sig) GROUP BY ALL), w AS (SELECT query_id, chunk, round(coalesce(rare_present,0)*5.0::DOUBLE + coalesce(dense_present,0)*2.0::DOUBLE + coalesce(rare_score,0) + coalesce(bonus,0)*0.3::DOUBLE, 6) AS score FROM hy FULL JOIN bo USING (query_id, chunk))" + top("w", "score", "score DESC"))
def c8_minimizer_bonus(spark, d):
    return C.with_minimizers(_evidence(spark, d), fragments(spark, d), S.minimizer_index(chunks(spark, d)), _count(spark, d), TOP)


@query(EV + """, st AS (SELECT query_id, chunk, frag, coalesce(dense,0) + coalesce(rare,0) AS s, CASE WHEN lag(frag) OVER (PARTITION BY query_id, chunk ORDER BY frag) = frag - 1 THEN 1 ELSE 0 END AS adj FROM ev),
ex AS (SELECT query_id, chunk, sum(adj) AS adj, CASE WHEN count(*) > 1 THEN min(s)/max(s) ELSE 0.0 END AS bal FROM st GROUP BY ALL),
w AS (SELECT query_id, chunk, round(rare_present*5.0::DOUBLE + dense_present*2.0::DOUBLE + rare_score + adj*3.0::DOUBLE + bal*2.0::DOUBLE, 6) AS score FROM hy JOIN ex USING (query_id, chunk))""" + top("w", "score", "score DESC"))
def c9_proximity(spark, d):
    return C.with_proximity(_evidence(spark, d), TOP)


ONLY = ", wd AS (SELECT query_id, chunk, round(dense_present*10.0::DOUBLE + dense_total*0.01::DOUBLE, 6) AS score FROM hy WHERE dense_present > 0), wr AS (SELECT query_id, chunk, round(rare_present*10.0::DOUBLE + rare_score, 6) AS score FROM hy WHERE rare_present > 0)"


@query(EV + ONLY + top("wd", "score", "score DESC"))
def c10_dense_only(spark, d):
    return C.dense_only(_evidence(spark, d), TOP)


@query(EV + ONLY + top("wr", "score", "score DESC"))
def c10_rare_only(spark, d):
    return C.rare_only(_evidence(spark, d), TOP)


@query(EV + ONLY + f", td AS ({top('wd', 'score', 'score DESC')}), tr AS ({top('wr', 'score', 'score DESC')}), un AS (SELECT query_id, chunk, CASE WHEN td.rank IS NOT NULL AND tr.rank IS NOT NULL THEN 0 WHEN tr.rank IS NOT NULL THEN 1 ELSE 2 END AS tier, CASE WHEN td.rank IS NOT NULL AND tr.rank IS NOT NULL THEN 0 WHEN tr.rank IS NOT NULL THEN tr.rank ELSE td.rank END AS inn FROM td FULL JOIN tr USING (query_id, chunk))" + top("un", "tier", "tier, inn"))
def c11_branch_union(spark, d):
    found = _evidence(spark, d)
    return C.branch_union(C.dense_only(found, TOP), C.rare_only(found, TOP), TOP)


@query(f"WITH {grams(8)}, {FR}, {sigs(8, 's')}, r AS (SELECT query_id, chunk, count(*) AS overlap FROM (SELECT DISTINCT query_id, sig FROM s) JOIN i8 USING (sig) GROUP BY ALL)" + top("r", "overlap", "overlap DESC"))
def c12_coarse_gate(spark, d):
    return C.coarse_gate(fragments(spark, d), S.coarse(chunks(spark, d)), TOP)


@query(f"WITH {grams(8)}, {FR}, {sigs(8, 's')}, v AS (SELECT query_id, chunk, frag, sum(ln(1.0 + {NCH}/greatest(1,df)::DOUBLE)) AS i FROM (SELECT DISTINCT query_id, frag, sig FROM s) JOIN i8 USING (sig) GROUP BY ALL), r AS (SELECT query_id, chunk, count(*) AS coverage, round(sum(i), 6) AS idf_sum FROM v GROUP BY ALL), w AS (SELECT *, round(coverage*10.0::DOUBLE + idf_sum, 6) AS score FROM r)" + top("w", "coverage, idf_sum, score", "score DESC, coverage DESC, idf_sum DESC"))
def c13_coarse_gate_weighted(spark, d):
    return C.coarse_gate_weighted(fragments(spark, d), S.coarse(chunks(spark, d)), _count(spark, d), TOP)


@query(EV + f", al AS (SELECT query_id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk) AS rank FROM (SELECT query_id, chunk, count(*) AS overlap FROM (SELECT DISTINCT query_id, sig FROM s WHERE pos % 8 = 0) JOIN i8 USING (sig) GROUP BY ALL)) WHERE rank <= 4)" + WEIGHTED + ", wa AS (SELECT * FROM w SEMI JOIN al USING (query_id, chunk))" + top("wa", "score", "score DESC"))
def c14_gated_hybrid(spark, d):
    allowed = C.coarse_gate(fragments(spark, d), S.coarse(chunks(spark, d)), 4)
    return C.gated(_evidence(spark, d), allowed, TOP)


FHIT = f"WITH {D}, {FR}, fh AS (SELECT query_id, frag, start, doc_id, o AS doc_offset, doc_id*1048576 + o//16384 AS chunk FROM (SELECT query_id, frag, start, doc_id, unnest(list_filter(range(n-23), lambda i: substr(hx, 2*i+1, 48) = fragment))::BIGINT AS o FROM d JOIN fr ON contains(hx, fragment)))"


def fragment_hits(spark, d):
    """(query_id, frag, start, doc_id, doc_offset, chunk) of the fragments' occurrences."""
    frags = fragments(spark, d)
    named = frags.select((F.col("query_id") * 16 + F.col("frag")).alias("query_id"), F.col("fragment").alias("pattern"))
    found = M.locate(T.documents(spark, d), named).withColumn("frag", (F.col("query_id") % 16).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 16))
    placed = found.join(frags.select("query_id", "frag", "start"), ["query_id", "frag"])
    return placed.select("query_id", "frag", "start", "doc_id", "doc_offset", A.chunk_id(F.col("doc_id"), F.col("doc_offset")).alias("chunk"))


@query(FHIT + ", r AS (SELECT query_id, chunk, round(sum(1.0::DOUBLE/(frag+1)), 6) AS score FROM fh GROUP BY ALL)" + top("r", "score", "score DESC"))
def c15_histogram(spark, d):
    return C.histogram(fragment_hits(spark, d), F.lit(1.0) / (F.col("frag") + 1), TOP)


FUSED = FHIT + f""", cc AS (SELECT query_id, frag, chunk, count(*) AS v FROM fh GROUP BY ALL), wi AS (SELECT query_id, frag, count(*) AS width FROM cc GROUP BY ALL), {CH},
rw AS (SELECT *, ln(1.0 + {NCH}/greatest(1,width)::DOUBLE) AS w FROM cc JOIN wi USING (query_id, frag)),
r AS (SELECT query_id, chunk, count(*) AS present, round(sum(w), 6) AS presence, min(v) AS least, round(sum(v*w), 6) AS weighted, round(min(v)/max(v)::DOUBLE, 6) AS balance, sum(v)::BIGINT AS total FROM rw GROUP BY ALL), fu AS ({top("r", "present, presence, least, weighted, balance, total", "present DESC, presence DESC, least DESC, weighted DESC, balance DESC, total DESC")}) """


@query(FUSED + "SELECT * FROM fu")
def c16_fusion(spark, d):
    return C.fusion(fragment_hits(spark, d), _count(spark, d), TOP)


@query(FUSED + ", k AS (SELECT query_id, chunk, round(present/5.0::DOUBLE*0.45::DOUBLE + least(1.0::DOUBLE, least/4.0::DOUBLE)*0.25::DOUBLE + least(1.0::DOUBLE, weighted/50.0::DOUBLE)*0.2::DOUBLE + balance*0.1::DOUBLE, 6) AS confidence FROM fu WHERE rank = 1) SELECT *, CASE WHEN confidence >= 0.88 THEN 'high' WHEN confidence >= 0.68 THEN 'medium' ELSE 'low' END AS label FROM k")
def c17_confidence(spark, d):
    return C.confidence(C.fusion(fragment_hits(spark, d), _count(spark, d), TOP))


AL = f"{FR}, {sigs(1, 's')}, al AS (SELECT DISTINCT query_id, sig FROM s WHERE (start + pos) % 8 = 0)"


@query(f"WITH {DENSE}, {AL}, fw AS (SELECT * FROM (SELECT query_id, sig, df, row_number() OVER (PARTITION BY query_id ORDER BY df, sig) AS r FROM al JOIN (SELECT DISTINCT sig, df FROM dense) USING (sig)) WHERE r <= 16), hd AS (SELECT query_id, chunk, r FROM fw JOIN dense USING (sig)), ns AS (SELECT query_id, max(r) AS n FROM fw GROUP BY ALL), pr AS (SELECT a.query_id, a.chunk, count(*) AS pairs FROM hd a JOIN hd b ON a.query_id = b.query_id AND a.chunk = b.chunk AND a.r < b.r JOIN ns ON a.query_id = ns.query_id WHERE (a.r-1)*n - (a.r-1)*a.r/2 + b.r - a.r <= 128 GROUP BY ALL), sg AS (SELECT query_id, chunk, count(*) AS singles FROM hd GROUP BY ALL), r AS (SELECT query_id, chunk, coalesce(pairs, 0) AS pairs, singles FROM sg LEFT JOIN pr USING (query_id, chunk))" + top("r", "pairs, singles", "pairs DESC, singles DESC"))
def c18_pair_conjunction(spark, d):
    return C.pair_conjunction(fragments(spark, d), S.dense(chunks(spark, d)), TOP)


@query(f"WITH {AL} SELECT query_id, sig FROM al")
def c19_aligned_signatures(spark, d):
    return C.aligned(fragments(spark, d)).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {DENSE}, {AL}, v AS (SELECT query_id, chunk, frag, sum(cnt) AS v FROM (SELECT * FROM s WHERE pos % 8 = 0) JOIN dense USING (sig) GROUP BY ALL), ms AS (SELECT DISTINCT query_id FROM fr WHERE query_id NOT IN (SELECT query_id FROM v)) SELECT query_id, count(*) AS n, min(df) AS least, quantile_cont(df, 0.5) AS median, max(df) AS most FROM al JOIN ms USING (query_id) JOIN (SELECT DISTINCT sig, df FROM dense) USING (sig) GROUP BY ALL")
def c20_missed_frequencies(spark, d):
    frags, index = fragments(spark, d), S.dense(chunks(spark, d))
    return C.missed_frequencies(frags, index, C.voting(frags, index, TOP), TOP)


PAIRS = FHIT + ", nf AS (SELECT query_id, frag FROM fh GROUP BY ALL HAVING count(*) <= 20000), pr AS (SELECT a.query_id, a.frag AS i, b.frag AS j, a.chunk, count(*) AS hits FROM fh a JOIN fh b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.doc_offset - a.start = b.doc_offset - b.start AND a.frag < b.frag JOIN nf ON nf.query_id = a.query_id AND nf.frag = a.frag GROUP BY ALL) "


@query(PAIRS + "SELECT * FROM pr")
def j1_pair_gap_join(spark, d):
    return J.pairs(fragment_hits(spark, d))


@query(PAIRS + "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap_support DESC, raw_support DESC, chunk) AS rank FROM (SELECT query_id, chunk, count(*) AS gap_support, sum(hits)::BIGINT AS raw_support FROM pr GROUP BY ALL)")
def j2_gap_support(spark, d):
    return J.support(J.pairs(fragment_hits(spark, d)))


@query(PAIRS + "SELECT * FROM pr WHERE j - i <= 2")
def j3_pair_template(spark, d):
    """Neighbours and pairs one apart of the five fragments."""
    template = spark.createDataFrame([(i, j) for i in range(5) for j in range(i + 1, min(i + 3, 5))], "i int, j int")
    return J.pairs(fragment_hits(spark, d), template=template)


@query("WITH l AS (SELECT t AS template, f AS frag, [[8,12,16],[12,16,8],[16,8,12]][t+1][f+1] AS length FROM range(3) a(t), range(3) b(f)), p AS (SELECT *, coalesce(sum(length + 128) OVER (PARTITION BY template ORDER BY frag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l) SELECT item_id AS query_id, template, frag, start, substr(lower(hex(encode(text))), 2*start+1, 2*length) AS fragment FROM benchmark JOIN p ON strlen(text) >= start + length")
def j4_variable_fragments(spark, d):
    lengths = spark.createDataFrame([(t, f, n) for t, row in enumerate(((8, 12, 16), (12, 16, 8), (16, 8, 12))) for f, n in enumerate(row)], "template bigint, frag bigint, length bigint")
    return J.variable_fragments(_queries(spark, d), lengths).withColumn("fragment", F.lower(F.hex("fragment")))


# chains of the fragments' places: all of them, and the greedy ones
CHAIN = FHIT.replace("WITH ", "WITH RECURSIVE ", 1) + ", cg AS (SELECT DISTINCT query_id, chunk FROM fh), ch0(query_id, chunk, f, c) AS (SELECT query_id, chunk, 0, [doc_offset] FROM fh WHERE frag = 0 UNION ALL SELECT a.query_id, a.chunk, f + 1, list_append(c, doc_offset) FROM ch0 a JOIN fh b ON a.query_id = b.query_id AND a.chunk = b.chunk AND b.frag = f + 1 AND doc_offset > c[-1] AND abs(doc_offset - c[-1] - 32) <= 4), al AS (SELECT * FROM ch0 JOIN (SELECT query_id, chunk, max(f) AS f FROM ch0 GROUP BY ALL) USING (query_id, chunk, f) WHERE f >= 2)"
GREEDY = FHIT.replace("WITH ", "WITH RECURSIVE ", 1) + ", cg AS (SELECT DISTINCT query_id, chunk FROM fh), ch0(query_id, chunk, f, c) AS (SELECT query_id, chunk, 0, [doc_offset] FROM fh WHERE frag = 0 UNION ALL SELECT query_id, chunk, f + 1, list_append(c, doc_offset) FROM (SELECT a.query_id, a.chunk, f, c, doc_offset, row_number() OVER (PARTITION BY a.query_id, a.chunk, c ORDER BY abs(doc_offset - c[-1] - 32), doc_offset) AS k FROM ch0 a JOIN fh b ON a.query_id = b.query_id AND a.chunk = b.chunk AND b.frag = f + 1 AND doc_offset > c[-1] AND abs(doc_offset - c[-1] - 32) <= 4) WHERE k = 1), al AS (SELECT query_id, chunk, max(f) AS f, arg_max(c, f) AS c FROM ch0 GROUP BY query_id, chunk, c[1] HAVING max(f) >= 2)"
BEST_CHAIN = ", gp AS (SELECT *, list_transform(range(1, len(c)), lambda i: c[i+1] - c[i]) AS g FROM al), sc AS (SELECT *, list_sum(list_transform(g, lambda x: abs(x - 32)))::BIGINT AS err, list_median(list_transform(g, lambda x: abs(x - list_median(g)))) AS mad FROM gp), bc AS (SELECT *, count(*) OVER (PARTITION BY query_id, chunk) AS chains, row_number() OVER (PARTITION BY query_id, chunk ORDER BY len(c) DESC, err, mad, c) AS k FROM sc), cn0 AS (SELECT query_id, chunk, coalesce(chains, 0) AS chains, coalesce(len(c), 0) AS best_length, coalesce(err, 0) AS gap_error, coalesce(mad, 0.0::DOUBLE) AS gap_mad, coalesce(len(list_filter(flatten(list_transform(range(1, len(c)+1), lambda i: list_transform(range(i+2, len(c)+1), lambda j: abs(c[j] - c[i] - 32*(j-i)) <= 4*(j-i)))), lambda x: x)), 0) AS skips FROM cg LEFT JOIN (SELECT * FROM bc WHERE k = 1) USING (query_id, chunk))"


CHAIN_COLUMNS = " SELECT query_id, chunk, chains, best_length, gap_error, gap_mad, skips FROM cn0"


@query(CHAIN + BEST_CHAIN + CHAIN_COLUMNS)
def j5_chains(spark, d):
    return J.chains(fragment_hits(spark, d), 5, distance=32, tolerance=4)


@query(GREEDY + BEST_CHAIN + CHAIN_COLUMNS)
def j6_greedy_chains(spark, d):
    return J.chains(fragment_hits(spark, d), 5, greedy=True, distance=32, tolerance=4)


@query(FHIT + ", s2 AS (SELECT a.query_id, a.chunk, count(*) AS skips FROM fh a JOIN fh b ON a.query_id = b.query_id AND a.chunk = b.chunk AND b.frag >= a.frag + 2 AND abs(b.doc_offset - a.doc_offset - 32*(b.frag - a.frag)) <= 4*(b.frag - a.frag) GROUP BY ALL) SELECT * FROM s2")
def j7_skip_pairs(spark, d):
    h = saved(fragment_hits(spark, d), "hits")
    b = h.select("query_id", "chunk", F.col("frag").alias("j"), F.col("doc_offset").alias("o"))
    far = F.col("j") - F.col("frag")
    met = h.join(b, ["query_id", "chunk"]).filter((far >= 2) & (F.abs(F.col("o") - F.col("doc_offset") - far * 32) <= far * 4))
    return met.groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("skips"))


@query("WITH x AS (SELECT l_orderkey, list(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY ALL) SELECT l_orderkey, list_median(list_transform(v, lambda q: abs(q - list_median(v)))) AS mad FROM x")
def j8_median_deviation(spark, d):
    x = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("v"))
    return x.select("l_orderkey", J.median_deviation(F.col("v")).alias("mad"))


@query("WITH g AS (SELECT page_id AS doc_id, pos, substr(hx, 2*pos+1, 32) AS sig FROM (SELECT page_id, lower(hex(encode(html))) AS hx, unnest(range(0, strlen(html) - 15, 8))::BIGINT AS pos FROM pages)) SELECT doc_id, sig, distance FROM (SELECT doc_id, sig, lead(pos) OVER (PARTITION BY doc_id, sig ORDER BY pos) - pos AS distance FROM g) WHERE distance IS NOT NULL")
def j9_repeat_distances(spark, d):
    pages = corpus.from_table(T.table(spark, d, "pages"), "page_id", "html")
    return J.repeat_distances(S.grams(pages, 16, 8, ("doc_id",), "content")).withColumn("sig", F.lower(F.hex("sig")))


@query(f"WITH {BOTH} SELECT 'dense' AS kind, chunk, sig, cnt, df FROM dense UNION ALL SELECT 'rare', chunk, sig, cnt, df FROM rare")
def s17_shortlist_export(spark, d):
    """Both indexes as one table of postings, laid out by signature for lookups."""
    c = chunks(spark, d)
    both = S.dense(c).withColumn("kind", F.lit("dense")).unionByName(S.rare(c).withColumn("kind", F.lit("rare")))
    return both.select("kind", "chunk", F.lower(F.hex("sig")).alias("sig"), "cnt", "df").repartition("sig")


@query(ANCHOR + ", r AS (SELECT DISTINCT query_id, chunk FROM hit) SELECT query_id, chunk FROM r")
def a10_raw_candidates(spark, d):
    """Without picking the rarest: all chunks of all anchors, as the earlier retrievers return them."""
    return _hits(spark, d)[1].select("query_id", "chunk").distinct()


@query(FHIT + "SELECT query_id, frag, count(*) AS match_count, min(doc_offset) AS first_offset, max(doc_offset) AS last_offset FROM fh GROUP BY ALL")
def w5_range_summaries(spark, d):
    return fragment_hits(spark, d).groupBy("query_id", "frag").agg(F.count(F.lit(1)).alias("match_count"), F.min("doc_offset").alias("first_offset"), F.max("doc_offset").alias("last_offset"))
