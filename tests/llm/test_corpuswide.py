"""Operators over all rows: near-dedup, decontamination, sharding, substring removal, mixing, the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanquarry.llm import decontaminate, mixing, near_dedup, sharding, substring_dedup

SPACED = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text, width):
    w = SPACED.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(rows, width, percent):
    """The smallest id reachable from each row, by comparing all pairs; rows of one id are one node."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t, width) for _, t, *_ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            alike = sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            if alike or (sets[a] and sets[b] and rows[a][0] is not None and rows[a][0] == rows[b][0]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[root(k)].append(r[0])
    least = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return [rows[k][0] if not sets[k] else least[root(k)] for k in range(len(rows))], [len(s) for s in sets]


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 512), (5, 80, 2)])
def test_near_dedup_against_all_pairs(docs, rows, width, percent, block):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.link(docs, "doc_id", "text", width, percent, block)[0].collect())
    found, sizes = components(rows, width, percent)
    assert got == Counter((r[0], n, c, r[0] == c) for r, n, c in zip(rows, sizes, found, strict=True))


def test_blocks_find_what_a_star_leaves(spark):
    """A chain of texts, each like its neighbours only, is one component."""
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[8 * k : 8 * k + 160])) for k in range(20)]
    table = spark.createDataFrame(chain, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(table, "doc_id", "text", 3, 85, 4)[0].collect()}
    want, _ = components(chain, 3, 85)
    assert [got[k] for k in range(20)] == want


def test_words_that_collide_in_polynomials_stay_apart(spark):
    """Two words of 1,024 letters that every polynomial modulo 2**64 gives one value, as words and inside passages."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    two = "".join("ba"[k.bit_count() % 2] for k in range(1024))
    rest = " ".join(f"w{k}" for k in range(3))
    table = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(table, "doc_id", "text", 3, 85)[0].collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    texts = [one, two, "x" + one]
    cut = {r["doc_id"]: tuple(r)[2:] for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert [cut[k] for k in range(3)] == list(cut_by_hand([t.encode() for t in texts], 200))


def test_blocks_of_large_sets(spark):
    """Links that stars leave between texts of more shingles than a block carries."""
    words = [f"w{k}" for k in range(2400)]
    chain = [(k, " ".join(words[40 * k : 40 * k + 800])) for k in range(16)]
    table = spark.createDataFrame(chain, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(table, "doc_id", "text", 3, 85, 4)[0].collect()}
    want, _ = components(chain, 3, 85)
    assert [got[k] for k in range(16)] == want


def test_rows_without_ids_and_versions_are_linked(spark):
    """Near copies without ids are linked to one another and to rows with ids; versions of an id link what is like either."""
    texts = [[f"{kind}{k}" for k in range(120)] for kind in "abcdef"]
    rows = []
    for n, (ids, words) in enumerate(zip([(None, 4), (None, None, None), (7, None, 9), (9, 2), (11,), (11, None)], texts, strict=True)):
        for j, i in enumerate(ids):
            rows.append((i, " ".join([*words[:100], f"edit{n}-{j}", *words[101:]])))
    rows += rows[:3]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    linked, _ = near_dedup.link(table, "doc_id", "text", 3, 85)
    found, sizes = components(rows, 3, 85)
    got = linked.collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((r[0], n, c) for r, n, c in zip(rows, sizes, found, strict=True))
    assert {c for r, c in zip(rows, found, strict=True) if r[0] is None} == {None, 2, 4, 11}
    assert len({r["part"] for r in got}) == len(texts)


def test_keep_one(docs, rows, empty):
    kept = [r["doc_id"] for r in near_dedup.keep_one(docs, "doc_id", "text").collect()]
    found, sizes = components(rows, 5, 80)
    assert Counter(kept) == Counter({c for c, n in zip(found, sizes, strict=True) if n}) + Counter(r[0] for r, n in zip(rows, sizes, strict=True) if not n)
    assert near_dedup.keep_one(empty, "doc_id", "text").columns == empty.columns


def test_keep_one_drops_no_text_for_its_id(spark):
    """Unrelated texts without ids or under one id all stay; copies of each are cut to one."""
    texts = [" ".join(f"{kind}{k}" for k in range(40)) for kind in "abcdefg"]
    rows = [(None, t) for t in texts[:3]] * 2 + [(5, t) for t in texts[3:5]] * 2 + [(8, texts[5]), (2, texts[5]), (None, texts[5])]
    rows += [(None, " \n"), (None, " \n"), (6, texts[6]), (5, texts[6])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(tuple(r) for r in near_dedup.keep_one(table, "doc_id", "text").collect())
    want = [(None, t) for t in texts[:3]] + [(5, t) for t in texts[3:5]] + [(2, texts[5]), (5, texts[6]), (None, " \n"), (None, " \n")]
    assert got == Counter(want)


def contained(rows, items, percent=80):
    def cut(text, width):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
        width = min(width, len(w)) if width < 0 else width
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if width else set()

    out = set()
    for j, text in items:
        n = len([x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x])
        own = cut(text, min(5, n))
        for i, t, *_ in rows:
            shared = len(own & cut(t, min(5, n)))
            if own and shared * 100 >= percent * len(own):
                out.add((i, j, shared, len(own)))
    return out


def test_decontamination_against_all_pairs(docs, rows, items, empty, monkeypatch):
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    for literal, most in ((decontaminate.LITERAL, 8 << 20), (decontaminate.LITERAL, 0), (0, 8 << 20)):
        monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
        got = {tuple(r)[:4] for r in decontaminate.contained(docs, "doc_id", "text", items, "item_id", "text", literal=literal).collect()}
        assert got == contained(rows, pairs)
    assert (3, 1) in {g[:2] for g in got} and (81, 5) in {g[:2] for g in got}
    clean = decontaminate.clean(docs, "text", items, "item_id", "text")
    assert clean.columns == docs.columns
    bad = {g[0] for g in got}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in bad)
    assert decontaminate.contained(empty, "doc_id", "text", items, "item_id", "text").count() == 0
    assert decontaminate.contained(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 200])
def test_jump_hash_is_the_published_one(spark, shards):
    keys = [0, 1, -1, 7, 123456789, 2**63 - 1, -(2**63), *range(40)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
    assert [(r["k"], r["s"]) for r in got] == [(k, jump(k, shards)) for k in keys]


def test_shards_are_gapless_and_move_only_into_the_new_one(docs, rows, empty):
    got = sharding.shard_rows(docs, "doc_id", "text", 16, buckets=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(key, 16), jump(key, 17), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(empty, "doc_id", "text", 16).count() == 0


def cut_by_hand(texts, depth):
    counts = Counter(t[k : k + depth] for t in texts for k in range(len(t) - depth + 1))
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - depth + 1):
            if counts[t[k : k + depth]] > 1:
                gone[k : k + depth] = [True] * depth
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("depth", [200, 24, 3])
def test_repeated_windows_against_all_windows(docs, rows, empty, depth):
    rows = [r for r in rows if r[0] != 83] if depth < 200 else rows
    table = docs.filter("doc_id IS NULL OR doc_id <> 83") if depth < 200 else docs
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(table, "doc_id", "text", depth).collect())
    texts = [(t or "").encode() for _, t, *_ in rows]
    assert got == Counter((r[0], len(t), *c) for r, t, c in zip(rows, texts, cut_by_hand(texts, depth), strict=True))
    assert substring_dedup.remove_repeats(empty, "doc_id", "text", depth).count() == 0


def test_periodic_and_overlapping_windows(spark):
    texts = ["ab" * 150, "a" * 240, "ab" * 99 + "c" + "ab" * 101, "a" * 200, "é" * 130, "xyz" * 70 + "é" * 120, "q" * 199]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[2:] for r in substring_dedup.remove_repeats(table, "doc_id", "text").collect()}
    assert [got[k] for k in range(len(texts))] == list(cut_by_hand([t.encode() for t in texts], 200))


def mixed_by_hand(rows, alpha):
    sources, own = Counter(), defaultdict(list)
    for i, t, _, s in rows:
        n = len(SPACED.findall((t or "").encode()))
        sources[s or ""] += n
        own[s or ""].append((i, n))
    power = {s: t**alpha for s, t in sources.items() if t}
    z = sum(power.values())
    budget = max(sources[s] / p for s, p in power.items()) * z
    copies = Counter()
    for s, docs in own.items():
        quota = power.get(s, 0) / z * budget
        whole = int(quota / sources[s] + 1e-9) if sources[s] else 1
        left = quota - whole * sources[s]
        for i, _ in docs:
            copies[i] += whole
        if sources[s] and left > sources[s] * 1e-9:
            def place(d, turn=whole):
                return int(hashlib.md5(f"{'' if d[0] is None else d[0]}:{turn}".encode()).hexdigest()[:7], 16)

            before, held, last = 0, 0, None
            for d in sorted(docs, key=lambda d: (place(d), -(10**18) if d[0] is None else d[0], d[1])):
                if d != last:
                    before, held, last = before + held, 0, d
                held += d[1]
                copies[d[0]] += before < left
    return copies


def test_mixture_against_plain_sums(docs, rows, empty):
    got = mixing.mix(docs, "doc_id", "text", "source", most_passes=1.7, block_tokens=2000).collect()
    sources = docs.select(F.coalesce("source", F.lit("")).alias("source"), mixing.tokens(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("t"))
    alpha = mixing.exponent(sources, most_passes=1.7)
    assert 0 <= alpha <= 1
    assert Counter(r["doc_id"] for r in got) == mixed_by_hand(rows, alpha)
    blocks = defaultdict(list)
    for r in got:
        blocks[r["block"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in blocks.values())
    same = mixing.apply(docs, "doc_id", "text", "source", most_passes=1.7)
    assert same.columns == docs.columns and Counter(r["doc_id"] for r in same.collect()) == Counter(r["doc_id"] for r in got)
    assert mixing.mix(empty, "doc_id", "text", "source").count() == 0 and mixing.apply(empty, "doc_id", "text", "source").count() == 0


def test_equal_rows_are_spread_over_a_mixture(spark):
    """Many rows of one id, with and without tokens, stay whole and fill no block alone."""
    rows = [(None, "a b c d", "x")] * 300 + [(None, "", "x")] * 200 + [(k, "one two three", "y") for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix(table, "doc_id", "text", "source", block_tokens=100).collect()
    assert {r["doc_id"] for r in got} == {None, *range(100)} and len(got) >= len(rows)
    assert Counter(r["doc_id"] for r in got if r["n_tokens"] == 0)[None] % 200 == 0
    blocks = Counter(r["block"] for r in got if r["n_tokens"])
    assert max(blocks.values()) < 60 and len(blocks) > 10
    slots = defaultdict(list)
    for r in got:
        slots[r["block"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_exponent_meets_its_targets(spark):
    sizes = [1000, 300, 50, 10]
    table = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(sizes)], "source string, t bigint")

    def entropy(a):
        p = [t**a for t in sizes]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    a = mixing.exponent(table, 0.9, 1e9)
    assert abs(entropy(a) - 0.9 * math.log(4)) < 1e-4
    assert abs((1000 / 10) ** (1 - mixing.exponent(table, 0.9, 1.5)) - 1.5) < 1e-4
    assert mixing.exponent(table, 0.1, 1e9) == 1.0


def test_pipeline_stages(spark, docs, rows, items, empty, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = table
        table = stage(spark, table, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert table.columns == docs.columns, name
            table.write.parquet(f"{tmp_path}/{k}")
            table = spark.read.parquet(f"{tmp_path}/{k}")
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name == "language_id":
            blank = Counter(r[0] for r in rows if not re.search("[^\\W\\d_]", r[1] or ""))
            assert Counter(r["doc_id"] for r in before.collect()) - Counter(r["doc_id"] for r in table.collect()) == blank
        if name == "near_dedup":
            left = [(r["doc_id"], r["text"]) for r in before.collect()]
            found, _ = components(left, 5, 80)
            assert Counter(r["doc_id"] for r in table.collect()) == Counter(set(found))
        if name == "decontamination":
            assert 3 not in {r["doc_id"] for r in table.collect()}
        if name == "mixing":
            assert {r["doc_id"] for r in table.collect()} == {r["doc_id"] for r in before.collect()}
    assert table.count() == before.count()


def test_pipeline_run(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
