"""Operators that answer each row by itself: licences, fingerprints, token counts, language, language model."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanquarry.llm import fingerprints, language_id, licenses, lm_score, token_counts

SPACED = re.compile(rb"[^\x20\x09-\x0d]+")


def lowered(text):
    return SPACED.findall((text or "").encode().lower())


def test_licences_against_word_scan(docs, rows):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in licenses.scan(docs, "doc_id", "text").collect())
    want = Counter()
    for i, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want[(i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert got == want


def test_licences_of_the_method(docs, spark, empty):
    found = {r["doc_id"]: r for r in licenses.scan(docs, "doc_id", "text").collect()}
    assert found[70]["labels"] == "apache-2.0,cc-by,reserved" and found[70]["score"] == 1.0
    assert found[78]["score"] == 0.0 and found[78]["labels"] == ""
    partly = spark.createDataFrame([(1, "APACHE LICENSE, version 2.1"), (2, "license apache version"), (3, "Kİ all rights reserved")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(partly, "doc_id", "text").collect()}
    assert got[1]["labels"] == "apache-2.0" and 0 < got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[3]["first_word"] == 1
    assert licenses.scan(empty, "doc_id", "text").count() == 0


def test_every_notice_against_a_plain_search(spark):
    known = licenses.templates()
    texts = [" ".join(t["words"]) for t in known]
    texts += [" ".join(t["words"][1:]) for t in known]  # the first word is of a key phrase
    texts += [", ".join(w.upper() for w in t["words"]) + ". " + " ".join(u["words"]) for t, u in zip(known, known[1:] + known[:1], strict=True)]
    texts += [" ".join("other" if q not in t["must"] else w for q, w in enumerate(t["words"])) for t in known]
    texts += [" ".join(w for w in t["words"] if w != t["anchors"][0][0]) for t in known]
    want = {}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        labels, best, places = set(), 0.0, 0
        for t in known:
            for s in range(len(words)):
                if all(s + q < len(words) and words[s + q] == t["words"][q] for q in t["must"]):
                    labels.add(t["label"])
                    places += not t["base"]
                    best = max(best, sum(r for q, (w, r) in enumerate(zip(t["words"], t["rarity"], strict=True)) if s + q < len(words) and words[s + q] == w) / sum(t["rarity"]))
        want[i] = (",".join(sorted(labels)), pytest.approx(best, abs=1e-6), places)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: (r["labels"], r["score"], r["n_notices"]) for r in licenses.scan(table, "doc_id", "text").collect()} == want
    assert all(t["label"] in want[i][0].split(",") and want[i][1] == 1.0 for i, t in enumerate(known))


def plain_sketch(text, k=128, width=5):
    """The k smallest 48-bit hashes of a text's distinct shingles, a word and a byte at a time in Python's integers."""
    full = (1 << 64) - 1

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & full
        return x ^ (x >> 32)

    def factor(place):
        return mixed((place + 1) * (0x9E3779B97F4A7C15 | 1) & full) | 1

    lanes = [pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(16)]
    words = [mixed(sum((b + 1) * factor(k) for k, b in enumerate(w)) & full) for w in lowered(text)]
    if len(words) >= width:
        found = {mixed(sum(w * x for w, x in zip(words[i : i + width], lanes, strict=False)) & full) for i in range(len(words) - width + 1)}
    else:
        found = {mixed((sum(w * x for w, x in zip(words, lanes, strict=False)) & full) ^ len(words))} if words else set()
    return sorted({x >> 16 for x in found})[:k], len({x >> 16 for x in found})


def shared_of(a, b, k=128):
    """Jaccard estimate of two plain sketches."""
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})[:k]
    return sum(x in set(a) and x in set(b) for x in union) / len(union)


def test_fingerprints_follow_the_order_of_ids(spark, docs, rows, empty):
    hashed = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(r[0] if r[0] is not None else -(10**18)), hashed.get(r[1], hashed[None])))
    want = Counter()
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        (a, n), (b, _), (c, _) = (plain_sketch(x) for x in (t, e, following))
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), b"".join(x.to_bytes(6, "big") for x in a), round(shared_of(a, b), 9), round(shared_of(a, c), 9), n if n < 128 else None)] += 1
    for ranges in (1, 7, 40):
        got = Counter()
        for r in fingerprints.fingerprint_edits(docs, "doc_id", "text", ranges=ranges).collect():
            n = r["n_distinct"]
            got[(r["doc_id"], r["n_chars"], r["edited_sha256"], base64.b64decode(r["fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9), int(n) if len(base64.b64decode(r["fingerprint"])) < 6 * 128 else None)] += 1
            assert 0 <= r["kept_share"] <= 1 and r["distinct_both"] >= 0
        assert got == want
    assert fingerprints.fingerprint_edits(empty, "doc_id", "text").count() == 0
    assert fingerprints.fingerprint_edits(docs.filter("doc_id = 4"), "doc_id", "text").first()["near_next"] == 1.0


def test_sketches_merge_and_estimate():
    a = " ".join(f"a{i}" for i in range(3000)).encode()
    b = " ".join(f"a{i}" for i in range(1500, 4500)).encode()
    x, y, both = fingerprints.sketches([a, b, a + b" cut " + b])
    union = fingerprints.merge(x, y)
    assert np.isin(union, both).mean() > 0.95
    assert abs(fingerprints.distinct(x) / 2996 - 1) < 0.3
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.15 and abs(fingerprints.containment(x, y) - 0.5) < 0.2
    assert (fingerprints.loads(fingerprints.dumps(x)) == x).all()


VOCABULARY = "byte_bpe_50k.json"


def test_token_counts_against_the_library(docs, rows, empty):
    pytest.importorskip("public_tokenizers")
    plain = token_counts.tokenizer(VOCABULARY)
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, "doc_id", "text", VOCABULARY, 100).collect())
    want = Counter()
    for i, text, *_ in rows:
        n = len(plain.encode(text or "", add_special_tokens=False))
        want[(i, len((text or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts.count_tokens(empty, "doc_id", "text", VOCABULARY, 100).count() == 0


def test_cut_texts_count_as_whole():
    pytest.importorskip("public_tokenizers")
    plain = token_counts.tokenizer(VOCABULARY)
    texts = ["it's we'll  two  spaces\n\n and<|endoftext|> more <|endoftext|> é è 漢字 ab 12 cd" * 40, "a" * 5000, " " * 3000, "x y" * 2000]
    for text in texts:
        assert "".join(token_counts.pieces(text, 50)) == text
        assert token_counts.lengths([text], VOCABULARY, 200, 50)[0] == len(plain.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_as_their_library(spark, vocabulary):
    pytest.importorskip("public_tokenizers")
    plain = token_counts.tokenizer(vocabulary)
    texts = ["It's  two words, é 漢字\n<|endoftext|> don't You" * 30, "", None, "a" * 3000, "x y " * 20_000]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text", vocabulary, 9).collect()}
    if vocabulary.endswith(".model"):
        assert not token_counts.cuttable(vocabulary)
        want = [len(plain.encode(t or "")) for t in texts]
    else:
        assert token_counts.cuttable(vocabulary)
        want = [len(plain.encode(t or "", add_special_tokens=False)) for t in texts]
    assert got == dict(enumerate(want))
    assert list(token_counts.lengths([t or "" for t in texts], vocabulary, 300, 40)) == want


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 5, 8])
    potentials, begin, step = rng.random((8, 3)) + 0.1, rng.random(3) + 0.1, rng.random((3, 3)) + 0.1
    gamma, moves = language_id.marginals(potentials, first, begin, step)
    want, want_moves = np.zeros((8, 3)), np.zeros((3, 3))
    for lo, hi in itertools.pairwise(first):
        paths = list(itertools.product(range(3), repeat=hi - lo))
        weights = [begin[p[0]] * potentials[lo, p[0]] * math.prod(step[p[t - 1], p[t]] * potentials[lo + t, p[t]] for t in range(1, len(p))) if p else 1.0 for p in paths]
        for p, w in zip(paths, weights, strict=True):
            for t, x in enumerate(p):
                want[lo + t, x] += w / sum(weights)
                if t:
                    want_moves[p[t - 1], x] += w / sum(weights)
    assert np.allclose(gamma, want) and np.allclose(moves, want_moves)


def test_language_of_held_out_documents(docs, rows, empty):
    got = language_id.identify(docs, "doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, text, lang, _ in rows if i is not None}
    for r in got:
        text = next((t for i, t, *_ in rows if i == r["doc_id"]), None)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and not re.search("[^\\W\\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["lang_pred"] != "und" and r["doc_id"] < 78]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert language_id.identify(empty, "doc_id", "text", "lang").count() == 0


def test_language_learned_from_long_documents_alone(spark):
    """A label is learned if all its documents are long, or share one id, or have none."""
    kinds = {"aa": "kalo tumi rasa belo", "bb": "wyzq xhgt prkv zzdf", "cc": "oeui eaio uoie aeou"}
    rng = np.random.default_rng(3)
    texts = {k: lambda n, w=w: " ".join(rng.choice(w.split(), n)) for k, w in kinds.items()}
    rows = [(None, texts["aa"](40), "aa") for _ in range(40)] + [(1, texts["bb"](45_000), "bb") for _ in range(3)] + [(1, texts["cc"](40), "cc") for _ in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(table, "doc_id", "text", "lang", docs_per_label=15)
    assert model["labels"] == ["aa", "bb", "cc"]
    langs, _ = language_id.predict(pa.array([texts[k](30) for k in kinds]), np.ones(3, dtype=bool), model)
    assert langs == list(kinds)


def test_every_label_is_learned(spark):
    """Seventy labels, all of them predicted; too many are refused."""
    words = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("om", "ur", "eth", "is")] for k in range(70)}
    rows = [(1, " ".join(w[(j + k) % 4] for k in range(12 + j)), lang) for lang, w in words.items() for j in range(6)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(table, "doc_id", "text", "lang", docs_per_label=6)
    assert model["labels"] == sorted(words)
    langs, _ = language_id.predict(pa.array([" ".join(w * 3) for w in words.values()]), np.ones(70, dtype=bool), model)
    assert langs == list(words)
    many = spark.range(language_id.MOST_LABELS + 1).selectExpr("1L AS doc_id", "'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(many, "doc_id", "text", "lang")


def test_language_model_base_is_exact(docs, rows, empty):
    train = Counter()
    for i, text, *_ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            train.update([*lowered(text), None])
    total, kinds = sum(train.values()), len(train)
    want = Counter()
    for i, text, *_ in rows:
        tokens = [*lowered(text), None]
        base = sum(math.log10((train[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in tokens)
        want[(i, len(tokens), sum(train[x] > 0 for x in tokens), total, round(base, 6))] += 1
    for most in (1 << 18, 10, 0):  # all words shipped, few, none
        got = lm_score.score(docs, "doc_id", "text", most_words=most, clustered=20, classes=4).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    assert lm_score.score(empty, "doc_id", "text").count() == 0


def plain_class_model(training, most, clustered, classes):
    """(score of a token list, next-token probabilities) by dictionaries of word counts, for given limits."""
    counts = Counter(x for tokens in training for x in tokens)
    words = [w for w in counts if w is not None]
    limit = min((c for c in set(counts.values()) if sum(counts[w] >= c for w in counts) <= most), default=None)
    known = [w for w in words if limit is not None and counts[w] >= limit]
    code = {w: int(lm_score.Words(*lm_score_raw(w)).hash[0]) for w in words}
    chosen = sorted(known, key=lambda w: (-counts[w], code[w]))[:clustered]
    place = {w: k for k, w in enumerate(chosen)}
    n = len(chosen)

    def table(symbol, size):
        out = np.zeros((size, size))
        for tokens in training:
            for a, b in itertools.pairwise([None, *tokens]):
                out[symbol(a), symbol(b)] += 1
        return out

    bigrams = table(lambda w: n + 2 if w is None else place.get(w, n if w in set(known) else n + 1), n + 3)
    kind = lm_score.exchange(bigrams, classes)
    every, own = int(kind[-1]) + 1, {}
    for w in words:
        own[w] = int(kind[place[w]]) if w in place else every - 3 if w in known else every - 2
    own[None] = every - 1
    joint = table(own.get, every)
    if len(known) > n > 0:
        moved = dict(own)
        for w in known:
            if w in place:
                continue
            after, before = np.zeros(every), np.zeros(every)
            for tokens in training:
                for a, b in itertools.pairwise([None, *tokens]):
                    after[own[b]] += a == w
                    before[own[a]] += b == w
            best = []
            for k in range(every - 3):
                f = lambda x: x * math.log(x) if x > 0 else 0.0
                gain = sum(f(joint[k, x] + after[x]) - f(joint[k, x]) + f(joint[x, k] + before[x]) - f(joint[x, k]) for x in range(every))
                gain -= f(joint[k].sum() + after.sum()) - f(joint[k].sum()) + f(joint[:, k].sum() + before.sum()) - f(joint[:, k].sum())
                best.append((-round(gain, 9), k))
            moved[w] = min(best)[1]
        own = moved
        joint = table(own.get, every)
    held, types = Counter(), Counter()
    for w, c in counts.items():
        held[own[w]] += c
        types[own[w]] += 1
    types[every - 1] = 1
    prior = (joint.sum(0) + 1e-3) / (joint.sum() + 1e-3 * every)

    def probability(a, w):
        k = own.get(w, every - 2)
        step = (joint[a, k] + lm_score.BACK_OFF * prior[k]) / (joint[a].sum() + lm_score.BACK_OFF)
        return step * (counts[w] + lm_score.ADD) / (held[k] + lm_score.ADD * (types[k] + 1)), k

    def score(tokens):
        total, a = 0.0, every - 1
        for w in tokens:
            p, a = probability(a, w)
            total += math.log10(p)
        return total

    sums = [sum(probability(a, w)[0] for w in counts) + sum((joint[a, k] + lm_score.BACK_OFF * prior[k]) / (joint[a].sum() + lm_score.BACK_OFF) * lm_score.ADD / (held[k] + lm_score.ADD * (types[k] + 1)) for k in range(every)) for a in range(every)]
    return score, sums


def lm_score_raw(word):
    return np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)])


def test_scores_against_a_plain_model(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[(i % 3) * 10 :: 2], rng.integers(1, 40))) for i in range(90)] + ["never seen", "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    training = [[*lowered(t), None] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    for most, clustered, classes in ((1 << 18, 12, 4), (25, 8, 3), (0, 8, 3), (1 << 18, 1000, 5)):
        score, sums = plain_class_model(training, most, clustered, classes)
        got = {r["doc_id"]: r["score"] for r in lm_score.score(table, "doc_id", "text", most_words=most, clustered=clustered, classes=classes).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], [score([*lowered(t), None]) for t in texts], atol=1e-6)
        assert np.allclose(sums, 1.0)


def test_class_model_is_a_distribution_and_exchange_helps():
    rng = np.random.default_rng(3)
    # two hidden classes that alternate
    bigrams = np.zeros((13, 13))
    for a in range(10):
        for b in range(10):
            bigrams[a, b] = rng.integers(50, 60) if (a < 5) != (b < 5) else rng.integers(0, 3)
    kind = lm_score.exchange(bigrams, 2)
    assert len({*kind[:5]}) == len({*kind[5:10]}) == 1 and kind[0] != kind[5]
    assert list(kind[10:]) == [2, 3, 4]
