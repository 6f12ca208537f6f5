"""Every operator on texts of a megabyte and more, beside short ones."""

import hashlib
import random
import re

import pytest

from spanquarry.llm import decontaminate, fingerprints, language_id, licenses, lm_score, mixing, near_dedup, sharding, substring_dedup, token_counts
from tests.llm.conftest import ITEM, prose

SPACES = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    long = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(180_000))
    near = long.split()
    near[90_000] = "changed"
    passage = prose(rng, 60)
    return {
        1: long,
        2: " ".join(near) + " " + ITEM,
        3: "x" * 1_500_000,  # one word, one window over and over
        4: passage + " all rights reserved",
        5: "mit license " * 100_000,
        6: prose(rng, 40) + " " + passage,
    }


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, "fr" if i == 6 else "en", "s", len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").cache()


def by_id(found):
    return {r["doc_id"]: r for r in found.collect()}


def test_licences(table, texts):
    got = by_id(licenses.scan(table, "doc_id", "text"))
    assert {i: r["n_words"] for i, r in got.items()} == {i: len(re.findall("[a-z]+", t)) for i, t in texts.items()}
    assert (got[5]["labels"], got[5]["n_notices"]) == ("mit", 100_000) and got[4]["labels"] == "reserved"
    assert got[1]["labels"] == got[3]["labels"] == ""


def test_near_copies(table, texts):
    linked, _ = near_dedup.link(table, "doc_id", "text", width=3, percent=85)
    got = by_id(linked)
    cut = {i: t.split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, w in cut.items()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_fingerprints(table, texts):
    got = by_id(fingerprints.fingerprint_edits(table, "doc_id", "text"))
    assert {i: r["n_chars"] for i, r in got.items()} == {i: len(t) for i, t in texts.items()}
    edited = texts[2][: len(texts[2]) - len(texts[2]) // 2] + texts[1][: len(texts[2]) // 2]
    assert got[2]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[2]["near_next"] > 0.9


def test_decontamination(spark, table):
    items = spark.createDataFrame([(1, ITEM), (2, "never seen words here at all now")], "item_id bigint, text string")
    kept = {r["doc_id"] for r in decontaminate.clean(table, "text", items, "item_id", "text").collect()}
    assert kept == {1, 3, 4, 5, 6}


def test_token_counts(table, texts):
    pytest.importorskip("public_tokenizers")
    plain = token_counts.tokenizer("byte_bpe_50k.json")
    got = by_id(token_counts.count_tokens(table.filter("doc_id <> 3"), "doc_id", "text", "byte_bpe_50k.json", 1024))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(plain.encode(t, add_special_tokens=False)) for i, t in texts.items() if i != 3}


def test_scores(table, texts):
    got = by_id(lm_score.score(table, "doc_id", "text"))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(t.split()) + 1 for i, t in texts.items()}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got.values())


def test_shards_and_mixture(table, texts):
    got = by_id(sharding.shard_rows(table, "doc_id", "text", 16))
    assert {i: r["size"] for i, r in got.items()} == {i: len(t) + 1 for i, t in texts.items()}
    assert {r["doc_id"] for r in mixing.mix(table, "doc_id", "text", "source").collect()} == set(texts)


def test_repeated_windows(table, texts):
    got = by_id(substring_dedup.remove_repeats(table, "doc_id", "text"))
    seen, twice = set(), set()
    for t in texts.values():
        for k in range(len(t) - 199):
            h = hash(t[k : k + 200])
            (twice if h in seen else seen).add(h)
    for i, t in texts.items():
        rest, reach, spans = [], 0, 0
        for k, c in enumerate(t):
            if k + 200 <= len(t) and hash(t[k : k + 200]) in twice:
                spans += k >= reach and (k > reach or not reach)
                reach = k + 200
            if k >= reach:
                rest.append(c)
        rest = "".join(rest)
        assert got[i]["n_removed"] == len(t) - len(rest)
        assert got[i]["kept_sha256"] == hashlib.sha256(rest.encode()).hexdigest()
        assert got[i]["n_spans"] == spans


def test_language(table):
    model = language_id.fit(table, "doc_id", "text", "lang")
    found = by_id(language_id.annotate(table.select("doc_id", "text"), "text", model).select("row.doc_id", "lang_pred", "score"))
    assert len(found) == 6 and all(r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1 for r in found.values())
