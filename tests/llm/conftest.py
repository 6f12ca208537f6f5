import random

import pytest

WORDS = {
    "en": "the of and to in that was with from this which their been house water letter morning".split(),
    "fr": "le la les des une dans pour avec est que maison lettre matin eau toujours été très".split(),
}
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "x", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): copies, near copies, passages, licences, nulls, blanks, repeats, a long text."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        out.append([i, prose(rng, rng.randint(5, 120), lang), lang, f"src{i % 4 if i % 2 else 0}"])
    base = prose(rng, 200)
    words = base.split()
    for i in range(60, 72):  # a family of edits
        edit = list(words)
        edit[rng.randrange(200)] = f"edit{i}"
        out.append([i, " ".join(edit), "en", "src0"])
    for i in range(72, 78):
        out.append([i, base, "en", "src0"])
    out[3][1] += " " + ITEM.upper()
    out[70][1] = out[70][1] + " Licensed under the Apache License, Version 2.0. All rights reserved. CC-BY 4.0"
    out[5][1] += " all rights reserved all rights reserved"
    out += [[78, None, "en", "src1"], [79, "", None, None], [80, " \n\t ", "en", "src1"], [81, "one two", "en", "src2"], [82, "12 34 !!", "fr", "src2"]]
    out += [[83, prose(rng, 6000), "en", "src3"], [None, base, "en", None], [None, "only here é <|endoftext|> naïve", "fr", "src1"]]
    out += [list(out[7]), list(out[7]), list(out[81])]  # repeated rows
    return [tuple(r) for r in out]


CLASH = ("score", "shard", "row", "t", "w", "digest", "n_tokens", "key")


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *("clash",) * len(CLASH)) for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "never seen words here at all now"), (3, None), (4, ""), (5, "one two")], "item_id bigint, text string")
