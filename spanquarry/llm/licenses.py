"""Licence scans over whole texts with a positional rare-token index, in DataFrame functions only.

Each notice of ``NOTICES`` is a template of words with mandatory key phrases. The index maps the rarest words
of all templates to postings (template and position), rarity being the inverse document frequency over the
templates; a map for the rarest and one for the second word. A text is cut into words once; its words that
the index knows are looked up, the templates' starts that follow from the postings of both maps are
intersected, and what is left are the places where both words of a template stand in the right distance.
There the key phrases are compared word by word. A place scores the share of the template's words, weighted
by rarity, that stand where the template has them. Templates, postings and key phrases are constants that a
few expressions read, so the plan does not grow with the number of templates.

All of it happens within a row: no shuffle, no explode, no driver state but the fixed templates.

Defined cases: a null or empty text has no words, no labels, null first_word and last_word and score 0;
every input row gives one output row, repeated rows included; a null id stays null; other columns of any
name are ignored; an empty table gives an empty result; equal words tie by their place in the template; a text of any length is
one row, cut as a whole into words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Licence notices as (label, words of the notice, key phrases that must stand verbatim).
# A notice begins with a word of a key phrase.
NOTICES = (
    ("apache-2.0", "apache license version 2 0", ("apache license", "version 2")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("licensed under the apache license", "you may not use this file except in compliance with the license")),
    ("mit", "mit license", ("mit license",)),
    ("mit", "free of charge to any person obtaining a copy of this software", ("free of charge", "any person obtaining a copy")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "any person obtaining a copy", "to deal in the software without restriction")),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("this program is free software", "gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("this program is free software", "gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("lgpl", "lesser general public license", ("lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("this library is free software", "gnu lesser general public license as published by the free software foundation")),
    ("agpl", "affero general public license", ("affero general public license",)),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("this program is free software", "gnu affero general public license as published by the free software foundation")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of the copyright holder", "endorse or promote products derived from this software")),
    ("bsd", "bsd license", ("bsd license",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("this source code form is subject to the terms of the mozilla public license",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("this program and the accompanying materials", "eclipse public license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify", "for any purpose")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("unlicense", "free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("this is free and unencumbered software", "anyone is free to copy")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("this software is provided as is", "in no event will the authors be held liable")),
    ("boost", "boost software license", ("boost software license",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("permission is hereby granted free of charge", "person or organization obtaining a copy")),
    ("artistic", "artistic license 2 0", ("artistic license",)),
    ("ofl", "sil open font license version 1 1", ("open font license", "sil")),
    ("gfdl", "gnu free documentation license", ("gnu free documentation license",)),
    ("odbl", "open database license", ("open database license",)),
    ("public-domain", "dedicated to the public domain", ("dedicated to the public domain",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "waived all copyright and related or neighboring rights")),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc-by-nd", "creative commons attribution noderivatives", ("creative commons attribution noderivatives",)),
    ("cc-by", "creative commons attribution", ("creative commons attribution",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("this work is licensed under a creative commons attribution",)),
    ("proprietary", "proprietary and confidential", ("proprietary and confidential",)),
)
ANCHORS = 2
# A place is one number: the template above ``PLACE_BITS`` bits, below them its start in the text plus ``BIAS``,
# which is more than any template's words, so that a template cut off by the text's beginning stays a number.
PLACE_BITS = 32
BIAS = 1 << 16


def templates() -> list[dict]:
    """Base phrases, then notices: label, words, positions that must match, rarities, and anchors (word, position)."""
    given = [(label, phrase, (phrase,), True) for phrase, label in BASE]
    given += [(*notice, False) for notice in NOTICES]
    texts = [phrase.split() for _, phrase, _, _ in given]
    rarity = {w: math.log(1 + len(texts) / sum(w in t for t in texts)) for t in texts for w in t}
    out = []
    for (label, _, keys, base), words in zip(given, texts, strict=True):
        must: set[int] = set()
        for key in keys:
            part = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            must |= set(range(at, at + len(part)))
        order = sorted(must, key=lambda i: (-rarity[words[i]], i))
        anchors: dict[str, int] = {}
        for i in order:
            anchors.setdefault(words[i], i)
        if 0 not in must or len(anchors) < ANCHORS or len(words) > BIAS:
            raise ValueError(f"not a template of {ANCHORS} key words that begins with one: {label}")
        out.append(
            {
                "label": label, "base": base, "words": words, "must": sorted(must),
                "rarity": [rarity[w] for w in words], "anchors": list(anchors.items())[:ANCHORS],
            }
        )
    return out


def _postings(known: list[dict], rank: int) -> Column:
    """The index of the anchors of a rank: word -> places (see ``BIAS``) of template starts, for the word at 0."""
    lists: dict[str, list[int]] = {}
    for k, t in enumerate(known):
        word, at = t["anchors"][rank]
        lists.setdefault(word, []).append((k << PLACE_BITS) + BIAS - at)
    pairs = ((F.lit(word), F.array(*map(F.lit, found)).cast("array<bigint>")) for word, found in lists.items())
    return F.create_map(*(c for pair in pairs for c in pair))


def _template(place: Column) -> Column:
    return F.shiftright(place, PLACE_BITS).cast("int")


def _start(place: Column) -> Column:
    return (place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - BIAS).cast("int")


def _words_at(known: list[dict], positions) -> Column:
    """Of every template, the words at some of its positions with their rarity."""
    return F.array(*(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(t["words"][q]).alias("v"), F.lit(t["rarity"][q]).alias("r")) for q in positions(t))) for t in known))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_notices of every row."""
    known = templates()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Two characters beyond A-Z become ASCII letters under lower(); texts that hold one take the slow way.
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.when(odd, F.translate(text, upper, low)).otherwise(F.lower(text))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.array_remove(F.split(lowered, SEPARATORS), "").alias("w"))
    index = sorted({w for t in known for w, _ in t["anchors"]})
    marks = F.transform("w", lambda w, i: F.when(w.isin(index), i))
    rows = rows.select("doc_id", "w", F.filter(marks, lambda i: i.isNotNull()).alias("hits"))

    def looked_up(rank: int) -> Column:
        postings, none = _postings(known, rank), F.array().cast("array<bigint>")
        return F.flatten(F.transform("hits", lambda i: F.transform(F.coalesce(F.element_at(postings, F.get("w", i)), none), lambda p: p + i)))

    must = _words_at(known, lambda t: t["must"])
    common = reduce(F.array_intersect, (looked_up(rank) for rank in range(ANCHORS)))
    verified = F.filter(common, lambda p: F.forall(F.get(must, _template(p)), lambda x: F.coalesce(F.get("w", _start(p) + x["q"]) == x["v"], F.lit(False))))
    rows = rows.select("doc_id", "w", verified.alias("places"))
    first_notice = len(BASE) << PLACE_BITS
    rows = rows.select("*", F.filter("places", lambda p: p < first_notice).alias("base"))
    every = _words_at(known, lambda t: range(len(t["words"])))
    totals, names = F.array(*(F.lit(sum(t["rarity"])) for t in known)), F.array(*(F.lit(t["label"]) for t in known))

    def share(p: Column) -> Column:
        stands = lambda x: F.when(F.get("w", _start(p) + x["q"]) == x["v"], x["r"]).otherwise(0.0)
        return F.aggregate(F.get(every, _template(p)), F.lit(0.0), lambda sum_, x: sum_ + stands(x)) / F.get(totals, _template(p))

    def labels(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, _template(p))))), ",")

    return rows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", _start)).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", _start)).cast("bigint").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", share)), F.lit(0.0)), 6).alias("score"),
        (F.size("places") - F.size("base")).cast("bigint").alias("n_notices"),
    )


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` over ``documents`` that tries every template at every word."""
    known = templates()
    starts, shares = [], []
    for k, t in enumerate(known):
        test = " AND ".join(f"w[s+{q + 1}]='{t['words'][q]}'" for q in t["must"])
        starts.append(f"list_filter(range(len(w)), lambda s: coalesce({test}, false)) AS s{k}")
        if t["base"]:
            shares.append(f"(CASE WHEN len(s{k})>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
        else:
            terms = "+".join(f"(CASE WHEN w[s+{q + 1}]='{w}' THEN {r!r}::DOUBLE ELSE 0.0::DOUBLE END)" for q, (w, r) in enumerate(zip(t["words"], t["rarity"], strict=True)))
            shares.append(f"coalesce(list_max(list_transform(s{k}, lambda s: ({terms})/{sum(t['rarity'])!r}::DOUBLE)), 0.0::DOUBLE)")

    def labels(which) -> str:
        items = ",".join(f"CASE WHEN len(s{k})>0 THEN '{t['label']}' END" for k, t in enumerate(known) if which(t))
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL))), ','), '')"

    base = [k for k, t in enumerate(known) if t["base"]]
    other = [k for k, t in enumerate(known) if not t["base"]]
    every = "||".join(f"s{k}" for k in base)
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, w, {", ".join(starts)} FROM cut)
SELECT doc_id, len(w)::BIGINT AS n_words, ({"+".join(f"len(s{k})" for k in base)})::BIGINT AS n_base,
 list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
 {labels(lambda t: t["base"])} AS base_labels, {labels(lambda t: True)} AS labels,
 round(greatest({", ".join(shares)}), 6) AS score, ({"+".join(f"len(s{k})" for k in other)})::BIGINT AS n_notices
FROM found"""
