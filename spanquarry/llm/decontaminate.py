"""Benchmark decontamination by an asymmetric MinHash containment search, in DataFrame functions only.

A test item of twenty shingles inside a document of twenty thousand has a Jaccard likeness near 0.001, so
signatures of whole documents cannot find it. The search is therefore asymmetric: an item is
indexed by the minima of its shingles under so many random orders that an item of which a document holds the
wanted share has at least one minimum in the document but for a chance of ``MISS``. That chance depends on the
share alone, so one number serves items of all sizes; an item of no more shingles is indexed whole. Every document's full set of shingle hashes is looked up in that index; a pair of
document and item that meets is verified by exact containment of the shingles themselves, as words.

The documents are read once and not shuffled. The index is a set of at most ``LITERAL`` numbers inside the
plan where the items are that few, and the postings that are shipped hold numbers alone; beyond it the documents'
shingles are joined with the index by hash. The items' shingles, of any length, meet the pairs that are left by
a join on the item, shipped only if they have at most ``MOST_BYTES``. The index is computed and written once.

Defined cases: an item without words is found nowhere; one of fewer words than a shingle is one shingle of
its own width; a null text has no shingles; rows that repeat an id give a row each per item, equal rows
once; a null id stays null; other columns of any name are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.storage import Scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MISS = 1e-9
LITERAL = 20_000
MOST_BYTES = 8 << 20


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")


def _runs(words: Column, width: Column | int, of) -> Column:
    """``of`` applied to every run of ``width`` words."""
    width = F.lit(width) if isinstance(width, int) else width
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of(F.slice(words, i, width)))


def index(items: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """A row per item with words: item_id, width, shingles (texts), size_class and anchors (hashes of its minima)."""
    cut = items.select(F.col(id_col).cast("bigint").alias("item_id"), _words(text_col).alias("w"))
    cut = cut.withColumn("width", F.least(F.lit(width), F.size("w"))).filter(F.col("width") > 0)
    cut = cut.withColumn("shingles", F.array_sort(F.array_distinct(_runs(F.col("w"), F.col("width"), lambda run: F.array_join(run, " ")))))
    cut = cut.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))
    cut = cut.withColumn("size_class", F.floor(F.log2(F.size("shingles"))).cast("int"))
    wanted = max(1, math.ceil(math.log(MISS) / math.log(1 - percent / 100))) if percent < 100 else 1
    orders = F.least(F.lit(wanted), F.shiftleft(F.lit(1), 1) * F.pow(F.lit(2), F.col("size_class"))).cast("int")
    least = F.transform(F.sequence(F.lit(1), orders), lambda k: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, k).alias("o"), h.alias("h"))))["h"])
    small = F.size("shingles") <= wanted  # all shingles of a small item are as few as its minima would be
    return cut.select("item_id", "width", "shingles", "size_class", F.when(small, F.col("hashes")).otherwise(F.array_distinct(least)).alias("anchors"))


def contained(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, width: int = 5, percent: int = 80, literal: int = LITERAL) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment where a document holds ``percent`` of an item's shingles."""
    found = _meeting(docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id")).alias("row"), F.col(text_col).alias("t")), items, item_id, item_text, width, percent, literal)
    return found.select("row.doc_id", "item_id", "n_shared", "n_item", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment")).distinct()


def _meeting(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int, percent: int, literal: int) -> DataFrame:
    """row, item_id, n_shared and n_item of the verified pairs, from (row, t)."""
    indexed = Scratch(docs.sparkSession, "decontamination").save(index(items, item_id, item_text, width, percent).withColumn("item", F.monotonically_increasing_id()), "index")
    text = F.aggregate("shingles", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s) + 32)
    sizes = {r["width"]: r for r in indexed.groupBy("width").agg(F.sum(F.size("anchors")).alias("n"), F.sum(text).alias("b")).collect()}
    parts = [_of_width(docs, indexed.filter(F.col("width") == w), w, percent, r["n"] <= literal, r["b"] <= MOST_BYTES) for w, r in sorted(sizes.items())]
    if not parts:
        return _of_width(docs, indexed, width, percent, False, False)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _of_width(docs: DataFrame, indexed: DataFrame, width: int, percent: int, few: bool, short: bool) -> DataFrame:
    postings = indexed.select(F.explode_outer("anchors").alias("h"), "item", "anchors")
    known = indexed.select("item", "item_id", "shingles")
    cut = docs.select("row", _words("t").alias("w"))
    hashed = cut.select("row", "w", _runs(F.col("w"), width, F.xxhash64).alias("all"))
    if few:
        numbers = [r["h"] for r in postings.select("h").distinct().collect()]
        hits = F.array_distinct(F.filter("all", lambda h: h.isin(numbers)))
        # explode_outer: explode's own filter would be pushed below the cut and repeat it for every shingle
        met = hashed.select("row", "w", hits.alias("hits"))
        met = met.select("row", "w", "hits", F.explode_outer("hits").alias("h")).join(F.broadcast(postings), "h")
        # the pair's first common hash stands for it
        met = met.filter(F.col("h") == F.array_min(F.array_intersect("anchors", "hits"))).select("row", "w", "item")
    else:
        # the index is too large to ship: look the shingles up by a join, one row a document and item
        keyed = hashed.withColumn("id", F.xxhash64(F.to_json("row"), F.array_join("w", " ")))
        looked = keyed.select("id", F.explode_outer(F.array_distinct("all")).alias("h")).join(postings.select("h", "item"), "h")
        met = keyed.select("id", "row", "w").join(looked.select("id", "item").distinct(), "id")
    met = met.join(F.broadcast(known) if short else known, "item")
    texts = F.array_distinct(_runs(F.col("w"), width, lambda run: F.array_join(run, " ")))
    shared = F.size(F.array_intersect(texts, F.col("shingles"))).cast("bigint")
    out = met.select("row", "item_id", shared.alias("n_shared"), F.size("shingles").cast("bigint").alias("n_item"))
    return out.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def clean(docs: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, columns as they are, that hold ``percent`` of no item's shingles.

    Rows are told apart by a hash of their whole text, which is what a hit depends on.
    """
    stamp = F.xxhash64(F.coalesce(F.col("t"), F.lit("")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("t"))
    keys = docs.select(F.col(text_col).alias("t")).select(F.struct(stamp.alias("s"), F.crc32(F.coalesce(F.col("t"), F.lit("")).cast("binary")).alias("c")).alias("row"), "t")
    bad = _meeting(keys, items, item_id, item_text, width, percent, LITERAL).select("row.s", "row.c").distinct()
    told = rows.select("row", stamp.alias("s"), F.crc32(F.coalesce(F.col("t"), F.lit("")).cast("binary")).alias("c"))
    return told.join(bad, ["s", "c"], "left_anti").select("row.*")


def contained_sql(width: int = 5, percent: int = 80) -> str:
    """DuckDB SQL that compares all shingles of all documents with all items'."""
    word = "regexp_extract_all(lower(coalesce(text,'')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH iw AS (SELECT item_id, {word} AS w FROM benchmark),
i1 AS (SELECT item_id, w, least({width}, len(w)) AS k FROM iw WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w)-k+2)) AS i FROM i1)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
dw AS (SELECT doc_id, {word} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s
 FROM (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM dw, (SELECT DISTINCT k FROM items)))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item, round(count(*)/any_value(n)::DOUBLE, 6) AS containment
FROM shingles JOIN items USING (k, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*)*100 >= any_value(n)*{percent}"""
