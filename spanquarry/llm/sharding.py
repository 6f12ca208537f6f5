"""Sharding by jump consistent hashing, in DataFrame functions only.

``jump_hash`` is the published algorithm: a 64-bit linear congruential generator seeded by the key jumps
from bucket to bucket until it passes the last one. It needs no ring table, and with one more shard a key
either stays or moves into the new shard. State is an unsigned 64-bit number held as a decimal, since
Spark's ANSI long arithmetic refuses to wrap.

``shard_rows`` numbers each shard's rows without gaps. A row's place is its rank among the rows of one of
``buckets`` hash buckets of its shard plus the rows of the buckets before. The bucket totals are at most
shards * buckets rows, and no task sorts a whole shard. Rows that agree in key, size and checksum are
counted before the shuffle and given consecutive slots, so a hot key is one row until the slots are dealt.

Defined cases: a null key takes the place of key -1, a null text has size 1 and the checksum of no bytes;
repeated rows each get a slot; other columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
BUCKETS = 256
RUN = 1 << 16


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a long key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    wide = "decimal(38,0)"
    modulus = F.lit(str(1 << 64)).cast(wide)

    def jump(state: Column, _: Column) -> Column:
        seed = (state["seed"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast(wide) + F.lit(1)
        seed = (seed.cast(wide) % modulus).cast("decimal(20,0)")
        high = F.floor(seed / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
        ahead = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / (high + 1.0))).cast("bigint")
        moved = F.struct(seed.alias("seed"), state["next"].alias("at"), ahead.alias("next"))
        return F.when(state["next"] >= shards, state).otherwise(moved)

    unsigned = F.when(key < 0, key.cast(wide) + modulus).otherwise(key.cast(wide)).cast("decimal(20,0)")
    start = F.struct(unsigned.alias("seed"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump)

    # each jump passes at least one bucket, so `shards` steps always suffice; few keys need over 64
    return walk(start, min(shards, 64))["at"].cast("int") if shards <= 64 else _long_walk(walk, start, shards)


def _long_walk(walk, start: Column, shards: int) -> Column:
    first = walk(start, 64)
    return F.when(first["next"] >= shards, first["at"]).otherwise(walk(first, shards)["at"]).cast("int")


def shard_rows(docs: DataFrame, id_col: str, text_col: str, shards: int, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard with one more) of every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key = F.coalesce("doc_id", F.lit(-1))
    kinds = kinds.select(
        "*",
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    by_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    placed = kinds.withColumn("before", F.sum("n").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    totals = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select("shard", "bucket", (F.sum("n").over(by_shard) - F.col("n")).alias("offset"))
    placed = placed.join(F.broadcast(offsets) if shards * buckets <= 1 << 16 else offsets, ["shard", "bucket"])
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("before")).alias("start"), "n", "grown_shard",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))).alias("run"),
    )
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    dealt = placed.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, last)))
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("k")).alias("slot"), "grown_shard")
