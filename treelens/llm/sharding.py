"""Sharding by jump consistent hashing, without a ring table.

A key walks from shard to shard; each jump is drawn from a 64-bit linear
congruential generator seeded with the key, and the last jump below the number
of shards is the key's shard.  With one shard more, a key either stays or goes
to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The generator's multiplier, as published; arithmetic is modulo 2**64.
MULTIPLIER = 2862933555777941757
#: Slots are numbered in so many parts of a shard, and then put one after another.
PARTS = 1024


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, on halves of 32 bits, so that no product overflows a long."""
    mask32, mask16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF

    def times(x: Column, m: int) -> Column:
        """x * m modulo 2**32."""
        return (x * F.lit(m & 0xFFFF) + F.shiftleft((x * F.lit(m >> 16)).bitwiseAND(mask16), 16)).bitwiseAND(mask32)

    upper = low * F.lit(ml >> 16)
    total = low * F.lit(ml & 0xFFFF) + F.shiftleft(upper.bitwiseAND(mask16), 16) + 1
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    return (carry + times(high, ml) + times(low, mh)).bitwiseAND(mask32), total.bitwiseAND(mask32)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key.  Each jump goes forward by one at least, so ``shards`` steps do."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda v: F.lit(v).cast("long")
    state = lambda b, j, high, low: F.struct(b.alias("b"), j.alias("j"), high.alias("high"), low.alias("low"))
    start = state(long(-1), long(0), F.shiftright(key, 32).bitwiseAND(long(0xFFFFFFFF)), key.bitwiseAND(long(0xFFFFFFFF)))

    def jump(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        draw = F.shiftright(high, 1) + 1  # the key's upper 31 bits
        on = state(s["j"], F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long"), high, low)
        return F.when(s["j"] < shards, on).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 16, parts: int = PARTS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored), by law ``key``.

    doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32,
    law, shard, slot (0, 1, ... without gaps in each shard), grown_shard (with
    one shard more).  Only slim rows shuffle, never texts.  A null doc_id counts
    as key 0; rows that repeat a doc_id get one shard and a slot each.  Slots:
    each shard is numbered within ``parts`` parts by hash of the key, and the
    counts of the parts before are added, so no task sorts a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"),
    )
    counts = slim.groupBy("shard", "part").count()  # at most shards x parts rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = slim.withColumn("n", F.row_number().over(within))
    joined = numbered.join(F.broadcast(starts), ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("n") - 1).alias("slot"), "grown_shard")
