"""Exact dedup by two-pass Bloom filtering.

The first pass reads every text once into a slim fingerprint row (id, SHA-256
of the normalised text, two 64-bit hashes), written to the shared folder.  A
blocked Bloom filter over the hashes then tells which hashes may be repeated:
every row sets BITS bits of one block, and the filter keeps the bits that two
rows or more have set.  In the second pass a row whose bits are all kept goes
through the shuffle that settles its group; all others are certainly single
and pass straight through, without shuffle.

The filter has 16 bits a row, in blocks of 4 KB, at every size.  Up to
``broadcast_blocks`` blocks it is broadcast; a larger one meets the fingerprint
rows by a shuffle of both by block, in which only slim rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

#: Bits of one block, as bitmap_construct_agg makes them; bits of the filter a row; blocks of a filter that is broadcast (16 MB).
BLOCK, BITS, BROADCAST_BLOCKS = 32768, 16, 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " {2,}", " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    sha = F.sha2(normalised(F.col("text")), 256)
    return docs.select("doc_id", sha.alias("text_sha256"))


def repeated_bits(prints: DataFrame, blocks: int) -> DataFrame:
    """The filter: for each block the bitmap of positions that two rows or more set."""
    bits = prints.select(block(blocks).alias("block"), F.explode(F.array(*positions())).alias("bit"))
    twice = bits.groupBy("block", "bit").count().where("count > 1")
    return twice.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256"), F.lit(blocks)).cast("int")


def positions() -> list[Column]:
    """Two positions in the block, never equal, so that one row alone can't set a bit twice."""
    h = F.xxhash64(F.lit(1), F.col("text_sha256"))
    half = BLOCK // 2
    return [F.pmod(h, F.lit(half)), F.pmod(F.shiftright(h, 20), F.lit(half)) + half]


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))


def exact_dedup(docs: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored).

    doc_id, keep_id (smallest doc_id with an equal text), group_size (rows with
    an equal text), kept, text_sha256.  Null texts equal the empty text.  Of
    rows that repeat one doc_id and one text all are kept or none.  A null
    doc_id is never the smallest unless the whole group has none.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    prints = scratch.write(fingerprints(docs), "prints")
    blocks = max(1, -(-prints.count() * BITS // BLOCK))
    seen = repeated_bits(prints, blocks)
    seen = F.broadcast(seen) if blocks <= broadcast_blocks else seen.hint("merge")
    tested = prints.withColumn("block", block(blocks)).join(seen, "block", "left")
    tested = tested.withColumn("maybe", is_set(F.col("bitmap"), positions()[0]) & is_set(F.col("bitmap"), positions()[1]))
    maybe = tested.where("maybe").select("doc_id", "text_sha256")
    groups = scratch.write(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups", slim=True)
    # both sides of the join are plain shuffles, so that Spark may split the rows of a large group
    settled = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    single = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    both = single.unionByName(settled)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
