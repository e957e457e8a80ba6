"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b: long, not null) reaches.

    Each round links nodes to the smallest of their neighbours; the rounds grow
    with the logarithm of the nodes.  A hub with many neighbours is one key of
    a join, which Spark may split, and never one row or one task.
    """
    current = scratch.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}_0", slim=True)
    last, i = None, 0
    while True:
        mark = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last, i = mark, i + 1
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the larger neighbours of a node go to the smallest of all
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of those
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        current = scratch.write(small.distinct(), f"{name}_{i}", slim=True)
        scratch.drop(f"{name}_{i - 1}")
    own = current.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component"))
    return own.groupBy("node").agg(F.min("component").alias("component"))
