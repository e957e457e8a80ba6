"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, largest ids first.  A run is a table of line hashes
with the number of documents that hold each, bucketed and sorted by hash, so
that a later batch merges with it without a new shuffle of the run.  Each batch
merge-anti-joins the runs: a hash that no run has is new, and its holder is the
largest id in the batch, which is the largest of all, as ids only fall from
batch to batch.  The batch then adds its own run at level 0.  When a level has
``fan_in`` runs they are compacted into one run of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, ascii_lower

KEY = ["h1", "h2"]


def line_rows(docs: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, tag, pos, h1, h2) of every line whose key is long enough.

    tag tells apart the texts of rows that repeat a doc_id.  Two seeds of a
    64-bit hash stand for the key.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    stripped = lines.select("doc_id", "tag", "pos", F.trim("line", F.lit(SPACE)).alias("line")).where(F.length("line") >= min_length)
    keyed = stripped.select("doc_id", "tag", "pos", ascii_lower(F.col("line")).alias("key"))
    return keyed.select("doc_id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


class LineRuns:
    """Levelled sorted runs (h1, h2, n_docs, holder), kept as bucketed tables in the shared folder."""

    def __init__(self, scratch: Scratch, fan_in: int = 2):
        self.scratch, self.spark, self.fan_in = scratch, scratch.spark, fan_in
        # as many buckets as a shuffle by KEY has partitions: a task then holds whole buckets, and a run has one file a bucket
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer = writer.option("path", f"{self.scratch.base}/{name}").option("compression", "none")  # hashes don't shrink
        writer.format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2), all of whose ids are below those of the batches before, or null."""
        held = batch.select(*KEY, "doc_id").distinct()
        # dealt as the runs are, so that neither side of the joins shuffles again
        rows = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        known = []
        for i, run in enumerate(self.tables()):
            known.append(F.col(f"in_{i}").isNotNull())
            rows = rows.join(self.spark.table(run).select(*KEY, F.lit(True).alias(f"in_{i}")).hint("merge"), KEY, "left")
        new = ~F.coalesce(*[F.when(k, True) for k in known], F.lit(False)) if known else F.lit(True)
        rows = rows.select(*KEY, "n_docs", F.when(new, F.col("holder")).alias("holder"))
        self._push(0, self._write(rows))

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            for name in old:
                self._drop(name)
            self._push(level + 1, merged)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Runs as one, by full merge joins of their sorted buckets; every key is in a run at most once."""
        rows = self.spark.table(runs[0])
        for other in runs[1:]:
            more = self.spark.table(other).select(*KEY, F.col("n_docs").alias("n_more"), F.col("holder").alias("holder_more"))
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
            rows = rows.join(more.hint("merge"), KEY, "full").select(*KEY, n.alias("n_docs"), F.greatest("holder", "holder_more").alias("holder"))
        return rows

    def all(self) -> DataFrame:
        return self._merged(self.tables())

    def close(self) -> None:
        for name in self.tables():
            self._drop(name)


def without(lines: Column, drops: Column) -> Column:
    """The lines whose positions are not in ``drops`` (sorted): the slices between one drop and the next."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda d: d + 1))
    ends = F.concat(drops, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def line_dedup(docs: DataFrame, min_length: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, and n_lines, n_dropped (long).

    Other columns pass through; input columns n_lines and n_dropped are
    replaced.  A key (the line stripped of white space, A-Z lower-cased) of at
    least ``min_length`` code points in at least ``min_docs`` documents loses
    all lines but those in the largest doc_id.  Null and empty texts are one
    empty line.  A null doc_id counts as one document, below all others; rows
    that repeat a doc_id count as one document.  A document all of whose lines
    go keeps its row, with an empty text.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    scratch = Scratch(spark)
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or [])) if shares else []
    batch = sum((F.when(F.col("doc_id") <= b, 1).otherwise(0) for b in bounds), F.lit(0))  # 0: the largest ids
    rows = line_rows(docs, min_length).withColumn("batch", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(batch))
    rows = scratch.write(rows, "lines")
    runs = LineRuns(scratch, fan_in)
    for i in range(len(bounds) + 1):
        runs.add(rows.where(F.col("batch") == i).select("doc_id", *KEY))
    common = scratch.write(runs.all().where(F.col("n_docs") >= min_docs).select(*KEY, "holder"), "common", slim=True)
    runs.close()
    # always by shuffle: the lists grow with the corpus, and a written table looks smaller than it is
    drops = rows.join(common.hint("merge"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    drops = drops.groupBy("doc_id", "tag").agg(F.array_sort(F.array_distinct(F.collect_list("pos"))).alias("drops"))
    drops = scratch.write(drops.select(F.col("doc_id").alias("drop_id"), F.col("tag").alias("drop_tag"), F.col("drops").alias("drop_lines")), "drops", slim=True)
    scratch.drop("lines", "common")

    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("tag"))
    joined = whole.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("tag") == F.col("drop_tag")), "left")
    kept = F.when(F.col("drop_lines").isNull(), F.col("text")).otherwise(F.array_join(without(F.split("text", "\n"), F.col("drop_lines")), "\n"))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    out = [kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*out, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop_lines"), F.lit(0)).cast("long").alias("n_dropped"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> holder AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
