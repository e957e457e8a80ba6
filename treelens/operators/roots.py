"""Source roots: directories that score as the root of sources.

A directory's score counts its name, project files in it, source files anywhere
below it, and subdirectories with common names.  Counts below a directory come
from one explode of each file's ancestors and one aggregation, not from walking
each subtree again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..rules import DEFAULT, Rules, pairs


def _clear(frame: DataFrame, rules: Rules) -> DataFrame:
    """Rows with no ignored name in their absolute path, that of the project too; frame has root_path and path."""
    every = F.concat(F.split("root_path", "/"), paths.parts(F.col("path")))
    return frame.where(~paths.any_in(every, rules.root_ignore_dirs))


def subtree_language_counts(listing: DataFrame, projects: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(project_id, directory, language, n, first_path): source files anywhere below each directory."""
    files = _clear(listing.join(projects.select("project_id", "root_path"), "project_id"), rules)
    files = files.withColumn("extension", paths.extension(paths.name(F.col("path"))))
    named = files.join(F.broadcast(pairs(listing.sparkSession, rules.root_language, "extension", "language")), "extension")
    # one row a directory and language of its own files first: the explode is over these, not over files
    own = named.groupBy("project_id", paths.parent(F.col("path")).alias("parent"), "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    above = own.select("project_id", F.explode(paths.ancestors(F.col("parent"))).alias("directory"), "language", "n", "first_path")
    return above.groupBy("project_id", "directory", "language").agg(F.sum("n").alias("n"), F.min("first_path").alias("first_path"))


def dominant_language(counts: DataFrame) -> DataFrame:
    """(project_id, directory, language, n_sources, language_counts): most files win; of equals the one with the least path."""
    order = F.struct(-F.col("n"), F.col("first_path"))
    return counts.groupBy("project_id", "directory").agg(
        F.min_by("language", order).alias("language"), F.sum("n").alias("n_sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_counts")
    )


def root_scores(listing: DataFrame, dirs: DataFrame, projects: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(project_id, path, score, language, language_counts, reasons) of every directory that isn't ignored.

    listing: project_id, path of all files, ignored ones too; dirs: project_id,
    path of all directories, with the root ''; projects: project_id, root_path.
    """
    marked = listing.withColumn("name", paths.name(F.col("path"))).where(F.col("name").isin(*rules.project_files))
    files = marked.groupBy("project_id", paths.parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_set(F.concat(F.lit("contains "), "name"))).alias("file_reasons"))
    inner = dirs.where("path <> ''").select("project_id", paths.parent(F.col("path")).alias("path"), F.lower(paths.name(F.col("path"))).alias("name"))
    inner = inner.where(F.col("name").isin(*rules.important_subdirs)).groupBy("project_id", "path").agg(F.count_distinct("name").alias("n_inner"))
    sources = dominant_language(subtree_language_counts(listing, projects, rules)).withColumnRenamed("directory", "path")
    all_dirs = _clear(dirs.select("project_id", "path").join(projects.select("project_id", "root_path"), "project_id"), rules)
    all_dirs = all_dirs.withColumn("name", F.when(F.col("path") == "", paths.name(F.col("root_path"))).otherwise(paths.name(F.col("path"))))
    joined = all_dirs.join(files, ["project_id", "path"], "left").join(inner, ["project_id", "path"], "left").join(sources, ["project_id", "path"], "left")
    n, k, m = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_sources", "n_inner", "n_files"))
    common = F.lower("name").isin(*rules.common_source_names)
    score = F.when(common, 30).otherwise(0) + 40 * m + F.least(3 * n, F.lit(30)) + F.least(5 * k, F.lit(20))
    reasons = F.concat(
        F.array_compact(F.array(
            F.when(common, F.concat(F.lit("directory named '"), "name", F.lit("'"))),
            F.when(n == 1, F.lit("contains 1 source file")).when(n > 1, F.concat(F.lit("contains "), n.cast("string"), F.lit(" source files"))),
            F.when(k > 0, F.lit("contains common source directories")),
        )),
        F.coalesce("file_reasons", F.array().cast("array<string>")),
    )
    return joined.select("project_id", "path", score.cast("int").alias("score"), "language", "language_counts", F.array_sort(reasons).alias("reasons"))


def source_roots(scores: DataFrame, projects: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(project_id, rank, path, score, language, language_counts, confidence, reasons).

    A candidate goes just if a directory above it is a candidate with at least
    its score: one that goes itself has such a one above it, too.  Projects
    without any candidate get their own root.
    """
    candidates = scores.where(F.col("score") >= rules.min_root_score)
    above = candidates.select("project_id", "path", F.col("score").alias("own"), F.explode(paths.ancestors(F.col("path"), proper=True)).alias("above"))
    nested = above.join(candidates.select("project_id", F.col("path").alias("above"), "score"), ["project_id", "above"]).where("score >= own").select("project_id", "path").distinct()
    kept = candidates.join(nested, ["project_id", "path"], "left_anti")
    alone = projects.select("project_id").join(candidates.select("project_id").distinct(), "project_id", "left_anti")
    none = F.lit(None)
    alone = alone.select("project_id", F.lit("").alias("path"), F.lit(1).alias("score"), none.cast("string").alias("language"), F.create_map().cast("map<string,bigint>").alias("language_counts"), F.array(F.lit("fallback")).alias("reasons"))
    both = kept.select(*alone.columns).unionByName(alone)
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), paths.depth(F.col("path")), "path")
    return both.select("project_id", F.row_number().over(order).alias("rank"), "path", "score", "language", "language_counts", F.lit("Low").alias("confidence"), "reasons")


def source_file_count(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + b)
