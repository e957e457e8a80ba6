"""Lookup indexes, as views; first and last are by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..rules import DEFAULT, Rules
from .listing import python_files


def files_by(files: DataFrame, key: str) -> DataFrame:
    """(project_id, key, n, first_path, files): the files of a name or an extension, in scan order."""
    return files.groupBy("project_id", key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("path", "seq").alias("first_path"), F.array_sort(F.collect_list(F.struct("seq", "path", "size"))).alias("files")
    )


def directories(files: DataFrame) -> DataFrame:
    """(project_id, directory): immediate parents of files; neither the root, nor those above, nor empty ones."""
    return files.where("parent <> ''").select("project_id", F.col("parent").alias("directory")).distinct()


def directories_by_name(files: DataFrame) -> DataFrame:
    """(project_id, name, directory): of directories with one name, that of the first file."""
    own = files.where("parent <> ''").select("project_id", "seq", "parent", paths.name(F.col("parent")).alias("name"))
    return own.groupBy("project_id", "name").agg(F.min_by("parent", "seq").alias("directory"))


def config_files(files: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The files whose name is a known project file."""
    return files.where(F.col("name").isin(*rules.known_config_files))


def owning_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with ``root``: of the source roots above a file the first by rank, not the deepest."""
    # by directory: there are fewer of them, and all files of one have the same owner
    above = files.select("project_id", "parent").distinct().select("project_id", "parent", F.explode(paths.ancestors(F.col("parent"))).alias("root"))
    owner = above.join(roots.select("project_id", F.col("path").alias("root"), "rank"), ["project_id", "root"])
    owner = owner.groupBy("project_id", "parent").agg(F.min_by("root", "rank").alias("root"))
    return files.join(owner, ["project_id", "parent"])


def module_index(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(project_id, module, path): of Python files with one module name the last."""
    owned = owning_roots(python_files(files), roots)
    named = owned.withColumn("module", paths.module_name(F.col("path"), F.col("root"))).where("module <> ''")
    return named.groupBy("project_id", "module").agg(F.max_by("path", "seq").alias("path"))
