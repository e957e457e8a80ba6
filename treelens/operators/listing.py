"""From a raw listing (project_id, seq, path, size, ...) to visible files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..rules import DEFAULT, Rules


def is_visible(path: Column, rules: Rules = DEFAULT) -> Column:
    """Whether a file is listed: no ignored directory above it, no ignored name, and no unsupported suffix."""
    file_name, suffix = paths.name(path), paths.extension(paths.name(path))
    return (
        ~paths.any_in(paths.parts(paths.parent(path)), rules.scan_ignore_dirs)
        & ~file_name.isin(*rules.scan_ignore_files)
        & ((suffix == "") | suffix.isin(*rules.supported_extensions))
    )


def visible_files(listing: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``listing`` (project_id, seq, path, size and others) cut to visible files, with name, parent, depth, extension, is_hidden."""
    seen = listing.where(is_visible(F.col("path"), rules))
    file_name = paths.name(F.col("path"))
    return seen.withColumns(
        {"name": file_name, "parent": paths.parent(F.col("path")), "depth": paths.depth(paths.parent(F.col("path"))), "extension": paths.extension(file_name), "is_hidden": F.startswith(file_name, F.lit("."))}
    )


def all_directories(listing: DataFrame) -> DataFrame:
    """(project_id, path, name, depth) of every directory above a listed file, the root too."""
    found = listing.select("project_id", paths.parent(F.col("path")).alias("parent")).distinct()
    found = found.select("project_id", F.explode(paths.ancestors(F.col("parent"))).alias("path")).distinct()
    return found.select("project_id", "path", paths.name(F.col("path")).alias("name"), paths.depth(F.col("path")).alias("depth"))


def visible_directories(dirs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Directories a scan descends into, without the root."""
    return dirs.where((F.col("path") != "") & ~paths.any_in(paths.parts(F.col("path")), rules.scan_ignore_dirs))


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("extension") == ".py")
