"""Statistics of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import DEFAULT, TIME_ZONES, Rules, pairs

NO_EXTENSION = "no_extension"


def project_totals(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(project_id, total_files, total_directories, total_size, hidden_files, max_depth); projects of either input."""
    by_files = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_size"), F.count_if("is_hidden").alias("hidden_files"))
    by_dirs = dirs.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_directories"), F.max("depth").alias("max_depth"))
    joined = by_files.join(by_dirs, "project_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("project_id", zero("total_files"), zero("total_directories"), zero("total_size"), zero("hidden_files"), zero("max_depth"))


def extension_histogram(files: DataFrame) -> DataFrame:
    """(project_id, extension, n); the empty extension has a name of its own here."""
    label = F.when(F.col("extension") == "", NO_EXTENSION).otherwise(F.col("extension"))
    return files.groupBy("project_id", label.alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def as_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One map a project, with keys in order."""
    return rows.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def python_round(value: Column) -> Column:
    """value to two places as Python's round does it: by the exact binary value, ties to even.

    100 * value is p + e without error: the halves of value have few enough bits
    for exact products.  From 2**45 on, where these products
    aren't exact any more, the value stays as it is.
    """
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    p = value * 100
    e = (high * 100 - p) + (value - high) * 100
    whole = F.floor(p).cast("double")
    over = (p - whole) - 0.5
    up = F.when(over > -e, 1).when(over == -e, F.pmod(whole, F.lit(2.0))).otherwise(0)
    return F.when(F.abs(value) >= F.lit(2.0**45), value).otherwise((whole + up) / 100)


def average_file_size(totals: DataFrame, rounded: bool = True) -> DataFrame:
    """``totals`` with average_file_size; 0 without files."""
    mean = F.coalesce(F.try_divide(F.col("total_size").cast("double"), F.col("total_files").cast("double")), F.lit(0.0))
    return totals.withColumn("average_file_size", python_round(mean) if rounded else mean)


def size_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id", "extension").agg(F.sum("size").alias("total_size"))


def language_rollup(histogram: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(project_id, language, n); extensions without a language drop out."""
    table = pairs(histogram.sparkSession, rules.extension_language, "extension", "language")
    return histogram.join(F.broadcast(table), "extension").groupBy("project_id", "language").agg(F.sum("n").alias("n"))


def zone_offset(time_zone: str) -> str:
    if time_zone.upper() not in TIME_ZONES:
        raise ValueError(f"time_zone must be one of {', '.join(TIME_ZONES)}")
    return TIME_ZONES[time_zone.upper()]


def in_zone(moment: Column, time_zone: str) -> Column:
    """The wall clock of a moment in a zone."""
    return F.from_utc_timestamp(moment, zone_offset(time_zone))
