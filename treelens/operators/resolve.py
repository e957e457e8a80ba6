"""Imports to files, and to the symbols in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SYMBOL_PRIORITY


def resolve_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``imports`` with resolved_file: the file of the module, else that of module.name; relative levels play no part."""
    direct = modules.select("project_id", F.col("module"), F.col("path").alias("file_1"))
    longer = modules.select("project_id", F.col("module").alias("long_module"), F.col("path").alias("file_2"))
    name = F.when(F.col("name") != "", F.concat("module", F.lit("."), "name"))
    joined = imports.withColumn("long_module", name).join(direct, ["project_id", "module"], "left").join(longer, ["project_id", "long_module"], "left")
    return joined.withColumn("resolved_file", F.coalesce("file_1", "file_2")).drop("file_1", "file_2", "long_module")


def symbol_table(parsed: DataFrame) -> DataFrame:
    """(project_id, path, name, type): of symbols with one name in a file the class, else the function, else the variable."""
    kinds = {"classes": "class", "functions": "function", "variables": "variable"}
    # one explode of all three lists, so that files are parsed once
    of = lambda k, t: F.transform(k, lambda x: F.struct(x["name"].alias("name"), F.lit(t).alias("type"), F.lit(SYMBOL_PRIORITY[t]).alias("prio")))
    both = parsed.select("project_id", "path", F.explode(F.concat(*(of(k, t) for k, t in kinds.items()))).alias("s"))
    return both.groupBy("project_id", "path", F.col("s.name").alias("name")).agg(F.min_by("s.type", "s.prio").alias("type"))


def resolve_symbols(resolved: DataFrame, table: DataFrame) -> DataFrame:
    """``resolved`` with resolved_symbol and resolved_symbol_type, null where the file has no such symbol."""
    target = table.select("project_id", F.col("path").alias("resolved_file"), F.col("name"), F.col("type").alias("resolved_symbol_type"))
    joined = resolved.join(target, ["project_id", "resolved_file", "name"], "left")
    return joined.withColumn("resolved_symbol", F.when(F.col("resolved_symbol_type").isNotNull(), F.col("name")))


def import_text() -> Column:
    """An import as a statement, of the columns of ``imports``."""
    alias = F.coalesce(F.concat(F.lit(" as "), "alias"), F.lit(""))
    of = F.concat(F.lit("from "), F.expr("repeat('.', relative_level)"), "module", F.lit(" import "), "name", alias)
    return F.when(F.col("name") != "", of).otherwise(F.concat(F.lit("import "), "module", alias))
