"""Reports of a scan, as rows and as texts for people."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import pyast, resolve
from .scan import Catalog


def info(settings: Settings | None = None) -> dict:
    settings = settings or Settings.load()
    return {"application": settings.app_name, "version": settings.version, "status": "running"}


def health() -> dict:
    return {"status": "healthy", "timestamp": datetime.now(UTC).isoformat()}


def as_json(rows: DataFrame, pretty: bool = True) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def symbol_listing(catalog: Catalog) -> str:
    """Imports as statements, classes with methods, functions and variables of each file."""
    lines = []
    for r in catalog.parsed.orderBy("project_id", "path").toLocalIterator():
        lines.append(r.path)
        for i in r.imports:
            alias = f" as {i.alias}" if i.alias else ""
            lines.append(f"  from {'.' * i.relative_level}{i.module} import {i.name}{alias}" if i.name else f"  import {i.module}{alias}")
        for c in r.classes:
            lines += [f"  class {c.name}", *(f"    def {m.name}" for m in c.methods)]
        lines += [f"  def {f.name}" for f in r.functions]
        lines += [f"  {v.name}" for v in r.variables]
    return "\n".join(lines)


#: Sections of a report, with what stands in one that is empty.
SECTIONS = {"Statistics": "None", "Frameworks": "None", "Git": "None", "Languages": "No languages", "Source roots": "No source roots", "Modules": "No Python modules", "Dependencies": "No dependency information", "Symbols": "No symbols"}


def report_lines(catalog: Catalog) -> DataFrame:
    """(project_id, section, ord, line): the lines of every project's report, as rows; ord is the order within a section."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lines = lambda df, n, key, line: df.select("project_id", F.lit(n).alias("section"), key.cast("string").alias("ord"), line.alias("line"))

    def fields(df: DataFrame, n: int) -> DataFrame:
        """A line for each column of a table with one row a project."""
        own = [c for c in df.columns if c != "project_id"]
        pairs = df.select("project_id", F.posexplode(F.array(*(F.concat(F.lit(f"{c}: "), text(c)) for c in own))).alias("k", "line"))
        return lines(pairs, n, F.lpad(F.col("k").cast("string"), 3, "0"), F.col("line"))

    rank, names = F.lpad(F.col("rank").cast("string"), 9, "0"), F.array_join("deps", ", ")
    root = F.concat_ws(" ", F.when(F.col("path") == "", ".").otherwise(F.col("path")), text("score"), text("language"), F.array_join("reasons", ", "))
    counts = F.concat_ws(" ", "path", *(x for c in ("imports", "classes", "functions", "variables") for x in (F.lit(c), F.col(f"n_{c}"))))
    parts = [
        *(fields(df, n) for n, df in enumerate((catalog.statistics, catalog.frameworks, catalog.git))),
        lines(catalog.languages, 3, F.col("language"), F.concat(F.rpad("language", 20, " "), F.lit(" "), text("n"))),
        lines(catalog.source_roots, 4, rank, root),
        lines(catalog.module_index, 5, F.col("module"), F.concat("module", F.lit(" -> "), "path")),
        lines(catalog.parsed, 6, F.col("path"), F.concat("path", F.lit(": "), F.when(names == "", "(none)").otherwise(names))),
        lines(pyast.symbol_counts(catalog.parsed), 7, F.col("path"), counts),
    ]
    found = reduce(DataFrame.unionByName, parts)
    every = catalog.projects.select("project_id", F.posexplode(F.array(*map(F.lit, SECTIONS.values()))).alias("section", "line"))
    empty = every.join(found.select("project_id", "section").distinct(), ["project_id", "section"], "left_anti")
    return found.unionByName(empty.select("project_id", "section", F.lit("").alias("ord"), "line"))


def text_report(catalog: Catalog) -> str:
    """The report of every project, for people; lines come sorted, part by part."""
    out, last, titles = [], (None, None), list(SECTIONS)
    rows = report_lines(catalog).join(catalog.projects, "project_id").orderBy("root_path", "section", "ord", "line")
    for r in rows.toLocalIterator():
        if r.root_path != last[0]:
            out.append(f"# {r.project_name} ({r.root_path})")
        if (r.root_path, r.section) != last:
            out.append(f"== {titles[r.section]} ==")
        last = (r.root_path, r.section)
        out.append(r.line)
    return "\n".join(out)


def import_statements(imports: DataFrame) -> DataFrame:
    return imports.select("project_id", "path", "ord", resolve.import_text().alias("statement"))
