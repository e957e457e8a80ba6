"""The scan of one or many projects: a catalog of lazy tables, one job for all projects."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import paths
from ..operators import git, index, listing, manifests, pyast, resolve, roots, stats
from ..rules import DEFAULT, Rules
from ..sources.tree import resolve_root

MANIFESTS = ["requirements.txt", "pyproject.toml", "package.json"]


@dataclass
class Catalog:
    """Tables of a scan; each is planned when it is first asked for, and runs when it is used."""

    spark: SparkSession
    paths: list[str]
    include_files: bool = True
    time_zone: str = "GMT"
    rules: Rules = DEFAULT
    keep: bool = True

    def _read(self, name: str, **options) -> DataFrame:
        return self.spark.read.format(name).options(paths=json.dumps(self.paths), **options).load()

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Kept, on disk where memory is short, for the tables that are made of it; a lost part is read again."""
        return rows.persist() if self.keep else rows

    def unpersist(self) -> None:
        """Frees what is kept."""
        for rows in self.__dict__.values():
            if isinstance(rows, DataFrame):
                rows.unpersist()

    @cached_property
    def projects(self) -> DataFrame:
        """(project_id, project_name, root_path)."""
        rows = []
        for p in self.paths:
            root, project_id = resolve_root(p)
            rows.append((project_id, Path(p).name, root))
        return self.spark.createDataFrame(rows, "project_id string, project_name string, root_path string")

    @cached_property
    def listed(self) -> DataFrame:
        return self._kept(self._read("project_tree", ruleset="scan", ignore_dirs=json.dumps(self.rules.scan_ignore_dirs)))

    @cached_property
    def tree(self) -> DataFrame:
        """The listing for roots, which leaves out other directories."""
        return self._kept(self._read("project_tree", ruleset="roots", ignore_dirs=json.dumps(self.rules.root_ignore_dirs)))

    @cached_property
    def seen(self) -> DataFrame:
        """Visible files, as statistics count them; seq, which first and last go by, is the path itself."""
        return listing.visible_files(self.listed.where("not is_dir"), self.rules).withColumn("seq", F.col("path"))

    @cached_property
    def wanted(self) -> DataFrame:
        """Visible files, as indexes have them."""
        return self.seen if self.include_files else self.seen.where("false")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        seq = F.row_number().over(Window.partitionBy("project_id").orderBy("path")).cast("long")
        zone = stats.zone_offset(self.time_zone)
        return rows.select(
            "project_id", seq.alias("seq"), "path", "name", "parent", "depth", "extension", "size",
            F.col("mtime").alias("modified_time"), F.col("ctime").alias("created_time"), F.lit(zone).alias("zone"), "is_hidden",
        )

    @cached_property
    def all_files(self) -> DataFrame:
        """Visible files, numbered in the order of the bytes of their paths."""
        return self._numbered(self.seen)

    @cached_property
    def files(self) -> DataFrame:
        return self._numbered(self.wanted)

    @cached_property
    def dirs(self) -> DataFrame:
        own = listing.visible_directories(self.listed.where("is_dir").select("project_id", "path"), self.rules)
        return own.withColumns({"name": paths.name(F.col("path")), "depth": paths.depth(F.col("path"))})

    @cached_property
    def statistics(self) -> DataFrame:
        totals = stats.project_totals(self.seen, self.dirs)
        zero = {c: F.coalesce(c, F.lit(0)) for c in totals.columns if c != "project_id"}
        totals = self.projects.select("project_id").join(totals, "project_id", "left").withColumns(zero)
        extensions = stats.as_map(stats.extension_histogram(self.seen), "extension", "n", "extensions")
        return stats.average_file_size(totals).join(extensions, "project_id", "left")

    @cached_property
    def languages(self) -> DataFrame:
        return stats.language_rollup(stats.extension_histogram(self.seen), self.rules)

    @cached_property
    def source_roots(self) -> DataFrame:
        scores = roots.root_scores(self.tree.where("not is_dir"), self.tree.where("is_dir"), self.projects, self.rules)
        return self._kept(roots.source_roots(scores, self.projects, self.rules))

    @cached_property
    def config_files(self) -> DataFrame:
        return index.config_files(self.wanted, self.rules)

    @cached_property
    def module_index(self) -> DataFrame:
        return index.module_index(self.wanted, self.source_roots)

    def _contents(self, **wanted) -> DataFrame:
        """(project_id, path, content) of visible files; the source itself applies the rules, so that no content meets a join."""
        rules = {"ignore_dirs": self.rules.scan_ignore_dirs, "ignore_files": self.rules.scan_ignore_files, "supported": self.rules.supported_extensions}
        rows = self._read("project_contents", ruleset="scan", **{k: json.dumps(v) for k, v in rules.items()}, **wanted)
        return rows if self.include_files else rows.where("false")

    @cached_property
    def manifests(self) -> DataFrame:
        known = [n for n in MANIFESTS if n in self.rules.known_config_files]
        content = self._contents(names=json.dumps(known)).withColumns({"name": paths.name(F.col("path")), "seq": F.col("path")})
        return self._kept(manifests.decoded(content))

    @cached_property
    def frameworks(self) -> DataFrame:
        """(project_id, frameworks, package_managers, build_systems, containerization, ci_cd), one row a project."""
        flags = manifests.framework_flags(self.manifests, self.rules).groupBy("project_id")
        flags = flags.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("framework", F.lit(True))))).alias("frameworks"))
        joined = self.projects.select("project_id").join(flags, "project_id", "left")
        for part in (manifests.scalars(self.config_files, self.manifests), manifests.containerization(self.config_files), manifests.ci_cd(index.directories(self.wanted))):
            joined = joined.join(part, "project_id", "left")
        none = F.array().cast("array<string>")
        return joined.select(
            "project_id", F.coalesce("frameworks", F.create_map().cast("map<string,boolean>")).alias("frameworks"), "package_managers", "build_systems",
            F.coalesce("containerization", none).alias("containerization"), F.coalesce("ci_cd", none).alias("ci_cd"),
        )

    @cached_property
    def git(self) -> DataFrame:
        return self._kept(git.git_statistics(self._read("git_facts"), self._read("git_commits"), self._read("git_remotes"), self._read("git_tags")))

    @cached_property
    def parsed(self) -> DataFrame:
        """Symbols and imported modules of each Python file; files are parsed once for both."""
        return self._kept(pyast.symbols(self._contents(extensions=json.dumps([".py"]))))

    @cached_property
    def dependencies(self) -> DataFrame:
        return pyast.edges(self.parsed)

    @cached_property
    def imports(self) -> DataFrame:
        resolved = resolve.resolve_modules(pyast.rows_of(self.parsed, "imports"), self.module_index)
        return resolve.resolve_symbols(resolved, resolve.symbol_table(self.parsed))

    @cached_property
    def diagnostics(self) -> DataFrame:
        """(project_id, path, diagnostic): what could not be read as what it claims to be; nothing of it stops a scan."""
        heads = self.git.where("diagnostic is not null").select("project_id", F.col("repository_root").alias("path"), "diagnostic")
        return pyast.diagnostics(self.parsed).union(manifests.diagnostics(self.manifests)).union(heads)

    def result(self) -> DataFrame:
        """One nested row a project: statistics, languages, frameworks, git, dependencies, symbols and files."""
        row = lambda df, name: df.select("project_id", F.struct(*[c for c in df.columns if c != "project_id"]).alias(name))
        gather = lambda df, name: df.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "project_id"]))).alias(name))
        shown = self.files.withColumns({c: stats.in_zone(F.col(c), self.time_zone) for c in ("modified_time", "created_time")})
        joined = self.projects
        for part in (
            row(self.statistics, "statistics"), stats.as_map(self.languages, "language", "n", "languages"), row(self.frameworks, "framework_statistics"), row(self.git, "git_statistics"),
            gather(self.parsed.select("project_id", "path", "deps"), "dependency_graph"), gather(self.parsed.select("project_id", "path", "language", "imports", "classes", "functions", "variables"), "symbol_graph"),
            gather(shown.select("project_id", "seq", "path", "extension", "size", "modified_time", "created_time", "zone"), "files"),
        ):
            joined = joined.join(part, "project_id", "left")
        return joined


def scan(spark: SparkSession, path: str | list[str], include_files: bool = True, time_zone: str = "GMT", rules: Rules = DEFAULT, keep: bool = True) -> Catalog:
    """The catalog of a project, or of several.  A missing path, a path that is no directory and an unknown zone are errors at once.

    keep: whether listings, parsed sources and other tables that several tables
    are made of are kept until ``unpersist``; else each table reads them again.
    """
    stats.zone_offset(time_zone)
    found = [path] if isinstance(path, str | Path) else list(path)
    for p in found:
        resolve_root(str(p))
    sources.register(spark)
    return Catalog(spark, [str(p) for p in found], include_files, time_zone, rules, keep)
