"""Frameworks, package managers, build systems, containers and CI from manifests and configuration files.

Manifests come as rows (project_id, seq, path, name, content); content null is
a file that is gone.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import DEFAULT, PYPROJECT_TOOLS, Rules, pairs

#: The order in which manifests are looked at; of scalars the last one wins.
REQUIREMENTS, PYPROJECT, PACKAGE = 0, 1, 2
PACKAGE_SCHEMA = "dependencies map<string,string>, devDependencies map<string,string>, packageManager string"


def text_of(content: bytes | None) -> str | None:
    """Text of a manifest: the first of four encodings that fits; the last one always does."""
    if content is None:
        return None
    for encoding in ("utf-8", "utf-8-sig", "utf-16"):
        try:
            return content.decode(encoding)
        except UnicodeError:
            continue
    return content.decode("latin-1")


def tool_keys(text: str | None) -> list[str] | None:
    """The keys under [tool]; None for what isn't TOML."""
    try:
        tool = tomllib.loads(text or "").get("tool", {})
    except (tomllib.TOMLDecodeError, RecursionError):
        return None
    return list(tool) if isinstance(tool, dict) else []


def _read(manifests: DataFrame, column: str, text) -> DataFrame:
    """``manifests`` with text and tools (of pyproject.toml), in one Arrow pass over ``column``."""
    names = ["project_id", "seq", "path", "name"]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [text(v.as_py()) for v in batch.column(column)]
            tools = [tool_keys(t) if n == "pyproject.toml" and t is not None else None for n, t in zip(batch.column("name").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(tools, pa.list_(pa.string()))], names=[*names, "text", "tools"])

    seq = manifests.schema["seq"].dataType.simpleString()
    return manifests.select(*names, column).mapInArrow(work, f"project_id string, seq {seq}, path string, name string, text string, tools array<string>")


def decoded(manifests: DataFrame) -> DataFrame:
    """``manifests`` with text and tools; those that are gone drop out."""
    return _read(manifests.withColumn("content", F.col("content").cast("binary")), "content", text_of).where("text is not null")


def requirement_packages(manifests: DataFrame) -> DataFrame:
    """(project_id, seq, package) of each line that names one: lower case, cut at the first version sign of three."""
    lines = manifests.where("name = 'requirements.txt'").select("project_id", "seq", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    package = F.lower(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    lines = lines.select("project_id", "seq", package.alias("package")).where("package <> '' and not startswith(package, '#')")
    cut = F.col("package")
    for sign in ("==", ">=", "<="):
        cut = F.split_part(cut, F.lit(sign), F.lit(1))
    return lines.select("project_id", "seq", cut.alias("package"))


def frameworks_of(packages: DataFrame, table: dict[str, str]) -> DataFrame:
    """(project_id, framework), each once."""
    rules = pairs(packages.sparkSession, table, "package", "framework")
    return packages.join(F.broadcast(rules), "package").select("project_id", "framework").distinct()


def pyproject_tools(manifests: DataFrame) -> DataFrame:
    """(project_id, seq, path, tools)."""
    own = manifests.where("name = 'pyproject.toml'")
    own = own if "tools" in manifests.columns else _read(own, "text", lambda text: text)
    return own.select("project_id", "seq", "path", "tools")


def package_json(manifests: DataFrame) -> DataFrame:
    """(project_id, seq, path, valid, packages, package_manager); packages of both kinds of dependencies."""
    own = manifests.where("name = 'package.json'").withColumn("m", F.from_json("text", PACKAGE_SCHEMA, {"mode": "PERMISSIVE"}))
    keys = lambda c: F.coalesce(F.map_keys(f"m.{c}"), F.array().cast("array<string>"))
    valid = F.try_parse_json("text").isNotNull()
    return own.select("project_id", "seq", "path", valid.alias("valid"), F.array_union(keys("dependencies"), keys("devDependencies")).alias("packages"), F.col("m.packageManager").alias("package_manager"))


def package_manager(declared: Column) -> Column:
    """pnpm, yarn or npm, for what packageManager has; null stays null."""
    low = F.lower(declared)
    return F.when(F.contains(low, F.lit("pnpm")), "pnpm").when(F.contains(low, F.lit("yarn")), "yarn").when(low.isNotNull(), "npm")


def build_system(packages: Column) -> Column:
    return F.when(F.array_contains(packages, "vite"), "Vite").when(F.array_contains(packages, "next"), "Next.js")


def framework_flags(manifests: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(project_id, framework), each once, of all manifests."""
    npm = package_json(manifests).select("project_id", F.explode("packages").alias("package"))
    tools = pyproject_tools(manifests).select("project_id", F.explode("tools").alias("package"))
    found = [frameworks_of(requirement_packages(manifests), rules.python_packages), frameworks_of(tools, PYPROJECT_TOOLS), frameworks_of(npm, rules.js_packages)]
    return found[0].union(found[1]).union(found[2]).distinct()


def scalars(config: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project_id, package_managers, build_systems): the last that a manifest sets, by kind, seq and statement.

    config: the config files of the listing; a listed file that is gone still
    sets the default of its kind.
    """
    value = lambda rows, kind, n, v, seq=F.col("seq"): rows.select("project_id", F.lit(kind).alias("kind"), seq.alias("seq"), F.lit(n).alias("n"), v.alias("value"))
    # the default of a kind comes before all that its files say
    first = F.lit(None).cast(manifests.schema["seq"].dataType)
    listed = lambda name, kind, v: value(config.where(F.col("name") == name), kind, 0, F.lit(v), first)
    npm = package_json(manifests)
    managers = (
        listed("requirements.txt", REQUIREMENTS, "pip")
        .union(value(pyproject_tools(manifests).where(F.array_contains("tools", "poetry")), PYPROJECT, 0, F.lit("Poetry")))
        .union(listed("package.json", PACKAGE, "npm"))
        .union(value(npm, PACKAGE, 1, package_manager(F.col("package_manager"))))
    )
    builds = value(npm, PACKAGE, 2, build_system(F.col("packages")))
    last = lambda rows, name: rows.where("value is not null").groupBy("project_id").agg(F.max_by("value", F.struct("kind", F.col("seq").isNotNull(), "seq", "n")).alias(name))
    return last(managers, "package_managers").join(last(builds, "build_systems"), "project_id", "full")


def containerization(config: DataFrame) -> DataFrame:
    """(project_id, containerization): labels in a fixed order; none without such files."""
    has = config.groupBy("project_id").agg(F.bool_or(F.col("name") == "Dockerfile").alias("docker"), F.bool_or(F.col("name").isin("docker-compose.yml", "compose.yml")).alias("compose"))
    return has.select("project_id", F.array_compact(F.array(F.when(F.col("docker"), "Docker"), F.when(F.col("compose"), "Docker Compose"))).alias("containerization"))


def ci_cd(directories: DataFrame) -> DataFrame:
    """(project_id, ci_cd) of (project_id, directory)."""
    has = directories.groupBy("project_id").agg(F.bool_or(F.startswith("directory", F.lit(".github"))).alias("actions"))
    return has.select("project_id", F.array_compact(F.array(F.when(F.col("actions"), "GitHub Actions"))).alias("ci_cd"))


def diagnostics(manifests: DataFrame) -> DataFrame:
    """(project_id, path, diagnostic) of manifests that can't be parsed."""
    toml = pyproject_tools(manifests).where("tools is null").select("project_id", "path", F.lit("not TOML").alias("diagnostic"))
    json = package_json(manifests).where("not valid").select("project_id", "path", F.lit("not JSON").alias("diagnostic"))
    return toml.union(json)
