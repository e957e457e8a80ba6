"""Listings and sources made of the columns of other tables, by SQL that runs on Spark and on other engines alike."""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING_COLUMNS = """doc_id AS seq, source AS project_id, CAST(n_chars AS BIGINT) AS size,
  CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/api/' WHEN 3 THEN 'backend/app/models/' WHEN 4 THEN 'node_modules/x/'
    WHEN 5 THEN '.github/workflows/' ELSE 'docs/' END
  || CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN '__init__.py' WHEN 1 THEN 'package.json' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN '.env' WHEN 4 THEN '.env.ci'
    WHEN 5 THEN concat('m', CAST(doc_id % 13 AS VARCHAR(9)), '.py') WHEN 6 THEN concat('V', CAST(doc_id AS VARCHAR(9)), '.PY')
    WHEN 7 THEN concat('w', CAST(doc_id AS VARCHAR(9)), '.tar.gz') WHEN 8 THEN concat('c', CAST(doc_id AS VARCHAR(9)), '.tsx')
    WHEN 9 THEN concat('n', CAST(doc_id AS VARCHAR(9)), '.md') ELSE concat('k', CAST(doc_id AS VARCHAR(9)), '.cpp') END AS path"""

#: A Python source of each file; what is in it follows from seq.
SOURCE = """'import os' || chr(10)
  || 'from m' || CAST(seq % 13 AS VARCHAR(9)) || ' import fn' || CAST(seq % 5 AS VARCHAR(9)) || ', K as k' || chr(10)
  || 'class C' || CAST(seq % 4 AS VARCHAR(9)) || '(Base' || CAST(seq % 3 AS VARCHAR(9)) || '):' || chr(10)
  || '    def run(self): pass' || chr(10)
  || 'def fn' || CAST((seq + 1) % 5 AS VARCHAR(9)) || '(): import json' || chr(10)
  || 'K = ' || CAST(seq AS VARCHAR(9)) || chr(10)"""

REQUIREMENTS = """'FastAPI==' || CAST(seq AS VARCHAR(9)) || chr(10) || '# torch' || chr(10) || chr(10) || '  '
  || CASE CAST(seq % 7 AS INT) WHEN 0 THEN 'flask>=2' WHEN 1 THEN 'django~=4' WHEN 2 THEN 'numpy[all]' WHEN 3 THEN 'pandas >= 1' WHEN 4 THEN 'PyTest' WHEN 5 THEN 'SQLAlchemy<=2' ELSE 'left-pad' END || '  '"""
FIRST = "CASE CAST(seq % 4 AS INT) WHEN 0 THEN 'react' WHEN 1 THEN 'next' WHEN 2 THEN '@angular/core' ELSE 'left-pad' END"
SECOND = "CASE CAST(seq % 5 AS INT) WHEN 0 THEN 'vite' WHEN 1 THEN 'svelte' ELSE 'eslint' END"
MANAGER = "CASE CAST(seq % 6 AS INT) WHEN 0 THEN 'PNPM@9' WHEN 1 THEN 'yarn@4' WHEN 2 THEN 'npm@10' ELSE NULL END"
PACKAGE = f"""'{{"dependencies":{{"' || {FIRST} || '":"1"}},"devDependencies":{{"' || {SECOND} || '":"2"}}' || coalesce(',"packageManager":"' || {MANAGER} || '"', '') || '}}'"""
TOOL = "CASE CAST(seq % 5 AS INT) WHEN 0 THEN 'poetry' WHEN 1 THEN 'ruff' WHEN 2 THEN 'black' WHEN 3 THEN 'mypy' ELSE 'isort' END"
PYPROJECT = f"'[project]' || chr(10) || 'name = \"p\"' || chr(10) || '[tool.' || {TOOL} || ']' || chr(10) || 'x = 1' || chr(10)"

#: A source with decorators, docstrings, bases, async definitions, and targets of several kinds.
DETAILS = """'@dec.a(1)' || chr(10) || 'class X' || CAST(seq % 4 AS VARCHAR(9)) || '(pkg.Base, Gen[int], metaclass=M):' || chr(10) || '    "doc ' || CAST(seq AS VARCHAR(9)) || '"' || chr(10)
  || '    @staticmethod' || chr(10) || '    async def m(self): pass' || chr(10) || chr(10) || '@wrap' || chr(10) || 'async def f(x):' || chr(10) || '    "fd"' || chr(10) || chr(10)
  || 'a, b = 1, 2' || chr(10) || 'X.y = 3' || chr(10) || '[c] = [4]' || chr(10) || 'z: int = 5' || chr(10)"""
#: A source whose one name is a class, a function and a variable, or two of these, or a variable.
PRIORITY = """CASE CAST(seq % 3 AS INT) WHEN 0 THEN 'N = 1' || chr(10) || 'def N(): pass' || chr(10) || 'class N: pass' WHEN 1 THEN 'N = 1' || chr(10) || 'def N(): pass' ELSE 'N = 1' END || chr(10)"""
#: What a file of the listing holds on disk.
ON_DISK = f"""CASE WHEN lower(path) LIKE '%.py' THEN {SOURCE} WHEN path = 'package.json' OR path LIKE '%/package.json' THEN {PACKAGE} ELSE repeat('x', CAST(size % 50 AS INT)) END"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, seq, size); of rows with one path the first."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*_columns(LISTING_COLUMNS))
    return rows.groupBy("project_id", "path").agg(F.min("seq").alias("seq"), F.min_by("size", "seq").alias("size"))


def _columns(text: str) -> list[str]:
    """Top-level columns of a list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def projects(files: DataFrame) -> DataFrame:
    return files.select("project_id").distinct().select("project_id", F.concat(F.lit("/data/"), "project_id").alias("root_path"))


def python_sources(files: DataFrame, source: str = SOURCE) -> DataFrame:
    return files.where("lower(path) LIKE '%.py'").selectExpr("project_id", "path", "seq", f"encode({source}, 'UTF-8') AS content")


def manifests(files: DataFrame, name: str) -> DataFrame:
    text = {"requirements.txt": REQUIREMENTS, "package.json": PACKAGE, "pyproject.toml": PYPROJECT}[name]
    return files.selectExpr("project_id", "seq", "path", f"'{name}' AS name", f"{text} AS text")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or on this machine where the master is local and that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="trees-")
    if not base or "://" in base.replace("file://", "", 1):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that the driver and all executors share")
    base = "/" + base.removeprefix("file:").lstrip("/")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_tree(spark: SparkSession, sf_dir: str) -> list[str]:
    """The listing as projects on disk, written by the executors; the projects' paths."""
    base, files = shared_folder(spark), listing(spark, sf_dir).selectExpr("project_id", "path", f"{ON_DISK} AS content")

    def write(rows):
        for r in rows:
            path = os.path.join(base, r.project_id, r.path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(r.content)

    files.foreachPartition(write)
    return [os.path.join(base, r.project_id) for r in files.select("project_id").distinct().orderBy("project_id").collect()]


def write_repositories(spark: SparkSession, sf_dir: str) -> list[str]:
    """A small git repository for each source, made of the number n of its documents; the paths.

    n % 3 + 1 commits, each with a tag; a remote with two urls and a head; one
    untracked file; a changed file where n is odd.
    """
    base, found = shared_folder(spark), []
    for source, n in spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").count().orderBy("source").collect():
        root = os.path.join(base, source)
        os.makedirs(root)
        git = lambda *args, **more: subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=os.environ | more)  # noqa: B023, E731
        git("init", "-q", "-b", "main")
        for k in range(n % 3 + 1):
            with open(f"{root}/a.txt", "w") as f:
                f.write(f"{k}\n")
            git("add", "a.txt")
            who = {f"GIT_{x}_{y}": v for x in ("AUTHOR", "COMMITTER") for y, v in (("NAME", f"A {k}"), ("EMAIL", f"a{k}@example.org"), ("DATE", f"2024-01-0{k + 1}T00:00:00+00:00"))}
            git("commit", "-q", "-m", f"c{k}", **who)
            git("tag", f"v{k}")
        for args in (("add", "origin", f"https://example.org/{source}"), ("set-url", "--add", "origin", "https://example.org/other")):
            git("remote", *args)
        git("symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/release/v1")
        for name, text in (("u.txt", "new"), *((("a.txt", "changed"),) if n % 2 else ())):
            with open(f"{root}/{name}", "w") as f:
                f.write(text)
        found.append(root)
    return found
