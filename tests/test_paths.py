from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelens.functions import paths
from treelens.operators import listing, stats
from treelens.rules import DEFAULT

NAME = st.text("abAB.-_ é1", min_size=1, max_size=6).filter(lambda n: n not in (".", ".."))
PATH = st.lists(NAME, min_size=1, max_size=4).map("/".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PATH, min_size=1, max_size=60))
def test_parts_of_paths_equal_pathlib(spark, found):
    rows = spark.createDataFrame([(p,) for p in found], "path string")
    p = F.col("path")
    out = rows.select("path", paths.name(p).alias("name"), paths.parent(p).alias("parent"), paths.extension(paths.name(p)).alias("ext"), paths.ancestors(paths.parent(p)).alias("up"), paths.depth(paths.parent(p)).alias("depth"))
    for r in out.collect():
        q = PurePosixPath(r.path)
        parent = "" if q.parent.as_posix() == "." else q.parent.as_posix()
        assert (r.name, r.parent, r.ext) == (q.name, parent, q.suffix.lower())
        assert r.depth == len(q.parts) - 1
        assert r.up == ["/".join(q.parts[:i]) for i in range(len(q.parts))]


def test_proper_ancestors(spark):
    row = spark.sql("SELECT '' AS a, 'x' AS b, 'x/y' AS c").select(*(paths.ancestors(F.col(c), proper=True).alias(c) for c in "abc")).first()
    assert (row.a, row.b, row.c) == ([], [""], ["", "x"])


def test_module_names(spark):
    cases = {("backend/app/__init__.py", "backend"): "app", ("backend/__init__.py", "backend"): "", ("backend/app/m0.py", "backend"): "app.m0", ("a.b.py", ""): "a.b", ("x/V1.PY", ""): "x.V1", ("__init__.py", ""): ""}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "path string, root string, module string")
    assert all(r.got == r.module for r in rows.withColumn("got", paths.module_name(F.col("path"), F.col("root"))).collect())


def test_visible(spark):
    cases = {"a.py": True, "B.PY": True, "c.tar.gz": False, ".env": False, ".env.ci": False, ".dockerignore": True, ".eslintrc.json": True, "Dockerfile": True, "x.toml": True, "node_modules/i.js": False, "a/build/x.py": False, "build": True}
    rows = spark.createDataFrame(list(cases.items()), "path string, seen boolean")
    assert all(r.got == r.seen for r in rows.withColumn("got", listing.is_visible(F.col("path"), DEFAULT)).collect())


def test_average_rounds_as_python(spark):
    rows = spark.createDataFrame([("a", 535, 200), ("b", 1, 8), ("c", 0, 0), ("d", 3, 8)], "project_id string, total_size long, total_files long")
    got = {r.project_id: r.average_file_size for r in stats.average_file_size(rows).collect()}
    assert got == {"a": round(535 / 200, 2), "b": 0.12, "c": 0.0, "d": 0.38}


def test_zones(spark):
    import pytest

    assert stats.zone_offset("ist") == "+05:30"
    with pytest.raises(ValueError):
        stats.zone_offset("CET")
