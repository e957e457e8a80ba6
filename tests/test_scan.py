import os
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from treelens.operators import pyast
from treelens.plans import report
from treelens.plans.scan import scan


def tree(base: Path, files: dict[str, str | bytes]) -> str:
    base.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(base)


def test_extensions_and_hidden_files(spark, tmp_path):
    names = ["a.py", "B.PY", "c.tar.gz", ".env", ".env.ci", ".dockerignore", ".eslintrc.json", "Dockerfile", "x.toml"]
    c = scan(spark, tree(tmp_path / "p", dict.fromkeys(names, "")))
    s = c.statistics.first()
    assert s.extensions == {".py": 2, "no_extension": 2, ".json": 1, ".toml": 1}
    assert (s.total_files, s.hidden_files, s.total_directories, s.max_depth, s.average_file_size) == (6, 2, 0, 0, 0.0)
    assert {r.language: r.n for r in c.languages.collect()} == {"Python": 2, "JSON": 1}


def test_pruning_and_empty_directories(spark, tmp_path):
    root = tree(tmp_path / "p", {"src/a.py": "", "node_modules/p/i.js": "", ".github/workflows/ci.yml": ""})
    os.mkdir(f"{root}/empty")
    c = scan(spark, root)
    s, f = c.statistics.first(), c.frameworks.first()
    assert (s.total_files, s.total_directories, s.max_depth) == (1, 2, 1)
    assert f.ci_cd == [] and f.containerization == []


def test_depth(spark, tmp_path):
    from treelens.operators import index

    c = scan(spark, tree(tmp_path / "p", {"a/b/c/d.py": "", "r.py": ""}))
    s = c.statistics.first()
    assert (s.total_directories, s.max_depth) == (3, 3)
    assert [r.directory for r in index.directories(c.files).collect()] == ["a/b/c"]
    assert [(r.name, r.directory) for r in index.directories_by_name(c.files).collect()] == [("c", "a/b/c")]


def test_empty_tree(spark, tmp_path):
    c = scan(spark, tree(tmp_path / "p", {}))
    s = c.statistics.first()
    assert (s.total_files, s.total_directories, s.total_size, s.average_file_size, s.max_depth) == (0, 0, 0, 0.0, 0)
    r = c.source_roots.first()
    assert (r.path, r.score, r.language, r.reasons) == ("", 1, None, ["fallback"])
    assert c.module_index.count() == 0 and c.dependencies.count() == 0


ROOTS = {"backend/requirements.txt": "", "web/package.json": "{}", "web/src/a.ts": "", "web/src/b.ts": "", **{f"backend/app/m{i}.py": "" for i in range(10)}}


def test_source_roots_and_modules(spark, tmp_path):
    c = scan(spark, tree(tmp_path / "proj", ROOTS | {"backend/app/__init__.py": "", "backend/__init__.py": ""}))
    got = [(r.path, r.score, r.language) for r in c.source_roots.orderBy("rank").collect()]
    assert got == [("backend", 100, "Python"), ("web", 46, "TypeScript"), ("", 30, "Python")]
    assert c.source_roots.where("path = 'backend'").first().reasons == ["contains 12 source files", "contains requirements.txt", "directory named 'backend'"]
    modules = {r.module: r.path for r in c.module_index.collect()}
    assert modules["app"] == "backend/app/__init__.py" and modules["app.m0"] == "backend/app/m0.py" and "" not in modules and len(modules) == 11


def test_roots_below_an_ignored_name(spark, tmp_path):
    c = scan(spark, tree(tmp_path / "build" / "proj", ROOTS))
    assert [(r.path, r.score) for r in c.source_roots.collect()] == [("", 1)]


SOURCE = """import os, sys as s
from a.b import c as d, e
from .. import up
@deco(1)
class K(B, m.C, G[int], f(x), metaclass=M):
    "doc"
    def p(self): pass
    async def q(self): pass
    class Inner: pass
async def top():
    import json
a = b, (c, *z) = 1, 2
obj.attr = 1
n: int = 3
a += 1
if True:
    import late
"""


def test_symbols():
    got = pyast.parse(SOURCE.encode())
    assert got["deps"] == ["a.b", "json", "late", "os", "sys"]
    assert [(i["module"], i["name"], i["alias"], i["relative_level"]) for i in got["imports"]] == [("os", None, None, 0), ("sys", None, "s", 0), ("a.b", "c", "d", 0), ("a.b", "e", None, 0), ("", "up", None, 2)]
    (k,) = got["classes"]
    assert (k["name"], k["line"], k["end_line"], k["decorators"], k["base_classes"], k["docstring"]) == ("K", 5, 9, ["deco(1)"], ["B", "m.C", "G[int]", "f"], "doc")
    assert [(m["name"], m["line"], m["async_method"]) for m in k["methods"]] == [("p", 7, False), ("q", 8, True)]
    assert [(f["name"], f["line"], f["end_line"], f["async_function"]) for f in got["functions"]] == [("top", 10, 11, True)]
    assert [(v["name"], v["line"]) for v in got["variables"]] == [("a", 12), ("b", 12), ("n", 14)]


@pytest.mark.parametrize(("data", "functions", "diagnostic"), [("def f(): pass".encode("utf-16"), 1, "not UTF-8"), (b"\xef\xbb\xbfdef f(): pass", 0, None), ("# é\ndef f(): pass\n".encode("latin-1"), 0, "not UTF-8"), (b"def f(", 0, None), (None, 0, None), (b"", 0, None), (b"x = '\x00'", 0, None)])
def test_encodings(data, functions, diagnostic):
    got = pyast.parse(data)
    assert len(got["functions"]) == functions and got["diagnostic"] == diagnostic and (diagnostic is None or got["deps"] == [])


def test_rendering():
    import ast

    of = lambda s: pyast.render(ast.parse(s, mode="eval").body)
    assert [of(s) for s in ("a.b.c", "G[int, str]", "f(1).g", "'x'", "a + b")] == ["a.b.c", "G[int, str]", "f.g", "'x'", "a + b"]


def resolved(c):
    return {(r.module, r.name): (r.resolved_file, r.resolved_symbol_type) for r in c.imports.where("path = 'src/main.py'").collect()}


MAIN = "import os\nfrom pkg.m import X, Y, Z\nfrom pkg import m\nfrom . import m\nfrom .m import X\n"
BODY = "class X: pass\ndef X(): pass\nY = 1\n"


def test_resolution(spark, tmp_path):
    got = resolved(scan(spark, tree(tmp_path / "p", {"src/pkg/__init__.py": "", "src/pkg/m.py": BODY, "src/main.py": MAIN})))
    assert got == {
        ("os", None): (None, None), ("pkg.m", "X"): ("src/pkg/m.py", "class"), ("pkg.m", "Y"): ("src/pkg/m.py", "variable"), ("pkg.m", "Z"): ("src/pkg/m.py", None),
        ("pkg", "m"): ("src/pkg/__init__.py", None), ("", "m"): (None, None), ("m", "X"): (None, None),
    }
    got = resolved(scan(spark, tree(tmp_path / "q", {"src/pkg/m.py": BODY, "src/main.py": MAIN})))
    assert got["pkg", "m"] == ("src/pkg/m.py", None)


def test_manifests(spark, tmp_path):
    lines = "FastAPI==1\nflask>=2\r\ndjango~=4\npandas >= 1\nnumpy[all]\n# torch\n\npytest\n"
    f = scan(spark, tree(tmp_path / "p", {"requirements.txt": lines})).frameworks.first()
    assert f.frameworks == {"FastAPI": True, "Flask": True, "PyTest": True} and f.package_managers == "pip" and f.build_systems is None
    package = '{"dependencies":{"next":"1"},"devDependencies":{"vite":"1"},"packageManager":"pnpm@9"}'
    c = scan(spark, tree(tmp_path / "q", {"requirements.txt": "", "pyproject.toml": "[tool.poetry]\n[tool.ruff]\n", "package.json": package, "docker-compose.yml": "", "Dockerfile": ""}))
    f = c.frameworks.first()
    assert (f.package_managers, f.build_systems, f.frameworks) == ("pnpm", "Vite", {"Ruff": True, "Next.js": True, "Vite": True})
    assert f.containerization == ["Docker", "Docker Compose"]
    bad = scan(spark, tree(tmp_path / "r", {"pyproject.toml": "[tool", "package.json": "{", "compose.yml": ""}))
    assert bad.frameworks.first().containerization == [] and {r.diagnostic for r in bad.diagnostics.collect()} == {"not TOML", "not JSON"}


def run(root, *args):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_DATE": "2024-01-02T03:04:05+00:00", "GIT_COMMITTER_DATE": "2024-01-02T03:04:05+00:00"}
    subprocess.run(["git", "-c", "user.name=A B", "-c", "user.email=a@example.org", "-C", root, *args], check=True, capture_output=True, env=env)


def test_git(spark, tmp_path):
    root = tree(tmp_path / "p", {"a.py": "x = 1\n"})
    assert scan(spark, root).git.first().is_git_repository is False
    run(root, "init", "-b", "main")
    assert scan(spark, root).git.first().diagnostic == "no commit"
    run(root, "add", ".")
    run(root, "commit", "-m", "one")
    run(root, "tag", "v1")
    run(root, "remote", "add", "origin", "https://example.org/x.git")
    run(root, "update-ref", "refs/remotes/origin/release/v1", "HEAD")
    run(root, "symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/release/v1")
    tree(tmp_path / "p", {"new.py": ""})
    g = scan(spark, root).git.first()
    assert (g.current_branch, g.default_branch, g.total_commits, g.dirty, g.untracked_files, g.tags) == ("main", "v1", 1, False, ["new.py"], ["v1"])
    assert (g.last_commit_author, g.last_commit_email, g.remotes) == ("A B", "a@example.org", {"origin": "https://example.org/x.git"})
    tree(tmp_path / "p", {"a.py": "x = 2\n"})
    run(root, "checkout", "--detach")
    g = scan(spark, root).git.first()
    assert g.dirty and g.current_branch is None and g.diagnostic == "detached head"
    sub = tree(tmp_path / "p" / "sub", {"b.py": ""})
    assert scan(spark, sub).git.first().repository_root == root


def test_many_projects_links_and_bad_paths(spark, tmp_path):
    a, b = tree(tmp_path / "a", {"x.py": "import os\n"}), tree(tmp_path / "b", {"d/y.py": ""})
    os.symlink(b, f"{a}/link")
    os.symlink(a, f"{a}/loop")
    os.symlink(f"{a}/nothing", f"{a}/broken.py")
    c = scan(spark, [a, b], time_zone="IST")
    paths = {(r.root_path, r.path) for r in c.files.join(c.projects, "project_id").collect()}
    assert {p for p in paths if "loop" not in p[1]} == {(a, "x.py"), (a, "link/d/y.py"), (b, "d/y.py")}
    without = scan(spark, [a], include_files=False)
    assert without.files.count() == 0 and without.statistics.first().total_files >= 2 and without.source_roots.count() == 1
    with pytest.raises(FileNotFoundError):
        scan(spark, f"{a}/nothing")
    with pytest.raises(NotADirectoryError):
        scan(spark, f"{a}/x.py")
    with pytest.raises(ValueError):
        scan(spark, a, time_zone="CET")


def test_reports(spark, tmp_path):
    c = scan(spark, tree(tmp_path / "proj", {"src/a.py": "import os as o\nclass A:\n    def f(self): pass\n"}))
    text = report.text_report(c)
    assert "a -> src/a.py" in text and "src/a.py: os" in text and "imports 1 classes 1" in text
    assert "  import os as o" in report.symbol_listing(c)
    nested = report.as_json(c.result()).first().json
    assert '"total_files" : 1' in nested and '"project_name" : "proj"' in nested
    assert report.info()["status"] == "running" and report.health()["status"] == "healthy"
    assert report.import_statements(c.imports).select(F.col("statement")).first().statement == "import os as o"


def test_links_are_listed_but_not_followed_by_the_walk_for_roots(spark, tmp_path):
    import json

    from treelens import sources

    root, other = tree(tmp_path / "p", {"a/x.py": ""}), tree(tmp_path / "o", {"y.py": ""})
    os.symlink(other, f"{root}/src")
    os.symlink(other, f"{root}/a/tests")
    sources.register(spark)
    rows = spark.read.format("project_tree").options(paths=json.dumps([root]), ruleset="roots").load()
    assert {(r.path, r.is_dir) for r in rows.collect()} == {("", True), ("a", True), ("a/x.py", False), ("src", True), ("a/tests", True)}


def test_settings(tmp_path, monkeypatch):
    from treelens.config import Settings

    (tmp_path / ".env").write_text("# c\nAPP_NAME='x'\nDEBUG=true\n")
    monkeypatch.setenv("VERSION", "9")
    assert Settings.load(str(tmp_path / ".env")) == Settings("x", "9", True)
    assert Settings.load(None).app_name == "treelens"


def test_kept_tables_answer_the_same(spark, tmp_path):
    root = tree(tmp_path / "p", {"src/a.py": "import os\n"})
    c, again = scan(spark, root), scan(spark, root, keep=False)
    assert c.dependencies.collect() == again.dependencies.collect() and c.parsed.is_cached and not again.parsed.is_cached
    c.unpersist()
    assert not c.parsed.is_cached


def test_rules_reach_the_sources(spark, tmp_path):
    from treelens.rules import Rules

    root = tree(tmp_path / "p", {"build/a.py": "import os\n", "vendor/b.py": "import json\n", "src/c.py": "", "src/d.x": ""})
    c = scan(spark, root, rules=Rules(scan_ignore_dirs=("vendor",), root_ignore_dirs=("src",), supported_extensions=(".py", ".x")))
    assert {r.path for r in c.files.collect()} == {"build/a.py", "src/c.py", "src/d.x"}
    assert {r.path for r in c.dirs.collect()} == {"build", "src"} and c.statistics.first().total_directories == 2
    assert {r.path for r in c.parsed.collect()} == {"build/a.py", "src/c.py"}
    assert {r.path for r in c.tree.where("is_dir").collect()} == {"", "build", "vendor"}


def test_levels_below_the_top_are_partitions(tmp_path):
    import json

    from treelens.sources import tree as source

    root = tree(tmp_path / "p", {f"src/d{i}/e{k}/f.py": "" for i in range(9) for k in range(9)} | {"src/x.py": "", "top.py": ""})
    os.symlink(root, f"{root}/src/back")
    reader = source.TreeReader({"paths": json.dumps([root])})
    parts = reader.partitions()
    rows = [r[2:4] for p in parts for r in reader.read(p)]
    wanted = {("", True), ("src", True), ("src/x.py", False), ("top.py", False)} | {(f"src/d{i}", True) for i in range(9)} | {(f"src/d{i}/e{k}", True) for i in range(9) for k in range(9)} | {(f"src/d{i}/e{k}/f.py", False) for i in range(9) for k in range(9)}
    assert len(parts) == 1 + 81 and len(rows) == len(wanted) and set(rows) == wanted


def test_imports_parse_each_file_once(spark, tmp_path):
    """Without kept tables, too, the symbols of all three kinds come from one pass."""
    from treelens.operators import resolve

    c = scan(spark, tree(tmp_path / "p", {"src/a.py": "import os\n"}), keep=False)
    plan = resolve.symbol_table(c.parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    c = scan(spark, str(tmp_path / "p"))
    plan = c.imports._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan.replace(plan[plan.index("InMemoryRelation"):], "") and "project_contents" not in plan.split("InMemoryRelation")[0]
    c.unpersist()


def test_rounding_is_that_of_python(spark):
    import random

    from treelens.operators import stats

    r = random.Random(3)
    values = [0.0, 0.125, 0.375, 2.675, 1.005, 0.615, 1e-9, 0.005, 0.015, 2.5, 1e15 + 0.3, 2.0**44 + 0.125, 123456789012.125, 0.995, 99.995]
    values += [r.randrange(1, 10**9) / r.randrange(1, 10**4) for _ in range(3000)] + [k / 8 + 0.005 for k in range(500)] + [k / 200 for k in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", stats.python_round(F.col("v")).alias("x")).collect()
    assert [(x.v, x.x) for x in rows if x.x != round(x.v, 2)] == []


def test_a_scanned_repository_runs_nothing(spark, tmp_path):
    root = tree(tmp_path / "p", {"a.txt": "1", ".gitattributes": "*.txt filter=evil\n"})
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("-c", "user.name=x\x1fy", "-c", "user.email=e", "commit", "-q", "-m", "c")
    for name in ("monitor", "filter"):
        script = tmp_path / name
        script.write_text(f"#!/bin/sh\ntouch {tmp_path}/{name}.ran\ncat\n")
        script.chmod(0o755)
    git("config", "core.fsmonitor", f"{tmp_path}/monitor")
    git("config", "filter.evil.clean", f"{tmp_path}/filter")
    git("config", "filter.evil.required", "true")
    (tmp_path / "p/a.txt").write_text("2")
    s = scan(spark, root).git.first()
    assert s.is_git_repository and s.dirty and s.last_commit_author == "x\x1fy" and s.total_commits == 1
    assert not list(tmp_path.glob("*.ran"))


def reference_roots(base: Path, ignored: set[str]):
    """Source roots by walking again for each directory, in plain Python."""
    from treelens import rules

    found = []
    for d in [base, *(p for p in base.rglob("*") if p.is_dir())]:
        if set(d.parts) & ignored:
            continue
        sources = [f for f in d.rglob("*") if f.is_file() and not set(f.parts) & ignored and f.suffix.lower() in rules.ROOT_LANGUAGE]
        files, inner = [f.name for f in d.iterdir() if f.is_file()], {x.name.lower() for x in d.iterdir() if x.is_dir()}
        score = 30 * (d.name.lower() in rules.COMMON_SOURCE_NAMES) + 40 * len(set(files) & set(rules.PROJECT_FILES)) + min(30, 3 * len(sources)) + min(20, 5 * len(inner & set(rules.IMPORTANT_SUBDIRS)))
        if score >= 30:
            found.append((-score, len(d.parts), d.as_posix(), d))
    kept = []
    for score, _, _, d in sorted(found):
        if not any(d.is_relative_to(k) for _, k in kept):
            kept.append((-score, d))
    return [(s, "" if d == base else d.relative_to(base).as_posix()) for s, d in kept] or [(1, "")]


def test_roots_of_random_trees_equal_the_plain_walk(spark, tmp_path):
    import random

    from treelens import rules

    r, paths = random.Random(4), []
    for i in range(12):
        names = ["src", "app", "models", "views", "x", "y", "build", "Core", "tests", "node_modules"]
        files = ["a.py", "b.ts", "c.cpp", "package.json", "go.mod", "README.md", "Makefile", "d.PY"]
        content = {"/".join([*r.choices(names, k=r.randint(0, 4)), r.choice(files)]): "" for _ in range(r.randint(0, 40))}
        content = {k: v for k, v in content.items() if not any(o != k and o.startswith(k + "/") for o in content)}
        paths.append(tree(tmp_path / f"t{i}" / r.choice(["proj", "src"]), content))
    c = scan(spark, paths)
    got = {}
    for row in c.source_roots.join(c.projects, "project_id").orderBy("rank").collect():
        got.setdefault(row.root_path, []).append((row.score, row.path))
    assert got == {p: reference_roots(Path(p), set(rules.ROOT_IGNORE_DIRS)) for p in paths}


def test_sources_hand_their_rows_on_in_small_batches(spark, tmp_path):
    """A worker holds few files of a large partition, and few bytes of large files."""
    import json

    from pyspark.sql.types import _parse_datatype_string

    from treelens.sources import tree as source

    files = {f"src/m{i}.py": f"import os\nclass C{i}: pass\n" for i in range(1_201)} | {f"src/large{i}.py": "# " + "x" * 300_000 + "\n" for i in range(9)}
    root = tree(tmp_path / "p", files)
    # options have no upper case
    options = {"paths": json.dumps([root]), "extensions": json.dumps([".py"])}
    for kind in (source.ProjectTree, source.ProjectContents):
        made = kind(options)
        reader, found = made.reader(_parse_datatype_string(made.schema())), []
        for p in reader.partitions():
            for b in reader.read(p):
                assert 0 < b.num_rows <= source.BATCH_ROWS and b.nbytes < source.BATCH_BYTES + 310_000
                found += b.column("path").to_pylist()
        assert sorted(x for x in found if x.endswith(".py")) == sorted(files)
    c = scan(spark, root)
    got = {r.path: ([x.name for x in r.classes], r.deps) for r in c.parsed.collect()}
    assert got == {p: ([f"C{p[5:-3]}"], ["os"]) if p.startswith("src/m") else ([], []) for p in files}
    contents = spark.createDataFrame([("p", p, t.encode()) for p, t in files.items()], "project_id string, path string, content binary").coalesce(1)
    assert {r.path: ([x.name for x in r.classes], r.deps) for r in pyast.symbols(contents).collect()} == got
    c.unpersist()
