"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..config import Settings
from ..functions import paths
from ..operators import git, index, listing, manifests, pyast, resolve, roots, stats
from . import carrier, report
from .scan import scan

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _values(pairs: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


NAME = "string_split(path, '/')[-1]"
PARENT = "regexp_extract(path, '(?s)^(.*)/[^/]+$', 1)"
EXTENSION = f"lower(regexp_extract({NAME}, '(?s)^.+?(\\.[^.]+)$', 1))"
V = f"v AS (SELECT project_id, path, min(seq) AS seq, arg_min(size, seq) AS size FROM (SELECT {carrier.LISTING_COLUMNS} FROM documents) GROUP BY project_id, path)"
LISTED = f"{V}, n AS (SELECT *, {NAME} AS name, {PARENT} AS parent, {EXTENSION} AS extension FROM v)"
SEEN = f"""{LISTED}, f AS (SELECT * FROM n WHERE NOT list_has_any(string_split(parent, '/'), [{_list(rules.SCAN_IGNORE_DIRS)}])
  AND name NOT IN ({_list(rules.SCAN_IGNORE_FILES)}) AND (extension = '' OR extension IN ({_list(rules.SUPPORTED_EXTENSIONS)})))"""
UP = "unnest(range(0, CASE WHEN {0} = '' THEN 1 ELSE len(string_split({0}, '/')) + 1 END))"
DIRS = f"d AS (SELECT DISTINCT project_id, array_to_string(string_split(parent, '/')[1:i], '/') AS path FROM (SELECT project_id, parent, {UP.format('parent')} AS i FROM (SELECT DISTINCT project_id, parent FROM n)))"
COUNTS = f"""{LISTED}, {DIRS},
s AS (SELECT project_id, path, parent, language FROM n JOIN (VALUES {_values(rules.ROOT_LANGUAGE)}) t(extension, language) USING (extension)
  WHERE NOT list_has_any(string_split(path, '/'), [{_list(rules.ROOT_IGNORE_DIRS)}])),
c AS (SELECT project_id, array_to_string(string_split(parent, '/')[1:i], '/') AS directory, language, count(*) AS n, min(path) AS first_path
  FROM (SELECT *, {UP.format('parent')} AS i FROM s) GROUP BY ALL)"""
DOMINANT = f"""{COUNTS}, m AS (SELECT project_id, directory, sum(n) OVER (PARTITION BY project_id, directory) AS n_sources, language,
  row_number() OVER (PARTITION BY project_id, directory ORDER BY n DESC, first_path) AS r FROM c)"""
SCORES = f"""{DOMINANT}, own AS (SELECT project_id, path, CASE WHEN path = '' THEN project_id ELSE {NAME} END AS name FROM d WHERE NOT list_has_any(string_split(path, '/'), [{_list(rules.ROOT_IGNORE_DIRS)}])),
pf AS (SELECT project_id, parent AS path, count(*) AS k FROM n WHERE name IN ({_list(rules.PROJECT_FILES)}) GROUP BY ALL),
sub AS (SELECT project_id, {PARENT} AS path, count(DISTINCT lower({NAME})) AS k FROM d WHERE path <> '' AND lower({NAME}) IN ({_list(rules.IMPORTANT_SUBDIRS)}) GROUP BY ALL),
sc AS (SELECT own.project_id, own.path, m.language, CAST(CASE WHEN lower(own.name) IN ({_list(rules.COMMON_SOURCE_NAMES)}) THEN 30 ELSE 0 END + 40 * coalesce(pf.k, 0)
    + least(3 * coalesce(m.n_sources, 0), 30) + least(5 * coalesce(sub.k, 0), 20) AS INT) AS score
  FROM own LEFT JOIN pf ON pf.project_id = own.project_id AND pf.path = own.path LEFT JOIN sub ON sub.project_id = own.project_id AND sub.path = own.path
  LEFT JOIN m ON m.project_id = own.project_id AND m.directory = own.path AND m.r = 1)"""
ROOTS = f"""{SCORES}, cand AS (SELECT * FROM sc WHERE score >= {rules.MIN_ROOT_SCORE}),
kept AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.project_id = a.project_id AND b.path <> a.path AND b.score >= a.score AND (b.path = '' OR starts_with(a.path, b.path || '/')))
  UNION ALL SELECT DISTINCT project_id, '' AS path, NULL AS language, 1 AS score FROM v WHERE project_id NOT IN (SELECT project_id FROM cand)),
rt AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END, path) AS INT) AS rank FROM kept)"""
OWNED = SEEN.replace(LISTED, ROOTS) + """, ow AS (SELECT f.project_id, f.path, f.seq, f.extension, arg_min(rt.path, rank) AS root FROM f JOIN rt ON rt.project_id = f.project_id
  AND (rt.path = '' OR starts_with(f.path, rt.path || '/')) GROUP BY ALL)"""
MODULES = f"""{OWNED}, mn AS (SELECT project_id, path, seq, replace(regexp_replace(regexp_replace(CASE WHEN root = '' THEN path ELSE substr(path, length(root) + 2) END, '\\.[^./]+$', ''), '(^|/)__init__$', ''), '/', '.') AS module
  FROM ow WHERE extension = '.py'), mi AS (SELECT project_id, module, arg_max(path, seq) AS path FROM mn WHERE module <> '' GROUP BY project_id, module)"""
PY = f"{V}, py AS (SELECT project_id, path, seq FROM v WHERE lower(path) LIKE '%.py')"
#: Imports of the generated sources, and their symbols.
IMPORTS = """im AS (SELECT project_id, path, 0 AS ord, 'os' AS module, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS alias, 0 AS relative_level FROM py
  UNION ALL SELECT project_id, path, 1, 'm' || (seq % 13), 'fn' || (seq % 5), NULL, 0 FROM py UNION ALL SELECT project_id, path, 2, 'm' || (seq % 13), 'K', 'k', 0 FROM py)"""
SYMBOLS = """sy AS (SELECT project_id, path, 'C' || (seq % 4) AS name, 'class' AS type FROM py UNION ALL SELECT project_id, path, 'fn' || ((seq + 1) % 5), 'function' FROM py UNION ALL SELECT project_id, path, 'K', 'variable' FROM py)"""
#: Modules for imports to resolve to: the name of a file without its suffix; of equal names the last.
SHORT = f"md AS (SELECT project_id, regexp_replace({NAME}, '\\.[^./]+$', '') AS module, arg_max(path, seq) AS path FROM py GROUP BY ALL)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.visible_files(carrier.listing(spark, sf_dir))


@query(f"WITH {SEEN} SELECT project_id, seq, path, name, parent, CAST(CASE WHEN parent = '' THEN 0 ELSE len(string_split(parent, '/')) END AS INT) AS depth, extension, size, starts_with(name, '.') AS is_hidden FROM f")
def scan_visible_files(spark, sf_dir):
    return _files(spark, sf_dir).select("project_id", "seq", "path", "name", "parent", "depth", "extension", "size", "is_hidden")


def _totals(spark, sf_dir):
    dirs = listing.visible_directories(listing.all_directories(carrier.listing(spark, sf_dir)))
    return stats.project_totals(_files(spark, sf_dir), dirs)


TOTALS = f"""{SEEN}, {DIRS}, a AS (SELECT project_id, count(*) AS total_files, sum(size)::BIGINT AS total_size, count(*) FILTER (starts_with(name, '.')) AS hidden_files FROM f GROUP BY project_id),
b AS (SELECT project_id, count(*) AS total_directories, max(len(string_split(path, '/')))::INT AS max_depth FROM d WHERE path <> '' AND NOT list_has_any(string_split(path, '/'), [{_list(rules.SCAN_IGNORE_DIRS)}]) GROUP BY project_id),
t AS (SELECT project_id, coalesce(total_files, 0) AS total_files, coalesce(total_directories, 0) AS total_directories, coalesce(total_size, 0) AS total_size, coalesce(hidden_files, 0) AS hidden_files, coalesce(max_depth, 0) AS max_depth FROM a FULL JOIN b USING (project_id))"""


@query(f"WITH {TOTALS} SELECT * FROM t")
def project_totals(spark, sf_dir):
    return _totals(spark, sf_dir)


#: printf rounds the exact binary value.
AVERAGE = "CASE WHEN total_files = 0 THEN 0.0 ELSE CAST(printf('%.2f', total_size::DOUBLE / total_files::DOUBLE) AS DOUBLE) END AS average_file_size"


@query(f"WITH {TOTALS} SELECT project_id, {AVERAGE}, CASE WHEN total_files = 0 THEN 0.0 ELSE total_size::DOUBLE / total_files::DOUBLE END AS exact FROM t")
def average_file_size(spark, sf_dir):
    totals = _totals(spark, sf_dir)
    exact = stats.average_file_size(totals, rounded=False).select("project_id", F.col("average_file_size").alias("exact"))
    return stats.average_file_size(totals).select("project_id", "average_file_size").join(exact, "project_id")


HISTOGRAM = f"{SEEN}, h AS (SELECT project_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS extension, count(*) AS n FROM f GROUP BY ALL)"


@query(f"WITH {HISTOGRAM} SELECT * FROM h")
def extension_histogram(spark, sf_dir):
    return stats.extension_histogram(_files(spark, sf_dir))


@query(f"WITH {SEEN} SELECT project_id, extension, sum(size)::BIGINT AS total_size FROM f GROUP BY ALL")
def size_by_extension(spark, sf_dir):
    return stats.size_by_extension(_files(spark, sf_dir))


@query(f"WITH {HISTOGRAM} SELECT project_id, language, sum(n)::BIGINT AS n FROM h JOIN (VALUES {_values(rules.EXTENSION_LANGUAGE)}) t(extension, language) USING (extension) GROUP BY ALL")
def language_rollup(spark, sf_dir):
    return stats.language_rollup(stats.extension_histogram(_files(spark, sf_dir)))


#: A list of files as text, in scan order.
FILES = "count(*) AS n, arg_min(path, seq) AS first_path, string_agg(seq || ':' || path || ':' || size, ',' ORDER BY seq) AS files"


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("files", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["seq"].cast("string"), f["path"], f["size"].cast("string"))), ","))


@query(f"WITH {SEEN} SELECT project_id, name, {FILES} FROM f GROUP BY project_id, name")
def files_by_name(spark, sf_dir):
    return _listed(index.files_by(_files(spark, sf_dir), "name"))


@query(f"WITH {SEEN} SELECT project_id, extension, {FILES} FROM f GROUP BY project_id, extension")
def files_by_extension(spark, sf_dir):
    return _listed(index.files_by(_files(spark, sf_dir), "extension"))


@query(f"WITH {SEEN} SELECT project_id, name, seq, path FROM f WHERE name IN ({_list(rules.KNOWN_CONFIG_FILES)})")
def config_files(spark, sf_dir):
    return index.config_files(_files(spark, sf_dir)).select("project_id", "name", "seq", "path")


@query(f"WITH {SEEN} SELECT DISTINCT project_id, parent AS directory FROM f WHERE parent <> ''")
def directories(spark, sf_dir):
    return index.directories(_files(spark, sf_dir))


@query(f"WITH {SEEN} SELECT project_id, string_split(parent, '/')[-1] AS name, arg_min(parent, seq) AS directory FROM f WHERE parent <> '' GROUP BY ALL")
def directories_by_name(spark, sf_dir):
    return index.directories_by_name(_files(spark, sf_dir))


@query(f"WITH {COUNTS} SELECT project_id, directory, language, n FROM c")
def subtree_language_counts(spark, sf_dir):
    v = carrier.listing(spark, sf_dir)
    return roots.subtree_language_counts(v, carrier.projects(v)).drop("first_path")


@query(f"WITH {DOMINANT} SELECT project_id, directory, language, n_sources::BIGINT AS n_sources FROM m WHERE r = 1")
def dominant_language(spark, sf_dir):
    v = carrier.listing(spark, sf_dir)
    found = roots.dominant_language(roots.subtree_language_counts(v, carrier.projects(v)))
    return found.select("project_id", "directory", "language", roots.source_file_count(F.col("language_counts")).alias("n_sources"))


def _scores(v: DataFrame) -> DataFrame:
    return roots.root_scores(v, listing.all_directories(v), carrier.projects(v))


@query(f"WITH {SCORES} SELECT project_id, path, score, language FROM sc")
def root_scores(spark, sf_dir):
    return _scores(carrier.listing(spark, sf_dir)).select("project_id", "path", "score", "language")


def _roots(v: DataFrame) -> DataFrame:
    return roots.source_roots(_scores(v), carrier.projects(v))


#: Roots with their reasons and language counts, as texts.
REASONS = f"""{ROOTS}, nm AS (SELECT project_id, parent AS path, list(DISTINCT 'contains ' || name) AS names FROM n WHERE name IN ({_list(rules.PROJECT_FILES)}) GROUP BY ALL),
lc AS (SELECT project_id, directory AS path, sum(n) AS n_sources, string_agg(language || '=' || n, ',' ORDER BY language) AS counts FROM c GROUP BY ALL),
why AS (SELECT own.project_id, own.path, coalesce(lc.counts, '') AS language_counts, array_to_string(list_sort(list_concat(list_concat(
    CASE WHEN lower(own.name) IN ({_list(rules.COMMON_SOURCE_NAMES)}) THEN ['directory named ' || chr(39) || own.name || chr(39)] ELSE [] END,
    CASE WHEN n_sources = 1 THEN ['contains 1 source file'] WHEN n_sources > 1 THEN ['contains ' || n_sources || ' source files'] ELSE [] END),
    list_concat(CASE WHEN sub.k > 0 THEN ['contains common source directories'] ELSE [] END, coalesce(nm.names, [])))), ', ') AS reasons
  FROM own LEFT JOIN nm USING (project_id, path) LEFT JOIN lc USING (project_id, path) LEFT JOIN sub USING (project_id, path))"""
ROOT_ROWS = """SELECT project_id, rank, rt.path, score, language, 'Low' AS confidence, CASE WHEN score = 1 THEN 'fallback' ELSE reasons END AS reasons, CASE WHEN score = 1 THEN '' ELSE language_counts END AS language_counts
  FROM rt LEFT JOIN why USING (project_id, path)"""


def _shown(found: DataFrame) -> DataFrame:
    counts = F.array_join(F.transform(F.map_entries("language_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumns({"reasons": F.array_join("reasons", ", "), "language_counts": F.coalesce(counts, F.lit(""))})


@query(f"WITH {REASONS} {ROOT_ROWS}")
def source_roots(spark, sf_dir):
    return _shown(_roots(carrier.listing(spark, sf_dir)))


@query(f"WITH {OWNED} SELECT project_id, path, root FROM ow")
def owning_root(spark, sf_dir):
    v = carrier.listing(spark, sf_dir)
    return index.owning_roots(listing.visible_files(v), _roots(v)).select("project_id", "path", "root")


@query(f"WITH {MODULES} SELECT * FROM mi")
def module_index(spark, sf_dir):
    v = carrier.listing(spark, sf_dir)
    return index.module_index(listing.visible_files(v), _roots(v))


@query(f"""WITH {V}, r AS (SELECT project_id, lower(trim(unnest(string_split({carrier.REQUIREMENTS}, chr(10))))) AS p FROM v),
c AS (SELECT project_id, split_part(split_part(split_part(p, '==', 1), '>=', 1), '<=', 1) AS package FROM r WHERE p <> '' AND NOT starts_with(p, '#'))
SELECT DISTINCT project_id, framework FROM c JOIN (VALUES {_values(rules.PYTHON_PACKAGES)}) t(package, framework) USING (package)""")
def requirements_frameworks(spark, sf_dir):
    rows = carrier.manifests(carrier.listing(spark, sf_dir), "requirements.txt")
    return manifests.frameworks_of(manifests.requirement_packages(rows), rules.PYTHON_PACKAGES)


@query(f"""WITH {V}, p AS (SELECT project_id, unnest([{carrier.FIRST}, {carrier.SECOND}]) AS package FROM v)
SELECT DISTINCT project_id, framework FROM p JOIN (VALUES {_values(rules.JS_PACKAGES)}) t(package, framework) USING (package)""")
def package_json_frameworks(spark, sf_dir):
    rows = manifests.package_json(carrier.manifests(carrier.listing(spark, sf_dir), "package.json"))
    return manifests.frameworks_of(rows.select("project_id", F.explode("packages").alias("package")), rules.JS_PACKAGES)


@query(f"WITH {V} SELECT project_id, path, CASE CAST(seq % 6 AS INT) WHEN 0 THEN 'pnpm' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' END AS package_manager FROM v")
def package_manager(spark, sf_dir):
    rows = manifests.package_json(carrier.manifests(carrier.listing(spark, sf_dir), "package.json"))
    return rows.select("project_id", "path", manifests.package_manager(F.col("package_manager")).alias("package_manager"))


@query(f"WITH {V} SELECT project_id, path, CASE WHEN {carrier.SECOND} = 'vite' THEN 'Vite' WHEN {carrier.FIRST} = 'next' THEN 'Next.js' END AS build_system FROM v")
def build_system(spark, sf_dir):
    rows = manifests.package_json(carrier.manifests(carrier.listing(spark, sf_dir), "package.json"))
    return rows.select("project_id", "path", manifests.build_system(F.col("packages")).alias("build_system"))


@query(f"""WITH {V}, m AS (SELECT project_id, 0 AS kind, min(seq) AS seq, 0 AS n, 'pip' AS x FROM v GROUP BY project_id UNION ALL SELECT project_id, 1, seq, 0, 'Poetry' FROM v WHERE {carrier.TOOL} = 'poetry'
  UNION ALL SELECT project_id, 2, -1, 0, 'npm' FROM v UNION ALL SELECT project_id, 2, seq, 1, CASE CAST(seq % 6 AS INT) WHEN 0 THEN 'pnpm' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' END FROM v),
b AS (SELECT project_id, seq, CASE WHEN {carrier.SECOND} = 'vite' THEN 'Vite' WHEN {carrier.FIRST} = 'next' THEN 'Next.js' END AS x FROM v)
SELECT * FROM (SELECT project_id, arg_max(x, kind * 1000000000000 + seq * 10 + n) AS package_managers FROM m WHERE x IS NOT NULL GROUP BY project_id)
FULL JOIN (SELECT project_id, arg_max(x, seq) AS build_systems FROM b WHERE x IS NOT NULL GROUP BY project_id) USING (project_id)""")
def manifest_scalars(spark, sf_dir):
    v = carrier.listing(spark, sf_dir)
    rows = carrier.manifests(v, "requirements.txt").union(carrier.manifests(v, "pyproject.toml")).union(carrier.manifests(v, "package.json"))
    return manifests.scalars(rows, rows)


@query(f"WITH {V} SELECT project_id, path, {carrier.TOOL} AS tool FROM v")
def pyproject_tools(spark, sf_dir):
    rows = manifests.pyproject_tools(carrier.manifests(carrier.listing(spark, sf_dir), "pyproject.toml"))
    return rows.select("project_id", "path", F.explode("tools").alias("tool"))


@query(f"""WITH {SEEN}, c AS (SELECT * FROM f WHERE name IN ({_list(rules.KNOWN_CONFIG_FILES)}))
SELECT project_id, CASE WHEN bool_or(name = 'Dockerfile') THEN 'Docker' ELSE '' END || CASE WHEN bool_or(name IN ('docker-compose.yml', 'compose.yml')) THEN ',Docker Compose' ELSE '' END AS containerization FROM c GROUP BY project_id""")
def containerization(spark, sf_dir):
    found = manifests.containerization(index.config_files(_files(spark, sf_dir)))
    return found.select("project_id", F.array_join("containerization", ",").alias("containerization"))


@query(f"WITH {LISTED} SELECT project_id, CASE WHEN bool_or(starts_with(parent, '.github')) THEN 'GitHub Actions' ELSE '' END AS ci_cd FROM n WHERE parent <> '' GROUP BY project_id")
def ci_cd(spark, sf_dir):
    # over all parents: a scan itself never lists .github
    v = carrier.listing(spark, sf_dir).select("project_id", paths.parent(F.col("path")).alias("parent"))
    return manifests.ci_cd(index.directories(v)).select("project_id", F.array_join("ci_cd", ",").alias("ci_cd"))


def _parsed(spark, sf_dir) -> DataFrame:
    return pyast.symbols(carrier.python_sources(carrier.listing(spark, sf_dir)))


@query(f"WITH {PY} SELECT project_id, path, unnest(['json', 'm' || (seq % 13), 'os']) AS module FROM py")
def dependency_edges(spark, sf_dir):
    return pyast.edges(_parsed(spark, sf_dir))


@query(f"WITH {PY}, {IMPORTS} SELECT * FROM im")
def symbols_imports(spark, sf_dir):
    return pyast.rows_of(_parsed(spark, sf_dir), "imports")


@query(f"WITH {PY} SELECT project_id, path, 'C' || (seq % 4) AS name, 3 AS line, 4 AS end_line, 'Base' || (seq % 3) AS base_classes, 1 AS n_methods FROM py")
def symbols_classes(spark, sf_dir):
    rows = pyast.rows_of(_parsed(spark, sf_dir), "classes")
    return rows.select("project_id", "path", "name", "line", "end_line", F.array_join("base_classes", ",").alias("base_classes"), F.size("methods").alias("n_methods"))


@query(f"WITH {PY} SELECT project_id, path, 'C' || (seq % 4) AS class, 'run' AS name, 4 AS line, 4 AS end_line, false AS async_method FROM py")
def symbols_methods(spark, sf_dir):
    return pyast.methods(_parsed(spark, sf_dir)).select("project_id", "path", "class", "name", "line", "end_line", "async_method")


@query(f"WITH {PY} SELECT project_id, path, 'fn' || ((seq + 1) % 5) AS name, 5 AS line, 5 AS end_line, false AS async_function FROM py")
def symbols_functions(spark, sf_dir):
    return pyast.rows_of(_parsed(spark, sf_dir), "functions").select("project_id", "path", "name", "line", "end_line", "async_function")


@query(f"WITH {PY} SELECT project_id, path, 'K' AS name, 6 AS line FROM py")
def symbols_variables(spark, sf_dir):
    return pyast.rows_of(_parsed(spark, sf_dir), "variables").select("project_id", "path", "name", "line")


@query(f"WITH {PY} SELECT project_id, path, 3 AS n_imports, 1 AS n_classes, 1 AS n_functions, 1 AS n_variables FROM py")
def symbol_counts(spark, sf_dir):
    return pyast.symbol_counts(_parsed(spark, sf_dir))


def _short_modules(v: DataFrame) -> DataFrame:
    own = v.where("lower(path) LIKE '%.py'").withColumn("module", F.regexp_replace(paths.name(F.col("path")), r"\.[^./]+$", ""))
    return own.groupBy("project_id", "module").agg(F.max_by("path", "seq").alias("path"))


RESOLVED = f"""{PY}, {IMPORTS}, {SHORT}, rs AS (SELECT im.*, coalesce(a.path, b.path) AS resolved_file FROM im LEFT JOIN md a ON a.project_id = im.project_id AND a.module = im.module
  LEFT JOIN md b ON b.project_id = im.project_id AND b.module = im.module || '.' || im.name)"""


@query(f"WITH {RESOLVED} SELECT project_id, path, ord, module, name, resolved_file FROM rs")
def resolve_modules(spark, sf_dir):
    imports = pyast.rows_of(_parsed(spark, sf_dir), "imports")
    return resolve.resolve_modules(imports, _short_modules(carrier.listing(spark, sf_dir))).select("project_id", "path", "ord", "module", "name", "resolved_file")


@query(f"""WITH {RESOLVED}, {SYMBOLS} SELECT rs.project_id, rs.path, ord, module, rs.name, resolved_file, sy.name AS resolved_symbol, sy.type AS resolved_symbol_type
FROM rs LEFT JOIN sy ON sy.project_id = rs.project_id AND sy.path = resolved_file AND sy.name = rs.name""")
def resolve_symbols(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    resolved = resolve.resolve_modules(pyast.rows_of(parsed, "imports"), _short_modules(carrier.listing(spark, sf_dir)))
    found = resolve.resolve_symbols(resolved, resolve.symbol_table(parsed))
    return found.select("project_id", "path", "ord", "module", "name", "resolved_file", "resolved_symbol", "resolved_symbol_type")


@query(f"""WITH {PY}, {IMPORTS} SELECT project_id, path, ord, CASE WHEN name IS NULL THEN 'import ' || module ELSE 'from ' || module || ' import ' || name END || coalesce(' as ' || alias, '') AS statement FROM im""")
def import_statement_text(spark, sf_dir):
    return report.import_statements(pyast.rows_of(_parsed(spark, sf_dir), "imports"))


def _commits(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.select(
        F.col("user_id").cast("string").alias("project_id"), F.row_number().over(newest).alias("ord"), F.col("event_id").cast("string").alias("hash"),
        F.col("event_type").alias("author"), F.concat("event_type", F.lit("@example.org")).alias("email"), F.col("ts").alias("committed_at"),
    )


@query("""SELECT CAST(user_id AS VARCHAR) AS project_id, count(*) AS total_commits, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS last_commit_hash, arg_max(event_type, (ts, event_id)) AS last_commit_author,
  arg_max(event_type, (ts, event_id)) || '@example.org' AS last_commit_email FROM events GROUP BY user_id""")
def commit_totals(spark, sf_dir):
    return git.commit_totals(_commits(spark, sf_dir)).drop("last_commit_date")


@query("SELECT page_id, string_split(url, '/')[-1] AS default_branch FROM pages")
def default_branch(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.last_segment(F.col("url")).alias("default_branch"))


@query("SELECT 'p' || (page_id % 10) AS project_id, split_part(url, '/', 3) AS name, arg_min(url, page_id) AS url FROM pages GROUP BY ALL")
def remotes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("concat('p', page_id % 10) AS project_id", "split_part(url, '/', 3) AS name", "url", "page_id AS ord")
    return git.remotes(rows).select("project_id", F.explode("remotes").alias("name", "url"))


@query(f"WITH {V} SELECT DISTINCT project_id AS project, sha256(lower('/Data/' || project_id)) AS project_id FROM v")
def project_id(spark, sf_dir):
    names = carrier.listing(spark, sf_dir).select(F.col("project_id").alias("project")).distinct()
    return names.select("project", paths.project_id(F.concat(F.lit("/Data/"), "project")).alias("project_id"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def tz_render(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.date_format(stats.in_zone(F.col("ts").cast("timestamp"), "IST"), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query(f"""WITH {TOTALS} SELECT '{{"project_id":"' || project_id || '","total_files":' || total_files || ',"total_directories":' || total_directories || ',"total_size":' || total_size
  || ',"hidden_files":' || hidden_files || ',"max_depth":' || max_depth || '}}' AS json FROM t""")
def report_json(spark, sf_dir):
    return report.as_json(_totals(spark, sf_dir), pretty=False)


@query(f"""WITH {V}, r AS (SELECT project_id, lower(trim(unnest(string_split({carrier.REQUIREMENTS}, chr(10))))) AS p FROM v),
x AS (SELECT project_id, framework FROM r JOIN (VALUES {_values(rules.PYTHON_PACKAGES)}) t(package, framework) ON package = split_part(split_part(split_part(p, '==', 1), '>=', 1), '<=', 1) AND NOT starts_with(p, '#')
  UNION SELECT project_id, framework FROM v JOIN (VALUES {_values(rules.PYPROJECT_TOOLS)}) t(package, framework) ON package = {carrier.TOOL}
  UNION SELECT project_id, framework FROM (SELECT project_id, unnest([{carrier.FIRST}, {carrier.SECOND}]) AS package FROM v) JOIN (VALUES {_values(rules.JS_PACKAGES)}) t(package, framework) USING (package))
SELECT DISTINCT project_id, framework FROM x""")
def framework_flags(spark, sf_dir):
    v = carrier.listing(spark, sf_dir)
    return manifests.framework_flags(carrier.manifests(v, "requirements.txt").union(carrier.manifests(v, "pyproject.toml")).union(carrier.manifests(v, "package.json")))


# What follows reads projects that are written to disk first, as the listing has them; "first" and "last" go by path there.

DISK = V.replace("arg_min(size, seq) AS size FROM", "arg_min(size, seq) AS given FROM").replace("v AS (SELECT project_id", "v0 AS (SELECT project_id") + f", v AS (SELECT project_id, path, seq, length({carrier.ON_DISK.replace('size %', 'given %')}) AS size FROM v0)"


def _on_disk(sql: str) -> str:
    return sql.replace(V, DISK)


def _scan(spark, sf_dir):
    return scan(spark, carrier.write_tree(spark, sf_dir))


def _named(catalog, rows: DataFrame) -> DataFrame:
    """``rows`` with the name of their project instead of its id."""
    return rows.join(catalog.projects.select("project_id", "project_name"), "project_id").drop("project_id")


DEPTH = "CAST(CASE WHEN parent = '' THEN 0 ELSE len(string_split(parent, '/')) END AS INT)"


@query(_on_disk(f"WITH {SEEN} SELECT project_id AS project_name, row_number() OVER (PARTITION BY project_id ORDER BY path) AS seq, path, name, parent, {DEPTH} AS depth, extension, size, starts_with(name, '.') AS is_hidden FROM f"))
def tree_files(spark, sf_dir):
    c = _scan(spark, sf_dir)
    return _named(c, c.files).drop("modified_time", "created_time", "zone")


@query(_on_disk(f"""WITH {TOTALS}, hx AS (SELECT project_id, string_agg(extension || '=' || n, ',' ORDER BY extension) AS extensions FROM (SELECT project_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS extension, count(*) AS n FROM f GROUP BY ALL) GROUP BY project_id)
SELECT project_id AS project_name, total_files, total_directories, total_size, hidden_files, max_depth, {AVERAGE}, extensions FROM t LEFT JOIN hx USING (project_id)"""))
def tree_statistics(spark, sf_dir):
    c = _scan(spark, sf_dir)
    extensions = F.array_join(F.transform(F.map_entries("extensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _named(c, c.statistics).withColumn("extensions", extensions)


@query(_on_disk(f"WITH {REASONS} SELECT project_id AS project_name, * EXCLUDE (project_id) FROM ({ROOT_ROWS})"))
def tree_roots(spark, sf_dir):
    c = _scan(spark, sf_dir)
    return _named(c, _shown(c.source_roots))


TREE_MODULES = _on_disk(MODULES).replace("arg_max(path, seq) AS path FROM mn", "max(path) AS path FROM mn")


@query(f"WITH {TREE_MODULES} SELECT project_id AS project_name, module, path FROM mi")
def tree_modules(spark, sf_dir):
    c = _scan(spark, sf_dir)
    return _named(c, c.module_index)


TREE_IMPORTS = f"""{TREE_MODULES}, py AS (SELECT project_id, path, seq FROM f WHERE extension = '.py'), {IMPORTS}, {SYMBOLS},
rs AS (SELECT im.*, coalesce(a.path, b.path) AS resolved_file FROM im LEFT JOIN mi a ON a.project_id = im.project_id AND a.module = im.module LEFT JOIN mi b ON b.project_id = im.project_id AND b.module = im.module || '.' || im.name)"""


@query(f"""WITH {TREE_IMPORTS} SELECT rs.project_id AS project_name, rs.path, ord, module, rs.name, alias, relative_level, resolved_file, sy.name AS resolved_symbol, sy.type AS resolved_symbol_type
FROM rs LEFT JOIN sy ON sy.project_id = rs.project_id AND sy.path = resolved_file AND sy.name = rs.name""")
def tree_imports(spark, sf_dir):
    c = _scan(spark, sf_dir)
    return _named(c, c.imports)


@query(_on_disk(f"""WITH {SEEN}, p AS (SELECT *, {carrier.FIRST} AS a, {carrier.SECOND} AS b, CASE CAST(seq % 6 AS INT) WHEN 0 THEN 'pnpm' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' END AS pm FROM f WHERE name = 'package.json'),
fw AS (SELECT project_id, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM (SELECT DISTINCT project_id, framework FROM (SELECT project_id, unnest([a, b]) AS package FROM p) JOIN (VALUES {_values(rules.JS_PACKAGES)}) t(package, framework) USING (package)) GROUP BY project_id),
bs AS (SELECT project_id, CASE WHEN b = 'vite' THEN 'Vite' WHEN a = 'next' THEN 'Next.js' END AS x, path FROM p),
pn AS (SELECT project_id, coalesce(arg_max(pm, path) FILTER (pm IS NOT NULL), 'npm') AS package_managers FROM p GROUP BY project_id)
SELECT g.project_id AS project_name, coalesce(frameworks, '') AS frameworks, package_managers, (SELECT arg_max(x, path) FROM bs WHERE bs.project_id = g.project_id AND x IS NOT NULL) AS build_systems,
  CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.project_id = g.project_id AND name = 'Dockerfile') THEN 'Docker' ELSE '' END AS containerization, '' AS ci_cd
FROM (SELECT DISTINCT project_id FROM v) g LEFT JOIN fw USING (project_id) LEFT JOIN pn USING (project_id)"""))
def tree_frameworks(spark, sf_dir):
    c = _scan(spark, sf_dir)
    lists = {k: F.array_join(k, ",") for k in ("containerization", "ci_cd")} | {"frameworks": F.array_join(F.map_keys("frameworks"), ",")}
    return _named(c, c.frameworks).withColumns(lists)


SYMBOL_LINE = "' imports 3 classes 1 functions 1 variables 1'"


@query(f"""WITH {TREE_IMPORTS}, hl AS (SELECT project_id, language, count(*) AS n FROM f JOIN (VALUES {_values(rules.EXTENSION_LANGUAGE)}) t(extension, language) USING (extension) GROUP BY ALL)
SELECT project_id AS project_name, 'Languages' AS section, rpad(language, 20, ' ') || ' ' || n AS line FROM hl UNION ALL SELECT project_id, 'Modules', module || ' -> ' || path FROM mi
UNION ALL SELECT project_id, 'Dependencies', path || ': json, m' || (seq % 13) || ', os' FROM py UNION ALL SELECT project_id, 'Symbols', path || {SYMBOL_LINE} FROM py
UNION ALL SELECT project_id, x.section, x.line FROM (SELECT DISTINCT project_id FROM v) g JOIN (VALUES ('Languages', 'No languages'), ('Modules', 'No Python modules'), ('Dependencies', 'No dependency information'), ('Symbols', 'No symbols')) x(section, line)
  ON NOT CASE x.section WHEN 'Languages' THEN EXISTS (SELECT 1 FROM hl WHERE hl.project_id = g.project_id) WHEN 'Modules' THEN EXISTS (SELECT 1 FROM mi WHERE mi.project_id = g.project_id) ELSE EXISTS (SELECT 1 FROM py WHERE py.project_id = g.project_id) END""")
def tree_report(spark, sf_dir):
    c = _scan(spark, sf_dir)
    title = F.element_at(F.array(*map(F.lit, report.SECTIONS)), F.col("section") + 1)
    return _named(c, report.report_lines(c).where("section IN (3, 5, 6, 7)").select("project_id", title.alias("section"), "line"))


@query("""SELECT source AS project_name, true AS is_git_repository, 'main' AS current_branch, 'v1' AS default_branch, 'origin=https://example.org/' || source AS remotes, 'A ' || (count(*) % 3) AS last_commit_author,
  'a' || (count(*) % 3) || '@example.org' AS last_commit_email, '2024-01-0' || (count(*) % 3 + 1) AS last_commit_date, count(*) % 3 + 1 AS total_commits, count(*) % 2 = 1 AS dirty, 'u.txt' AS untracked_files,
  CASE count(*) % 3 WHEN 0 THEN 'v0' WHEN 1 THEN 'v0,v1' ELSE 'v0,v1,v2' END AS tags FROM documents GROUP BY source""")
def git_repositories(spark, sf_dir):
    c = scan(spark, carrier.write_repositories(spark, sf_dir), keep=False)
    remotes = F.array_join(F.transform(F.map_entries("remotes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    lists = {k: F.array_join(k, ",") for k in ("untracked_files", "tags")} | {"remotes": remotes, "last_commit_date": F.date_format(F.to_utc_timestamp("last_commit_date", F.current_timezone()), "yyyy-MM-dd")}
    return _named(c, c.git).withColumns(lists).drop("repository_root", "last_commit_hash", "diagnostic")


@query(f"""WITH {PY} SELECT project_id, path, x.* FROM py, LATERAL (VALUES ('class', 'X' || (seq % 4), 2, 5, 'dec.a(1)', 'doc ' || seq, 'pkg.Base,Gen[int]', false), ('method', 'm', 5, 5, 'staticmethod', NULL, NULL, true),
  ('function', 'f', 8, 9, 'wrap', 'fd', NULL, true), ('variable', 'a', 11, 11, NULL, NULL, NULL, false), ('variable', 'b', 11, 11, NULL, NULL, NULL, false), ('variable', 'z', 14, 14, NULL, NULL, NULL, false)) x(kind, name, line, end_line, decorators, docstring, bases, is_async)""")
def symbol_details(spark, sf_dir):
    parsed = pyast.symbols(carrier.python_sources(carrier.listing(spark, sf_dir), carrier.DETAILS))
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, name, line, end=None, decorators=None, doc=None, bases=None, is_async=None: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), line.alias("line"), (line if end is None else end).alias("end_line"), (null("string") if decorators is None else F.array_join(decorators, ",")).alias("decorators"),
        (null("string") if doc is None else doc).alias("docstring"), (null("string") if bases is None else F.array_join(bases, ",")).alias("bases"), (F.lit(False) if is_async is None else is_async).alias("is_async"),
    )
    methods = F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], lambda m: row("method", m["name"], m["line"], m["end_line"], m["decorators"], m["docstring"], None, m["async_method"]))))
    every = F.concat(
        F.transform("classes", lambda c: row("class", c["name"], c["line"], c["end_line"], c["decorators"], c["docstring"], c["base_classes"])), methods,
        F.transform("functions", lambda f: row("function", f["name"], f["line"], f["end_line"], f["decorators"], f["docstring"], None, f["async_function"])), F.transform("variables", lambda v: row("variable", v["name"], v["line"])),
    )
    return parsed.select("project_id", "path", F.explode(every).alias("x")).select("project_id", "path", "x.*")


@query(f"""WITH {MODULES}, im AS (SELECT project_id, module, 'N' AS name FROM mi UNION ALL SELECT project_id, regexp_replace(module, '\\.[^.]+$', ''), string_split(module, '.')[-1] FROM mi WHERE contains(module, '.')),
rs AS (SELECT im.*, coalesce(a.path, b.path) AS resolved_file FROM im LEFT JOIN mi a ON a.project_id = im.project_id AND a.module = im.module LEFT JOIN mi b ON b.project_id = im.project_id AND b.module = im.module || '.' || im.name)
SELECT rs.project_id, module, name, resolved_file, CASE WHEN name <> 'N' THEN NULL WHEN v.seq % 3 = 0 THEN 'class' WHEN v.seq % 3 = 1 THEN 'function' ELSE 'variable' END AS resolved_symbol_type FROM rs LEFT JOIN v ON v.project_id = rs.project_id AND v.path = resolved_file""")
def resolve_true_index(spark, sf_dir):
    """Over the true module index: module.name where the module is none, and names that are symbols of several kinds."""
    v = carrier.listing(spark, sf_dir)
    modules = index.module_index(listing.visible_files(v), _roots(v))
    longer = modules.where("contains(module, '.')").select("project_id", F.regexp_replace("module", r"\.[^.]+$", "").alias("module"), paths.last_segment(F.translate("module", ".", "/")).alias("name"))
    resolved = resolve.resolve_modules(modules.select("project_id", "module", F.lit("N").alias("name")).union(longer), modules)
    table = resolve.symbol_table(pyast.symbols(carrier.python_sources(v, carrier.PRIORITY)))
    return resolve.resolve_symbols(resolved, table).select("project_id", "module", "name", "resolved_file", "resolved_symbol_type")


@query(f"""WITH {PY} SELECT project_id, path, CASE WHEN seq % 4 = 3 THEN 1 ELSE 0 END AS n_functions, CASE WHEN seq % 4 = 3 THEN 'os' ELSE '' END AS deps, CASE WHEN seq % 4 = 2 THEN 'not UTF-8' END AS diagnostic FROM py""")
def parse_guard(spark, sf_dir):
    """Empty, broken and undecodable sources have no symbols, and stop nothing."""
    content = "CASE CAST(seq % 4 AS INT) WHEN 0 THEN encode('', 'UTF-8') WHEN 1 THEN encode('def (', 'UTF-8') WHEN 2 THEN X'783D22E922' ELSE encode('import os' || chr(10) || 'def f(): pass', 'UTF-8') END"
    parsed = pyast.symbols(carrier.python_sources(carrier.listing(spark, sf_dir)).withColumn("content", F.expr(content)))
    return parsed.select("project_id", "path", F.size("functions").alias("n_functions"), F.array_join("deps", ",").alias("deps"), "diagnostic")


@query(f"WITH {PY} SELECT project_id, path, 'json,m' || (seq % 13) || ',os' AS deps FROM py")
def dependency_lists(spark, sf_dir):
    return _parsed(spark, sf_dir).select("project_id", "path", F.array_join("deps", ",").alias("deps"))


@query(f"WITH {V} SELECT project_id, seq, path, 'caf' || chr(233) || ' ' || lpad(CAST(seq AS VARCHAR), 6, '0') AS text FROM v WHERE seq % 5 <> 4")
def manifest_texts(spark, sf_dir):
    """Manifests in three encodings; those that are gone have no row.  An odd number of bytes can't be taken for UTF-16."""
    text = "concat('caf', char(233), ' ', lpad(cast(seq as string), 6, '0'))"
    encoded = f"CASE CAST(seq % 5 AS INT) WHEN 0 THEN encode({text}, 'UTF-8') WHEN 1 THEN encode({text}, 'ISO-8859-1') WHEN 2 THEN encode({text}, 'UTF-16') WHEN 3 THEN encode({text}, 'UTF-8') END"
    rows = carrier.listing(spark, sf_dir).selectExpr("project_id", "seq", "path", "'requirements.txt' AS name", f"{encoded} AS content")
    return manifests.decoded(rows).select("project_id", "seq", "path", "text")


@query(f"SELECT '{Settings().app_name}' AS application, '{Settings().version}' AS version, 'running' AS status, 'healthy' AS health")
def service_info(spark, sf_dir):
    return spark.createDataFrame([{**report.info(Settings()), "health": report.health()["status"]}], "application string, version string, status string, health string")
