"""Python sources to symbols: one pass of the parser over each file, in Arrow batches."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..schemas import SYMBOLS

DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Sources that are parsed before their symbols leave a worker.
AT_ONCE = 250


def decode_symbols(data: bytes | None) -> str:
    """Text for symbols: the first of three encodings that fits; a byte-order mark stays, so that such a file doesn't parse."""
    for encoding in ("utf-8", "utf-8-sig", "utf-16"):
        try:
            return (data or b"").decode(encoding)
        except UnicodeError:
            continue
    return ""


def decode_strict(data: bytes | None) -> str | None:
    """Text for dependencies; None for what is not UTF-8."""
    try:
        return (data or b"").decode()
    except UnicodeError:
        return None


def render(node: ast.AST) -> str:
    """An expression as text: a call as what is called, the parts of a tuple side by side, other nodes as their source."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=value, attr=attr):
            return ".".join(filter(None, (render(value), attr)))
        case ast.Subscript(value=value, slice=inner):
            return f"{render(value)}[{render(inner)}]"
        case ast.Call(func=func):
            return render(func)
        case ast.Constant(value=value):
            return repr(value)
        case ast.Tuple(elts=elements):
            return ", ".join(map(render, elements))
    try:
        return ast.unparse(node)
    except Exception:  # a node without a source form
        return ""


def _definition(node: ast.AST, is_async: str) -> dict:
    return {
        "name": node.name, "line": node.lineno, "end_line": node.end_lineno or node.lineno, is_async: isinstance(node, ast.AsyncFunctionDef),
        "decorators": [ast.unparse(d) for d in node.decorator_list], "docstring": ast.get_docstring(node),
    }


def _variables(target: ast.AST) -> list[dict]:
    """Plain names, alone or in a tuple; not those in lists, deeper tuples, attributes or behind a star."""
    names = target.elts if isinstance(target, ast.Tuple) else [target]
    return [{"name": t.id, "line": t.lineno} for t in names if isinstance(t, ast.Name)]


def _imports(node: ast.Import | ast.ImportFrom) -> list[dict]:
    if isinstance(node, ast.Import):
        return [{"module": a.name, "name": None, "alias": a.asname, "relative_level": 0} for a in node.names]
    return [{"module": node.module or "", "name": a.name, "alias": a.asname, "relative_level": node.level} for a in node.names]


def _class(node: ast.ClassDef) -> dict:
    return {
        "name": node.name, "line": node.lineno, "end_line": node.end_lineno or node.lineno, "decorators": [ast.unparse(d) for d in node.decorator_list],
        "base_classes": [render(b) for b in node.bases], "docstring": ast.get_docstring(node), "methods": [_definition(n, "async_method") for n in node.body if isinstance(n, DEFINITIONS)],
    }


def _modules(tree: ast.Module) -> list[str]:
    """Every module that is imported anywhere in the file."""
    found = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.add(node.module)
    return sorted(found)


def parse(data: bytes | None) -> dict:
    """Symbols of a source; what can't be parsed has none and a diagnostic where it isn't a plain syntax error."""
    out = {"imports": [], "classes": [], "functions": [], "variables": [], "deps": [], "diagnostic": None}
    text, strict = decode_symbols(data), decode_strict(data)
    if strict is None:
        out["diagnostic"] = "not UTF-8"
    try:
        tree = ast.parse(text)
        for node in tree.body:
            if isinstance(node, ast.Import | ast.ImportFrom):
                out["imports"] += _imports(node)
            elif isinstance(node, ast.ClassDef):
                out["classes"].append(_class(node))
            elif isinstance(node, DEFINITIONS):
                out["functions"].append(_definition(node, "async_function"))
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    out["variables"] += _variables(target)
        if strict is not None:
            out["deps"] = _modules(tree)
    except SyntaxError:
        pass
    except (ValueError, RecursionError, MemoryError) as e:
        out |= {"imports": [], "classes": [], "functions": [], "variables": [], "deps": [], "diagnostic": type(e).__name__}
    return out


def symbols(sources: DataFrame) -> DataFrame:
    """(project_id, path, language, imports, classes, functions, variables, deps, diagnostic) of (project_id, path, content)."""
    names = ("imports", "classes", "functions", "variables", "deps", "diagnostic")
    schema = _parse_datatype_string(SYMBOLS)

    def work(batches):
        import pyarrow as pa

        types = {f.name: to_arrow_type(f.dataType) for f in schema}
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                parsed = [parse(c.as_py()) for c in batch.column("content")]
                arrays = [batch.column("project_id"), batch.column("path"), *(pa.array([p[n] for p in parsed], types[n]) for n in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=["project_id", "path", *names])

    rows = sources.select("project_id", "path", F.col("content").cast("binary").alias("content")).mapInArrow(work, f"project_id string, path string, {SYMBOLS}")
    return rows.select("project_id", "path", F.lit("Python").alias("language"), *names)


def edges(parsed: DataFrame) -> DataFrame:
    """(project_id, path, module); files without imports have no row here and are nodes all the same."""
    return parsed.select("project_id", "path", F.explode("deps").alias("module"))


def rows_of(parsed: DataFrame, kind: str) -> DataFrame:
    """One row for each element of imports, classes, functions or variables, with its place ``ord``."""
    return parsed.select("project_id", "path", F.posexplode(kind).alias("ord", "x")).select("project_id", "path", "ord", "x.*")


def methods(parsed: DataFrame) -> DataFrame:
    own = parsed.select("project_id", "path", F.explode("classes").alias("c"))
    return own.select("project_id", "path", F.col("c.name").alias("class"), F.posexplode("c.methods").alias("ord", "m")).select("project_id", "path", "class", "ord", "m.*")


def symbol_counts(parsed: DataFrame) -> DataFrame:
    return parsed.select("project_id", "path", *(F.size(k).alias(f"n_{k}") for k in ("imports", "classes", "functions", "variables")))


def diagnostics(parsed: DataFrame) -> DataFrame:
    return parsed.where("diagnostic is not null").select("project_id", "path", "diagnostic")
