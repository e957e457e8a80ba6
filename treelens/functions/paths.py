"""Functions of POSIX paths that are relative to their project; the project's root is ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components of a path; none for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """'' for what lies in the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]+$", 1)


def depth(directory: Column) -> Column:
    return F.size(parts(directory))


def extension(file_name: Column) -> Column:
    """The lower-cased last suffix with its dot: '' for '.env' and 'a.', '.gz' for 'a.tar.gz'."""
    return F.lower(F.regexp_extract(file_name, r"(?s)^.+?(\.[^.]+)$", 1))


def ancestors(directory: Column, proper: bool = False) -> Column:
    """The root and every directory on the way; with the directory itself unless ``proper``."""
    p = parts(directory)
    n = F.size(p) - (1 if proper else 0)
    chain = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.array_join(F.slice(p, 1, i), "/"))
    return F.when(n < 0, F.array().cast("array<string>")).otherwise(chain) if proper else chain


def any_in(values: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def project_id(root: Column) -> Column:
    """SHA-256 of the lower-cased absolute path."""
    return F.sha2(F.lower(root), 256)


def join_path(directory: Column, child: Column) -> Column:
    return F.when(directory == "", child).otherwise(F.concat(directory, F.lit("/"), child))


def module_name(path: Column, root: Column) -> Column:
    """The dotted name of a file under a root; '' for the root's own __init__."""
    relative = F.when(root == "", path).otherwise(F.substring(path, F.length(root) + 2, F.length(path)))
    bare = F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", "")
    return F.translate(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/", ".")


def last_segment(ref: Column) -> Column:
    return F.substring_index(ref, "/", -1)
