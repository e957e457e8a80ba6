"""project_tree: files and directories of project trees.  project_contents: the bytes of chosen files."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..rules import ROOT_IGNORE_DIRS, SCAN_IGNORE_DIRS, SCAN_IGNORE_FILES, SUPPORTED_EXTENSIONS
from ..schemas import LISTING


#: What a walk does with an entry: lists a file, lists a directory only, or goes into it.
FILE, STAY, DESCEND = "file", "stay", "descend"
#: Rows of a batch that leaves a source at most, and about how many bytes of them.
BATCH_ROWS, BATCH_BYTES = 500, 1_000_000
#: Subtrees of a project from which planning opens no more levels, and levels it opens at most.
SPREAD, LEVELS = 64, 3


def resolve_root(path: str) -> tuple[str, str]:
    """The absolute path of a project, checked, and its id."""
    root = Path(path)
    if not root.exists():
        raise FileNotFoundError(path)
    if not root.is_dir():
        raise NotADirectoryError(path)
    absolute = root.resolve().as_posix()
    return absolute, hashlib.sha256(absolute.lower().encode()).hexdigest()


def _moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, tz=UTC)


class Subtrees(InputPartition):
    """Directories of a project: of each its own entries, and all below it unless ``flat``."""

    def __init__(self, root: str, project_id: str, directories: tuple[str, ...], flat: bool):
        super().__init__((root, directories))
        self.root, self.project_id, self.directories, self.flat = root, project_id, directories, flat


def _weight(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, str | bytes))


class Batches(DataSourceReader):
    """The rows of a reader as Arrow batches, so that a worker holds few of them, however many a partition has."""

    def __init__(self, reader: DataSourceReader, schema):
        self.reader, self.schema = reader, schema

    def partitions(self):
        return self.reader.partitions()

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, size = [], 0
        for row in self.reader.read(partition):
            rows.append(row)
            size += _weight(row)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class ProjectTree(DataSource):
    """Options: path (one), or paths (a JSON list); ruleset scan (default) or roots; ignore_dirs (a JSON list) instead of the ruleset's own.

    scan leaves out ignored directories and follows links to directories; roots
    leaves out the other set and lists links to directories without following
    them.  The subtrees of the first level that has SPREAD of them are
    partitions, and the directories above are one more.  What can't be read is
    left out; a link back to a directory above it isn't followed.
    """

    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return Batches(TreeReader(self.options), schema)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.roots = [resolve_root(p) for p in paths]
        self.follow = options.get("ruleset", "scan") == "scan"
        own = SCAN_IGNORE_DIRS if self.follow else ROOT_IGNORE_DIRS
        self.ignored = set(json.loads(options["ignore_dirs"]) if "ignore_dirs" in options else own)

    def partitions(self):
        found = []
        for root, project_id in self.roots:
            flat, level = [], [""]
            for _ in range(LEVELS):
                if len(level) < SPREAD:
                    flat += level
                    level = [below for d in level for below in self._below(root, d)]
            found.append(Subtrees(root, project_id, tuple(flat), True))
            found += [Subtrees(root, project_id, (d,), False) for d in level]
        return found

    @staticmethod
    def _above(root: str, relative: str) -> set[str]:
        """Where a directory and those above it really are."""
        parts = relative.split("/") if relative else []
        return {os.path.realpath(os.path.join(root, *parts[:n])) for n in range(len(parts) + 1)}

    def _below(self, root: str, relative: str) -> list[str]:
        above = self._above(root, relative)
        entries = self._entries(os.path.join(root, relative))
        return [f"{relative}/{name}" if relative else name for name, path, kind in entries if kind == DESCEND and os.path.realpath(path) not in above]

    def _entries(self, directory: str):
        """(name, path, kind) of what is listed in a directory."""
        try:
            with os.scandir(directory) as entries:
                for e in entries:
                    if self._is(e.is_dir):
                        if e.name not in self.ignored:
                            yield e.name, e.path, DESCEND if self.follow or not e.is_symlink() else STAY
                    elif self._is(e.is_file):
                        yield e.name, e.path, FILE
        except PermissionError:
            return

    @staticmethod
    def _is(test) -> bool:
        try:
            return test()
        except OSError:
            return False

    def _row(self, part: Subtrees, path: str, relative: str, is_dir: bool) -> tuple:
        size, modified, created = 0, 0.0, 0.0
        try:
            s = os.stat(path)
            size, modified, created = s.st_size, s.st_mtime, getattr(s, "st_birthtime", s.st_ctime)
        except OSError:
            pass
        return part.project_id, path, relative, is_dir, 0 if is_dir else size, _moment(modified), _moment(created)

    def _walk(self, partition: Subtrees):
        """(path, relative path, is_dir) of all that is listed."""
        for relative in partition.directories:
            top = os.path.join(partition.root, relative) if relative else partition.root
            yield top, relative, True
            stack = [(top, relative, self._above(partition.root, relative))]
            while stack:
                directory, relative, above = stack.pop()
                for name, path, kind in self._entries(directory):
                    own = f"{relative}/{name}" if relative else name
                    if kind != DESCEND:
                        yield path, own, kind == STAY
                        continue
                    if partition.flat or (real := os.path.realpath(path)) in above:
                        continue
                    yield path, own, True
                    stack.append((path, own, above | {real}))

    def read(self, partition: Subtrees):
        for path, relative, is_dir in self._walk(partition):
            yield self._row(partition, path, relative, is_dir)


class ProjectContents(DataSource):
    """(project_id, path, content) of the files of trees whose name or extension is asked for.

    Options as for project_tree, and JSON lists: names and extensions, one of
    which a file has; ignore_files and supported, the names that are not listed
    and the suffixes that are, so that no other content leaves the source.
    """

    @classmethod
    def name(cls) -> str:
        return "project_contents"

    def schema(self) -> str:
        return "project_id string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return Batches(ContentReader(self.options), schema)


class ContentReader(TreeReader):
    def __init__(self, options):
        super().__init__(options)
        own = lambda name, default=(): set(json.loads(options[name])) if name in options else set(default)
        self.names, self.extensions = own("names"), own("extensions")
        self.ignored_files, self.supported = own("ignore_files", SCAN_IGNORE_FILES), own("supported", SUPPORTED_EXTENSIONS)

    def _wanted(self, name: str) -> bool:
        suffix = Path(name).suffix.lower()
        listed = name not in self.ignored_files and (not suffix or suffix in self.supported)
        return listed and (name in self.names or suffix in self.extensions)

    def read(self, partition: Subtrees):
        for path, relative, is_dir in self._walk(partition):
            if is_dir or not self._wanted(os.path.basename(relative)):
                continue
            try:
                with open(path, "rb") as f:
                    yield partition.project_id, relative, f.read()
            except OSError:
                yield partition.project_id, relative, None
