"""git_facts, git_commits, git_remotes, git_tags: rows of the repositories that hold projects."""

from __future__ import annotations

import json
import os
import subprocess
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tree import resolve_root

#: Seconds after which a call of git is given up.
LIMIT = 120
#: Nothing that a scanned repository configures may run: no monitor, no hooks, no prompts, and no filters (below).
SAFE = ["-c", "core.quotePath=false", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-c", "core.pager=cat"]
ENVIRONMENT = {"GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_ASKPASS": "true"}


def git(root: str, *args: str, settings: tuple[str, ...] = ()) -> str | None:
    """What git prints; None if it fails, takes too long or isn't there."""
    own = [x for s in settings for x in ("-c", s)]
    try:
        done = subprocess.run(["git", *SAFE, *own, "-C", root, *args], capture_output=True, text=True, errors="replace", timeout=LIMIT, env=os.environ | ENVIRONMENT, stdin=subprocess.DEVNULL)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def without_filters(root: str) -> tuple[str, ...]:
    """Settings that switch off each filter that the repository configures; to list them runs none."""
    names = (git(root, "config", "--name-only", "-z", "--get-regexp", r"^filter\..*\.(clean|smudge|process|required)$") or "").split("\0")
    return tuple(f"{n}={'false' if n.endswith('.required') else ''}" for n in names if n)


class Project(InputPartition):
    def __init__(self, root: str, project_id: str):
        super().__init__(root)
        self.root, self.project_id = root, project_id


class GitReader(DataSourceReader):
    """One partition a project; options path or paths (a JSON list)."""

    def __init__(self, options, rows):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.roots, self.rows = [resolve_root(p) for p in paths], rows

    def partitions(self):
        return [Project(*r) for r in self.roots]

    def read(self, partition: Project):
        yield from self.rows(partition.root, partition.project_id)


def facts(root: str, project_id: str):
    """Head states: a branch; detached or without a commit, which leave a diagnostic; or no repository."""
    top = git(root, "rev-parse", "--show-toplevel")
    if top is None:
        yield project_id, False, None, None, None, None, [], None
        return
    top = top.strip("\n")
    branch = git(top, "symbolic-ref", "--short", "-q", "HEAD")
    has_commit = git(top, "rev-parse", "--verify", "-q", "HEAD") is not None
    changed = [line for line in (git(top, "status", "--porcelain", "--untracked-files=no", "--ignore-submodules=all", settings=without_filters(top)) or "").splitlines() if line]
    untracked = (git(top, "ls-files", "--others", "--exclude-standard", "-z") or "").split("\0")
    origin = git(top, "symbolic-ref", "refs/remotes/origin/HEAD")
    diagnostic = "no commit" if not has_commit else "detached head" if branch is None else None
    yield project_id, True, top, branch and branch.strip("\n"), origin and origin.strip("\n"), bool(changed), [u for u in untracked if u], diagnostic


def commits(root: str, project_id: str):
    # no name can hold the byte 0, which stands between and behind all fields
    fields = (git(root, "log", "-z", "--no-show-signature", "--format=%H%x00%an%x00%ae%x00%cI") or "").split("\0")
    for i in range(len(fields) // 4):
        sha, author, email, date = fields[4 * i : 4 * i + 4]
        yield project_id, i, sha, author, email, datetime.fromisoformat(date)


def remotes(root: str, project_id: str):
    for name in (git(root, "remote") or "").split():
        for i, url in enumerate((git(root, "remote", "get-url", "--all", name) or "").splitlines()):
            yield project_id, name, url, i


def tags(root: str, project_id: str):
    for tag in (git(root, "tag") or "").splitlines():
        yield project_id, tag


class GitFacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_facts"

    def schema(self) -> str:
        return "project_id string, is_git_repository boolean, repository_root string, current_branch string, origin_head string, dirty boolean, untracked_files array<string>, diagnostic string"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options, facts)


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "project_id string, ord bigint, hash string, author string, email string, committed_at timestamp"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options, commits)


class GitRemotes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_remotes"

    def schema(self) -> str:
        return "project_id string, name string, url string, ord int"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options, remotes)


class GitTags(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tags"

    def schema(self) -> str:
        return "project_id string, tag string"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options, tags)
