"""Data sources that read what Spark's own readers can't: whole trees with dot files and empty files, and git."""

from .git import GitCommits, GitFacts, GitRemotes, GitTags
from .tree import ProjectContents, ProjectTree

SOURCES = (ProjectTree, ProjectContents, GitFacts, GitCommits, GitRemotes, GitTags)


def register(spark) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
