"""Git facts of projects, from rows of the git sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def commit_totals(commits: DataFrame) -> DataFrame:
    """(project_id, total_commits, last_commit_hash, last_commit_author, last_commit_email, last_commit_date); ord 0 is the head."""
    head = F.min_by(F.struct("hash", "author", "email", "committed_at"), "ord")
    out = commits.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_commits"), head.alias("h"))
    return out.select("project_id", "total_commits", F.col("h.hash").alias("last_commit_hash"), F.col("h.author").alias("last_commit_author"), F.col("h.email").alias("last_commit_email"), F.col("h.committed_at").alias("last_commit_date"))


def remotes(rows: DataFrame) -> DataFrame:
    """(project_id, remotes): the first url of each name."""
    first = rows.groupBy("project_id", "name").agg(F.min_by("url", "ord").alias("url"))
    return first.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "url")))).alias("remotes"))


def git_statistics(facts: DataFrame, commits: DataFrame, remote_rows: DataFrame, tags: DataFrame) -> DataFrame:
    """One row a project with all git facts; lists and maps are empty where there is nothing."""
    tag_lists = tags.groupBy("project_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    joined = facts.join(commit_totals(commits), "project_id", "left").join(remotes(remote_rows), "project_id", "left").join(tag_lists, "project_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "project_id", "is_git_repository", "repository_root", "current_branch", paths.last_segment(F.col("origin_head")).alias("default_branch"),
        F.coalesce("remotes", F.create_map().cast("map<string,string>")).alias("remotes"), "last_commit_hash", "last_commit_author", "last_commit_email", "last_commit_date",
        F.coalesce("total_commits", F.lit(0)).alias("total_commits"), "dirty", F.coalesce("untracked_files", none).alias("untracked_files"), F.coalesce("tags", none).alias("tags"), "diagnostic",
    )
