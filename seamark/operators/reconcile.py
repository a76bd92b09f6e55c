"""Comparison of the files of a repository with the stored content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, cached: DataFrame) -> DataFrame:
    """repo_path, path, state (new, changed, unchanged, deleted) from current and cached (repo_path, path, hash)."""
    old = cached.select(F.col("repo_path").alias("_r"), F.col("path").alias("_p"), F.col("hash").alias("_h"))
    d = current.join(old, (F.col("repo_path") == F.col("_r")) & (F.col("path") == F.col("_p")), "full")
    state = F.when(F.col("_p").isNull(), "new").when(F.col("path").isNull(), "deleted").when(F.col("hash").eqNullSafe(F.col("_h")), "unchanged").otherwise("changed")
    return d.select(F.coalesce("repo_path", "_r").alias("repo_path"), F.coalesce("path", "_p").alias("path"), state.alias("state"))


def needs_index(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of current that are not cached with the same hash."""
    old = cached.select("repo_path", "path", "hash")
    return current.join(old, ["repo_path", "path", "hash"], "left_anti")


def updated(cached: DataFrame, indexed: DataFrame, states: DataFrame) -> DataFrame:
    """The cache after a run: rows of new and changed files are replaced, deleted files go."""
    touched = states.filter("state <> 'unchanged'").select("repo_path", "path")
    return cached.join(touched, ["repo_path", "path"], "left_anti").unionByName(indexed)
