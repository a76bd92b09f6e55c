"""Aggregates over stored chunks and cached hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_totals(cached: DataFrame) -> DataFrame:
    """total_files, total_chunks, updated_at (null without such a column)."""
    when = F.max("last_indexed") if "last_indexed" in cached.columns else F.lit(None).cast("timestamp")
    return cached.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("total_chunks"), when.alias("updated_at"))


def chunks_per_repo(chunks: DataFrame, repo: str = "repo_path") -> DataFrame:
    return chunks.groupBy(repo).agg(F.count("*").alias("n_chunks"))


def chunk_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n_chunks"))


def repo_status(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """One row a repository: files in the cache, chunks in the store, status, and
    whether the cache speaks of files whose chunks are missing (then index all anew)."""
    v = chunks.groupBy("repo_path").agg(F.count("*").alias("total_chunks"))
    h = cached.groupBy(F.col("repo_path").alias("_r")).agg(F.count("*").alias("total_files"))
    d = v.join(h, F.col("repo_path") == F.col("_r"), "full")
    files, n = F.coalesce("total_files", F.lit(0)), F.coalesce("total_chunks", F.lit(0))
    return d.select(F.coalesce("repo_path", "_r").alias("repo_path"), files.alias("total_files"), n.alias("total_chunks"),
                    F.when((files == 0) & (n == 0), "not_indexed").otherwise("completed").alias("status"), ((files > 0) & (n == 0)).alias("needs_force"))
