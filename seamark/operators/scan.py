"""Scan bookkeeping over tables of files: what is kept and why not, and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths


def languages(spark: SparkSession) -> DataFrame:
    """extension, language, structural (whether it has a structural chunker)."""
    return spark.createDataFrame([(e, n, n in paths.STRUCTURAL) for e, n in paths.LANGUAGES.items()], "extension string, language string, structural boolean")


def disposition(files: DataFrame, patterns=paths.IGNORE, limit_bytes: int = 1 << 20, glob_mode: str = "compatible") -> DataFrame:
    """files(rel_path, size) with language and disposition: pruned (below a hidden
    folder), ignored, unsupported, too_large (over the limit; equal stays) or kept."""
    p = F.col("rel_path")
    d = files.withColumn("language", paths.language(p))
    return d.withColumn("disposition", F.when(paths.hidden_folder(p), "pruned").when(paths.ignored(p, patterns, glob_mode), "ignored")
                        .when(F.col("language").isNull(), "unsupported").when(F.col("size") > limit_bytes, "too_large").otherwise("kept"))


def counters(scanned: DataFrame) -> DataFrame:
    """total_files (not ignored), skipped_files (ignored, unsupported, too large), kept_files; pruned ones are in neither."""
    d = F.col("disposition")
    return scanned.agg(F.count_if(~d.isin("pruned", "ignored")).alias("total_files"), F.count_if(d.isin("ignored", "unsupported", "too_large")).alias("skipped_files"),
                       F.count_if(d == "kept").alias("kept_files"))


def files_per_language(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n_files"))


def batches(rows: DataFrame, order: str, size: int, slices: int = 256) -> DataFrame:
    """rows with batch: consecutive runs of ``size`` rows in the given order.

    Positions come from counts of ranges of the order, then a window within each range,
    so no task sorts all rows.
    """
    if size < 1:
        raise ValueError("the batch size must be at least 1")
    cuts = [c for c in (rows.approxQuantile(order, [i / slices for i in range(1, slices)], 0.001) if slices > 1 else [])]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    d = rows.withColumn("_r", F.size(F.filter(bounds, lambda c: c < F.col(order))))
    n = d.groupBy("_r").agg(F.count("*").alias("_n"))
    n = n.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_r", "_base")
    at = F.col("_base") + F.row_number().over(W.partitionBy("_r").orderBy(order)) - 1
    return d.join(F.broadcast(n), "_r").withColumn("batch", F.floor(at / size)).drop("_r", "_base")
