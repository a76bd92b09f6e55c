"""Streaming ingestion: micro-batches of files go through the same reconcile and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Engine


def ingest(engine: Engine, files: DataFrame, checkpoint: str, **trigger):
    """Starts a query that indexes a stream of files(repo_path, rel_path, language, content).

    Within a batch the last row of a path wins (by content where there is no other order).
    A batch brings some files of a repository, not all: what it doesn't hold stays as it is. A
    repeated batch changes nothing, as unchanged files are recognised by their hash. All repositories of a batch
    are indexed in one plan and committed at once; their names, not their files, come to the driver.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            repos = [r["repo_path"] for r in df.select("repo_path").distinct().collect()]
            if repos:
                last = df.groupBy("repo_path", "rel_path").agg(F.max_by(F.struct("language", "content"), "content").alias("f"))
                engine.index_many(last.select("repo_path", "rel_path", "f.language", "f.content"), repos)
        finally:
            df.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
