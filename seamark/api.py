"""The engine: index a repository, search it, report its status, clear its cache.

Files or tables of files go through one plan: reconcile with the stored hashes, chunk,
embed, and commit. Chunks are committed before hashes, so a run that fails in between is
repeated next time. New chunks replace those of the same file; deleted files go.
"""

from __future__ import annotations

import json
import logging
import sys
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import chunking, text
from .functions.embedding import Embedder, embed_column
from .operators import reconcile, search, store
from .sources.repo_files import read_repo

log = logging.getLogger(__name__)


@dataclass
class Job:
    """One indexing run."""

    repo_path: str
    id: str = field(default_factory=lambda: f"job-{time.time_ns()}-{uuid.uuid4().hex[:6]}")
    status: str = "pending"
    started: float = 0.0
    finished: float = 0.0
    files: int = 0
    chunks: int = 0
    error: str = ""
    progress: float = 0.0

    @property
    def chunks_per_second(self) -> float:
        seconds = (self.finished or time.time()) - self.started
        return self.chunks / seconds if seconds > 0 else 0.0


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: Callable[[], Embedder] | None = None):
        self.spark, self.config = spark, config or Config()
        self.embedder = embedder or self.config.make_embedder()
        meta = {"dimension": self.embedder().dimension, "metric": self.config.metric}
        self.vectors = store.Table(spark, f"{path}/chunks", store.CHUNKS, meta)
        self.hashes = store.Table(spark, f"{path}/hashes", store.HASHES)
        self.jobs: dict[str, Job] = {}

    # Index

    def index(self, repo_path: str, force: bool = False, files: DataFrame | None = None) -> Job:
        """Indexes a folder, or a table of files(rel_path, language, content) that stands for it."""
        return self._run(self._job(repo_path), force, files)

    def start(self, repo_path: str, force: bool = False, files: DataFrame | None = None) -> Job:
        """As index, in the background; the job's status, progress and counts change as it goes on."""
        job = self._job(repo_path)

        def run() -> None:
            try:
                self._run(job, force, files)
            except Exception as e:
                log.error("indexing %s failed: %s", job.repo_path, e)
        threading.Thread(target=run, name=job.id, daemon=True).start()
        return job

    def index_some(self, repo_path: str, files: DataFrame) -> Job:
        """Indexes files(rel_path, language, content) and leaves the repository's others as they are."""
        return self._run(self._job(repo_path), False, files, partial=True)

    def index_many(self, files: DataFrame, repos: list[str]) -> int:
        """Indexes files(repo_path, rel_path, language, content) of several repositories in one go and leaves their
        others as they are; how many of them were new or had changed."""
        job = Job("")
        self._apply(job, files, repos, False, partial=True)
        return job.files

    def _job(self, repo_path: str) -> Job:
        if not repo_path:
            raise ValueError("repo_path is required")
        job = Job(repo_path, status="running", started=time.time())
        self.jobs[job.id] = job
        return job

    def _run(self, job: Job, force: bool, files: DataFrame | None, partial: bool = False) -> Job:
        try:
            c = self.config
            if files is None:
                files = read_repo(self.spark, job.repo_path, c.max_file_size_mb, c.ignore).filter("disposition = 'kept'")
                files = files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
            self._apply(job, files.withColumn("repo_path", F.lit(job.repo_path)), [job.repo_path], force, partial)
            job.status, job.progress = "completed", 1.0
        except Exception as e:
            job.status, job.error = "failed", str(e)
            raise
        finally:
            job.finished = time.time()
        return job

    def _apply(self, job: Job, files: DataFrame, repos: list[str], force: bool, partial: bool) -> None:
        """files(repo_path, rel_path, language, content) of the repositories, chunked, embedded and committed."""
        c = self.config
        now = F.lit(time.time()).cast("timestamp")
        files = files.select("repo_path", F.col("rel_path").alias("path"), "language", "content", F.sha2("content", 256).alias("hash")).persist()
        new = states = None
        try:
            old_hashes, old = self.hashes.read(*repos), self.vectors.read(*repos)
            cached = old_hashes.limit(0) if force else old_hashes
            if not force:  # hashes of a repository without chunks, though some file should have one, are of no use
                lost = old_hashes.filter("chunk_count > 0").select("repo_path").distinct().join(old.select("repo_path").distinct(), "repo_path", "left_anti")
                cached = cached.join(lost, "repo_path", "left_anti")
            states = reconcile.diff(files.select("repo_path", "path", "hash"), cached)
            if partial:
                states = states.filter("state <> 'deleted'")
            states = states.filter("state <> 'unchanged'").persist()
            n_states = states.count()
            job.progress = 0.2
            if not (n_states or force):
                return
            todo = reconcile.needs_index(files, cached)
            job.files = todo.count()
            chunks = chunking.chunk_files(todo.select("repo_path", F.col("path").alias("file_path"), "language", "content"), c.sizes, c.max_chunk_bytes, c.compat, c.hierarchy)
            chunks = chunks.withColumn("id", text.chunk_id(F.col("repo_path"), F.col("file_path"), F.col("chunk_type"), F.col("start_line"), F.col("end_line"), F.col("content"), F.col("ordinal")))
            parents = chunks.filter("chunk_type = 'class'").select("repo_path", "file_path", F.col("ordinal").alias("parent_ordinal"), F.col("id").alias("parent_chunk_id"))
            chunks = chunks.join(parents, ["repo_path", "file_path", "parent_ordinal"], "left")
            chunks = chunks.withColumn("embedding", embed_column(self.embedder, text.cut(F.col("content")), c.embed_batch)).withColumn("indexed_at", now)
            chunks = chunks.withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("repo_key", F.lit(None).cast("string"))
            new = chunks.select(*store.CHUNKS.fieldNames()).persist()
            job.chunks = new.count()
            job.progress = 0.8
            changed = states.select("repo_path", F.col("path").alias("file_path"))
            base = old.limit(0) if force else old.join(changed, ["repo_path", "file_path"], "left_anti")
            n = new.groupBy("repo_path", F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("chunk_count"))
            indexed = todo.join(n, ["repo_path", "path"], "left").select("repo_path", "path", "hash", now.alias("last_indexed"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(None).cast("string").alias("repo_key"))
            kept = old_hashes.limit(0) if force else reconcile.updated(old_hashes, indexed.limit(0), states)
            self.vectors.replace(base.unionByName(new), repos)
            job.progress = 0.9
            self.hashes.replace(kept.unionByName(indexed), repos)
        finally:
            for d in (files, states, new):
                if d is not None:
                    d.unpersist()

    # Search

    def search(self, query: str, repo_path: str, limit: int | None = None, chunk_type: str | None = None) -> DataFrame:
        if not query.strip() or not repo_path:
            raise ValueError("query and repo_path are required")
        if chunk_type not in (None, "all", "function", "class", "method"):
            raise ValueError(f"unknown chunk type: {chunk_type}")
        c = self.config
        r = search.Ranking(limit or c.max_results, c.semantic_weight, c.exact_match_boost, min_score=c.min_score_threshold)
        vector = self.embedder().embed([query[: text.EMBED_CHARS]])[0]
        return search.search(self.vectors.read(repo_path), query, vector, r, c.metric, repo_path, chunk_type)

    @staticmethod
    def format(results: DataFrame) -> str:
        """Text for a handful of results."""
        rows = results.select("file_path", "start_line", "end_line", "hybrid_score", "exact_match", "language", "chunk_type", "content", F.coalesce(F.nullif("function_name", F.lit("")), "class_name").alias("symbol")).withColumn("n", F.monotonically_increasing_id()).collect()
        if not rows:
            return "No results found"
        spark = results.sparkSession
        d = spark.createDataFrame([(i + 1, *r[:9]) for i, r in enumerate(rows)], "r int, file_path string, start_line int, end_line int, hybrid_score double, exact_match boolean, language string, chunk_type string, content string, symbol string")
        line = text.format_result(F.col("r"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("hybrid_score"), F.col("exact_match"), F.col("language"), F.col("chunk_type"), F.col("content"), F.col("symbol"))
        return f"Found {len(rows)} results:\n\n" + "\n\n".join(x[0] for x in d.orderBy("r").select(line).collect())

    # Status

    def status(self, repo_path: str) -> dict:
        for j in self.jobs.values():
            if j.repo_path == repo_path and j.status == "running":
                return {"repo_path": repo_path, "status": "running", "progress": j.progress, "total_files": j.files, "total_chunks": j.chunks}
        v, h = self.vectors.read(repo_path), self.hashes.read(repo_path)
        chunks, last = v.agg(F.count("*"), F.max("indexed_at")).first()
        langs = {r[0]: r[1] for r in v.groupBy("language").agg(F.countDistinct("file_path")).collect()}
        files = h.count()
        return {"repo_path": repo_path, "status": "completed" if chunks or files else "not_indexed", "total_files": files, "total_chunks": chunks, "languages": langs, "last_indexed": last.isoformat() if last else None}

    def job(self, job_id: str) -> Job | None:
        return self.jobs.get(job_id)

    def clear_cache(self, repo_path: str) -> None:
        """Forgets a repository's hashes; its chunks stay until they are replaced."""
        self.hashes.drop(repo_path)

    def delete_repo(self, repo_path: str) -> None:
        self.vectors.drop(repo_path)
        self.clear_cache(repo_path)

    # Tools over JSON lines

    def call(self, tool: str, args: dict) -> dict:
        """One of semantic_search, index_codebase, clear_cache, get_index_status, get_job."""
        try:
            if tool == "semantic_search":
                return {"content": self.format(self.search(args.get("query", ""), args.get("repo_path", ""), args.get("limit"), args.get("chunk_type")))}
            if tool == "index_codebase":
                run = self.start if args.get("background") else self.index
                return {"content": asdict(run(args.get("repo_path", ""), bool(args.get("force_reindex"))))}
            if tool == "clear_cache":
                self.clear_cache(args["repo_path"])
                return {"content": "cache cleared"}
            if tool == "get_index_status":
                return {"content": self.status(args["repo_path"])}
            if tool == "get_job":
                j = self.job(args["job_id"])
                return {"content": asdict(j) if j else None}
            return {"error": f"unknown tool: {tool}"}
        except Exception as e:
            return {"error": str(e)}

    def serve(self, lines=None, out=None) -> None:
        """Reads {"id", "tool", "arguments"} by line, writes {"id", "content" or "error"}."""
        out = out or sys.stdout
        for line in lines or sys.stdin:
            if line.strip():
                q = json.loads(line)
                print(json.dumps({"id": q.get("id"), **self.call(q.get("tool", ""), q.get("arguments", {}))}, default=str), file=out, flush=True)
