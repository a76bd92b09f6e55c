"""Times the headline queries and the engine, and prints one JSON line.

value is the sum of the headline queries. engine: indexing the documents end to end, embedding them alone, indexing them
again without a change, a search on a fresh session's index, the same again, and a hundred queries at once.
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ("hybrid_search", "knn_cosine", "knn_batch", "exact_match_positions", "incremental_diff", "token_count", "token_chunks", "embed_hash", "scan_counters", "upsert_merge")


def engine_times(spark, sf: str) -> dict:
    from pyspark.sql import functions as F

    from seamark.api import Engine
    from seamark.functions import paths, text
    from seamark.functions.embedding import embed_column
    from seamark.operators import search
    from seamark.plans.queries import REPO, TEXT, corpus

    out, at = {}, tempfile.mkdtemp(prefix="seamark-bench-")
    files = corpus(spark, sf).select("rel_path", paths.language(F.col("file_path")).alias("language"), "content")

    def timed(name, work):
        t = time.time()
        got = work()
        out[name] = round(time.time() - t, 3)
        return got
    try:
        e = Engine(spark, f"file://{at}")
        job = timed("index", lambda: e.index(REPO, files=files))
        out["chunks"], out["chunks_per_second"] = job.chunks, round(job.chunks / out["index"], 1)
        chunks = e.vectors.read(REPO)
        timed("embed_only", lambda: chunks.select(embed_column(e.embedder, text.cut(F.col("content")))).write.format("noop").mode("overwrite").save())
        timed("reindex_unchanged", lambda: e.index(REPO, files=files))
        timed("search_first", lambda: Engine(spark, f"file://{at}").search(TEXT, REPO).collect())
        timed("search_again", lambda: e.search(TEXT, REPO).collect())
        numbered = chunks.select(F.xxhash64("id").alias("n"), "embedding")
        queries = numbered.orderBy("n").limit(100).select(F.col("n").alias("query_id"), "embedding")
        timed("search_100", lambda: search.knn_many(numbered, queries, 5, id_col="n").collect())
    finally:
        shutil.rmtree(at, ignore_errors=True)
    return out


def main() -> None:
    from seamark.plans.queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    engine = engine_times(spark, sf)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "engine": engine, "sf": sf}))


if __name__ == "__main__":
    main()
