"""Retrieval: exact top-k by vector, then lexical and path-aware ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text, vectors


@dataclass(frozen=True)
class Ranking:
    """Parameters of the hybrid score; the defaults are the reference's."""

    max_results: int = 5
    semantic_weight: float = 0.7
    exact_boost: float = 1.5
    partial_weight: float = 0.3
    oversample: int = 3
    min_score: float | None = None

    def __post_init__(self):
        if self.max_results < 1 or self.oversample < 1:
            raise ValueError("max_results and oversample must be at least 1")


def knn(chunks: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", repo: str | None = None, chunk_type: str | None = None, id_col: str = "id") -> DataFrame:
    """The k rows nearest to the query, with semantic_score; ties by id.

    The plan is scan, filter, project, TakeOrderedAndProject: each task keeps k rows. k of
    0 or less is 5. Rows with a null vector don't take part.
    """
    k = k if k > 0 else 5
    d = chunks.filter(F.col("embedding").isNotNull())
    if repo:
        d = d.filter(F.col("repo_path") == repo)
    if chunk_type and chunk_type != "all":
        d = d.filter(F.col("chunk_type") == chunk_type)
    q = F.array(*[F.lit(float(x)) for x in query])
    d = d.withColumn("semantic_score", vectors.similarity(metric)(F.col("embedding"), q))
    return d.orderBy(F.desc("semantic_score"), F.asc(id_col)).limit(k)


def knn_many(chunks: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "id", most_queries: int = 10_000) -> DataFrame:
    """query_id, rank, id, semantic_score: the k nearest of every query (query_id, embedding).

    Any number of queries is answered: they are read in blocks of ``most_queries``, each block is broadcast as
    a matrix and takes its own pass over chunks; each batch of rows is multiplied with it, and a task keeps and
    sends k rows a query, which one window then merges.
    """
    if metric not in vectors.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    from functools import reduce
    from itertools import batched

    import numpy as np
    import pyarrow as pa

    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    d = chunks.filter(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding")

    def near(rows):
        ids = np.array([r[0] for r in rows], np.int64)
        m = np.array([r[1] for r in rows], np.float64)
        shared = chunks.sparkSession.sparkContext.broadcast(unit(m) if metric == "cosine" else m)

        def run(batches):
            # The best k of each query so far, in this task; one batch of k rows a query comes out at the end.
            q = shared.value
            best = np.full((len(q), k), -np.inf)
            who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
            for b in batches:
                own = b.column(0).to_numpy(zero_copy_only=False)
                if not len(own):
                    continue
                x = np.array(b.column(1).to_pylist(), np.float64)
                if metric == "cosine":
                    x = unit(x)
                for lo in range(0, len(q), 1000):  # scores of a whole block and batch would take 800 MB
                    y = q[lo:lo + 1000]
                    s = y @ x.T
                    if metric == "euclid":
                        s = 1 / (1 + np.sqrt(np.maximum(0, (y**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * s)))
                    s = np.concatenate([best[lo:lo + 1000], s], axis=1)
                    i = np.concatenate([who[lo:lo + 1000], np.broadcast_to(own, (len(y), len(own)))], axis=1)
                    # Everything as good as the k-th best counts, so that ties go by id.
                    least = np.partition(s, -k, axis=1)[:, -k]
                    for r in range(len(y)):
                        at = np.flatnonzero(s[r] >= least[r])
                        at = at[np.lexsort((i[r, at], -s[r, at]))[:k]]
                        best[lo + r], who[lo + r] = s[r, at], i[r, at]
            real = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[real]), pa.array(who[real]), pa.array(best[real])], ["query_id", "id", "semantic_score"])

        return d.mapInArrow(run, "query_id long, id long, semantic_score double")

    parts = [near(rows) for rows in batched(queries.select("query_id", "embedding").toLocalIterator(), most_queries)]
    if not parts:
        return chunks.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("semantic_score")).limit(0)
    order = W.partitionBy("query_id").orderBy(F.desc("semantic_score"), "id")
    return reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "semantic_score")


def hybrid(candidates: DataFrame, query: str, r: Ranking = Ranking()) -> DataFrame:
    """candidates with exact_match and hybrid_score."""
    if not query.strip():
        raise ValueError("the query is empty")
    _, n = text.query_words(query)
    exact = text.contains_text(F.col("content"), query)
    matched = text.matched_words(F.col("content"), query)
    lexical = F.when(exact, F.lit(r.exact_boost)).when(matched > 0, r.partial_weight * matched / n).otherwise(0.0)
    score = (F.col("semantic_score") * r.semantic_weight + lexical) * paths.path_factor(F.col("file_path"))
    return candidates.withColumn("exact_match", exact).withColumn("hybrid_score", score)


def search(chunks: DataFrame, query: str, vector: list[float], r: Ranking = Ranking(), metric: str = "cosine", repo: str | None = None, chunk_type: str | None = None, id_col: str = "id", texts: DataFrame | None = None) -> DataFrame:
    """Top oversample * n by vector, scored anew, top n of those; ties by semantic score, then id.

    texts: the rows' other columns by id_col, where they are in a table of their own; they come to the candidates only, which are broadcast.
    """
    near = knn(chunks, vector, r.max_results * r.oversample, metric, repo, chunk_type, id_col)
    if texts is not None:
        near = texts.join(F.broadcast(near), id_col)
    d = hybrid(near, query, r)
    if r.min_score is not None:
        d = d.filter(F.col("hybrid_score") >= r.min_score)
    return d.orderBy(F.desc("hybrid_score"), F.desc("semantic_score"), F.asc(id_col)).limit(r.max_results)
