"""Embedders: text to vector, in Arrow batches.

An embedder has ``dimension`` and ``embed(texts) -> list of vectors``; it is made once
a task. The default hashes words, needs no model and gives the same result
everywhere; HttpEmbedder asks a model server.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EMBED_CHARS
from .vectors import snap_dimension


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Words of the first 4,000 characters fall on components by digest, with a sign; unit length."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for w in re.findall(r"[a-zA-Z0-9_]+", text[:EMBED_CHARS].lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:6], 16) % self.dimension] += 1 if int(h[6], 16) % 2 == 0 else -1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def check(self) -> bool:
        return len(self._one("test")) == self.dimension


class HttpEmbedder:
    """POST {url}/api/embeddings with model and prompt; the full dimension is checked,
    then the vector is cut to ``dimension`` and scaled to unit length. At most ``in_flight`` requests
    are out at a time; vectors come in the order of the texts. Any failure fails the batch (the first text's, if there are more)."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "nomic-embed-text", full: int = 768, dimension: int = 256, truncate: bool = True, normalise: bool = True, timeout: float = 60, in_flight: int = 10):
        self.url, self.model, self.full, self.timeout, self.normalise, self.in_flight = url.rstrip("/"), model, full or 768, timeout, normalise, in_flight
        self.dimension = snap_dimension(dimension, self.full) if truncate and dimension < self.full else self.full

    def embed(self, texts: list[str]) -> list[list[float]]:
        with ThreadPoolExecutor(self.in_flight) as pool:
            return list(pool.map(self._one, texts))

    def _one(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "prompt": text[:EMBED_CHARS]}).encode()
        req = urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            v = json.load(r)["embedding"]
        if len(v) != self.full:
            raise ValueError(f"expected {self.full} dimensions, got {len(v)}")
        v = v[: self.dimension]
        n = math.sqrt(sum(x * x for x in v)) if self.normalise else 1.0
        return [x / n for x in v] if n else v

    def check(self) -> bool:
        return len(self._one("test")) == self.dimension


def embed_column(make: Callable[[], Embedder], column: Column, batch: int = 16) -> Column:
    """Vectors of a text column; the embedder is made once a task and gets ``batch`` texts at a time. Null gives null."""
    if batch < 1:
        raise ValueError("the batch size must be at least 1")

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = make()
        for s in parts:
            own = s.dropna()
            out: list = []
            for lo in range(0, len(own), batch):
                out += e.embed(own.iloc[lo:lo + batch].tolist())
            yield pd.Series(out, index=own.index, dtype=object).reindex(s.index).map(lambda v: v if isinstance(v, list) else None)

    return run(column)


def hashed_components(rows: DataFrame, id_col: str, text_col: str, dimension: int) -> DataFrame:
    """id, dim, x: the non-zero components of HashEmbedder's vectors, in Column code only."""
    w = F.regexp_extract_all(F.lower(F.substring(text_col, 1, EMBED_CHARS)), F.lit(r"(\w+)"), F.lit(1))
    h = rows.select(id_col, F.explode(w).alias("w")).select(id_col, F.md5("w").alias("h"))
    dim = (F.conv(F.substring("h", 1, 6), 16, 10).cast("long") % dimension).cast("int")
    sign = F.when(F.conv(F.substring("h", 7, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    s = h.groupBy(id_col, dim.alias("dim")).agg(F.sum(sign).alias("x"))
    n = s.groupBy(F.col(id_col).alias("_id")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return s.join(n, F.col(id_col) == F.col("_id")).filter("x <> 0").select(id_col, "dim", F.round(F.col("x") / F.col("n"), 6).alias("x"))


def estimate_seconds(n: Column, rate: float = 600.0) -> Column:
    return n / F.lit(rate)
