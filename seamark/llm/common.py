"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """All words of a text, in order; an empty array for null and blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), _GAPS)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: inside a lambda a plain
    expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent and the master is local (tests, a single machine) a folder is
    made once and put in its place for the session; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='seamark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives
    lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


#: Physical operators that give the same rows in the same partitions whenever they run over files.
_STEADY = frozenset("FileScan BatchScan ColumnarToRow Filter Project".split())


def steady(df: DataFrame, name: str) -> DataFrame:
    """df if reading it again gives the same rows in the same partitions and order, that is if
    it is a deterministic projection of files; else it is stored first."""
    plan = df._jdf.queryExecution()
    nodes = {m[1] for line in plan.executedPlan().toString().split("\n") if (m := re.match(r"[^A-Za-z]*([A-Za-z]+)", line))}
    return df if nodes <= _STEADY and plan.analyzed().deterministic() else stored(df, name)


#: Bytes of rows that go to a Python worker as one Arrow batch.
BATCH_BYTES = 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python workers in Arrow batches of about BATCH_BYTES at most.

    The limit is one of the session and read when a job runs, so it is lowered for the session (a lower one
    stays). Else a batch is a task's first 10,000 rows, held by the JVM outside its heap and by the worker.
    """
    spark = df.sparkSession
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


#: What a Python worker keeps for its next task: one thing at a time.
_KEPT: dict = {}


def kept(name, build: Callable):
    """build(), made once a worker; whatever was kept under another name goes."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = build()
    return _KEPT[name]


def lean(rows: Iterator, keep: bool = False) -> Iterator:
    """rows; a worker waiting for its next task then holds no freed memory, and, unless
    told to, nothing kept by an earlier task while it works."""
    if not keep:
        _KEPT.clear()
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc only
            trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, cut where the column's texts reach that many bytes."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        lo = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= n_bytes or i == len(sizes) - 1:
                yield b.slice(lo, i + 1 - lo)
                lo, total = i + 1, 0
