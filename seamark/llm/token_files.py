"""Token counts of documents in flat, unindexed token files.

A file is nothing but token ids of a fixed width, each document followed by an
end-of-document id. It is cut into blocks of equal size that tasks scan on their own:
a vectorised comparison finds the end ids of a block, and a prefix scan over the
blocks' summaries (how many, where the last) gives each block what its first
document began with before it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stored

#: Vocabulary file of ranks and the free id that ends a document in it.
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: Fixed value: the pattern that goes with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 20
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 32 << 20
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN, ranks: bytes | None = None):
    """A tiktoken encoding of a rank file, one a process; ranks: the file's content, where it isn't at hand."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        if ranks is None:
            with open(vocabulary, "rb") as f:
                ranks = f.read()
        own = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[vocabulary] = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=own, special_tokens={})
    return _ENCODERS[vocabulary]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system that Arrow knows, and the path there; s3a and s3n are s3 to it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    try:
        return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files can't be kept at {path}: Arrow knows no {scheme} store") from e


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, width: int = 2) -> DataFrame:
    """Tokenises docs (doc_id, text) into one flat file a partition and says which
    document went where: file, ordinal, doc_id.

    A null text has no tokens; texts are read whole, however long. A file appears under its name only when
    whole; a task that runs again leaves the same there. The work is done when the result is
    first computed: store it. The vocabulary is read by the driver and broadcast; it is a few MB at most.
    """
    if end >= 1 << (8 * width):
        raise ValueError("the end id does not fit the width")
    kind = f"<u{width}"
    if os.path.getsize(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get()
        name = f"part-{part.partitionId():06d}.bin"
        temp = f"{root}/.{name}.{part.taskAttemptId()}"
        enc, n, out = encoder(vocabulary, ranks=ranks.value), 0, None
        for b in batches:
            out = out or fs.open_output_stream(temp)
            for t in b.column(1).to_pylist():
                ids = enc.encode_ordinary(t) if t else []
                ids.append(end)
                out.write(np.array(ids, kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(range(n, n + b.num_rows), pa.int64()), b.column(0)], ["file", "ordinal", "doc_id"])
            n += b.num_rows
        if out:
            out.close()
            try:
                fs.move(temp, f"{root}/{name}")
            except OSError:  # some stores don't replace what an earlier attempt left, which is the same
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise
                fs.delete_file(temp)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, doc_id long")


def scan_token_files(spark: SparkSession, path: str, end: int = END, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, start, n_tokens, ended for each document of the files of a folder.

    start counts tokens from the file's begin; the end id isn't counted. What follows the last
    end id is a document that isn't ended. Two end ids in a row hold an empty document; an
    empty file holds none. A size that isn't a multiple of the width is an error.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    odd = files.filter(F.col("length") % width != 0).select("path").head()
    if odd:
        raise ValueError(f"not whole tokens of {width} bytes: {odd['path']}")
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("block"))
    blocks = blocks.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, length, block in zip(*(c.to_pylist() for c in b.columns)):
                fs, place = _store(p)
                with fs.open_input_file(place) as f:
                    a = np.frombuffer(f.read_at(min(size, length - block * size), block * size), f"<u{width}")
                at = np.flatnonzero(a == end) + block * block_tokens
                last = (block + 1) * size >= length
                open_ = bool(last and a[-1] != end)
                if open_:
                    at = np.append(at, length // width)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([block], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([open_])], ["path", "block", "ends", "open"])

    found = stored(blocks.mapInArrow(run, "path string, block long, ends array<bigint>, open boolean"), "ends")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = found.select("path", "block", F.size("ends").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"))
    scan = scan.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prev"))
    d = found.join(scan, ["path", "block"])
    d = d.select("path", "base", "prev", "ends", "open", F.posexplode("ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("prev")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    return d.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (~(F.col("open") & (F.col("i") == F.size("ends") - 1))).alias("ended"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file, ordinal for every row of docs, by way of token files in the shared folder.

    Null and empty texts have 0 tokens, repeated rows come again, an empty table gives none; other columns are ignored.
    """
    path = scratch(docs.sparkSession, "tokens")
    where = stored(write_token_files(docs, path, vocabulary, end, width), "token-index")
    if where.limit(1).count() == 0:
        return where.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal")
    seen = scan_token_files(docs.sparkSession, path, end, width, block_tokens)
    return where.join(seen, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
