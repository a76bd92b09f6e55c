"""Exact removal of repeated byte strings, built block by block with a difference cover.

Every string of ``length`` bytes that also starts earlier loses its bytes. All
suffixes of a corpus can't be sorted at once, so:

1. A difference cover modulo ``PERIOD`` samples 8 of 57 positions of each block. Any two
   equal strings have, at one offset below the period, a sampled position in both,
   so equal strings share a sampled substring of length - PERIOD + 1 bytes. The
   sampled substrings are dealt into buckets; each bucket is sorted on its own and gives
   the samples that more than one block holds.
2. Only strings around such samples can repeat. Their fingerprints are dealt into
   buckets, each sorted a range at a time, ties resolved by document order; the answer to
   each block is one bit a string: whether its first occurrence is elsewhere.
3. Each block marks its bytes.

A block is a run of a partition's rows of a few MB, made as the rows arrive; it sends each distinct
string once, so a string that a third of all texts hold costs one entry a block. Texts never leave
their partition: the answers come to them. A string is compared by a 64-bit fingerprint within its
bucket, which other bits choose: n strings have about n * BUCKET / 2^65 false pairs, that is one in 2^43
strings if the hash is as good as a random one. In step 1, 32 bits suffice, as a false hit only adds work.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, steady

#: A perfect difference set: every difference modulo 57 occurs once.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
LENGTH = 100
#: Positions hashed in one vectorised step, few enough for a processor's cache.
STEP = 1 << 15
#: Entries of a bucket to aim at, entries sorted at a time, and bytes of text of a block (a longer text is a block of its own).
BUCKET, SORTED = 4_000_000, 500_000
BLOCK = 2 << 20

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_HALF = np.uint64(32)


def _mix(a: np.ndarray, b: np.ndarray, k: int = 0) -> np.ndarray:
    """One hash of two; neither is linear in the result."""
    x = a * _K[k]
    x ^= x >> _HALF
    x += b
    x *= _K[k + 1]
    x ^= x >> _HALF
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position, as integers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype(np.uint64)


def fingerprints(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every string of that many bytes (16 or more):
    halves of a power of two are joined, the last two overlap."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, size = _eights(data), 8
    while 2 * size <= length:
        h = _mix(h[:-size], h[size:])
        size *= 2
    a, b = h[:n], h[length - size:length - size + n]
    return _mix(a, b), _mix(a, b, 2)


def _at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """One hash of the string of that many bytes at each of some places."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = _mix(h, eight[at + k])
    return h


def _pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    a = np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(a.T).view(dtype).ravel()


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _bits(a: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(a).tobytes(), 1)


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=n).astype(bool)


def _heads(a: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


class _Block:
    """The distinct texts of some documents in the order of their ids, one after the other."""

    def __init__(self, rows):
        self.docs = sorted(((-(1 << 63) if i is None else i, (t or "").encode("utf-8", "surrogatepass"), i, rest) for i, t, *rest in rows), key=lambda r: (r[0], r[1]))
        self.digests = [hashlib.blake2b(d[1], digest_size=16).digest() for d in self.docs]
        self.first: dict[bytes, int] = {}
        for k, d in enumerate(self.digests):
            self.first.setdefault(d, k)

    def copies(self) -> tuple[bytes, np.ndarray]:
        """Digests of the texts, and the least id of each."""
        return b"".join(self.first), np.array([self.docs[k][0] for k in self.first.values()], np.int64)

    def lay(self, least: int) -> None:
        """Lays out the texts of at least that many bytes."""
        self.own = [k for k in self.first.values() if len(self.docs[k][1]) >= least]
        texts = [self.docs[k][1] for k in self.own]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def fits(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those places at which a string of that many bytes ends within its text."""
        return at[at + length <= self.starts[np.searchsorted(self.starts, at, "right")]]

    def samples(self, short: int) -> None:
        """Sorts the sampled substrings: places, hashes, and where runs of equal ones begin."""
        n = len(self.data)
        at = (np.arange(0, n, PERIOD, dtype=np.int64)[:, None] + np.array(COVER)).ravel()
        at = self.fits(at[at < n], short) if n else at
        keys = np.concatenate([np.zeros(0, np.uint64), *(_at(self.data, at[lo:lo + STEP], short) for lo in range(0, len(at), STEP))])
        by = np.argsort(keys)
        self.sample_at, self.sample_keys = at[by], keys[by]
        self.sample_heads = _heads(self.sample_keys)

    def strings(self, shared: np.ndarray, length: int, short: int) -> None:
        """Sorts the strings that may repeat, those around samples that do (shared: by run).

        places: of all of them; keys, buckets, firsts: of the distinct ones, by bucket and key.
        """
        sizes = np.diff(self.sample_heads, append=len(self.sample_keys))
        hit = self.sample_at[np.repeat(shared | (sizes > 1), sizes)]
        n = len(self.data)
        # Where the reach of a sample begins and ends; no two begin at one place but the first ones at 0.
        edge = np.zeros(n + 2, np.int8)
        np.add.at(edge, np.maximum(hit - (length - short), 0), np.int8(1))
        np.add.at(edge, hit + 1, np.int8(-1))
        del hit
        own, depth = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))], 0
        for lo in range(0, n, STEP):  # a step at a time, so that only what may repeat is held
            within = np.cumsum(edge[lo:min(lo + STEP, n)], dtype=np.int32) + depth
            depth = int(within[-1])
            p = self.fits(np.flatnonzero(within > 0) + lo, length)
            if len(p):
                h, g = fingerprints(self.data[lo:lo + STEP + length - 1], length)
                own.append((p.astype(np.int32 if n < 1 << 31 else np.int64), h[p - lo], (g[p - lo] >> _HALF).astype(np.uint32)))
        del edge
        self.places, keys, other = (np.concatenate(x) for x in zip(*own))
        del own
        by = np.argsort(keys)
        keys = keys[by]
        heads = _heads(keys)
        self.firsts = np.minimum.reduceat(self.places[by], heads) if len(heads) else self.places
        self.keys, self.other = keys[heads], other[by[heads]]
        self.sample_at = self.sample_keys = None  # not needed any more

    def deal(self, n: int) -> np.ndarray:
        """Sorts the distinct strings by bucket; where each of n buckets begins."""
        to = (self.other.astype(np.uint64) * np.uint64(n) >> _HALF).astype(np.uint16 if n < 1 << 16 else np.uint32)
        by = np.argsort(to, kind="stable")
        self.keys, self.firsts = self.keys[by], self.firsts[by]
        return np.searchsorted(to[by], np.arange(n + 1))


def _cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins in sorted fingerprints."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _low(keys: np.ndarray, lo: int, width: int) -> np.ndarray:
    """Place in the bucket, scaled to 32 bits."""
    return ((keys - np.uint64(lo)) // np.uint64(max(1, width >> 32))).astype(np.uint32)


def shared_samples(pieces: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """pieces: (block, its distinct sorted samples); to each, whether another block holds them too."""
    if pieces:
        flat = np.sort(np.concatenate([a for _, a in pieces]))
        twice = flat[1:][flat[1:] == flat[:-1]]
        for b, a in pieces:
            at = np.searchsorted(twice, a)
            yield b, (twice[np.minimum(at, len(twice) - 1)] == a) if len(twice) else np.zeros(len(a), bool)


def later_copies(texts: list[tuple[int, bytes, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """texts: (block, digests, least ids); to each block, the digests of which another has an earlier one."""
    least: dict[bytes, tuple[int, int]] = {}
    for b, d, ids in texts:
        for k, i in enumerate(ids.tolist()):
            key = d[16 * k:16 * k + 16]
            if (old := least.get(key)) is None or (i, b) < old:
                least[key] = (i, b)
    for b, d, ids in texts:
        later = [d[16 * k:16 * k + 16] for k, i in enumerate(ids.tolist()) if least[d[16 * k:16 * k + 16]] != (i, b)]
        if later:
            yield b, b"".join(later)


def later_strings(pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """pieces: (block, distinct sorted keys, codes, ids: the owner of string i is ids[codes[i]]);
    for each, whether its strings occur earlier: in a lesser document, or the same one's lesser block.

    A range of the keys is sorted at a time, so that only the pieces themselves are held whole.
    """
    total = sum(len(p[1]) for p in pieces)
    n = max(1, -(-total // SORTED))
    cuts = [_cut(p[1], n) for p in pieces]
    out = [np.zeros(len(p[1]), bool) for p in pieces]
    for r in range(n):
        own = [(i, c[r], c[r + 1]) for i, c in enumerate(cuts) if c[r] < c[r + 1]]
        if not own:
            continue
        keys = np.concatenate([pieces[i][1][x:y] for i, x, y in own])
        ids = np.concatenate([pieces[i][3][pieces[i][2][x:y]] for i, x, y in own])
        block = np.concatenate([np.full(y - x, pieces[i][0], np.int64) for i, x, y in own])
        by = np.argsort(keys)
        heads = _heads(keys[by])
        sizes = np.diff(heads, append=len(by))
        ids, block = ids[by], block[by]
        late = ids != np.repeat(np.minimum.reduceat(ids, heads), sizes)
        block[late] = np.iinfo(np.int64).max
        late |= block != np.repeat(np.minimum.reduceat(block, heads), sizes)
        back = np.empty(len(by), bool)
        back[by] = late
        lo = 0
        for i, x, y in own:
            out[i][x:y] = back[lo:lo + y - x]
            lo += y - x
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, carry: bool = False):
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    (on request also kept: the remaining text, and the other columns of docs).

    Null texts are empty. Texts are ordered by doc_id, null first; of rows that share a
    doc_id the one with the lesser bytes is the earlier (in different blocks: the lesser block). Of
    repeated rows one keeps its bytes. A text shorter than ``length`` loses nothing, an empty table gives
    no rows. Where a cut falls within a character, the kept text has the replacement character; the digest is
    of the bytes. Columns named like a result are replaced by it. A text is held whole by one task, with
    about 40 bytes a byte where all of it may repeat.
    """
    if length < PERIOD + 16:
        raise ValueError(f"length must be at least {PERIOD + 16}")
    short = length - PERIOD + 1
    spark = docs.sparkSession
    sc = spark.sparkContext
    # What is read three times must come in the same rows and partitions each time.
    docs = steady(docs, "repeats_input")
    more = [f for f in docs.schema if carry and f.name not in ("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_parts = plain.rdd.getNumPartitions()
    sizes = plain.groupBy(F.spark_partition_id()).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    block_bytes = BLOCK
    share = int(largest) // block_bytes + 1  # blocks a partition
    n1 = max(1, -(-int(total * len(COVER) / PERIOD) // BUCKET))
    n2 = max(1, -(-int(total / 4) // BUCKET))
    width = (1 << 64) // n1
    single = BatchedSerializer(CPickleSerializer(), 1)  # one block a record, for zip

    def split(p: int, rows):
        """(block, rows): cut by bytes as the rows arrive; every partition has as many, some empty."""
        k, held, size = 0, [], 0
        for r in rows:
            if held and k + 1 < share and size >= block_bytes * (k + 1):
                yield p * share + k, held
                k, held = k + 1, []
            held.append(tuple(r))
            size += len(r[1].encode("utf-8", "surrogatepass")) if r[1] else 0
        yield p * share + k, held
        for j in range(k + 1, share):
            yield p * share + j, []

    def send_samples(part):
        b, rows = part
        block = _Block(rows)
        block.lay(length)
        block.samples(short)
        u = block.sample_keys[block.sample_heads]
        cut = _cut(u, n1)
        for j in range(n1):
            if cut[j] < cut[j + 1]:
                yield j, (b, 0, _pack(_steps(_low(u[cut[j]:cut[j + 1]], j * (1 << 64) // n1, width))))
        digests, ids = block.copies()
        to = np.frombuffer(digests, ">u4")[::4].astype(np.uint64) * np.uint64(n1) >> _HALF
        for j in np.unique(to).tolist():
            own = np.flatnonzero(to == j)
            yield j, (b, 1, (b"".join(digests[16 * k:16 * k + 16] for k in own), ids[own].tobytes()))

    def answer_samples(j, rows):
        """To each block: which of its samples other blocks hold too, and which texts have an earlier copy elsewhere."""
        samples, texts = [], []
        for _, (b, kind, x) in rows:
            if kind == 0:
                samples.append((b, np.cumsum(_unpack(x, np.uint32), dtype=np.uint32)))
            else:
                texts.append((b, x[0], np.frombuffer(x[1], np.int64)))
        # Scaled to 32 bits, two samples of a block may be one.
        for b, shared in shared_samples([(b, a) for b, a in samples]):
            yield b, (0, j, _bits(shared), len(shared))
        for b, x in later_copies(texts):
            yield b, (1, j, x, 0)

    def dealt(pairs, n):
        return pairs.partitionBy(n, lambda j: j)

    def by_block(answers):
        """A list of answers for each block, in the order of split."""
        def lists(p: int, it):
            own = [[] for _ in range(share)]
            for b, x in it:
                own[b - p * share].append(x)
            return own
        return answers.partitionBy(told_parts, lambda b: b // share).mapPartitionsWithIndex(lists)._reserialize(single)

    def known(rows, told) -> _Block:
        """The block with its strings that may repeat."""
        block = _Block(rows)
        block.gone = frozenset(x[i:i + 16] for kind, _, x, _ in told if kind == 1 for i in range(0, len(x), 16))
        block.lay(length)
        block.samples(short)
        shared = np.concatenate([np.zeros(0, bool), *(_unbits(x, n) for kind, j, x, n in sorted(told, key=lambda t: t[1]) if kind == 0)])
        block.strings(shared, length, short)
        # Texts with an earlier copy elsewhere fall whole; what is in them is in that copy too.
        late = [i for i, k in enumerate(block.own) if block.digests[k] in block.gone]
        if late:
            whole = np.isin(np.searchsorted(block.starts, block.places, "right") - 1, late)
            block.places = block.places[~whole]
            left = ~np.isin(np.searchsorted(block.starts, block.firsts, "right") - 1, late)
            block.keys, block.other, block.firsts = block.keys[left], block.other[left], block.firsts[left]
        return block

    def send_strings(part):
        (b, rows), told = part
        block = known(rows, told)
        cut = block.deal(n2)
        owner = np.searchsorted(block.starts, block.firsts, "right") - 1
        ids = np.array([block.docs[k][0] for k in block.own], np.int64)
        small = np.uint16 if len(ids) < 1 << 16 else np.uint32
        for j in range(n2):
            lo, hi = cut[j], cut[j + 1]
            if lo < hi:
                used, code = np.unique(owner[lo:hi], return_inverse=True)
                yield j, (b, _pack(_steps(block.keys[lo:hi])), zlib.compress(ids[used].tobytes(), 1), _pack(code.astype(small)), small().itemsize)

    def answer_strings(j, rows):
        """To each block, a bit a string: its first occurrence is elsewhere."""
        pieces = []
        for _, (b, keys, ids, code, w) in rows:
            pieces.append((b, np.cumsum(_unpack(keys, np.uint64), dtype=np.uint64), _unpack(code, f"u{w}"), np.frombuffer(zlib.decompress(ids), np.int64)))
        for (b, *_), late in zip(pieces, later_strings(pieces)):
            yield b, (2, j, _bits(late), len(late))

    def finish(part):
        (b, rows), told = part
        block = known(rows, told)
        block.deal(n2)
        late = np.concatenate([np.zeros(0, bool), *(_unbits(x, n) for kind, j, x, n in sorted(told, key=lambda t: t[1]) if kind == 2)])
        # Every later string falls; the block's first one only if it occurs earlier elsewhere.
        falls = np.zeros(len(block.data), bool)
        falls[block.places] = True
        falls[block.firsts[~late]] = False
        at = np.flatnonzero(falls)
        edges = dict(zip(block.own, zip(block.starts[:-1], np.searchsorted(at, block.starts[:-1]), np.searchsorted(at, block.starts[1:]))))
        for k, (_, data, doc_id, rest) in enumerate(block.docs):
            n = len(data)
            if n >= length and (block.first[block.digests[k]] != k or block.digests[k] in block.gone):
                removed, spans, kept = n, 1, b""
            else:
                start, lo, hi = edges.get(k, (0, 0, 0))
                p = at[lo:hi] - start
                if len(p):
                    apart = p[1:] > p[:-1] + length
                    begin, end = p[np.concatenate([[True], apart])], p[np.concatenate([apart, [True]])] + length
                    removed, spans = int((end - begin).sum()), len(begin)
                    kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), n]))
                else:
                    removed, spans, kept = 0, 0, data
            row = (doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest())
            yield (*row, *([kept.decode("utf-8", "replace")] if keep_text else []), *rest)

    def blocks_of(rows):
        blocks = rows.rdd.mapPartitionsWithIndex(split)._reserialize(single)
        if told_parts > n_parts:
            empty = sc.parallelize([], told_parts - n_parts).mapPartitionsWithIndex(lambda p, it: [((n_parts + p) * share + i, []) for i in range(share)])
            blocks = sc.union([blocks, empty._reserialize(single)])._reserialize(single)
        return blocks

    # A session may deal out to more partitions than asked for; zip wants as many on
    # either side, so empty ones are added.
    told_parts = sc.parallelize([], 1).map(lambda x: (x, x)).partitionBy(n_parts).getNumPartitions()
    blocks = blocks_of(plain)
    samples = dealt(blocks.flatMap(send_samples).mapPartitions(lean), n1).mapPartitionsWithIndex(answer_samples)
    strings = dealt(blocks.zip(by_block(samples)).flatMap(send_strings).mapPartitions(lean), n2)
    strings = strings.mapPartitionsWithIndex(answer_strings).mapPartitions(lean)
    # All answers of a block come in one list: each list zipped to the texts is a Python worker more in every task.
    answers = by_block(samples.union(strings))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[f"`{f.name}`" for f in more])
    done = blocks_of(whole).zip(answers).flatMap(finish).mapPartitions(lean)
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep_text else ""))
    return spark.createDataFrame(done, T.StructType(schema.fields + more), verifySchema=False)
