"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles (weight: how often it occurs;
the m-th occurrence is an element of its own, so weights are whole). Darts fall on
every element as a Poisson process over rank, all from hashes, so equal elements
get equal darts in all texts; only darts up to a rank that yields about
k ln k + 2 k of them are thrown. Each dart goes to one of k coordinates and the
earliest of a coordinate is kept: two texts agree there with the probability of
their weighted Jaccard similarity.

Bands of coordinates are joined. Equal sets are merged first. Then, in rounds, each
text is compared with a few texts of its bucket that aren't yet in its class; what is
still apart in a bucket after that is compared in full, each pair once, so every pair
of a bucket is either compared or already in one class. Pairs whose sizes rule the similarity
out, or whose sketches do (parity bits: for certain; signature bits: by four deviations),
aren't made; the others are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, steps, stored

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows: a pair at 0.8 shares no band with probability 0.0004.
BANDS, ROWS = 20, 5
#: Most differing bits of two texts' sketches (two bits a coordinate; at the
#: threshold 20 of 200 differ on average, with a deviation of 5).
DIFFERENT_BITS = 40
#: 64-bit words of the parity sketch: each element flips one of its bits, so two sets' sketches
#: never differ in more bits than the sets do in elements. The wide one has four times as many
#: and goes to the later rounds only; folded it is the narrow one.
PARITY_WORDS, WIDE_WORDS = 8, 32
#: Other texts of its bucket that a text is compared with in a round before the last.
PIVOTS = 4
#: Rows of a bucket's block in the last round.
BLOCK_ROWS = 1000
#: Bytes of text that one vectorised step takes.
STEP_BYTES = 2_000_000
#: Word hashes that a worker keeps from one step to the next.
CACHED_WORDS = 100_000
_WORD = re.compile(r"[^\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        self[w] = h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def elements(texts: list[str | None], order: int = SHINGLE, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed elements of all texts, sorted by text, and the index where each text's begin.

    Words are lower-cased runs of letters and digits; a text of fewer than ``order``
    words is one shingle, one of none has no element.
    """
    cache = _Hashes() if cache is None else cache
    if len(cache) > CACHED_WORDS:
        cache.clear()
    hs, sizes = [], []
    for t in texts:
        w = _WORD.findall(t.lower()) if t else []
        hs.append(np.array([cache[x] for x in w], np.uint64))
        sizes.append(len(w))
    n = np.array(sizes, np.int64)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    flat = np.concatenate([*hs, np.zeros(order, np.uint64)])
    start = np.concatenate([[0], np.cumsum(n)])
    key = np.zeros(len(flat) - order, np.uint64)
    for k in range(order):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(key)])
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - start[doc]
    ok = at <= n[doc] - order
    for i in np.flatnonzero((n > 0) & (n < order)):
        key[start[i]] = int.from_bytes(hashlib.blake2b(hs[i].tobytes(), digest_size=8).digest(), "little")
        ok[start[i]] = True
    key, doc = key[ok], doc[ok]
    by = np.lexsort((key, doc))
    key, doc = key[by], doc[by]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    run = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    key = np.where(run > 0, _mix(key + run.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), key)
    return key, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(key: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Ranks of the earliest dart of each coordinate: (texts, k); texts of no element: inf."""
    n = np.diff(start)
    out = np.full((len(n), k), np.inf)
    todo = np.flatnonzero(n > 0)
    limit = np.zeros(len(n))
    limit[todo] = (k * math.log(k) + 2 * k) / n[todo]
    doc = np.repeat(np.arange(len(n)), n)
    while len(todo):
        pick = np.isin(doc, todo) if len(todo) < len(n) else np.ones(len(doc), bool)
        e, d = key[pick], doc[pick]
        rank, j = np.zeros(len(e)), 0
        sig = out.ravel()
        while len(e):
            j += 1
            h = _mix(e + np.uint64(j * 0xA0761D6478BD642F % 2**64))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank <= limit[d]
            e, d, rank, h = e[hit], d[hit], rank[hit], h[hit]
            np.minimum.at(sig, d * k + (_mix(h) % np.uint64(k)).astype(np.int64), rank)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        limit[todo] *= 2
    return out


def _parity(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Wide parity sketch of each text: (texts, WIDE_WORDS)."""
    size, n = 64 * WIDE_WORDS, len(start) - 1
    out = np.zeros((n, WIDE_WORDS), np.uint64)
    for lo in range(0, n, 2000):
        hi = min(lo + 2000, n)
        doc = np.repeat(np.arange(hi - lo), np.diff(start[lo:hi + 1]))
        place = (key[start[lo]:start[hi]] % np.uint64(size)).astype(np.int64)
        odd = (np.bincount(doc * size + place, minlength=(hi - lo) * size) & 1).astype(np.uint8)
        out[lo:hi] = np.packbits(odd.reshape(hi - lo, size), axis=1, bitorder="little").view("<u8")
    return out


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, order: int = SHINGLE) -> DataFrame:
    """id, digest (of the element set; null without elements), keys array<bigint> (one
    a band), n (elements), bits array<bigint> (two bits of every coordinate, then the parity
    sketch), wide array<bigint> (the wide parity sketch)."""
    def run(batches):
        cache = _Hashes()
        for step in steps(batches, "text", STEP_BYTES):
            ids, texts = step.column(0), step.column(1).to_pylist()
            key, start = elements(texts, order, cache)
            sig = signatures(key, start, bands * rows).view(np.uint64).reshape(len(texts), bands, rows)
            h = np.zeros((len(texts), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for r in range(rows):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            digest = [hashlib.blake2b(key[start[i]:start[i + 1]].tobytes(), digest_size=16).digest() if start[i] < start[i + 1] else None for i in range(len(texts))]
            two = _mix(sig.reshape(len(texts), -1)) & np.uint64(3)
            bits = np.stack([(two[:, lo:lo + 31] << (2 * np.arange(two[:, lo:lo + 31].shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64) for lo in range(0, bands * rows, 31)], axis=1)
            wide = _parity(key, start)
            bits = np.concatenate([bits, np.bitwise_xor.reduce(wide.reshape(len(texts), -1, PARITY_WORDS), axis=1)], axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), pa.array(list(h.view(np.int64)), pa.list_(pa.int64())), pa.array(np.diff(start), pa.int64()),
                                              pa.array(list(bits.view(np.int64)), pa.list_(pa.int64())), pa.array(list(wide.view(np.int64)), pa.list_(pa.int64()))], ["id", "digest", "keys", "n", "bits", "wide"])
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("id"), "text")).mapInArrow(lambda batches: lean(run(batches)), "id long, digest binary, keys array<bigint>, n long, bits array<bigint>, wide array<bigint>")


def _sets(docs: DataFrame, order: int) -> DataFrame:
    """id, items: the element set as sorted 32-bit hashes in bytes."""
    def run(batches):
        cache = _Hashes()
        for step in steps(batches, "text", STEP_BYTES):
            ids, texts = step.column(0), step.column(1).to_pylist()
            key, start = elements(texts, order, cache)
            small = (key >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([ids, pa.array([np.unique(small[a:b]).tobytes() for a, b in zip(start[:-1], start[1:])], pa.binary())], ["id", "items"])
    return small_batches(docs.select("id", "text")).mapInArrow(lambda batches: lean(run(batches)), "id long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""
    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):  # views of the batch, no copies
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep))
    return small_batches(p.select("a", "b", "x", "y")).mapInArrow(lambda batches: lean(run(batches)), "a long, b long")


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cls for every id of nodes: the least id of its connected component.

    Labels begin as the least of a node and its neighbours. Least labels go along the edges,
    then to the label's own label, until nothing changes; labels and changes live in written tables.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    near = both.groupBy("a").agg(F.min("b").alias("_m"))
    labels = stored(nodes.join(near, nodes["id"] == near["a"], "left").select("id", F.least("id", F.coalesce("_m", "id")).alias("cls")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("cls").alias("_m"))
        new = labels.join(seen, labels["id"] == seen["a"], "left").select("id", F.col("cls").alias("_old"), F.least("cls", F.coalesce("_m", "cls")).alias("cls"))
        up = labels.select(F.col("id").alias("_u"), F.col("cls").alias("_up"))
        new = stored(new.join(up, new["cls"] == up["_u"], "left").select("id", F.least("cls", F.coalesce("_up", "cls")).alias("cls"), "_old"), "labels")
        changed = new.filter("cls <> _old").limit(1).count()
        labels = new.select("id", "cls")
        if not changed:
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after the classes that links join have become one: components of the
    classes, over the new links alone. Where these join none, labels itself."""
    def of(x):
        return labels.select(F.col("id").alias(x), F.col("cls").alias(f"_{x}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    edges = stored(edges, "joined")
    if not edges.limit(1).count():
        return labels
    new = classes(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), edges)
    new = new.select(F.col("id").alias("cls"), F.col("cls").alias("_new"))
    return stored(labels.join(new, "cls", "left").select("id", F.coalesce("_new", "cls").alias("cls")), "labels")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, order: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs; n_links: similar texts found
    for its text, at least one wherever its class has more than one text.

    class_id is the least doc_id of the class. Texts without words, null ones and
    rows without doc_id are alone in their class (null for those). Repeated rows and
    rows that share a doc_id share a class.
    """
    sk = stored(sketches(docs, bands, rows, order), "sketches")
    reps = sk.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    reps = stored(reps, "reps")
    # One row per distinct set and band.
    first = reps.select(F.col("digest").alias("_d"), "rep")
    one = sk.join(first, (sk["digest"] == first["_d"]) & (sk["id"] == first["rep"]), "left_semi").dropDuplicates(["digest", "id"])
    words = -(-bands * rows // 31)
    about = ["n", *[f"s{i}" for i in range(words + PARITY_WORDS)]]
    slots = one.select("id", F.posexplode("keys").alias("band", "key"), "n", *[F.get("bits", F.lit(i)).alias(f"s{i}") for i in range(words + PARITY_WORDS)])

    differ = (F.col("x.n") + F.col("y.n")) * (1 - similarity) / (1 + similarity) + 1e-6

    def plausible(x: str, y: str):
        def apart(lo: int, hi: int):
            return sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(lo, hi)), F.lit(0))
        most = DIFFERENT_BITS * bands * rows // 100
        return (F.least(f"{x}.n", f"{y}.n") >= similarity * F.greatest(f"{x}.n", f"{y}.n")) & (apart(words, words + PARITY_WORDS) <= differ) & (apart(0, words) <= most)

    bits = F.aggregate(F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)
    full = slots.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    slots = stored(slots.join(full.select("band", "key"), ["band", "key"]), "slots")
    low = slots.groupBy("band", "key").agg(F.min(F.struct("id", *about)).alias("y")).select("band", "key", "y")
    wanted = slots.select("id").distinct()
    ids = wanted.select(F.col("id").alias("_w"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, F.col("id") == F.col("_w"), "left_semi")
    sets = stored(_sets(texts, order).dropDuplicates(["id"]), "sets")

    # First round: the least text of any of its buckets.
    x = slots.select("band", "key", F.struct("id", *about).alias("x"))
    pairs = x.join(low, ["band", "key"]).filter((F.col("x.id") > F.col("y.id")) & plausible("x", "y"))
    pairs = stored(pairs.groupBy(F.col("x.id").alias("a")).agg(F.min("y.id").alias("b")), "pairs")
    links = stored(_verified(pairs, sets, similarity), "links")
    tried = pairs.select("a", "b")
    labels = classes(wanted, links)
    for k in range(3):
        # Buckets that hold texts of more than one class; what is one class stays one.
        mine = slots.join(labels, "id")
        apart = mine.groupBy("band", "key").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi")).filter("_lo <> _hi").select("band", "key")
        mine = mine.join(apart, ["band", "key"])
        if k == 0:  # what is left gets the keys of all bands and the wide sketch
            whole = sk.join(mine.select(F.col("id").alias("_w")).distinct(), F.col("id") == F.col("_w"), "left_semi").dropDuplicates(["id", "digest"])
            whole = whole.select(F.col("id").alias("_w"), "keys", "wide")
            mine = mine.join(whole, (F.col("id") == F.col("_w")) & (F.expr("get(keys, band)") == F.col("key"))).drop("_w")
        slots = stored(mine, "apart")
        if not slots.limit(1).count():
            break
        mine, slots = slots, slots.drop("cls")
        if k < 2:  # a few texts of the bucket, different ones in each bucket and round
            mine = mine.select("band", "key", F.struct("id", "cls", *about, "wide").alias("x"))
            pick = mine.groupBy("band", "key").agg(F.array(*[F.min_by("x", F.xxhash64("x.id", F.lit(k * PIVOTS + i), "band")) for i in range(PIVOTS)]).alias("y"))
            pick = pick.select("band", "key", F.explode(F.array_distinct("y")).alias("y"))
            pairs = mine.join(pick, ["band", "key"]).filter((F.col("x.cls") != F.col("y.cls")) & plausible("x", "y") & (bits <= differ))
        else:  # all that is still apart, each pair in the first bucket that it shares
            # A large bucket is cut into blocks, and each pair of blocks is joined on its own.
            cut = mine.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
            mine = mine.join(cut, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            mine = mine.select("band", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.struct("id", "cls", *about, "keys", "wide").alias("x"))
            other = mine.select(F.col("band").alias("_b"), F.col("key").alias("_k"), F.col("other").alias("_x"), F.col("block").alias("_y"), F.col("x").alias("y"))
            shared = F.array_position(F.zip_with("x.keys", "y.keys", lambda a, b: a == b), True)
            pairs = mine.join(other, (F.col("band") == F.col("_b")) & (F.col("key") == F.col("_k")) & (F.col("block") == F.col("_x")) & (F.col("other") == F.col("_y"))
                              & (F.col("x.id") > F.col("y.id")) & (F.col("x.cls") != F.col("y.cls")) & plausible("x", "y") & (bits <= differ) & (shared == F.col("band") + 1))
        pairs = pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
        pairs = stored(pairs.select("a", "b").distinct(), "pairs")
        more = stored(_verified(pairs.join(tried, ["a", "b"], "left_anti"), sets, similarity), "links")
        tried, links = tried.select("a", "b").union(pairs), links.union(more)
        labels = _merged(labels, more)
    n = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    # Back to the documents: a digest's rows take its representative's class.
    by_set = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(n.withColumnRenamed("id", "rep"), "rep", "left")
    by_set = by_set.select("digest", F.coalesce("cls", "rep").alias("cls"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sk.select("id", "digest").join(by_set, "digest", "left")
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.coalesce("cls", "id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs with one row of the least doc_id of each class; rows without doc_id stay. Of rows that share
    a kept doc_id one stays (which, if they aren't equal, is open). All columns stay, whatever their names."""
    c = stored(near_classes(docs, **kw).filter("doc_id is not null").groupBy("doc_id")
               .agg(F.max(F.col("doc_id") != F.col("class_id")).alias("gone"), F.count("*").alias("n")).filter("gone or n > 1"), "gone")
    on = F.expr("cast(d.doc_id as bigint) = c.doc_id")
    left = docs.alias("d").join(c.select("doc_id").alias("c"), on, "left_anti")
    again = c.filter("not gone").select("doc_id")
    if not again.limit(1).count():
        return left
    return left.unionByName(docs.alias("d").join(again.alias("c"), on, "left_semi").dropDuplicates(["doc_id"]))
