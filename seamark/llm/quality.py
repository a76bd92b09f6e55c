"""Quality rules: counts over whole texts and a hashed n-gram likelihood ratio.

Two multinomials over ``buckets`` hashed word n-grams (n = 1, 2) are counted over
all documents: the trusted target (documents labelled good) and the raw corpus.
A text's score is the mean over its n-grams of log p_target - log p_raw; a text is
kept when no base rule fails and its score reaches ``threshold``. Everything is
built-in Column code: texts are read twice, no n-gram is shuffled before it is
summed into its bucket, and the ratio table has ``buckets`` entries at any scale.
The target is learnt from a bounded sample of the documents labelled good
(``TARGET_DOCS``, by a hash of their id), whose ids are broadcast, so that no text is
shuffled; the raw counts cover every document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

BUCKETS = 16384
#: Mean log ratio under which a text is dropped: about 5 % less likely under the target an n-gram.
THRESHOLD = -0.05
#: A bucket's ratio is drawn to 1 as if it held so many more n-grams of a target that is like the corpus.
PRIOR = 16.0
ORDER = 5
#: Most documents labelled good that the target is learnt from: those of the least hash of their id. Their ids, 8 bytes each, are broadcast.
TARGET_DOCS = 20_000


def ngram_buckets(ws: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word, then of each pair of neighbours."""
    of = _bucket(buckets)
    return let(_hashes(ws), lambda h: F.concat(F.transform(h, of), F.transform(_pairs(h), of)))


def _bucket(buckets: int):
    return lambda w: F.pmod(w, F.lit(buckets)).cast("int")


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _joined(a: Column, b: Column, skip: int, n: Column) -> Column:
    """The first n of: hash of each of a and that of b which stands ``skip`` places later. (Looking
    places up one by one would make several objects a word.)
    """
    both = F.zip_with(a, F.slice(b, F.lit(skip + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))
    return F.slice(both, F.lit(1), F.greatest(n, F.lit(0)))


def _pairs(h: Column) -> Column:
    """Hash of each pair of neighbours, given the words' hashes."""
    return _joined(h, h, 1, F.size(h) - 1)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> list[float]:
    """log p_target - log p_raw of every bucket, smoothed by ``PRIOR``, so that what a small target
    hasn't seen tells little; at most ``buckets`` rows reach the driver. Without labelled documents all are 0.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    good = F.broadcast(good.orderBy(F.xxhash64("_id"), "_id").limit(target_docs))
    lab = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_id"), "left_semi")

    def count(d: DataFrame) -> dict[int, int]:
        b = d.select(F.explode(ngram_buckets(words(F.col("text")), buckets)).alias("b"))
        return {r["b"]: r["n"] for r in b.groupBy("b").agg(F.count("*").alias("n")).collect()}

    raw, target = count(docs.select("text")), count(lab.select("text"))
    if not target:
        return [0.0] * buckets
    n, m = sum(target.values()), sum(raw.values()) + buckets
    like = [n * (raw.get(i, 0) + 1) / m for i in range(buckets)]
    return [math.log((target.get(i, 0) + PRIOR) / (like[i] + PRIOR)) for i in range(buckets)]


def _covered(h: Column, pairs: Column) -> Column:
    """Words that lie in a window of ``ORDER`` words found twice or more in the text, given the hashes of words and pairs."""
    def starts(hs: Column) -> Column:
        order_ = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order_, lambda pos: F.sort_array(F.transform(
            F.filter(pos, lambda x, j: F.coalesce(F.get(pos, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pos, j + 1)["h"] == x["h"], F.lit(False))) , lambda x: x["i"])))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-ORDER).alias("last")),
                           lambda a, s: F.struct((a["n"] + F.least(F.lit(ORDER), s - a["last"])).alias("n"), s.alias("last")),
                           lambda a: a["n"])

    # two pairs and a word: ORDER words
    keys = _joined(_joined(pairs, pairs, 2, F.size(h) - 3), h, 4, F.size(h) - ORDER + 1)
    return let(keys, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(starts(hs))))


def base_counts(text: Column, hashes: Column, pairs: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, given the hashes of its words and pairs; null: all 0.

    A line counts as repeated if it has a word and equals an earlier line.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _covered(hashes, pairs).cast("long"),
    }


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, score, kept.

    Null and blank texts have no words, fail the base rule and score 0. Rows with
    equal texts get equal verdicts, repeated rows come again, an empty table gives none.
    Labels of unknown documents count for nothing; other columns of docs are ignored.
    Texts of any length are counted and scored whole.
    """
    # one literal, folded by Catalyst, not an expression of thousands of nodes
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, labels, buckets)))), ",").cast("array<double>")
    of, (h, pairs) = _bucket(buckets), map(F.col, ("h", "pairs"))

    def add(start: Column, grams: Column) -> Column:
        return F.aggregate(grams, start, lambda a, w: a + F.get(ratios, of(w)))

    n = F.size(h)
    # columns of their own: what follows reads 8 bytes a word and a pair, and no text is split once more for each use
    d = docs.select("doc_id", "text", _hashes(words(F.col("text"))).alias("h")).withColumn("pairs", _pairs(h))
    d = d.select("doc_id", *[c.alias(k) for k, c in base_counts(F.col("text"), h, pairs).items()],
                 F.when(n > 0, add(add(F.lit(0.0), h), pairs) / (2 * n - 1)).otherwise(0.0).alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
