"""Benchmark decontamination by spaced-seed hashing.

A mask such as 1110100111 picks some positions of a window of words; the picked
words' hashes are hashed again, so windows that differ only at the other positions
meet. Every window of every text is looked up among the benchmark's; around each
hit the texts are laid over each other and the overlap must hold enough equal
words. All Column code. A bitmap of the benchmark's seeds, a literal of fixed size, rules
out nearly all windows before a row is made of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_words

#: Fixed masks (1: the word counts). All ways of changing two words of 16 leave a hit, 98 % of those of changing three.
MASKS = ("1110100111", "11101111", "1110100000111")
#: An overlap is a leak if of its VERIFY words at least EQUAL agree.
VERIFY, EQUAL = 16, 13
#: Items of fewer words than WHOLE must occur whole; those of fewer than SHORTEST are too common to tell anything.
WHOLE, SHORTEST = 14, 5
#: Longs of the bitmap: 2 million bits, 256 KB.
BITMAP = 1 << 15
#: Largest benchmark side that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def _hashes(text: Column) -> Column:
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def _seeds(h: Column, masks, fits=None, whole=None) -> Column:
    """array<struct<at, key>> of all windows under all masks whose key fits; whole: the words that
    a text must have for a mask without gaps that stands for a short item."""
    def one(k: int, m: str) -> Column:
        picks = [i for i, c in enumerate(m) if c == "1"]
        ok = F.size(h) >= len(m) if whole is None or len(m) >= whole else F.size(h) == len(m)
        at = F.when(ok, F.sequence(F.lit(0), F.size(h) - len(m))).otherwise(F.array().cast("array<int>"))
        got = F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.get(h, i + p) for p in picks]).alias("key")))
        return got if fits is None else F.filter(got, lambda x: fits(x["key"]))
    return F.concat(*[one(k, m) for k, m in enumerate(masks)])


def _place(key: Column) -> tuple[Column, Column]:
    """Long and bit of a key in the bitmap."""
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(BITMAP - 1)).cast("int"), key.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(seeds: DataFrame):
    """A test of keys by a bitmap of the seeds' (at most BITMAP rows reach the driver)."""
    at, bit = _place(F.col("key"))
    rows = seeds.groupBy(at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).collect()
    longs = [0] * BITMAP
    for r in rows:
        longs[r["at"]] = r["bits"]
    bits = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")  # one literal, folded by Catalyst

    def fits(key: Column) -> Column:
        at, bit = _place(key)
        return F.getbit(F.get(bits, at), bit) == 1
    return fits


def _own(d: str = "") -> Column:
    """What tells rows without doc_id apart: their text's hash; null for others."""
    return F.when(F.col(f"{d}doc_id").isNull(), F.xxhash64(f"{d}text"))


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, verify: int = VERIFY, equal: int = EQUAL) -> DataFrame:
    """doc_id, own, item_ids array<bigint> (sorted), n_equal: one row per document that
    holds part of a benchmark item.

    A leak is a stretch of ``verify`` words around a seed hit, laid over an item,
    with ``equal`` or more equal words (for items of fewer than ``verify`` words four fifths of the item, for those
    of fewer than ``WHOLE`` all of it; items of fewer than ``SHORTEST`` words match nothing).
    Words are lower-cased runs of letters and digits. Null and empty texts and items match nothing. Rows
    that share a doc_id count as one document; rows without are documents by their text, whose hash is own; an item
    without id isn't listed.
    Texts are searched whole, however long; other columns are ignored; an empty table or benchmark gives no leaks.
    """
    least = min(map(len, masks))
    own = benchmark.filter(F.col("text").isNotNull()).select("item_id", _hashes(F.col("text")).alias("ih"))
    short = sorted(r["n"] for r in own.select(F.size("ih").alias("n")).filter(F.col("n").between(SHORTEST, least - 1)).distinct().collect())
    masks = [*masks, *("1" * n for n in short)]
    items = own.select("item_id", "ih", F.inline(_seeds(F.col("ih"), masks, whole=least)).alias("iat", "key"))
    size = items.agg(F.coalesce(F.sum(8 * F.size("ih") + 64), F.lit(0)).alias("b")).first()["b"]
    fits = _bitmap(items)
    d = docs.filter(F.col("text").isNotNull()).select("doc_id", _own().alias("own"), _hashes(F.col("text")).alias("h"))
    seeds = d.select("doc_id", "own", "h", F.inline(_seeds(F.col("h"), masks, fits)).alias("at", "key"))
    if size <= BROADCAST_BYTES:
        hit = seeds.join(F.broadcast(items), "key")
    else:  # places are shuffled, not words; these come to the hits
        hit = seeds.select("doc_id", "own", "at", "key").join(items.select("item_id", "iat", "key"), "key").drop("key").distinct()
        hit = hit.alias("x").join(own.alias("y"), F.expr("x.item_id <=> y.item_id")).select("x.*", "y.ih")
        hit = hit.alias("x").join(d.alias("y"), F.expr("x.doc_id <=> y.doc_id and x.own <=> y.own")).select("x.*", "y.h")
    # The words from verify - least before the hit to verify after it, each 1 if equal.
    reach = verify - least
    offsets = F.array(*[F.lit(o) for o in range(-reach, verify)])
    same = F.transform(offsets, lambda o: F.when((F.col("at") + o >= 0) & (F.col("iat") + o >= 0)
                                                 & (F.get("h", F.col("at") + o) == F.get("ih", F.col("iat") + o)), 1).otherwise(0))
    hit = hit.select("doc_id", "own", "item_id", F.size("ih").alias("n"), same.alias("same"))
    sums = F.array(*[reduce(lambda a, x: a + x, [F.get("same", F.lit(s + k)) for k in range(verify)]) for s in range(reach + 1)])
    need = F.when(F.col("n") < WHOLE, F.col("n")).otherwise(F.least(F.lit(equal), F.ceil(F.col("n") * 0.8)))
    found = hit.select("doc_id", "own", "item_id", F.array_max(sums).alias("n_equal"), need.alias("need")).filter("n_equal >= need")
    found = found.groupBy("doc_id", "own", "item_id").agg(F.max("n_equal").alias("n_equal"))
    return found.groupBy("doc_id", "own").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"),
                                              F.max("n_equal").cast("long").alias("n_equal"))


def flag(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, contaminated, item_ids, n_equal for every row of docs."""
    found = leaks(docs, benchmark, **kw)
    return (docs.select("doc_id", _own().alias("own")).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.own <=> f.own"), "left")
            .select("d.doc_id", F.col("f.n_equal").isNotNull().alias("contaminated"),
                    F.coalesce("f.item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
                    F.coalesce("f.n_equal", F.lit(0)).alias("n_equal")))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the documents that leak; all columns stay, whatever their names."""
    on = F.expr("d.doc_id <=> f.doc_id") & _own("d.").eqNullSafe(F.col("f.own"))
    return docs.alias("d").join(leaks(docs, benchmark, **kw).alias("f"), on, "left_anti")


def sql() -> str:
    """flag for DuckDB, from the same constants: seeds are the words themselves, not their hashes. item_ids is text."""
    least, span = min(map(len, MASKS)), VERIFY
    masks = [*MASKS, *("1" * n for n in range(SHORTEST, least))]
    rows = ", ".join(f"({k}, {[i for i, c in enumerate(m) if c == '1']}, {len(m)})" for k, m in enumerate(masks))
    words = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"

    def seeds(table: str, key: str, fits: str) -> str:
        return f"""(select {key}, pos, k, array_to_string(list_transform(picks, lambda p: h[pos + p + 1]), ' ') seed
from (select {key}, h, k, picks, unnest(range(0, len(h) - size + 1)) pos from {table}, m where len(h) >= size and {fits}))"""
    reach = span - least
    return f"""
with m as (select * from (values {rows}) v(k, picks, size)),
d as (select row_number() over () r, doc_id, case when doc_id is null then text end own, {words} h from documents where text is not null),
b as (select row_number() over () r, item_id, {words} h from benchmark where text is not null),
x as (select distinct a.r dr, c.r br, a.pos, c.pos ipos from {seeds('d', 'r', 'true')} a join {seeds('b', 'r', f'(size >= {least} or len(h) = size)')} c using (k, seed)),
y as (select d.doc_id, d.own, b.item_id, len(b.h) n, list_transform(range({-reach}, {span}), lambda o: case when pos + o >= 0 and ipos + o >= 0 and pos + o < len(d.h) and ipos + o < len(b.h) and d.h[pos + o + 1] = b.h[ipos + o + 1] then 1 else 0 end) same
      from x join d on d.r = dr join b on b.r = br),
z as (select doc_id, own, item_id, list_max(list_transform(range(0, {reach + 1}), lambda s: list_sum(same[s + 1:s + {span}]))) n_equal, case when n < {WHOLE} then n else least({EQUAL}, ceil(n * 0.8)) end need from y),
w as (select doc_id, own, item_id, max(n_equal) n_equal from z where n_equal >= need group by all),
v as (select doc_id, own, array_to_string(list_sort(list(item_id) filter (item_id is not null)), ',') item_ids, max(n_equal)::bigint n_equal from w group by all)
select o.doc_id, v.n_equal is not null contaminated, coalesce(v.item_ids, '') item_ids, coalesce(v.n_equal, 0) n_equal
from documents o left join v on o.doc_id is not distinct from v.doc_id and v.own is not distinct from (case when o.doc_id is null then o.text end)
"""
