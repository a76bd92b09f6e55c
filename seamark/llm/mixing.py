"""Mixing sources to target weights by capped water-filling.

Sources share a word budget in proportion to their weights; a source stops at
``max_epochs`` times its own size and the excess goes to the others, again by
weight, until no source is above. A source's target is then drawn as whole
repetitions of all its documents plus a seeded fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, words

#: Ranges of the seeded order in which a source's fractional repetition is drawn.
SLICES = 4096


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), max_epochs: float = 3.0,
                   share: float = 1.0) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target double.

    Weights go to the sources by code point, null last, and repeat. Water-filling
    has a closed form: with the sources in order of cap / weight, the level is
    that of the first source whose cap the remaining level doesn't reach. Sources
    of no size get 0. Windows run over one row per source.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)),
                                            ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    s = s.withColumn("_cap", max_epochs * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = (s.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
          .withColumn("_left", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
          .withColumn("_all", share * F.sum("source_size").over(everything)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_left"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))
    s = s.withColumn("_level", F.min(fits).over(everything)["level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), max_epochs: float = 3.0, share: float = 1.0,
        seed: str = "mix-1", size=None) -> DataFrame:
    """docs with size, source_size, target and taken (words drawn, repeats counted).

    Each source takes floor(target / size) whole repetitions of every document,
    then goes through its documents in a seeded order until the rest is used up;
    the document at which it runs out gives a part. So a source's taken words sum
    to its target rounded down. Null and blank texts have size 0 and take 0.
    Running sums go through ``SLICES`` ranges of the seeded order, so no task gets
    a whole source. Repeated rows follow each other in that order; which of two equal rows
    comes first makes no difference to the result as a set. Rows without doc_id are ordered by
    their text. Input columns with the name of a result are replaced by it; an empty table gives no rows.
    """
    size = F.size(words(F.col("text"))) if size is None else size
    key_, slice_, source_, range_, start_, at_ = fresh(docs, "_key", "_slice", "_source", "_range", "_start", "_at")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
    d = docs.drop("source_size", "target", "taken").withColumn("size", size.cast("long")).withColumn(key_, key)
    d = d.withColumn(slice_, (F.conv(F.substring(key_, 1, 3), 16, 10)).cast("int"))
    slices = d.groupBy("source", F.col(slice_).alias("slice")).agg(F.sum("size").alias("n"))
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0)))
    targets = source_targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs, share)
    slices = (slices.alias("a").join(targets.alias("t"), F.expr("a.source <=> t.source"))
              .select(F.col("a.source").alias(source_), F.col("slice").alias(range_), F.col("start").alias(start_), "source_size", "target"))
    d = d.join(slices, F.col("source").eqNullSafe(F.col(source_)) & (F.col(slice_) == F.col(range_)))
    within = W.partitionBy("source", slice_).orderBy(key_, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn(at_, F.col(start_) + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(at_)))
    taken = (whole * F.col("size") + part).cast("long")
    return d.withColumn("taken", taken).drop(key_, slice_, source_, range_, start_, at_)


#: The same for DuckDB.
SQL = r"""
with d as (
  select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as bigint) size,
         md5('mix-1:' || coalesce(cast(doc_id as varchar), text, '')) k from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last)) - 1) % 3 + 1]::double w, 3.0::double * source_size cap from s),
l as (select *, ((select sum(source_size) from s)::double - coalesce(sum(cap) over (order by cap / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, encode(source) nulls last rows between current row and unbounded following) lev from w),
f as (select lev from l where lev * w <= cap order by cap / w limit 1),
t as (select source, source_size, case when (select lev from f) is null then cap else least(cap, (select lev from f) * w) end target from l),
r as (select d.*, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end n,
      coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) a
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, cast(target as double) target,
       cast(n * size + greatest(0, least(size, floor(target) - n * source_size - a)) as bigint) taken from r
"""
