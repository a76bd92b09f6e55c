"""License scans by canonical digest lookup.

A text is brought to a canonical form (lower case, no punctuation, no copyright lines, one
spelling of equivalent words, single spaces); its digest is joined with those of the known texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import EQUIVALENT, KNOWN

#: Lines that a canonical form leaves out, over the lower-cased text.
COPYRIGHT_LINE = r"(^|\n)[ \t]*((copyright\b|\(c\)|©)[^\n]*|all rights reserved\.?[ \t]*)"
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form; empty for null."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, " "), F.lit(" "))
    for other, word in EQUIVALENT:
        t = F.replace(t, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """license_id, digest of the known texts, by the same expression."""
    d = spark.createDataFrame([(k, t) for k, t in known.items()], "license_id string, text string")
    return d.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def first_words(spark, known=KNOWN) -> list[str]:
    """Words that a text which equals a known one can begin with; COPYRIGHT_LINE may leave out "all rights reserved" before it."""
    d = spark.createDataFrame([(t,) for t in known.values()], "text string").select(canonical(F.col("text")).alias("c"))
    first = {r["c"].split(" ")[0] for r in d.collect()}
    return sorted(first | {"all"} | {other.split(" ")[0] for other, word in EQUIVALENT if word.split(" ")[0] in first})


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, digest, license_id, notices for every row of docs.

    license_id is that of the known text that the whole text equals in canonical form, else null; notices are the
    ids of known texts that one of its lines equals, sorted, joined by commas, null if none. Null and
    empty texts have the digest of the empty text and no licence. The known texts, a fixed list, are broadcast.
    Texts are read whole, however long. Repeated rows come again, rows that share a doc_id share their notices; an
    empty table gives none; other columns are ignored.
    """
    ids = known_digests(docs.sparkSession, known)
    whole = F.broadcast(ids.withColumnRenamed("digest", "_d"))
    d = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    d = d.join(whole, d["digest"] == whole["_d"], "left").select("doc_id", "digest", "license_id")
    # A line's canonical form begins with its first word, or what that is an equivalent spelling of, or follows "all rights reserved".
    line = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    line = line.filter(F.regexp_extract(F.lower("line"), r"[\p{L}\p{N}]+", 0).isin(*first_words(docs.sparkSession, known)))
    line = line.select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("_d"))
    hit = line.join(F.broadcast(ids.select(F.col("license_id").alias("_l"), F.col("digest").alias("_d"))), "_d")
    hit = hit.groupBy(F.col("doc_id").alias("_id")).agg(F.array_join(F.sort_array(F.collect_set("_l")), ",").alias("notices"))
    return d.join(hit, d["doc_id"].eqNullSafe(hit["_id"]), "left").select("doc_id", "digest", "license_id", "notices")


def sql() -> str:
    """The same for DuckDB, from the same constants."""
    def form(x: str) -> str:
        t = f"regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', '\\1', 'g')"
        t = f"' ' || regexp_replace({t}, '{PUNCTUATION}', ' ', 'g') || ' '"
        for other, word in EQUIVALENT:
            t = f"replace({t}, ' {other} ', ' {word} ')"
        return f"sha256(trim(regexp_replace({t}, ' +', ' ', 'g')))"
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN.items())
    return f"""
with k as (select id, {form('t')} d from (values {rows}) v(id, t)),
d as (select doc_id, {form('text')} digest from documents),
l as (select doc_id, {form('line')} d from (select doc_id, unnest(string_split(text, chr(10))) line from documents)),
h as (select doc_id, array_to_string(list_sort(list(distinct k.id)), ',') notices from l join k using (d) group by doc_id)
select d.doc_id, d.digest, k.id license_id, h.notices from d left join k on d.digest = k.d left join h on d.doc_id is not distinct from h.doc_id
"""
