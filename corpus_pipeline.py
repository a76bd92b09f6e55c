"""A training-data pipeline over the table documents: each stage keeps, cuts or repeats
documents and hands on the columns of documents (the last adds what it took).

Every stage takes null doc_ids, texts, languages and sources, empty and very long texts, repeated rows and empty
tables, and hands on further columns of documents, whatever their names; the docstrings say with what result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.llm import decontaminate, langid, mixing, nearcopies, repeats
from seamark.llm.common import fresh, stored, table


def _aside(docs, names):
    """docs with the columns of those names under others, and docs' names by the ones they now have."""
    clash = [c for c in docs.columns if c.lower() in names]
    now = dict(zip(clash, fresh(docs, *clash)))
    return docs.withColumnsRenamed(now), {now.get(c, c): c for c in docs.columns}


def _back(docs, columns):
    return docs.select(*[F.col(f"`{now}`").alias(was) for now, was in columns.items()])


def language_id(spark, docs, sf_dir):
    """Drops documents of no language (null, empty and letterless texts); lang becomes the predicted one, also where it was null.

    Texts are parsed whole. Of languages that are as near the first by name wins. Repeated rows stay. Without
    any labelled text every document is of no language.
    """
    pred, score = fresh(docs, "lang_pred", "score")
    got = langid.identify(docs, langid.sample(docs), (pred, score)).filter(F.col(pred) != "und")
    return got.withColumn("lang", F.col(pred)).drop(pred, score)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class stays, that of the least doc_id; of rows that share a doc_id one stays.

    Rows without doc_id stay, as do documents without words, which are like none. Texts are compared whole.
    """
    return nearcopies.one_of_each(docs)


def suffix_dedup(spark, docs, sf_dir):
    """Cuts byte strings that also start earlier; documents of which nothing but white space is left go.

    The order is that of doc_id, null first, then of the texts' bytes. Of repeated rows one keeps its text. A cut within a
    character leaves the replacement character there. n_chars becomes that of what is left.
    """
    plain, columns = _aside(docs, ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"))
    cut = repeats.remove_repeats(plain, keep_text=True, carry=True)
    cut = cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return _back(cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), columns)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold benchmark passages: all rows of a doc_id of which one does, of rows without doc_id those
    that do. Null and empty texts hold none. Without benchmark items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Draws the mix: documents with size, source_size, target and the words taken; those of which none are taken go.

    A null source is one of its own, the last. Texts without words have size 0 and go. Rows that share a doc_id
    are drawn one after the other, those without by their text. Columns of documents with those names are replaced.
    """
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("mix_sources", mix_sources)]

#: Automata, sketches and fingerprints aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
