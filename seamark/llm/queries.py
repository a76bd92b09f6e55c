"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, mixing, nearcopies, quality, repeats, token_files, urls, wrappers
from .common import table


def op1_token_counts(spark, sf_dir):
    """Tokens of every document, by way of token files."""
    return token_files.count_tokens(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op3_decontamination(spark, sf_dir):
    """Whether every document holds benchmark items, which, and the most words of 16 that agree."""
    got = decontaminate.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op4_license_scan(spark, sf_dir):
    """Licence and notices of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    """Base counts, score and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs.select("doc_id", "text"), langid.sample(docs))
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_url_filter(spark, sf_dir):
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark, sf_dir):
    """What of every document repeats earlier bytes."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_near_dedup(spark, sf_dir):
    """Class and number of links of every document."""
    return nearcopies.near_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_html_extraction, op3_decontamination, op4_license_scan, op5_quality_rules,
                                   op6_language_id, op7_url_filter, op8_suffix_dedup, op9_mixing, op10_near_dedup)}
SQL = {"op3_decontamination": decontaminate.sql(), "op4_license_scan": licenses.sql(), "op7_url_filter": urls.sql(), "op9_mixing": mixing.SQL}
