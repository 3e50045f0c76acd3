"""Queries of the text operators, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import leakage, mixture, names, pii_crf, scans, subjects, unicode_form
from quillspan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both tables under one key: record_table, record_key, text."""
    b = table(spark, d, "blocks", "document_id", "block_id", "text").select(F.lit("blocks").alias("record_table"), F.concat_ws("/", "document_id", "block_id").alias("record_key"), "text")
    v = table(spark, d, "label_rows", "row_id", "value_text").select(F.lit("label_rows").alias("record_table"), F.col("row_id").cast("string").alias("record_key"), F.col("value_text").alias("text"))
    return b.unionByName(v)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with a character that is not the usual one for what it reads as."""
    found = unicode_form.unusual_texts(_records(spark, d), ["record_table", "record_key"], "text").filter("is_case")
    return found.select("k.record_table", "k.record_key").distinct()


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    """Every record's text in its usual form."""
    return unicode_form.usual_form(_records(spark, d), ["record_table", "record_key"], "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal values in block texts."""
    return pii_crf.find_pii(table(spark, d, "blocks", "document_id", "block_id", "text"), table(spark, d, "entities", "document_id", "block_id", "span_start", "span_end", "entity_type", "confidence"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """Block texts with a typed placeholder in place of every personal value."""
    b = table(spark, d, "blocks", "document_id", "block_id", "text").dropDuplicates(["document_id", "block_id"])
    return pii_crf.replace_spans(b, p2_found(spark, d)).select("document_id", "block_id", "clean_text")


def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    """Every name record with the person it means."""
    mentions = names.name_mentions(table(spark, d, "people"), table(spark, d, "label_rows"), table(spark, d, "source_files"))
    return names.link_names(mentions, "scope_id", "mention", "name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.mention_pairs(p3_persons(spark, d), "scope_id", "mention")


def _scan_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks", "document_id", "block_id", "block_ord", "page_number", "extraction_method", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Scanned blocks and their defects."""
    return scans.find_defects(_scan_blocks(spark, d))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of scanned blocks, repaired."""
    return scans.repaired(_scan_blocks(spark, d))


def p4_figures(spark: SparkSession, d: str) -> DataFrame:
    """Text of figures, repaired from their lines."""
    return scans.repaired_figures(table(spark, d, "figure_lines"), _scan_blocks(spark, d))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the length of the passage."""
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("doc_id", "item_id").distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without those that hold an evaluation passage."""
    return leakage.without_leaks(table(spark, d, "documents"), p6_matches(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of the sources, slot by slot."""
    return mixture.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixture.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every document with the weight of the stretch devoted to them."""
    return subjects.find_subjects(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "subject_labels", "doc_id", "subject"), table(spark, d, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_subjects(spark, d).select("doc_id", "subject").distinct()


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_text": p1_text, "p2_found": p2_found, "p2_text": p2_text, "p3_found": p3_found, "p3_persons": p3_persons,
    "p4_found": p4_found, "p4_text": p4_text, "p4_figures": p4_figures,
    "p6_found": p6_found, "p6_matches": p6_matches, "p6_clean": p6_clean, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_subjects": p8_subjects,
}
SQL: dict[str, str] = {}
