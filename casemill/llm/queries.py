"""The queries of this subpackage: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import lookalikes, pairs
from casemill.llm.leaks import find_leaks
from casemill.llm.mixing import Mixture, token_counts
from casemill.llm.names import cluster_names, find_entities
from casemill.llm.scans import ScanRepair
from casemill.llm.spans import SharedSpans
from casemill.llm.subjects import assign_subjects
from casemill.runtime import table


def _scans(spark: SparkSession, d: str) -> ScanRepair:
    return ScanRepair(table(spark, d, "pdf_lines"), table(spark, d, "panes"), "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).defects()


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).paragraphs()


def _reports(spark: SparkSession, d: str) -> SharedSpans:
    return SharedSpans(table(spark, d, "panes").where("pane = 'report'"), "pane_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).pairs().select(F.col("id_a").alias("pane_id_a"), F.col("id_b").alias("pane_id_b"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).coverage().withColumnRenamed("id", "pane_id")


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).spans().withColumnRenamed("id", "pane_id")


def p3_unshared(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).unshared().withColumnRenamed("id", "pane_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "responses"), "response_id", "question", "content", pairs.RULING, pairs.RULING_WORDS)


def p4_copy_ratio(spark: SparkSession, d: str) -> DataFrame:
    return pairs.copy_ratios(table(spark, d, "responses"), "response_id", "question", "content")


def _rewriter(spark: SparkSession, d: str) -> lookalikes.Rewriter:
    texts = table(spark, d, "panes").select("text").union(table(spark, d, "slot_corrections").select("quote"))
    return lookalikes.Rewriter(lookalikes.member_counts(texts, "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "cases").select("case_number", F.explode("source_files").alias("file"))
    quotes = table(spark, d, "slot_corrections").join(files, "case_number").select(F.col("correction_id").alias("quote_id"), "file", "quote")
    places = table(spark, d, "panes").select(F.col("pane_id").alias("place_id"), "file", "text")
    found = lookalikes.find_quotes(quotes, places, _rewriter(spark, d))
    return found.select(F.col("quote_id").alias("correction_id"), F.col("place_id").alias("pane_id"))


def p5_panes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent(table(spark, d, "panes").select("pane_id", "text"), ["text"], _rewriter(spark, d))


def p5_quotes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent(table(spark, d, "slot_corrections").select("correction_id", "quote"), ["quote"], _rewriter(spark, d))


def _names(spark: SparkSession, d: str) -> DataFrame:
    pages, cases = table(spark, d, "pages"), table(spark, d, "cases")
    one = [pages.select(F.lit(f).alias("field"), F.col("page_id").alias("record_id"), F.col(f).alias("name")) for f in ("respondent", "complainant")]
    return one[0].union(one[1]).union(cases.select(F.lit("companies"), "case_id", F.explode("entities.companies")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "companies").select(F.col("company_id").alias("entity_id"), "name")
    return find_entities(_names(spark, d), known).withColumnRenamed("entity_id", "company_id")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster_names(_names(spark, d), "name")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").where("split = 'test'")
    found = find_leaks(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "extract_text")
    return found.withColumn("similarity", F.round("similarity", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("run >= 20").select("doc_id", "item_id")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(token_counts(table(spark, d, "documents"), "doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p8_mix_plan(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).plan().withColumnRenamed("doc", "doc_id")


def p8_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    subjects = [r.subject for r in table(spark, d, "subjects").select("subject").where("subject is not null").distinct().collect()]  # the list of outputs
    return assign_subjects(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "doc_labels"), "doc_id", "subject", subjects).select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_paragraphs, p3_found, p3_coverage, p3_spans, p3_unshared, p4_found, p4_copy_ratio, p5_found, p5_panes, p5_quotes, p6_found, p6_clusters, p7_found, p7_leaks, p8_mix_plan, p8_mix_shares, p9_found)}

#: None of them can be said in SQL on whole tables; tests/llm holds them against brute force and held-out labels.
ORACLE_SQL: dict[str, str] = {}
