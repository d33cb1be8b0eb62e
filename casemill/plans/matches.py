"""Queries that match texts to lists and versions to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import text as t
from casemill.operators import matching, ranking
from casemill.runtime import table

ROLES = ["general practitioner", "hospital pharmacist", "ward sister", "journal editor", "practice manager", "former employee"]


def title_products(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "cases").select(F.explode("entities.products").alias("product"))
    return matching.longest_prefix(table(spark, d, "documents"), "doc_id", "text", names, "product")


def first_roles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(matching.earliest_phrase(F.col("text"), ROLES).alias("role")).agg(F.count("*").alias("docs"))


def fetch_agreement(spark: SparkSession, d: str) -> DataFrame:
    return matching.agreement(table(spark, d, "pages").where("file is not null"), ["file"], "respondent")


def source_integrity(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    numbers = lambda c: F.coalesce(t.case_numbers(c), none)
    return table(spark, d, "pages").select("page_id", matching.declared_and_found(numbers("case_number"), numbers("title")).alias("state"))


def unbalanced_quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("keywords is not null").groupBy(matching.unbalanced(F.col("keywords")).alias("unbalanced")).agg(F.count("*").alias("pages"))


def line_sequences(spark: SparkSession, d: str) -> DataFrame:
    return ranking.contiguous(table(spark, d, "pdf_lines").where("line_no is not null"), ["file", "page_no"], "line_no")


QUERIES = {f.__name__: f for f in (title_products, first_roles, fetch_agreement, source_integrity, unbalanced_quotes, line_sequences)}

_CASE = r"\b([A-Z]{2,6}/[0-9]+/[0-9]{1,2}/[0-9]{2})\b"
_PLACES = ", ".join(f"{{'at': instr(text, '{r}'), 'n': {n}, 'p': '{r}'}}" for n, r in enumerate(ROLES))

ORACLE_SQL = {
    "title_products": """WITH n AS (SELECT DISTINCT unnest(entities.products) AS product FROM cases)
SELECT doc_id, max_by(product, length(product)) AS product FROM documents JOIN n ON trim(text) = product OR starts_with(trim(text), product || ' ') GROUP BY doc_id""",
    "first_roles": f"SELECT list_min(list_filter([{_PLACES}], lambda x: x.at > 0)).p AS role, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "fetch_agreement": """SELECT file, count(*) AS versions, CASE WHEN count(DISTINCT respondent) = 1 THEN 'exact' WHEN count(DISTINCT trim(regexp_replace(respondent, '[ \\t\\r\\n]+', ' ', 'g'))) = 1 THEN 'blanks' WHEN count(DISTINCT regexp_replace(lower(respondent), '[^a-z0-9]+', '', 'g')) = 1 THEN 'marks' ELSE 'differs' END AS tier FROM pages WHERE file IS NOT NULL AND respondent IS NOT NULL GROUP BY file""",
    "source_integrity": f"""WITH n AS (SELECT page_id, coalesce(list_distinct(regexp_extract_all(case_number, '{_CASE}', 1)), []) AS a, coalesce(list_distinct(regexp_extract_all(title, '{_CASE}', 1)), []) AS b FROM pages)
SELECT page_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 'none' WHEN len(a) = 0 THEN 'undeclared' WHEN len(b) = 0 THEN 'unfound' WHEN list_sort(a) = list_sort(b) THEN 'equal' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'disjoint' END AS state FROM n""",
    "unbalanced_quotes": """SELECT (length(keywords) - length(replace(keywords, '"', ''))) % 2 = 1 OR length(replace(keywords, '“', '')) <> length(replace(keywords, '”', '')) AS unbalanced, count(*) AS pages FROM pages WHERE keywords IS NOT NULL GROUP BY 1""",
    "line_sequences": "SELECT file, page_no, count(DISTINCT line_no) AS n, max(line_no) AS top, count(DISTINCT line_no) = max(line_no) AND min(line_no) = 1 AS contiguous FROM pdf_lines WHERE line_no IS NOT NULL GROUP BY 1, 2",
}
