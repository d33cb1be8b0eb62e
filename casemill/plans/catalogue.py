"""The queries of the library's core: name -> function of (spark, folder of tables), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casemill.operators.packed import split_values
from casemill.plans import audits, corpus, ledgers, matches, scoring, shapes
from casemill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {"clause_breach": "numbers", "clause_no_breach": "numbers", "related_clauses": "numbers", "keywords": "list"}
    return split_values(table(spark, d, "pages"), "page_id", fields)


QUERIES: dict[str, Query] = {"p2_found": p2_found, **scoring.QUERIES, **ledgers.QUERIES, **corpus.QUERIES, **shapes.QUERIES, **matches.QUERIES, **audits.QUERIES}
FLAGSHIP = "metric_set_by_task"
ORACLE_SQL: dict[str, str] = {**scoring.ORACLE_SQL, **ledgers.ORACLE_SQL, **corpus.ORACLE_SQL, **shapes.ORACLE_SQL, **matches.ORACLE_SQL, **audits.ORACLE_SQL}
