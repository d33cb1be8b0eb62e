"""Append-only ledgers: plans, receipts, latest rows, upserts.

A plan has one row per call, receipts any number. Nothing planned is ever dropped: each call ends up in exactly one
state. Null call ids match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order. Keys are many and groups small: a window, not a gathering; it keeps
    only the best row of each group."""
    at = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(at)).where("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of incoming in place of those with the same key. Keys compare null-safe."""
    a, b = existing.alias("a"), incoming.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key))
    return a.join(b, same, "left_anti").unionByName(incoming)


def coverage(plan: DataFrame, receipts: DataFrame, call: str, failed: Column) -> DataFrame:
    """(call, receipts, failures, state): state is pending without receipt, error if all failed, duplicate with more than
    one that did not fail, else done."""
    seen = receipts.where(F.col(call).isNotNull()).groupBy(call).agg(F.count("*").alias("receipts"), F.count_if(failed).alias("failures"))
    both = plan.select(call).join(seen, call, "left").fillna(0, ["receipts", "failures"])
    good = F.col("receipts") - F.col("failures")
    state = F.when(F.col("receipts") == 0, "pending").when(good == 0, "error").when(good > 1, "duplicate").otherwise("done")
    return both.select(call, "receipts", "failures", state.alias("state"))


def cumulative(plan: DataFrame, responses: DataFrame, ledger: DataFrame, call: str, payload: str) -> DataFrame:
    """(call, payload, source): every planned call once, with its response, else what the ledger completed, else nothing:
    response, ledger or missing. Of several rows the smallest payload counts; no planned call is dropped."""
    one = lambda df, name: df.where(F.col(call).isNotNull()).groupBy(call).agg(F.min(payload).alias(name), F.lit(True).alias(f"has{name}"))
    both = plan.where(F.col(call).isNotNull()).select(call).distinct().join(one(responses, "_r"), call, "left").join(one(ledger, "_l"), call, "left")
    source = F.when(F.col("has_r"), "response").when(F.col("has_l"), "ledger").otherwise("missing")
    return both.select(call, F.when(F.col("has_r"), F.col("_r")).otherwise(F.col("_l")).alias(payload), source.alias("source"))


def alias_mismatches(target: DataFrame, source: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """(on, mismatch): rows of target that claim a row of source, and what bears it out not: no source, or the fields (by
    name, joined by commas) that differ. Rows whose every field is the same are left out."""
    held = source.select(*on, F.struct(*fields).alias("_s"), F.lit(True).alias("_has"))
    both = target.select(*on, F.struct(*fields).alias("_t")).join(held, on, "left")
    differs = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_t.{f}").eqNullSafe(F.col(f"_s.{f}")), F.lit(f)) for f in fields))), ",")
    return both.select(*on, F.when(F.col("_has").isNull(), "no source").otherwise(differs).alias("mismatch")).where("mismatch != ''")


def orphans(plan: DataFrame, receipts: DataFrame, call: str) -> DataFrame:
    """Receipts of calls that the plan does not have."""
    return receipts.join(plan.select(call), call, "left_anti")


def missing(plan: DataFrame, receipts: DataFrame, call: str, failed: Column, retry: DataFrame | None = None) -> DataFrame:
    """Planned calls without a receipt that did not fail; with retry, only those named there."""
    left = plan.join(receipts.where(~F.coalesce(failed, F.lit(False))).select(call), call, "left_anti")
    return left if retry is None else left.join(retry.select(call), call, "left_semi")


def classify_import(plan: DataFrame, results: DataFrame, call: str, failed: Column, payload: Column) -> DataFrame:
    """(call, results, outcome): what an import of results would do: unknown (not planned), conflict (several payloads),
    failed, repeated (the same payload again), completed."""
    known = plan.select(call).distinct().withColumn("_known", F.lit(True))
    seen = results.where(F.col(call).isNotNull()).groupBy(call).agg(F.count("*").alias("results"), F.count_if(failed).alias("_f"), F.count_distinct(F.when(~failed, payload)).alias("_d"))
    joined = seen.join(known, call, "left")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(F.col("_d") > 1, "conflict").when(F.col("_d") == 0, "failed").when(F.col("results") - F.col("_f") > 1, "repeated").otherwise("completed")
    return joined.select(call, "results", outcome.alias("outcome"))


def merge_by_priority(sources: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """One row per key over several sources with equal columns; earlier sources win, within a source the given order."""
    both = reduce(DataFrame.unionByName, (s.withColumn("_source", F.lit(n)) for n, s in enumerate(sources)))
    return latest(both, key, [F.col("_source"), *order]).withColumnRenamed("_source", "source")


def catalog_conflicts(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, rows, versions): keys that come with several contents; identical repeats are no conflict."""
    seen = rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(content).alias("versions"))
    return seen.where("versions > 1")
