"""Integrity gates: checks as DataFrames of violations, collected as counts, refusing once for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailure(RuntimeError):
    """Raised with the names and counts of all gates that found violations."""


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def not_in(df: DataFrame, key: list[str], other: DataFrame) -> DataFrame:
    """Rows of df whose key the other table lacks; rows with a null key refer to nothing and pass."""
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    return df.where(present).join(other.select(*key).distinct(), key, "left_anti")


def check(df: DataFrame, holds: Column) -> DataFrame:
    """Rows for which a condition is false; unknown passes, as in SQL."""
    return df.where(~F.coalesce(holds, F.lit(True)))


def asymmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges without their reverse."""
    back = edges.select(F.col(b).alias(a), F.col(a).alias(b)).distinct()
    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(back, [a, b], "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): what only one of two sets has; left_only or right_only."""
    l, r = left.select(*key).distinct(), right.select(*key).distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left_only")).unionByName(r.exceptAll(l).withColumn("side", F.lit("right_only")))


def report(gates: dict[str, DataFrame]) -> DataFrame:
    """(gate, violations): one row per gate, also for those that found nothing."""
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations") for name, df in gates.items()]
    return reduce(DataFrame.unionByName, counts)


def enforce(gates: dict[str, DataFrame]) -> None:
    """Raises once if any gate found a violation."""
    bad = [(r.gate, r.violations) for r in report(gates).collect() if r.violations]
    if bad:
        raise GateFailure(", ".join(f"{g}: {n}" for g, n in bad))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): how often each column has each value, nulls included."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, column: str, decided: list[str]) -> DataFrame:
    """(value, n, decided): the distinct values of a slot, and whether somebody has decided what they mean."""
    value = F.lower(F.trim(F.col(column)))
    return df.where(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("decided", F.col("value").isin(*decided))


def accounting(candidates: DataFrame, kept: DataFrame, excluded: DataFrame, key: list[str]) -> DataFrame:
    """(key, fate): each candidate is kept, excluded, both (a contradiction) or lost."""
    k = kept.select(*key).distinct().withColumn("_k", F.lit(True))
    e = excluded.select(*key).distinct().withColumn("_e", F.lit(True))
    both = candidates.select(*key).distinct().join(k, key, "left").join(e, key, "left")
    fate = F.when(F.col("_k") & F.col("_e"), "both").when(F.col("_k"), "kept").when(F.col("_e"), "excluded").otherwise("lost")
    return both.select(*key, fate.alias("fate"))
