"""Exact duplicates: classes of equal rows and equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """(item, keeper, n): for each item the smallest item with the same key, which stands for all, and how many there are.
    The members of a group are never gathered. Keys compare null-safe; null items are left out, repeated ones count once."""
    own = rows.where(F.col(item).isNotNull()).select(item, *key).distinct()
    groups = own.groupBy(*key).agg(F.min(item).alias("keeper"), F.count("*").alias("n"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return own.alias("l").join(groups.alias("r"), on).select(F.col(f"l.{item}").alias(item), "r.keeper", "r.n")


def classes(rows: DataFrame, item: str, text: str) -> DataFrame:
    """(item, class, copies): each text's class of exact copies, named by its smallest item. Only digests and counts are
    shuffled, and the members of a class are never gathered. Null items and null texts are left out."""
    digest = rows.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item), F.md5(text).alias("_d"), F.length(text).alias("_n"))
    sizes = digest.groupBy("_d", "_n").agg(F.min(item).alias("class"), F.count("*").alias("copies"))
    return digest.join(sizes, ["_d", "_n"]).select(item, "class", "copies")
