"""Positions and intervals: as-of attribution, containment, gaps, clusters on a line.

Everything that depends on order goes through Ordered, so a group (a document, a user) may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.ordered import Ordered


def asof_last(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, name: str) -> DataFrame:
    """left with name: the value of the last row of right in the same group at or before the position of the row. One sort
    of the union instead of a range join. Of right rows at one position the greatest value counts; null positions match
    nothing, and right rows with a null value are no marks."""
    marks = right.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*key, at).agg(F.max(value).alias("_mark")).withColumn("_late", F.lit(0))
    rows = left.withColumn("_late", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = Ordered(both, key, [at, "_late"]).last_seen("_seen", F.col("_mark")).rows()
    return seen.where("_late = 1").withColumn(name, F.when(F.col(at).isNotNull(), F.col("_seen"))).drop("_late", "_mark", "_seen")


def spans_from_starts(rows: DataFrame, key: list[str], start: str, end: Column | None = None) -> DataFrame:
    """(key, start, next): the intervals from each distinct start to the next, the last one to end (null if open)."""
    starts = rows.where(F.col(start).isNotNull()).select(*key, start).distinct()
    following = Ordered(starts, key, [start]).neighbour("next", F.col(start), ahead=True).rows()
    return following.withColumn("next", F.col("next.v") if end is None else F.coalesce("next.v", end))


def in_any_span(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, slot: int) -> DataFrame:
    """points that lie in a span [start, end) of their group, once each. Spans are cut into slots of the given width, so
    the join is on equal slots; a slot that is hot is split by the adaptive planner."""
    wide = spans.where(F.col(end) > F.col(start)).select(*key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    wide = wide.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_s") / slot), F.floor((F.col("_e") - 1) / slot))))
    placed = points.withColumn("_slot", F.floor(F.col(at) / slot))
    on = [placed[c] == wide[c] for c in [*key, "_slot"]] + [placed[at] >= wide["_s"], placed[at] < wide["_e"]]
    return placed.join(wide, on, "left_semi").drop("_slot")


def clusters(rows: DataFrame, key: list[str], at: str, gap: float | int) -> DataFrame:
    """rows with cluster, from 1: a new one begins where a position is more than gap after the one before."""
    near = F.coalesce(F.col(at) - F.col("_before.v") <= gap, F.lit(False))
    # Equal positions belong together, so it is distinct positions that are numbered.
    spots = rows.select(*key, at).distinct()
    made = Ordered(spots, key, [at]).neighbour("_before", F.col(at)).total("cluster", F.when(near, 0).otherwise(1).cast("bigint")).rows().drop("_before")
    left, right = rows.alias("l"), made.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*key, at]]
    return left.join(right, on).select("l.*", "r.cluster")


def merged(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end): the union of intervals, overlapping and touching ones as one."""
    distinct = spans.where(F.col(end) > F.col(start)).groupBy(*key, start).agg(F.max(end).alias(end))
    fresh = F.when(F.col(start) <= F.col("_before"), 0).otherwise(1)
    made = Ordered(distinct, key, [start]).largest_before("_before", F.col(end)).total("_g", fresh).rows()
    return made.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def gaps(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end): what the union of intervals leaves out between its first start and last end."""
    made = Ordered(merged(spans, key, start, end), key, [start]).neighbour("_n", F.col(start), ahead=True).rows()
    return made.where("_n is not null").select(*key, F.col(end).alias(start), F.col("_n.v").alias(end))


def runs(rows: DataFrame, key: list[str], order_by: list[str], value: str) -> DataFrame:
    """(key, value, first, length): maximal runs of equal neighbouring values; nulls equal each other. first counts from 1."""
    same = F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(F.col(value))
    made = Ordered(rows, key, order_by).neighbour("_before", F.col(value)).number("_i").total("_g", F.when(same, 0).otherwise(1)).rows()
    return made.groupBy(*key, "_g", value).agg(F.min("_i").alias("first"), F.count("*").alias("length")).drop("_g")


def offsets(rows: DataFrame, key: list[str], order_by: list[str], size: Column, separator: int = 1) -> DataFrame:
    """rows with start and end: where each piece stands when the pieces of a group are put one after the other."""
    made = Ordered(rows, key, order_by).total("start", (size + separator).cast("bigint"), inclusive=False).rows()
    return made.withColumn("start", F.col("start").cast("bigint")).withColumn("end", (F.col("start") + size).cast("bigint"))
