"""Order-dependent columns over groups of any size.

Rows are laid out in ranges of (key, order), so a group that holds most of the rows is spread over many ranges. What a
row needs from the rows before it is taken from its own range, and, for what lies before that, from one carried row per
key and range. Rows that are equal in key and order stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.runtime import cut


class Ordered:
    """df in the order of some columns within keys; add() columns one after the other, then rows()."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str]) -> None:
        self.columns, self.key, self.order = df.columns, key, order
        laid = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in [*key, *order]))
        self.df = cut(laid.withColumn("_pid", F.spark_partition_id()))
        self.inside = Window.partitionBy(*key, "_pid").orderBy(*(F.col(c).asc_nulls_first() for c in order))

    def _carried(self, made: DataFrame, aggregate: Column, over, kind) -> DataFrame:
        per = made.groupBy(*self.key, "_pid").agg(aggregate.alias("__v"))
        return per.select(*self.key, "_pid", kind(F.col("__v")).over(over).alias("__c"))

    def _join(self, made: DataFrame, carried: DataFrame) -> DataFrame:
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*self.key, "_pid"]]
        return made.alias("l").join(carried.alias("r"), on, "left").select("l.*", "r.__c")

    def total(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """Running sum of value."""
        frame = self.inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        made = self.df.withColumn("__x", value).withColumn("__in", F.coalesce(F.sum("__x").over(frame), F.lit(0)))
        before = Window.partitionBy(*self.key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        carried = self._carried(made, F.sum("__x"), before, F.sum)
        self.df = self._join(made, carried).withColumn(name, F.col("__in") + F.coalesce("__c", F.lit(0))).drop("__x", "__in", "__c")
        return self

    def number(self, name: str) -> Ordered:
        """Row number from 1."""
        return self.total(name, F.lit(1).cast("bigint"))

    def largest_before(self, name: str, value: Column) -> Ordered:
        """Largest value of the rows before; null for the first."""
        made = self.df.withColumn("__x", value).withColumn("__in", F.max("__x").over(self.inside.rowsBetween(Window.unboundedPreceding, -1)))
        before = Window.partitionBy(*self.key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        carried = self._carried(made, F.max("__x"), before, F.max)
        self.df = self._join(made, carried).withColumn(name, F.greatest("__in", "__c")).drop("__x", "__in", "__c")
        return self

    def last_seen(self, name: str, value: Column) -> Ordered:
        """The last value that is not null, up to and with the row."""
        made = self.df.withColumn("__x", value).withColumn("__in", F.last("__x", ignorenulls=True).over(self.inside.rowsBetween(Window.unboundedPreceding, 0)))
        made = made.withColumn("__n", F.row_number().over(self.inside))
        before = Window.partitionBy(*self.key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        carried = self._carried(made, F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col("__n"))), before, lambda c: F.last(c, ignorenulls=True))
        self.df = self._join(made, carried).withColumn(name, F.coalesce("__in", "__c")).drop("__x", "__in", "__n", "__c")
        return self

    def neighbour(self, name: str, value: Column, ahead: bool = False) -> Ordered:
        """Value of the row before (or after, ahead) in a struct, null at the end of the group."""
        step = F.lead if ahead else F.lag
        made = self.df.withColumn("__x", F.struct(value.alias("v"))).withColumn("__n", F.row_number().over(self.inside)).withColumn("__in", step("__x").over(self.inside))
        pids = Window.partitionBy(*self.key).orderBy("_pid")
        pick = F.min_by("__x", "__n") if ahead else F.max_by("__x", "__n")
        carried = self._carried(made, pick, pids, step)
        self.df = self._join(made, carried).withColumn(name, F.coalesce("__in", "__c")).drop("__x", "__in", "__n", "__c")
        return self

    def rows(self) -> DataFrame:
        """The rows with the columns added."""
        return self.df.drop("_pid")
