"""Columns and reading order of pages, from boxes and lines with coordinates; y grows upwards.

Everything is relational on rows of numbers, so a page of any size is spread over tasks like any other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.intervals import merged
from casemill.operators.ordered import Ordered


def gutters(boxes: DataFrame, page: str, row: str, x0: str, x1: str, low: int, high: int, width: int, support: float, doubtful: float, least: int) -> DataFrame:
    """(page, rows, position, share, state): the leftmost of the positions from low to below high where a band of that width
    is free of ink in most rows of a page.

    A row is free where none of its boxes reaches into the band, on one side of all ink or between boxes. state is columns
    if the share of free rows is at least support and at least so many rows have ink left, and as many right, of the band;
    refused if the share is between doubtful and support; else single. Boxes without width and those with a null in any column are left out.
    """
    known = boxes.where(" and ".join(f"`{c}` is not null" for c in (page, row, x0, x1)))
    ink = merged(known.select(page, row, x0, x1), [page, row], x0, x1)
    edges = ink.groupBy(page, row).agg(F.array_sort(F.collect_list(F.struct(F.col(x0).alias("a"), F.col(x1).alias("b")))).alias("ink"))
    # The free stretches of a row: before, between and after its boxes. A row has no more of them than it has boxes.
    starts = F.concat(F.array(F.lit(float("-inf"))), F.transform("ink", lambda i: i.b.cast("double")))
    ends = F.concat(F.transform("ink", lambda i: i.a.cast("double")), F.array(F.lit(float("inf"))))
    free = edges.select(page, row, F.explode(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("f"))
    first = F.greatest(F.lit(low), F.ceil(F.greatest("f.a", F.lit(float(low)))).cast("int"))
    last = F.least(F.lit(high - 1), F.floor(F.least("f.b", F.lit(float(high + width))) - width).cast("int"))
    at = free.where(first <= last).select(page, row, (F.col("f.a") > float("-inf")).alias("_l"), (F.col("f.b") < float("inf")).alias("_r"), F.explode(F.sequence(first, last)).alias("position"))
    counts = at.groupBy(page, "position").agg(F.count("*").alias("_n"), F.count_if("_l").alias("_l"), F.count_if("_r").alias("_r"))
    best = counts.groupBy(page).agg(F.max(F.struct("_n", (-F.col("position")).alias("_m"), "_l", "_r")).alias("_b"))
    rows = edges.groupBy(page).agg(F.count("*").alias("rows"))
    share = F.coalesce(F.col("_b._n"), F.lit(0)) / F.col("rows")
    enough = F.coalesce((F.col("_b._l") >= least) & (F.col("_b._r") >= least), F.lit(False))
    state = F.when((share >= support) & enough, "columns").when((share >= doubtful) & (share < support), "refused").otherwise("single")
    return rows.join(best, page, "left").select(page, "rows", (-F.col("_b._m")).alias("position"), share.alias("share"), state.alias("state"))


_SIDE = {"full": 0, "left": 1, "right": 2}


def _side(side: str) -> Column:
    order = F.lit(3)
    for name, n in _SIDE.items():
        order = F.when(F.col(side) == name, n).otherwise(order)
    return order


def reading_order(lines: DataFrame, page: str, y: str, side: str) -> DataFrame:
    """lines with block and place: down a page, the left column before the right, between lines of full width, which close
    the block above and open the one that they begin. Lines of equal height on a side keep no order of their own."""
    down = lines.withColumns({"_y": -F.col(y), "_s": _side(side)})
    made = Ordered(down, [page], ["_y", "_s"]).total("block", (F.col(side) == "full").cast("int")).rows()
    return Ordered(made, [page], ["block", "_s", "_y"]).number("place").rows().drop("_y", "_s")


def order_by_bands(lines: DataFrame, cuts: DataFrame, page: str, y: str, side: str, cut: str) -> DataFrame:
    """lines with band, the number of cuts of their page above them, and place: band by band, in a band the left column
    before the right, down each. A cut at the height of a line is not above it."""
    both = lines.withColumns({"_y": -F.col(y), "_k": F.lit(0), "_c": F.lit(0)}).unionByName(cuts.select(page, (-F.col(cut)).alias("_y"), F.lit(1).alias("_k"), F.lit(1).alias("_c")), allowMissingColumns=True)
    counted = Ordered(both, [page], ["_y", "_k"]).total("band", F.col("_c")).rows().where("_k = 0")
    return Ordered(counted.withColumn("_s", _side(side)), [page], ["band", "_s", "_y"]).number("place").rows().drop("_y", "_k", "_c", "_s")


def band_cuts(heads: DataFrame, gaps: DataFrame, left: DataFrame, page: str, head: str, low: str, high: str, y: str, tie: float) -> DataFrame:
    """(page, head, cut, width, rival, state): for each heading the middle of the widest gap between it and the heading above
    that has text of the left column above it. undecided (and no cut) if the next widest is within tie of it.

    heads: page and the top of each heading; gaps: page, low, high; left: page and y of the lines of the left column. A gap
    belongs to the highest heading that is not above its low end. Headings without such a gap have no row.
    """
    top = left.groupBy(page).agg(F.max(y).alias("_top"))
    cutting = gaps.join(top, page).where(F.col("_top") >= F.col(high)).select(page, low, high)
    marks = heads.where(F.col(head).isNotNull()).select(page, F.col(head).alias("_at"), F.col(head).alias("_h"), F.lit(0).alias("_k"))
    both = marks.unionByName(cutting.select(page, F.col(low).alias("_at"), F.lit(1).alias("_k"), low, high), allowMissingColumns=True)
    placed = Ordered(both, [page], ["_at", "_k"]).last_seen(head, F.col("_h")).rows().where(F.col("_k") == 1).where(F.col(head).isNotNull())
    size = (F.col(high) - F.col(low)).alias("w")
    best = placed.groupBy(page, head).agg(F.max(F.struct(size, F.col(low).alias("a"), F.col(high).alias("b"))).alias("_b"), F.sort_array(F.collect_list(size), asc=False).alias("_w"))
    rival = F.get("_w", F.lit(1))
    sure = F.coalesce(F.col("_b.w") - rival > tie, F.lit(True))
    return best.select(page, head, F.when(sure, (F.col("_b.a") + F.col("_b.b")) / 2).alias("cut"), F.col("_b.w").alias("width"), rival.alias("rival"), F.when(sure, "cut").otherwise("undecided").alias("state"))
