"""Deferring to a reader at a cost: levels, budgets, implied confidence, switch points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators import metrics
from casemill.operators.metrics import usable
from casemill.operators.ordered import Ordered
from casemill.runtime import arrow_safe

#: How far outside its levels a switch point is put at most, and the range it never leaves.
MARGIN, LOWEST, HIGHEST = 0.02, 0.001, 0.999
#: Weight of the penalty on both coefficients of a fitted curve, and the gradient at which a fit is done.
RIDGE, FLAT = 1e-6, 1e-9


def levels(rows: DataFrame, costs: list[int], loss: int, by: list[str]) -> DataFrame:
    """(by, cost, n, deferral_rate, accuracy_answered, accuracy_deferred, mean_loss): each row defers at a cost below the
    loss it expects, (1 - p) loss. The accuracy of an empty side is null."""
    spread = usable(rows).withColumn("cost", F.explode(F.array(*map(F.lit, costs)))).withColumn("deferred", (1 - F.col("p")) * loss > F.col("cost"))
    paid = F.when(F.col("deferred"), F.col("cost")).otherwise((1 - F.col("correct")) * loss)
    return spread.groupBy(*by, "cost").agg(F.count("*").alias("n"), F.avg(F.col("deferred").cast("int")).alias("deferral_rate"), F.avg(F.when(~F.col("deferred"), F.col("correct"))).alias("accuracy_answered"), F.avg(F.when(F.col("deferred"), F.col("correct"))).alias("accuracy_deferred"), F.avg(paid).alias("mean_loss"))


def level_intervals(rows: DataFrame, costs: list[int], loss: int, by: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """(by, cost, metric, draws, lo, hi): intervals of deferral_rate and mean_loss at each cost, clusters resampled."""
    spread = usable(rows).withColumn("cost", F.explode(F.array(*map(F.lit, costs)))).withColumn("_d", ((1 - F.col("p")) * loss > F.col("cost")).cast("bigint"))
    paid = F.when(F.col("_d") == 1, F.col("cost")).otherwise((1 - F.col("correct")) * loss).cast("bigint")
    per = spread.groupBy(*by, "cost", cluster).agg(F.count("*").alias("n"), F.sum("_d").alias("_d"), F.sum(paid).alias("_l"))
    drawn = metrics.resampled(per, [*by, "cost"], cluster, ["n", "_d", "_l"], draws, seed)
    return metrics.intervals(drawn.select(*by, "cost", (F.col("_d") / F.col("n")).alias("deferral_rate"), (F.col("_l") / F.col("n")).alias("mean_loss")), [*by, "cost"], ["deferral_rate", "mean_loss"])


def _budgets(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """(by, n, caught, wrong): for each budget n the wrong rows among the n least confident, ties in the order of tie, and
    all of them; no budget is among them, as n = 0. No group is gathered into one task."""
    ok = usable(rows).select(*by, "p", F.col(tie).alias("_t"), (1 - F.col("correct")).cast("bigint").alias("_w"))
    wrong = ok.groupBy(*by).agg(F.sum("_w").alias("wrong"))
    ranked = Ordered(ok, by, ["p", "_t"]).number("n").total("caught", F.col("_w")).rows()
    nothing = wrong.select(*by, F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("caught"), "wrong")
    sums = wrong.select(*(F.col(c).alias(f"_{c}") for c in by), "wrong")
    return ranked.join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).select(*by, "n", "caught", "wrong").unionByName(nothing)


def _lost(cost: Column, loss: float) -> Column:
    return F.col("n") * cost + F.lit(float(loss)) * (F.col("wrong") - F.col("caught"))


def budget_curve(rows: DataFrame, by: list[str], loss: float, cost: float, tie: str) -> DataFrame:
    """(by, n, loss): the loss if the n least confident rows are deferred, ties in the order of tie; a row for each n from 1."""
    return _budgets(rows, by, tie).where("n > 0").select(*by, "n", _lost(F.lit(float(cost)), loss).alias("loss"))


def optimal_budget(rows: DataFrame, by: list[str], loss: float, costs: list[int], tie: str) -> DataFrame:
    """(by, cost, best_loss): the least loss over all budgets, none included."""
    spread = _budgets(rows, by, tie).withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    return spread.groupBy(*by, "cost").agg(F.min(_lost(F.col("cost"), loss)).alias("best_loss"))


def budget_comparison(rows: DataFrame, by: list[str], loss: int, costs: list[int], tie: str) -> DataFrame:
    """(by, cost, n, deferred, own_loss, matched_loss, always_loss, best_loss): mean losses of a row at each cost, if it
    defers by what it expects, if as many of the least confident rows are deferred, if none is, and at best."""
    own = levels(rows, costs, loss, by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("cost").alias("_cost"), F.col("n").alias("rows"), F.round(F.col("deferral_rate") * F.col("n")).cast("bigint").alias("deferred"), F.col("mean_loss").alias("own_loss"))
    spread = _budgets(rows, by, tie).withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    both = spread.join(own, [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("cost") == F.col("_cost")])
    lost = _lost(F.col("cost"), loss) / F.col("rows")
    out = both.groupBy(*by, "cost").agg(F.first("rows").alias("n"), F.first("deferred").alias("deferred"), F.first("own_loss").alias("own_loss"), F.max(F.when(F.col("n") == F.col("deferred"), lost)).alias("matched_loss"), F.max(F.when(F.col("n") == 0, lost)).alias("always_loss"), F.min(lost).alias("best_loss"))
    return out


def midpoints(costs: list[int], loss: int) -> list[float]:
    """The middle of the confidence that deferring at k costs of a grid, k = 0 first, leaves open, to six digits."""
    bounds = [1.0, *(1 - c / loss for c in sorted(costs)), 0.0]
    return [round((a + b) / 2, 6) for a, b in zip(bounds, bounds[1:], strict=False)]


def board_metrics(rows: DataFrame, by: list[str], item: list[str], costs: list[int], loss: int, answer: str, label: str) -> DataFrame:
    """(by, n, accuracy, brier, ece, auroc, aurc) of items, whose p is the middle of the confidence that they imply by
    deferring at some of the costs, and whose answer is the most frequent one of their rows. An item whose most frequent
    answer has not more than half of its rows has none and is left out. ECE is taken over the items of equal p."""
    votes = usable(rows).where(F.col(answer).isNotNull()).groupBy(*by, *item, answer).agg(F.count("*").alias("_v"), F.sum(1 - F.col("p")).alias("_doubt"), F.max(label).alias("_label"))
    each = votes.groupBy(*by, *item).agg(F.max_by(answer, "_v").alias("_a"), F.max("_v").alias("_top"), F.sum("_v").alias("_n"), F.sum("_doubt").alias("_doubt"), F.max("_label").alias("_label")).where("_top * 2 > _n")
    doubt = F.round(F.col("_doubt") / F.col("_n") * loss, 9)
    deferred = sum((F.lit(c) < doubt).cast("int") for c in sorted(costs))
    scored = each.select(*by, F.get(F.array(*map(F.lit, midpoints(costs, loss))), deferred).alias("p"), (F.col("_a") == F.col("_label")).cast("int").alias("correct"))
    hist = metrics.histogram(scored, by)
    n, k, p = F.col("n"), F.col("k"), F.col("p")
    simple = hist.groupBy(*by).agg(F.sum(n).alias("n"), (F.sum(k) / F.sum(n)).alias("accuracy"), (F.sum(k * F.pow(1 - p, 2) + (n - k) * F.pow(p, 2)) / F.sum(n)).alias("brier"), (F.sum(F.abs(k - n * p)) / F.sum(n)).alias("ece"))
    return simple.join(metrics.auroc(scored, by), by).join(metrics.aurc(scored, by), by)


def implied_bins(rows: DataFrame, item: list[str], costs: list[int], loss: int) -> DataFrame:
    """(bin, n, low, high): items by the number of cost levels below the loss that their mean p expects, and the interval
    of confidence that this number implies; empty bins are listed with 0. Costs are sorted; a negative cost or a single
    level implies nothing and gives no rows."""
    grid = sorted(costs)
    spark = rows.sparkSession
    if len(grid) < 2 or grid[0] < 0:
        return spark.createDataFrame([], "bin int, n bigint, low double, high double")
    edges = [0, *grid, loss]
    bins = spark.createDataFrame([(k, 1 - edges[k + 1] / loss, 1 - edges[k] / loss) for k in range(len(grid) + 1)], "bin int, low double, high double")
    doubt = usable(rows).groupBy(*item).agg((F.avg(1 - F.col("p")) * loss).alias("d"))
    placed = doubt.select(sum((F.lit(c) < F.round("d", 9)).cast("int") for c in grid).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(placed, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "low", "high")


def monotone_patterns(rows: DataFrame, item: list[str], level: str, choice: str, tie: str) -> DataFrame:
    """(item, levels, falls, monotone): how often a 0/1 choice falls from one level to the next, equal levels in the order
    of tie. Null levels are left out."""
    step = Ordered(usable(rows).where(F.col(level).isNotNull()).select(*item, level, tie, choice), item, [level, tie]).neighbour("_before", F.col(choice)).rows()
    return step.groupBy(*item).agg(F.count("*").alias("levels"), F.count_if(F.col("_before.v") > F.col(choice)).alias("falls")).withColumn("monotone", F.col("falls") == 0)


def logistic_curves(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """(intercept, slope) of the logistic curve of the share of ones over x, fitted to each row of counts by penalised
    maximum likelihood; all rows take their Newton steps together, each halved until its likelihood does not fall."""
    design = np.stack([np.ones_like(x), x], axis=2)
    n = zeros + ones

    def value(beta: np.ndarray) -> np.ndarray:
        line = np.einsum("ilk,ik->il", design, beta)
        return (ones * line - n * np.logaddexp(0, line)).sum(axis=1) - RIDGE / 2 * (beta**2).sum(axis=1)

    beta = np.zeros((len(x), 2))
    for _ in range(100):
        share = 0.5 * (1 + np.tanh(np.einsum("ilk,ik->il", design, beta) / 2))
        slope = np.einsum("ilk,il->ik", design, ones - n * share) - RIDGE * beta
        if np.abs(slope).max(initial=0) < FLAT:
            break
        bend = np.einsum("ilk,il,ilm->ikm", design, n * share * (1 - share), design) + RIDGE * np.eye(2)
        step, here = np.linalg.solve(bend, slope[:, :, None])[:, :, 0], value(beta)
        for _ in range(30):
            worse = value(beta + step) < here - 1e-12
            if not worse.any():
                break
            step[worse] /= 2
        beta = beta + step
    return beta


def switch_points(rows: DataFrame, item: list[str], level: str, choice: str) -> DataFrame:
    """(item, point, method, monotone): the level in [0, 1] at which the 0/1 choices of an item turn from 0 to 1.

    If they turn once: midpoint, the middle of the neighbours; all ones: cap_low, all zeros: cap_high, MARGIN outside the
    levels of the item. If they turn to and fro, logistic, where a fitted curve crosses one half, at most MARGIN outside the
    levels; without a rising curve, count_midpoint, where as many zeros would turn once. Choices are counted per level
    first, so an item has no more entries than there are levels. Null levels and choices are left out.
    """
    counts = usable(rows).where(F.col(level).isNotNull()).groupBy(*item, F.col(level).cast("double").alias("x")).agg(F.count_if(F.col(choice) == 0).alias("z"), F.count_if(F.col(choice) == 1).alias("o"))
    grid = F.array_sort(F.collect_list(F.struct("x", "z", "o")))
    per = counts.groupBy(*item).agg(grid.alias("g"), F.sum("z").alias("zeros"), F.sum("o").alias("ones"), F.min(F.when(F.col("o") > 0, F.col("x"))).alias("first_one"), F.max(F.when(F.col("z") > 0, F.col("x"))).alias("last_zero"), F.min("x").alias("least"), F.max("x").alias("most"))
    # The levels of the last of as many zeros, and of the choice after them, in the order of levels.
    at = lambda k: F.aggregate("g", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("x")), lambda acc, e: F.struct((acc.n + e.z + e.o).alias("n"), F.coalesce(acc.x, F.when(acc.n + e.z + e.o >= k, e.x)).alias("x"))).x
    low, high = F.greatest(F.lit(LOWEST), F.col("least") - MARGIN), F.least(F.lit(HIGHEST), F.col("most") + MARGIN)
    turned = (at(F.col("zeros")) + at(F.col("zeros") + 1)) / 2
    per = per.withColumns({"monotone": F.coalesce(F.col("last_zero") <= F.col("first_one"), F.lit(True)), "low": low, "high": high}).withColumn("count", F.when(F.col("zeros") == 0, F.col("low")).when(F.col("ones") == 0, F.col("high")).otherwise(turned))
    kind = F.when(F.col("zeros") == 0, "cap_low").when(F.col("ones") == 0, "cap_high").otherwise("midpoint")
    once = per.where("monotone").select(*item, F.col("count").alias("point"), kind.alias("method"), "monotone")
    kinds = ", ".join(f"{c} {per.schema[c].dataType.simpleString()}" for c in item)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            widest = max(map(len, b.g), default=0)
            x, z, o = (np.array([[e[c] for e in g] + [0] * (widest - len(g)) for g in b.g], float).reshape(len(b), widest) for c in "xzo")
            a, s = logistic_curves(x, z, o).T
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = np.clip(-a / s, b.low, b.high)
            rises = s > 1e-9
            yield b[item].assign(point=np.where(rises, cross, b["count"]), method=np.where(rises, "logistic", "count_midpoint").astype(object), monotone=False)

    return once.unionByName(per.where("not monotone").mapInPandas(arrow_safe(fit), f"{kinds}, point double, method string, monotone boolean"))
