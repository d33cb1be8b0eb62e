"""Accuracy, calibration, discrimination and selective prediction over scored rows.

A scored row has a probability p in [0, 1] and correct, 0 or 1. Everything that ranks by p works on the histogram of
distinct p, and running totals are taken in two steps, over buckets of p and inside them, so no group is gathered into
one task, however many rows or distinct p it has. Rows with a null p or correct are left out by every operator here;
empty groups have no row, undefined metrics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.ordered import Ordered
from casemill.runtime import cut, spread

#: Buckets of p between the two steps of running totals.
BUCKETS = 1024


def usable(rows: DataFrame) -> DataFrame:
    """Rows with p and correct."""
    return rows.where("p is not null and correct is not null")


def histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, n, k): rows and correct rows for each distinct p."""
    return usable(rows).groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("k"))


def running(hist: DataFrame, by: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """hist with c_<value>: totals of value up to and with each p, rising or falling, within by."""
    order = F.col("p").desc() if descending else F.col("p")
    bucket = F.floor(F.col("p") * BUCKETS).cast("int")
    placed = hist.withColumn("_b", bucket)
    sums = placed.groupBy(*by, "_b").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    over = Window.partitionBy(*by).orderBy(F.col("_b").desc() if descending else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_b", *(F.coalesce(F.sum(f"_s_{v}").over(over), F.lit(0)).alias(f"_o_{v}") for v in values))
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = [placed[c].eqNullSafe(before[c]) for c in [*by, "_b"]]
    joined = placed.alias("l").join(before.alias("r"), on)
    kept = [F.col(f"l.{c}") for c in placed.columns]
    return joined.select(*kept, *(F.col(f"r._o_{v}") for v in values)).select(*[c for c in hist.columns], *((F.sum(v).over(inside) + F.col(f"_o_{v}")).alias(f"c_{v}") for v in values))


def means(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, accuracy, brier, mean_p)."""
    return usable(rows).groupBy(*by).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("correct"), 2)).alias("brier"), F.avg("p").alias("mean_p"))


def adaptive_bins(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, min_p, max_p, mean_p, accuracy, gap): bins of about equal mass that never split equal p.

    Of B bins over n rows, bin i ends at the first cumulative count that is at least both round-half-even((i+1)n/B) and
    one past the end before; there may be fewer than B.
    """
    return _bins(cut(running(histogram(rows, by), by, ["n", "k"])), by, bins)


def _bins(curve: DataFrame, by: list[str], bins: int) -> DataFrame:
    if bins < 1 or not by:
        raise ValueError("bins must be 1 or more, and by must name a column")
    # Each distinct p ends at most one bin. It is asked to by every goal that its counts reach first; goals that wait, since
    # an earlier one took their p, go to the next ones: a queue, so the waiting are a running sum less its running minimum.
    totals = curve.groupBy(*by).agg(F.sum("n").alias("_total")).select(*(F.col(c).alias(f"_{c}") for c in by), "_total")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    goal = lambda i: F.bround(F.lit(i + 1) * F.col("_total") / F.lit(float(bins)), 0)
    reached = sum(((goal(i) > F.col("c_n") - F.col("n")) & (goal(i) <= F.col("c_n"))).cast("int") for i in range(bins))
    # A goal of 0 rows waits for the first p.
    early = sum((goal(i) <= 0).cast("int") for i in range(bins))
    asked = curve.join(totals, on).withColumn("_m", reached + F.when(F.col("c_n") == F.col("n"), early).otherwise(0)).select(*curve.columns, "_m")
    queue = Ordered(asked, by, ["p"]).total("_s", F.col("_m") - 1).largest_before("_low", -F.col("_s"))
    waiting = F.col("_s") - F.col("_m") + 1 + F.greatest(F.lit(0), F.coalesce("_low", F.lit(0)))
    ends = queue.total("bin", (waiting + F.col("_m") > 0).cast("int"), inclusive=False).rows()
    out = ends.groupBy(*by, F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.sum(F.col("p") * F.col("n")).alias("_sp"), F.sum("k").alias("_k"))
    return out.select(*by, "bin", "n", "min_p", "max_p", (F.col("_sp") / F.col("n")).alias("mean_p"), (F.col("_k") / F.col("n")).alias("accuracy"), (F.col("_k") / F.col("n") - F.col("_sp") / F.col("n")).alias("gap"))


def ece(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, ece): share-weighted mean of the absolute gaps of the adaptive bins."""
    return _ece(adaptive_bins(rows, by, bins), by)


def _ece(made: DataFrame, by: list[str]) -> DataFrame:
    return made.groupBy(*by).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, auroc): chance that a correct row has a larger p than a wrong one, ties one half; null with one class only."""
    return _auroc(running(histogram(rows, by), by, ["n"]), by)


def _auroc(curve: DataFrame, by: list[str]) -> DataFrame:
    ranked = curve.groupBy(*by).agg(F.sum("k").alias("pos"), F.sum("n").alias("all"), F.sum((F.col("c_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)) * F.col("k")).alias("ranks"))
    pos, neg = F.col("pos").cast("double"), (F.col("all") - F.col("pos")).cast("double")
    return ranked.select(*by, ((F.col("ranks") - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))).alias("auroc"))


def metric_set(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, n, accuracy, brier, mean_p, ece, auroc), all from one histogram of distinct p."""
    return metrics_of(histogram(rows, by), by, bins)


def metrics_of(hist: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """metric_set from a histogram (by, p, n, k)."""
    curve = cut(running(hist, by, ["n", "k"]))
    p, n, k = F.col("p"), F.col("n"), F.col("k")
    total = F.sum(n)
    simple = curve.groupBy(*by).agg(total.alias("n"), (F.sum(k) / total).alias("accuracy"), (F.sum(k * F.pow(1 - p, 2) + (n - k) * F.pow(p, 2)) / total).alias("brier"), (F.sum(n * p) / total).alias("mean_p"))
    out = simple.alias("s")
    for other in (_ece(_bins(curve, by, bins), by), _auroc(curve, by)):
        renamed = other.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in other.columns if c not in by))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        out = out.join(renamed, on, "left").drop(*(f"_{c}" for c in by))
    return out


def case_weighted(rows: DataFrame, by: list[str], case: str) -> DataFrame:
    """(by, cases, accuracy, brier, mean_p): means of the means of cases, so each case counts once."""
    return means(rows, [*by, case]).groupBy(*by).agg(F.count("*").alias("cases"), F.avg("accuracy").alias("accuracy"), F.avg("brier").alias("brier"), F.avg("mean_p").alias("mean_p"))


def by_tag(rows: DataFrame, tags: str, keep: list[str], by: list[str]) -> DataFrame:
    """means for each of the tags in keep; a row counts under each of its tags once."""
    spread = usable(rows).withColumn("tag", F.explode(F.array_distinct(F.array_intersect(F.col(tags), F.array(*map(F.lit, keep))))))
    return means(spread, [*by, "tag"])


def overall_and_by(rows: DataFrame, key: str) -> DataFrame:
    """(scope, key, n, accuracy, brier, mean_p): one row per value of key (scope key) and one over all (scope all)."""
    ok = usable(rows)
    sets = ok.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("_g"), F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("correct"), 2)).alias("brier"), F.avg("p").alias("mean_p"))
    return sets.select(F.when(F.col("_g") == 1, "all").otherwise("key").alias("scope"), key, "n", "accuracy", "brier", "mean_p")


def risk_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, accepted, errors, coverage, risk): for falling thresholds, how many rows have p at or above and how
    many of these are wrong. Equal p enter together; the first point accepts nothing and has null threshold and risk."""
    curve = running(histogram(rows, by).withColumn("w", F.col("n") - F.col("k")), by, ["n", "w"], descending=True)
    total = curve.groupBy(*by).agg(F.sum("n").alias("total"))
    points = curve.join(total, by).select(*by, F.col("p").alias("threshold"), F.col("c_n").alias("accepted"), F.col("c_w").alias("errors"), (F.col("c_n") / F.col("total")).alias("coverage"), (F.col("c_w") / F.col("c_n")).alias("risk"))
    none = F.lit(None).cast("double")
    start = total.select(*by, none.alias("threshold"), F.lit(0).cast("bigint").alias("accepted"), F.lit(0).cast("bigint").alias("errors"), F.lit(0.0).alias("coverage"), none.alias("risk"))
    return start.unionByName(points)


def aurc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, aurc): area under the risk-coverage curve by right steps: each distinct p adds its share of rows times the risk
    at it."""
    curve = running(histogram(rows, by).withColumn("w", F.col("n") - F.col("k")), by, ["n", "w"], descending=True)
    return curve.groupBy(*by).agg((F.sum(F.col("n") * F.col("c_w") / F.col("c_n")) / F.sum("n")).alias("aurc"))


def error_transitions(rows: DataFrame, by: list[str], truth: str, said: str) -> DataFrame:
    """(by, truth, said, threshold, errors): for each kind of error its running count at the thresholds where it grows."""
    wrong = usable(rows).where("correct = 0")
    hist = wrong.groupBy(*by, truth, said, "p").agg(F.count("*").alias("n"))
    curve = running(hist, [*by, truth, said], ["n"], descending=True)
    return curve.select(*by, truth, said, F.col("p").alias("threshold"), F.col("c_n").alias("errors"))


def percentile_interval(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, draws, lo, hi): of n values that are not null, those at the indices floor(0.025(n-1)) and
    round-half-even(0.975(n-1)), counted from 0. The number of draws bounds a group."""
    ok = values.where(F.col(value).isNotNull())
    at = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = ok.select(*by, F.col(value).alias("_v"), (F.row_number().over(at) - 1).alias("_i"), n.alias("_n"))
    lo, hi = F.floor((F.col("_n") - 1) * F.lit(0.025)), F.bround((F.col("_n") - 1) * F.lit(0.975), 0)
    pick = lambda at: F.max(F.when(F.col("_i") == at, F.col("_v")))
    return ranked.groupBy(*by).agg(F.count("*").alias("draws"), pick(lo).alias("lo"), pick(hi).alias("hi"))


#: Chances of at most 0, 1, 2 ... draws of one cluster, Poisson distributed with mean 1, times 2 to the 32.
POISSON = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817)


def resampled(rows: DataFrame, by: list[str], cluster: str, sums: list[str], draws: int, seed: int, within: list[str] | None = None) -> DataFrame:
    """(by, draw, within, sums): the sums over rows, each cluster drawn as often as a hash of seed, cluster and draw says.

    Numbers of draws are Poisson distributed with mean 1, independently for each cluster: the bootstrap for data whose
    clusters no machine can number. A row is multiplied and added up before the shuffle of the draws, which carries no more
    than a row for each (by, draw, within) and task; nothing is broadcast and nothing joined. rows should be summed
    per cluster before. Rows with a null cluster are left out; a draw that takes no cluster has no row. Four draws share a
    hash: draw d takes the hex digits 8 (d mod 4) to 8 (d mod 4) + 8 of md5(seed|cluster|d div 4).
    """
    keys = [*by, "draw", *(within or [])]
    known = rows.where(F.col(cluster).isNotNull())
    # Few rows make many draws: they are spread over all cores first.
    fours = spread(known, *by, cluster, *(within or [])).withColumn("_four", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))))
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cluster).cast("string"), F.col("_four")))
    u = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.substring("_h", 8 * i + 1, 8).alias("u")) for i in range(4))))
    one = fours.withColumn("_h", digits).withColumn("_u", u).withColumn("draw", (F.col("_four") * 4 + F.col("_u.i")).cast("int")).where(F.col("draw") < draws)
    # Eight hex digits stand in the order of their numbers.
    weight = F.lit(len(POISSON))
    for n in reversed(range(len(POISSON))):
        weight = F.when(F.col("_u.u") < f"{POISSON[n]:08x}", n).otherwise(weight)
    return one.withColumn("_w", weight).where("_w > 0").groupBy(*keys).agg(*(F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums))


def cluster_bootstrap(rows: DataFrame, by: list[str], cluster: str, draws: int, seed: int, bins: int = 10) -> DataFrame:
    """(by, draw, n, accuracy, brier, mean_p, ece, auroc): the metrics of each draw of clusters, as resampled() draws
    them, from its weighted histogram of distinct p."""
    per = histogram(rows, [*by, cluster])
    return metrics_of(resampled(per, by, cluster, ["n", "k"], draws, seed, ["p"]), [*by, "draw"], bins)


def intervals(values: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, draws, lo, hi): percentile_interval() of several columns of drawn values."""
    long = values.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("_m")).select(*by, "_m.*")
    return percentile_interval(long, [*by, "metric"], "value")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """df with every double rounded, for comparison between engines."""
    one: dict[str, Column] = {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.withColumns(one) if one else df
