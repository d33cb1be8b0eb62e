"""Deterministic orders: seeded keys, round-robin ranks, prefixes, samples, boards, paired comparisons.

Global ranks are taken in two steps, counting by the leading key first, so no task ever sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.metrics import resampled


def seeded_key(seed: int, namespace: str, *values: Column | str) -> Column:
    """Order key that shuffles values the same way in every engine: md5 of seed, namespace and the values."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(namespace), *values))


def hash_split(key: Column | str, seed: int, train: float = 0.6, dev: float = 0.8) -> Column:
    """train, dev or test by the first 32 bits of a hash of the group key, cumulative shares train and dev."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.when(u < train, "train").when(u < dev, "dev").otherwise("test")


def content_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of the sha256 of the parts, a line each; null parts are left out."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def round_robin(items: DataFrame, case: str, item: str, seed: int, first: Column | None = None) -> DataFrame:
    """items with depth and rank: every case gives one item before any gives a second. Order in a case and between cases
    follows seeded keys, ties the ids; in a case what holds first, such as items with a partner, comes
    before. A case's items are numbered inside the case; rank adds the sizes of the levels of depth before, and numbers
    inside a level by ranges of the case's key."""
    keyed = items.withColumn("_k", seeded_key(seed, "item", F.col(item).cast("string")))
    if first is not None:
        keyed = keyed.withColumn("_k", F.concat(F.when(first, "0").otherwise("1"), "_k"))
    deep = _hashed_numbers(keyed, case, [F.col("_k"), F.col(item)], "depth")
    deep = deep.withColumn("_k", seeded_key(seed, "case", F.coalesce(F.col(case).cast("string"), F.lit(""))))
    return _level_ranks(deep, "depth", [F.col("_k"), F.col(case), F.col(item)], "rank").drop("_k")


def _hashed_numbers(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """df with row numbers within by in the order of the hex key _k: its first two digits cut a group into 256 parts."""
    parts = df.withColumn("_r", F.substring("_k", 1, 2))
    sizes = parts.groupBy(by, "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(F.col(by).alias("_by"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbered = parts.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_r").orderBy(*order)))
    joined = numbered.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") == F.col("_q")))
    return joined.withColumn(name, (F.col("_i") + F.col("_o")).cast("int")).select(*df.columns, name)


def _level_ranks(df: DataFrame, level: str, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """df with a rank by (level, _k, ...): _k is a hex key, whose first three digits cut a level into 4096 ranges."""
    within = within or []
    cutted = df.withColumn("_r", F.substring("_k", 1, 3))
    sizes = cutted.groupBy(*within, level, "_r").agg(F.count("*").alias("_n"))
    levels = sizes.groupBy(*within, level).agg(F.sum("_n").alias("_l"))
    before_level = Window.partitionBy(*within).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(*within, level, F.coalesce(F.sum("_l").over(before_level), F.lit(0)).alias("_o1"))
    before_range = Window.partitionBy(*within, level).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.select(*within, level, "_r", F.coalesce(F.sum("_n").over(before_range), F.lit(0)).alias("_o2"))
    inside = Window.partitionBy(*within, level, "_r").orderBy(*order)
    numbered = cutted.withColumn("_i", F.row_number().over(inside))
    joined = numbered.join(ranges, [*within, level, "_r"]).join(levels, [*within, level])
    return joined.withColumn(name, (F.col("_i") + F.col("_o1") + F.col("_o2")).cast("bigint")).select(*[c for c in df.columns], name)


def prefix(ranked: DataFrame, rank: str, size: int, keep: Column | None = None) -> DataFrame:
    """The first size ranks, and whatever keep holds for. Ranks come before the filter, so they do not shift."""
    chosen = F.col(rank) <= size
    return ranked.where(chosen if keep is None else chosen | F.coalesce(keep, F.lit(False)))


def stratified_sample(items: DataFrame, stratum: str, item: str, size: int, seed: int) -> DataFrame:
    """size items: round robin over the strata, the largest first, in each stratum by seeded key. A limit is the feature."""
    sizes = items.groupBy(stratum).agg(F.count("*").alias("_size"))
    key = seeded_key(seed, "sample", F.col(item).cast("string"))
    inside = Window.partitionBy(stratum).orderBy(key, F.col(item))
    ranked = items.withColumn("_k", key).withColumn("_pass", F.row_number().over(inside)).where(F.col("_pass") <= size)
    joined = ranked.join(sizes, ranked[stratum].eqNullSafe(sizes[stratum])).drop(sizes[stratum])
    return joined.orderBy("_pass", F.col("_size").desc(), "_k", F.col(item)).limit(size).drop("_k", "_pass", "_size")


def largest_run(rows: DataFrame, key: str, run: str, newest: str) -> DataFrame:
    """(key, run, n, latest): for each key the run with most rows, of equals the one with the newest row."""
    runs = rows.groupBy(key, run).agg(F.count("*").alias("n"), F.max(newest).alias("latest"))
    best = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("latest").desc(), F.col(run))
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def contiguous(rows: DataFrame, group: list[str], rank: str) -> DataFrame:
    """(group, n, top, contiguous): whether the ranks of a group are exactly 1 to their largest."""
    seen = rows.groupBy(*group).agg(F.count_distinct(rank).alias("n"), F.max(rank).alias("top"), F.min(rank).alias("_low"))
    return seen.select(*group, "n", "top", ((F.col("n") == F.col("top")) & (F.col("_low") == 1)).alias("contiguous"))


def common_prefix_board(rows: DataFrame, board: str, entry: str, repeat: str) -> DataFrame:
    """(board, place, entry, k, n, accuracy, brier): entries of a board compared over the repeats that all of them reach, in
    the order of their Brier score (to nine digits; nulls last), then name."""
    ok = rows.where("p is not null and correct is not null")
    horizon = ok.groupBy(board, entry).agg(F.max(repeat).alias("h")).groupBy(board).agg(F.min("h").alias("k"))
    inside = ok.join(horizon, board).where(F.col(repeat) <= F.col("k"))
    entries = inside.groupBy(board, entry, "k").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("correct"), 2)).alias("brier"))
    place = F.row_number().over(Window.partitionBy(board).orderBy(F.round("brier", 9).asc_nulls_last(), entry))
    return entries.select(board, place.alias("place"), entry, "k", "n", "accuracy", "brier")


def paired_deltas(pairs: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """(by, pairs, answer_changes, accuracy_delta, brier_delta, mean_p_delta): mean differences, left less right; both are
    structs of answer, correct and p."""
    loss = lambda s: F.pow(F.col(f"{s}.p") - F.col(f"{s}.correct"), 2)
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col(f"{left}.answer") != F.col(f"{right}.answer")).alias("answer_changes"), F.avg(F.col(f"{left}.correct") - F.col(f"{right}.correct")).alias("accuracy_delta"), F.avg(loss(left) - loss(right)).alias("brier_delta"), F.avg(F.col(f"{left}.p") - F.col(f"{right}.p")).alias("mean_p_delta"))


def paired_delta_draws(pairs: DataFrame, left: str, right: str, by: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """(by, draw, accuracy_delta, brier_delta, mean_p_delta): paired_deltas() of each draw of clusters. A pair has one
    cluster, so it never crosses two."""
    side = lambda c: F.col(f"{left}.{c}") - F.col(f"{right}.{c}")
    loss = lambda s: F.pow(F.col(f"{s}.p") - F.col(f"{s}.correct"), 2)
    per = pairs.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum(side("correct")).alias("accuracy_delta"), F.sum(loss(left) - loss(right)).alias("brier_delta"), F.sum(side("p")).alias("mean_p_delta"))
    names = ["accuracy_delta", "brier_delta", "mean_p_delta"]
    return resampled(per, by, cluster, ["n", *names], draws, seed).select(*by, "draw", *((F.col(c) / F.col("n")).alias(c) for c in names))


def drops(planned: DataFrame, complete: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, planned, complete, dropped): how many planned rows have a complete one."""
    both = planned.join(complete.withColumn("_ok", F.lit(1)), keys, "left")
    return both.groupBy(*by).agg(F.count("*").alias("planned"), F.count("_ok").alias("complete")).withColumn("dropped", F.col("planned") - F.col("complete"))
