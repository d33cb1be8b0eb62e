"""From repeated draws to one answer: modal vote, linear pool, dispersion, completeness.

Groups are the draws of one item; all operators are partial aggregations, so a hot group costs no more than its share.
Null answers or probabilities are the caller's to drop: here they count as values of their own (modal) or are ignored
(means).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.metrics import resampled


def modal(rows: DataFrame, by: list[str], answer: str) -> DataFrame:
    """(by, answer, draws, p, tied): the most frequent answer, of equals the alphabetically first; p its share."""
    counts = rows.groupBy(*by, F.col(answer).alias("_a")).agg(F.count("*").alias("_n"))
    levels = counts.groupBy(*by, "_n").agg(F.count("*").alias("_c"), F.min("_a").alias("_a"))
    best = levels.groupBy(*by).agg(F.max(F.struct("_n", "_c", "_a")).alias("_b"), F.sum(F.col("_n") * F.col("_c")).alias("draws"))
    return best.select(*by, F.col("_b._a").alias(answer), "draws", (F.col("_b._n") / F.col("draws")).alias("p"), (F.col("_b._c") > 1).alias("tied"))


def prefix_votes(rows: DataFrame, by: list[str], repeat: str, answer: str, sizes: list[int]) -> DataFrame:
    """modal over the draws with repeat up to k, for each k of sizes."""
    spread = rows.withColumn("k", F.explode(F.array(*(F.lit(int(k)) for k in sizes)))).where(F.col(repeat) <= F.col("k"))
    return modal(spread, ["k", *by], answer)


def linear_pool(rows: DataFrame, by: list[str], answer: str, p: str, positive: str, negative: str) -> DataFrame:
    """(by, draws, pooled, answer, confidence): the mean probability of the positive answer; at one half (within 1e-12)
    the vote decides, and a tied vote is negative."""
    q = F.when(F.col(answer) == positive, F.col(p)).otherwise(1 - F.col(p))
    pooled = rows.groupBy(*by).agg(F.count("*").alias("draws"), F.avg(q).alias("pooled"), F.count_if(F.col(answer) == positive).alias("_pos"))
    vote = F.when(2 * F.col("_pos") > F.col("draws"), positive).otherwise(negative)
    said = F.when(F.abs(F.col("pooled") - 0.5) <= 1e-12, vote).when(F.col("pooled") > 0.5, positive).otherwise(negative)
    return pooled.select(*by, "draws", "pooled", said.alias(answer), F.greatest("pooled", 1 - F.col("pooled")).alias("confidence"))


def dispersion(rows: DataFrame, by: list[str], answer: str, p: str) -> DataFrame:
    """(by, draws, entropy, sd, low, high): entropy of the answers in bits, and spread of the probabilities."""
    counts = rows.groupBy(*by, F.col(answer).alias("_a")).agg(F.count("*").alias("n"))
    # With n draws and counts c: entropy = log2 n - (sum of c log2 c) / n, so no share is needed per answer.
    entropy = counts.groupBy(*by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    spread = rows.groupBy(*by).agg(F.count("*").alias("draws"), F.stddev_pop(p).alias("sd"), F.min(p).alias("low"), F.max(p).alias("high"))
    return spread.join(entropy, by).select(*by, "draws", (F.col("entropy") + 0.0).alias("entropy"), "sd", "low", "high")


def dispersion_means(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, items, draws, disagreement, modal_share, entropy, sd): means over items, each once, of what item_dispersion()
    tells of them."""
    return _means(items.groupBy(*by).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in _SPREAD)), by)


_SPREAD = ["draws", "disagreement", "modal_share", "entropy", "sd"]


def _means(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.select(*by, "items", "draws", *((F.col(c) / F.col("items")).alias(c) for c in _SPREAD[1:]))


def item_dispersion(rows: DataFrame, by: list[str], answer: str, p: str) -> DataFrame:
    """(by, draws, disagreement, modal_share, entropy, sd): of each item's draws, whether their answers differ (0 or 1), the
    share of the most frequent one, their entropy in bits and the spread of the probabilities."""
    counts = rows.groupBy(*by, F.col(answer).alias("_a")).agg(F.count("*").alias("n"))
    shares = counts.groupBy(*by).agg((F.count("*") > 1).cast("int").alias("disagreement"), (F.max("n") / F.sum("n")).alias("modal_share"))
    return dispersion(rows, by, answer, p).join(shares, by).select(*by, *_SPREAD)


def dispersion_draws(items: DataFrame, by: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """dispersion_means() of each draw of clusters."""
    per = items.groupBy(*by, cluster).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in _SPREAD))
    return _means(resampled(per, by, cluster, ["items", *_SPREAD], draws, seed), [*by, "draw"])


def incomplete(rows: DataFrame, by: list[str], repeat: str, expected: int) -> DataFrame:
    """(by, n, reason): groups whose repeats are not exactly 1 to expected: duplicate, unexpected or missing."""
    seen = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(repeat).alias("_d"), F.min(repeat).alias("_low"), F.max(repeat).alias("_high"))
    whole = (F.col("n") == expected) & (F.col("_d") == expected) & (F.col("_low") == 1) & (F.col("_high") == expected)
    reason = F.when(F.col("n") > F.col("_d"), "duplicate").when((F.col("_low") < 1) | (F.col("_high") > expected), "unexpected").otherwise("missing")
    return seen.where(~F.coalesce(whole, F.lit(False))).select(*by, "n", reason.alias("reason"))
