"""Call plans and payloads: content-addressed plans, identity of repeats, waves, parsed answers, changes, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_plan(items: DataFrame, item: str, keep: list[str], repeats: int, protocols: list[str], seed: int) -> DataFrame:
    """(item, keep, protocol, repeat_index, call_id): every item under every protocol, so many times; the id is made of what
    is asked, so a longer plan begins with the shorter one. Null items are left out."""
    spread = items.where(F.col(item).isNotNull()).select(item, *keep, F.explode(F.array(*map(F.lit, protocols))).alias("protocol")).withColumn("repeat_index", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return spread.withColumn("call_id", F.substring(F.sha2(F.concat_ws("\n", F.lit(str(seed)), item, "protocol", F.col("repeat_index").cast("string")), 256), 1, 24))


def repeat_identity(rows: DataFrame, by: list[str], repeat: str, content: Column) -> DataFrame:
    """(by, n, versions, repeats): groups whose repeats do not all ask the same."""
    seen = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(content).alias("versions"), F.count_distinct(repeat).alias("repeats"))
    return seen.where("versions > 1")


def waves(ranked: DataFrame, rank: str, bounds: list[int], size: Column) -> DataFrame:
    """(wave, n, size): ranks cut at the given bounds, from 1, with the summed size of each wave."""
    wave = F.lit(len(bounds) + 1)
    for k in range(len(bounds), 0, -1):
        wave = F.when(F.col(rank) <= bounds[k - 1], k).otherwise(wave)
    return ranked.groupBy(wave.alias("wave")).agg(F.count("*").alias("n"), F.sum(size).alias("size"))


def parsed(rows: DataFrame, key: str, payload: str, answer: str, probability: str, domain: list[str]) -> DataFrame:
    """(key, answer, probability, status): JSON objects read strictly, values outside their domain refused by name."""
    obj = F.when(F.col(payload).startswith("{"), F.from_json(payload, "map<string,string>"))
    read = rows.select(key, F.col(payload).alias("_t"), obj.alias("_o")).withColumns({"_a": F.col("_o")[answer], "_p": F.col("_o")[probability].try_cast("double")})
    good_a, good_p = F.coalesce(F.col("_a").isin(*domain), F.lit(False)), F.coalesce(F.col("_p").between(0, 1), F.lit(False))
    status = F.when(F.col("_t").isNull(), "null").when(~F.col("_t").startswith("{"), "no json").when(F.col("_o").isNull(), "malformed").when(~good_a, "answer out of domain").when(~good_p, "probability out of range").otherwise("valid")
    return read.select(key, F.when(good_a, F.col("_a")).alias("answer"), F.when(good_p, F.col("_p")).alias("probability"), status.alias("status"))


def changes(rows: DataFrame, by: list[str], order: list[Column], key: str, fields: list[str]) -> DataFrame:
    """(by, key, fetch, changed): for every later version of a record, which fields differ from the version before."""
    at = Window.partitionBy(*by).orderBy(*order)
    differs = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.lag(f).over(at)), F.lit(f)) for f in fields)))
    return rows.select(*by, key, F.row_number().over(at).alias("fetch"), F.array_join(differs, ",").alias("changed")).where("fetch > 1")


def canonical_digest(fields: dict[str, Column]) -> Column:
    """sha256 of the compact JSON of the fields in the order of their names; null fields stand as null."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def carry_identity(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, n, whole): whether every row of a group has all the fields that tell it from others."""
    present = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in fields))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(present).alias("whole"))


def banded(rate: Column, high: float, low: float) -> Column:
    """high at a rate of at least high, low at one of at most low, else between; null for null."""
    return F.when(rate >= high, "high").when(rate <= low, "low").when(rate.isNotNull(), "between")


def pair_key(*parts: Column) -> Column:
    """One key of several parts, arrays among them in their order; null parts are told from missing ones."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{n}") for n, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def cost_bound(rows: DataFrame, by: list[str], text: str, in_rate: float, out_rate: float, overhead: int, longest: int) -> DataFrame:
    """(by, calls, bytes, bound): the most that calls can cost: every byte of their text and an overhead a call at one
    rate, the longest answer a call at another. A null text has no bytes."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
    return sums.withColumn("bound", (F.col("bytes") + overhead * F.col("calls")) * F.lit(in_rate) + longest * F.col("calls") * F.lit(out_rate))
