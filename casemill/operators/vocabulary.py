"""Counts of tokens: multiset coverage, attested spellings of compounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), " ")
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.explode(words).alias("token")).where("token != ''")


def multiset_difference(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(key, only_left, only_right): tokens that one side of a document has more often than the other, with multiplicity.
    Counts are signed and summed before they are compared, so the sides are never joined."""
    signed = _tokens(left, key, text).groupBy(key, "token").agg(F.count("*").alias("n")).unionByName(_tokens(right, key, text).groupBy(key, "token").agg((-F.count("*")).alias("n")))
    rest = signed.groupBy(key, "token").agg(F.sum("n").alias("n"))
    return rest.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("only_left"), F.coalesce(-F.sum(F.when(F.col("n") < 0, F.col("n"))), F.lit(0)).alias("only_right"))


def slash_votes(df: DataFrame, text: str) -> DataFrame:
    """(left, right, closed, spaced, decision): for every two words with a slash between, how often no blank follows it and
    how often one does, and which it is more often; equally often decides nothing (tie)."""
    pattern = "([A-Za-z]+) ?/( ?)([A-Za-z]+)"
    found = df.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
    part = lambda g: F.lower(F.regexp_extract("m", pattern, g))
    counts = found.groupBy(part(1).alias("left"), part(3).alias("right")).agg(F.count_if(F.regexp_extract("m", pattern, 2) == "").alias("closed"), F.count_if(F.regexp_extract("m", pattern, 2) == " ").alias("spaced"))
    return counts.withColumn("decision", F.when(F.col("closed") > F.col("spaced"), "closed").when(F.col("spaced") > F.col("closed"), "spaced").otherwise("tie"))


def hyphen_votes(df: DataFrame, text: str) -> DataFrame:
    """(pair, closed, hyphened, decision): for every hyphened pair of words in the texts, how often it stands with the hyphen
    and how often closed up, and which form more often (hyphen on a tie)."""
    low = F.lower(F.col(text))
    words = F.explode(F.regexp_extract_all(low, F.lit(r"([a-z]+(?:-[a-z]+)*)"), F.lit(1)))
    counts = df.where(F.col(text).isNotNull()).select(words.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = counts.where(F.col("w").rlike("^[a-z]+-[a-z]+$")).select(F.col("w").alias("pair"), F.replace("w", F.lit("-"), F.lit("")).alias("w"), F.col("n").alias("hyphened"))
    both = pairs.join(counts.select("w", F.col("n").alias("closed")), "w", "left").fillna(0, ["closed"])
    return both.select("pair", "closed", "hyphened", F.when(F.col("closed") > F.col("hyphened"), "closed").otherwise("hyphened").alias("decision"))
