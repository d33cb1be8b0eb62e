"""Gates that look at the data again: slices, quotes, statements in prose, verdict rows, cells of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resliced(refs: DataFrame, sources: DataFrame, source: str, start: str, end: str, text: str, quote: str) -> DataFrame:
    """refs that their source does not bear out, with problem: no source (or one without text), out of bounds, or differs.

    A reference is a source, a start and an end (past the last character) and the quote that should stand there. sources
    has source, unique, and text. A reference with a null source, place or quote refers to nothing and passes.
    """
    held = sources.select(F.col(source).alias("_s"), F.col(text).alias("_t"))
    asked = refs.where(" and ".join(f"`{c}` is not null" for c in (source, start, end, quote)))
    slice_ = F.substring("_t", F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int"))
    outside = (F.col(start) < 0) | (F.col(end) < F.col(start)) | (F.col(end) > F.length("_t"))
    problem = F.when(F.col("_t").isNull(), "no source").when(outside, "out of bounds").when(slice_ != F.col(quote), "differs")
    return asked.join(held, asked[source] == held["_s"], "left").withColumn("problem", problem).where("problem is not null").select(*refs.columns, "problem")


def statements(rows: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """(key, clause, polarity): what prose says was ruled. pattern has two groups, how the ruling begins (with a "no" or
    "not" in it for no_breach) and the clause numbers that follow. Repeated statements are told once."""
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = rows.where(F.col(text).isNotNull()).select(*key, F.explode(said).alias("_s"))
    polarity = F.when(F.regexp_extract("_s", pattern, 1).rlike("(?i)^no"), "no_breach").otherwise("breach")
    clause = F.explode(F.regexp_extract_all(F.regexp_extract("_s", pattern, 2), F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))
    return each.select(*key, polarity.alias("polarity"), F.col("_s")).select(*key, "polarity", clause.alias("clause")).distinct()


def unlisted(found: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of what was found that no listed row has; a null in a key is found nowhere."""
    return found.select(*key).distinct().join(listed.select(*key).distinct(), key, "left_anti")


def verdict_checks(rows: DataFrame, key: list[str], final: str, panel: str, board: str, dual: str, flipped: str, domain: list[str]) -> DataFrame:
    """(check, rows, violations) over verdict rows: a key stands once; final is null or in the domain; flipped just where
    panel and board are known and differ; a dual ruling has no panel polarity; a board's polarity is the final one. A row
    that says nothing on a check passes it. One pass over the rows, and one over the counts of keys."""
    differ = F.coalesce(F.col(panel) != F.col(board), F.lit(False))
    tests = {
        "final in domain": F.col(final).isin(*domain),
        "flipped": F.col(flipped) == differ,
        "dual without panel": ~F.col(dual) | F.col(panel).isNull(),
        "board decides": F.col(board) == F.col(final),
    }
    counts = rows.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(t, F.lit(True))).alias(n) for n, t in tests.items()))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col("rows"), F.col(f"`{n}`").alias("violations")) for n in tests))).alias("c")).select("c.*")
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.lit("key stands once").alias("check"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("violations"))
    return long.unionByName(twice)


def within_bounds(rows: DataFrame, index: Column, items: Column) -> DataFrame:
    """Rows whose index, from 0, is not one of an array; null indices and arrays pass."""
    return rows.where(F.coalesce((index < 0) | (index >= F.size(items)), F.lit(False)))


def rectangle(rows: DataFrame, item: list[str], repeat: str, k: int, content: Column) -> DataFrame:
    """(item, n, problem): items whose rows are not exactly the repeats 1 to k with one content: duplicate, unexpected,
    missing or differs, the first that holds. k must be odd and positive. A null repeat is unexpected."""
    if k < 1 or k % 2 == 0:
        raise ValueError("k must be odd and positive")
    seen = rows.groupBy(*item).agg(F.count("*").alias("n"), F.count_distinct(repeat).alias("_d"), F.count_if(~F.coalesce(F.col(repeat).between(1, k), F.lit(False))).alias("_out"), F.count(repeat).alias("_r"), F.count_distinct(content).alias("_c"))
    problem = F.when(F.col("_r") > F.col("_d"), "duplicate").when(F.col("_out") > 0, "unexpected").when(F.col("_d") < k, "missing").when(F.col("_c") > 1, "differs")
    return seen.withColumn("problem", problem).where("problem is not null").select(*item, "n", "problem")


def cells(rows: DataFrame, item: list[str], level: str, levels: list[int], value: str) -> DataFrame:
    """(item, one column c<level> for each level, duplicates): the value of each item at each level; of several the smallest,
    and how many rows too many there are. Other levels count as duplicates of none and are left out."""
    one = rows.where(F.col(level).isin(*levels))
    at = [F.min(F.when(F.col(level) == x, F.col(value))).alias(f"c{x}") for x in levels]
    return one.groupBy(*item).agg(*at, (F.count("*") - F.count_distinct(level)).alias("duplicates"))
