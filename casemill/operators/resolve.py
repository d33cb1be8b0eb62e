"""Conflicting witnesses to one value, with the basis on which it was taken.

Witnesses are columns, in falling trust. A resolved value is a struct of value, basis and the witnesses seen, so that
nothing that lost is thrown away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.runtime import cut


def resolve(witnesses: dict[str, Column]) -> Column:
    """struct(value, basis, sources, conflict). basis: none without a witness, unanimous if all that speak agree (single if
    only one speaks), majority if most of the speaking do, else the name of the first witness that speaks."""
    seen = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in witnesses.items())), lambda w: w.value.isNotNull())
    values = F.array_distinct(F.transform(seen, lambda w: w.value))
    count = lambda v: F.size(F.filter(seen, lambda w: w.value == v))
    major = F.get(F.filter(values, lambda v: count(v) * 2 > F.size(seen)), F.lit(0))
    basis = F.when(F.size(seen) == 0, "none").when(F.size(seen) == 1, "single").when(F.size(values) == 1, "unanimous").when(major.isNotNull(), "majority").otherwise(F.get(seen, F.lit(0))["name"])
    value = F.when(F.size(values) == 1, F.get(values, F.lit(0))).when(major.isNotNull(), major).otherwise(F.get(seen, F.lit(0))["value"])
    sources = F.map_from_arrays(F.transform(seen, lambda w: w["name"]), F.transform(seen, lambda w: w["value"]))
    return F.struct(value.alias("value"), basis.alias("basis"), sources.alias("sources"), (F.size(values) > 1).alias("conflict"))


def override(df: DataFrame, reviewed: DataFrame, key: list[str], column: str, value: str, pin: str, seen: Column) -> DataFrame:
    """df with column replaced where a reviewed row of the key has a value and its pin equals the hash of what was reviewed;
    a stale pin changes nothing and is flagged. Adds <column>_reviewed and <column>_stale."""
    side = reviewed.select(*key, F.col(value).alias("_v"), F.col(pin).alias("_p"))
    fits = F.coalesce(F.col("_p") == F.sha2(seen, 256), F.lit(False))
    joined = df.join(side, key, "left").withColumn("_fits", fits)
    stale = F.col("_p").isNotNull() & ~F.col("_fits")
    return joined.withColumns({column: F.when(F.col("_fits"), F.col("_v")).otherwise(F.col(column)), f"{column}_reviewed": F.col("_fits"), f"{column}_stale": stale}).drop("_v", "_p", "_fits")


def single_polarity(yes: Column, no: Column) -> Column:
    """breach, no_breach, or null where both or neither was said."""
    return F.when(yes & ~no, "breach").when(no & ~yes, "no_breach")


def verdict_rows(statements: DataFrame, key: list[str], polarity: str, body: str) -> DataFrame:
    """(key, panel, board, final, dual, flipped, basis) from statements (key, polarity, body). body is panel or board for
    what prose says that they ruled, list for the lists of the record. final comes from the lists: a key that both lists
    have is dual and has none; prose moves panel and board only. Both polarities from one body are dual and no polarity;
    flipped if both bodies are known and differ. basis: unlisted without a list, list where prose is silent, unanimous
    where the body that decided (the board if it was heard) says the same, else conflict."""
    said = lambda b, p: F.bool_or((F.col(body) == b) & (F.col(polarity) == p))
    heard = statements.groupBy(*key).agg(*(F.coalesce(said(b, p), F.lit(False)).alias(f"_{b}_{p}") for b in ("panel", "board", "list") for p in ("breach", "no_breach")))
    panel, board, final = (single_polarity(F.col(f"_{b}_breach"), F.col(f"_{b}_no_breach")) for b in ("panel", "board", "list"))
    spoke = lambda b: F.col(f"_{b}_breach") | F.col(f"_{b}_no_breach")
    dual = F.lit(False)
    for b in ("panel", "board", "list"):
        dual = dual | (F.col(f"_{b}_breach") & F.col(f"_{b}_no_breach"))
    heard_last = F.when(spoke("board"), board).otherwise(panel)
    basis = F.when(~spoke("list"), "unlisted").when(~spoke("board") & ~spoke("panel"), "list").when(heard_last == final, "unanimous").otherwise("conflict")
    return heard.select(*key, panel.alias("panel"), board.alias("board"), final.alias("final"), dual.alias("dual"), (panel.isNotNull() & board.isNotNull() & (panel != board)).alias("flipped"), basis.alias("basis"))


def ladder(levels: dict[str, list[Column]]) -> Column:
    """struct(value, basis, refused) from levels of witnesses in falling trust: the first level at which somebody speaks
    decides; witnesses that differ there refuse the value (null, basis <level> conflict), whatever lower levels say."""
    value, basis = F.lit(None).cast("string"), F.lit("none")
    for name, witnesses in reversed(levels.items()):
        said = F.array_distinct(F.array_compact(F.array(*(w.cast("string") for w in witnesses))))
        value = F.when(F.size(said) == 0, value).when(F.size(said) == 1, F.get(said, F.lit(0)))
        basis = F.when(F.size(said) == 0, basis).when(F.size(said) == 1, name).otherwise(f"{name} conflict")
    return F.struct(value.alias("value"), basis.alias("basis"), basis.endswith("conflict").alias("refused"))


def ordered_dates(first: Column, second: Column, year: Column) -> Column:
    """struct(first, second, basis) of two ISO dates, the first of which may not come after the second, nor lie outside the
    year of its record or the one before: both are refused (null) if they are out of order, the first alone if its year
    contradicts. basis is stated, out of order, year conflict or none."""
    wrong = F.coalesce(first > second, F.lit(False))
    told = F.substring(first, 1, 4).cast("int")
    odd = F.coalesce((told > year) | (told < year - 1), F.lit(False))
    basis = F.when(first.isNull() & second.isNull(), "none").when(wrong, "out of order").when(odd, "year conflict").otherwise("stated")
    return F.struct(F.when(~wrong & ~odd, first).alias("first"), F.when(~wrong, second).alias("second"), basis.alias("basis"))


def rename_tokens(df: DataFrame, key: str, tokens: str, corrections: DataFrame, old: str, new: str) -> DataFrame:
    """df with the tokens of its array renamed, or deleted where the new name is null, by the corrections of its key; each
    token once, in the order of first standing. Adds changed. Of several new names for one token the smallest counts."""
    one = corrections.where(F.col(key).isNotNull() & F.col(old).isNotNull()).groupBy(key, old).agg(F.min(new).alias("_new"))
    maps = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(old), F.struct(F.col("_new").alias("v"))))).alias("_m"))
    joined = df.join(maps, key, "left")
    renamed = F.array_distinct(F.array_compact(F.transform(tokens, lambda t: F.when(F.coalesce(F.map_contains_key("_m", t), F.lit(False)), F.element_at("_m", t).v).otherwise(t))))
    return joined.withColumn("_r", renamed).withColumn("changed", F.coalesce(F.col("_r") != F.array_distinct(tokens), F.lit(False))).withColumn(tokens, F.col("_r")).drop("_m", "_r")


def canonical_spelling(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, name, n, spellings): per key the most frequent spelling, of equals the shorter, then the first by order."""
    counts = rows.where(F.col(name).isNotNull()).select(key.alias("key"), F.col(name)).where("key != ''").groupBy("key", name).agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), F.length(name).alias("l"), F.col(name).alias("v"))).alias("_b"), F.count("*").alias("spellings"), F.sum("n").alias("rows"))
    return best.select("key", F.col("_b.v").alias(name), (-F.col("_b.m")).alias("n"), "spellings", "rows")


def lookup_with_parent(rows: DataFrame, book: DataFrame, group: list[str], number: str, text: str) -> DataFrame:
    """rows with text and rung: the entry of the row's own dotted number, else of its parent (the number before the last
    point), else of no rung (missing)."""
    entries = book.select(*group, F.col(number).alias("_n"), F.col(text).alias("_t"))
    parent = F.when(F.col(number).contains("."), F.regexp_replace(number, r"\.[^.]*$", ""))
    own = rows.withColumn("_parent", parent).alias("r").join(entries.alias("a"), [*(F.col(f"r.{g}") == F.col(f"a.{g}") for g in group), F.col(f"r.{number}") == F.col("a._n")], "left")
    both = own.join(entries.alias("b"), [*(F.col(f"r.{g}") == F.col(f"b.{g}") for g in group), F.col("r._parent") == F.col("b._n")], "left")
    rung = F.when(F.col("a._t").isNotNull(), "own").when(F.col("b._t").isNotNull(), "parent").otherwise("missing")
    return both.select(*(F.col(f"r.{c}") for c in rows.columns), F.coalesce("a._t", "b._t").alias(text), rung.alias("rung"))


def chain_ends(links: DataFrame, old: str, new: str) -> DataFrame:
    """(old, end, steps): where each chain of renamings ends, by doubling; a chain that runs into a circle has null end and
    steps. Of several new names the smallest counts; a link to itself ends at once. Null names are left out. Rounds are
    the logarithm of the number of links, and one counter per round reaches the driver."""
    one = cut(links.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(old).agg(F.min(new).alias("end")).withColumn("steps", F.lit(1).cast("bigint")))
    stops = one.where(F.col(old) == F.col("end")).withColumn("done", F.lit(True))
    moving = one.where(F.col(old) != F.col("end"))
    known = moving.select(F.col(old).alias("_o"))
    step = cut(moving.join(known, F.col("end") == F.col("_o"), "left").withColumn("done", F.col("_o").isNull()).drop("_o"))
    for _ in range(max(1, moving.count().bit_length())):
        if not step.where("not done").take(1):
            break
        a, b = step.alias("a"), step.alias("b")
        moved = a.join(b, (F.col("a.end") == F.col(f"b.{old}")) & ~F.col("a.done"), "left")
        step = cut(moved.select(F.col(f"a.{old}").alias(old), F.coalesce("b.end", "a.end").alias("end"), (F.col("a.steps") + F.coalesce("b.steps", F.lit(0))).alias("steps"), F.coalesce("b.done", "a.done").alias("done")))
    both = step.unionByName(stops)
    return both.select(old, F.when(F.col("done"), F.col("end")).alias("end"), F.when(F.col("done"), F.col("steps")).alias("steps"))
