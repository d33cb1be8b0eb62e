"""Matching texts to short lists: longest prefix, earliest phrase, agreement of versions, declared and found sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name): the longest name that a text begins with, words whole. Every text gives its prefixes of as many words as a
    name has at most, which are joined on equality; names are not scanned. Texts without a match have no row."""
    most_words = names.agg(F.max(F.size(F.split(F.col(name), " ")))).first()[0] or 1
    words = F.split(F.trim(F.col(text)), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most_words))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    spread = rows.where(F.col(text).isNotNull()).select(F.col(key), F.explode(prefixes).alias("_p"))
    known = names.where(F.col(name).isNotNull()).select(F.col(name).alias("_p")).distinct()
    return spread.join(known, "_p").groupBy(key).agg(F.max_by("_p", F.length("_p")).alias(name))


def earliest_phrase(text: Column, phrases: list[str]) -> Column:
    """The phrase with the first place in a text, of equals the earlier in the list; null if none is there."""
    places = F.array(*(F.struct(F.instr(text, p).alias("at"), F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in enumerate(phrases)))
    return F.array_min(F.filter(places, lambda x: x["at"] > 0))["p"]


def agreement(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, versions, tier): how far the versions of a text agree: exact, but for blanks, but for case and marks, or not."""
    collapsed = F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))
    bare = F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", "")
    seen = rows.where(F.col(text).isNotNull()).groupBy(*by).agg(F.count("*").alias("versions"), F.count_distinct(text).alias("_0"), F.count_distinct(collapsed).alias("_1"), F.count_distinct(bare).alias("_2"))
    tier = F.when(F.col("_0") == 1, "exact").when(F.col("_1") == 1, "blanks").when(F.col("_2") == 1, "marks").otherwise("differs")
    return seen.select(*by, "versions", tier.alias("tier"))


def declared_and_found(declared: Column, found: Column) -> Column:
    """none, undeclared, unfound, equal, overlap or disjoint, of two arrays."""
    a, b = F.size(declared), F.size(found)
    same = (F.size(F.array_except(declared, found)) == 0) & (F.size(F.array_except(found, declared)) == 0)
    return F.when((a == 0) & (b == 0), "none").when(a == 0, "undeclared").when(b == 0, "unfound").when(same, "equal").when(F.arrays_overlap(declared, found), "overlap").otherwise("disjoint")


def pane_state(declared: Column, head: Column, title: Column, body: Column) -> Column:
    """Whether a text belongs to its record: ok, title typo, arises from another or mismatch.

    declared and head are the identifiers of the record and of the head of its text, in order. ok if the head has none or
    one of the record's; a typo if a serial is the same and only month or year differ; the text arises from another record
    where title or body say so; else it belongs to that other record."""
    serial = lambda ids: F.transform(ids, lambda i: F.get(F.split(i, "/"), F.lit(1)))
    told = F.coalesce(title.rlike("(?i)Paragraph 17|During (?:its|the) consideration of"), F.lit(False)) | F.coalesce(body.rlike(r"(?i)^\s*During (?:its|the) consideration of"), F.lit(False))
    return F.when((F.size(head) <= 0) | F.arrays_overlap(declared, head), "ok").when(F.arrays_overlap(serial(declared), serial(head)), "title typo").when(told, "arises from another").otherwise("mismatch")


def unbalanced(text: Column) -> Column:
    """Whether a text opens a double quote that it does not close."""
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
    opened = F.length(text) - F.length(F.replace(text, F.lit("“"), F.lit("")))
    closed = F.length(text) - F.length(F.replace(text, F.lit("”"), F.lit("")))
    return odd | (opened != closed)
