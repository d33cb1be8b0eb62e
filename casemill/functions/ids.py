"""Identifiers of cases: canonical forms, serials, file names, what is left of them in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An identifier as people write it: prefix, serial, month and year, with slashes, backslashes or dashes.
LOOSE = r"(?i)\b([a-z]{2,6})[ \t/\\-]{0,3}([0-9]{2,5})[ \t]*[/\\-]{1,2}[ \t]*([0-9]{1,2})[ \t]*[/\\-]{1,2}[ \t]*([0-9]{2,4})\b"


def normalised(x: Column) -> Column:
    """The first identifier of a text in its canonical form PREFIX/serial/month/yy, null without one."""
    part = lambda g: F.regexp_extract(x, LOOSE, g)
    made = F.concat_ws("/", F.upper(part(1)), F.lpad(part(2), 4, "0"), part(3).cast("int").cast("string"), F.right(part(4), F.lit(2)))
    return F.when(F.length(part(2)) > 0, made)


def serial(x: Column) -> Column:
    """The serial of a canonical identifier as a number; null for anything else."""
    parts = F.split(x, "/")
    return F.when(F.size(parts) == 4, F.get(parts, F.lit(1)).try_cast("int"))


def serials(x: Column) -> Column:
    """The serials of an array of identifiers, each once, in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(x, serial))))


def file_name(numbers: Column, suffix: str = ".html") -> Column:
    """Identifiers as one file name: slashes become dashes, several are joined by two underscores."""
    return F.when(F.size(numbers) > 0, F.concat(F.array_join(F.transform(numbers, lambda n: F.replace(n, F.lit("/"), F.lit("-"))), "__"), F.lit(suffix)))


def residual(x: Column, own: Column) -> Column:
    """Which of the own serials still stand in a text as numbers of their own with an identifier's neighbourhood: a prefix
    before or a slash, dash or comma and a digit after."""
    near = F.regexp_extract_all(x, F.lit(r"(?i)(?:\b[a-z]{2,6}[ \t]?[/\\-][ \t]?([0-9]{2,5})\b)|(?:\b([0-9]{2,5})[ \t]*[/\\,-][ \t]*[0-9])"), F.lit(0))
    numbers = F.transform(near, lambda s: F.regexp_extract(s, "([0-9]{2,5})", 1).cast("int"))
    return F.array_sort(F.array_intersect(numbers, own))


def cluster(tags: Column, case: Column, prefix: str) -> Column:
    """The one tag that begins with prefix, else the case; several such tags give no cluster (null)."""
    own = F.filter(tags, lambda t: t.startswith(prefix))
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.concat(F.lit("case:"), case)).when(F.size(own) == 1, F.get(own, F.lit(0)))


def usable_rank(*columns: Column) -> Column:
    """The first of some values that is a whole number of at least 1, read from text; booleans are none."""
    one = [F.when(c.cast("string").rlike("^[0-9]+$"), c.cast("string").try_cast("int")) for c in columns]
    return F.coalesce(*(F.when(v >= 1, v) for v in one))


def state(x: Column, states: list[str]) -> Column:
    """A state by its name, with or without the prefixes that providers put before it; null for one that is not known."""
    bare = F.lower(F.regexp_replace(x, "^(?:JOB_STATE_|BATCH_STATE_|STATE_)", ""))
    return F.when(bare.isin(*[s.lower() for s in states]), bare)


def no_blanks(x: Column) -> Column:
    """A text without any blanks."""
    return F.regexp_replace(x, "[ \t\r\n    　]+", "")


def loose_literal(x: Column) -> Column:
    """A pattern that finds a literal text whatever its blanks are."""
    words = F.filter(F.split(F.trim(F.regexp_replace(x, "[ \t\r\n]+", " ")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "\\s+")


def url_parts(path: Column) -> Column:
    """struct(year, root, rest) of a path: its first segment of four digits, what stands before it and after it."""
    part = lambda g: F.nullif(F.regexp_extract(path, r"^(.*?)/([0-9]{4})(?:/(.*))?$", g), F.lit(""))
    return F.struct(part(2).cast("int").alias("year"), part(1).alias("root"), part(3).alias("rest"))
