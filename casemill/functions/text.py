"""Column functions on text: identifiers, sentences, dates, folding. All run inside the JVM; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case numbers: scheme, serial, month, two digits of the year.
CASE_NUMBER = r"[A-Z]{2,6}/[0-9]+/[0-9]{1,2}/[0-9]{2}"
#: Letters with accents, and the letters under them.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Words of company names that do not tell companies apart.
COMPANY_SUFFIXES = "ltd|limited|plc|inc|gmbh|uk|co|company|corp|corporation|llc|ag|sa"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"[ \t\r\n\x{A0}\x{2003}\x{2009}\x{202F}\x{3000}]+", " "))


def needle(x: Column | str) -> Column:
    """Form for comparing phrases: collapsed, lower case."""
    return F.lower(collapse(x))


def upper_ratio(x: Column | str) -> Column:
    """Share of capitals among the ASCII letters; 0 without letters."""
    letters = F.length(F.regexp_replace(_c(x), "[^A-Za-z]", ""))
    return F.coalesce(F.length(F.regexp_replace(_c(x), "[^A-Z]", "")) / F.nullif(letters, F.lit(0)), F.when(_c(x).isNotNull(), F.lit(0.0)))


def case_numbers(x: Column | str) -> Column:
    """The different case numbers in a text, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(rf"\b({CASE_NUMBER})\b"), F.lit(1)))


def case_sort_key(x: Column | str) -> Column:
    """Struct that sorts case numbers by year, month and serial as numbers."""
    part = lambda n: F.try_element_at(F.split(_c(x), "/"), F.lit(n)).try_cast("int")
    return F.struct(part(4).alias("year"), part(3).alias("month"), part(2).alias("serial"))


def clause_sort_key(x: Column | str) -> Column:
    """Struct that sorts dotted clause numbers as numbers; a missing second number comes first."""
    part = lambda n: F.try_element_at(F.split(_c(x), r"\."), F.lit(n)).try_cast("int")
    return F.struct(part(1).alias("major"), F.coalesce(part(2), F.lit(-1)).alias("minor"))


def case_year(x: Column | str) -> Column:
    """Year of a case number, its two digits after 2000; null where there is none."""
    return (F.try_element_at(F.split(_c(x), "/"), F.lit(4)).try_cast("int") + 2000).cast("int")


def sentences(x: Column | str) -> Column:
    """Sentences of a collapsed text: cut after . ! ? before a blank."""
    return F.filter(F.split(collapse(x), r"(?<=[.!?]) "), lambda s: s != "")


def sentence_key(x: Column | str) -> Column:
    """The first 12 hex digits of the sha256 of a collapsed sentence."""
    return F.substring(F.sha2(collapse(x), 256), 1, 12)


def redact(x: Column | str, own: Column, token: str = "[case]") -> Column:
    """Text with each of the row's own identifiers replaced, longest first, where no digit follows."""
    ordered = F.array_sort(own, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, _c(x), lambda acc, i: F.regexp_replace(acc, F.concat(F.lit("\\Q"), i, F.lit("\\E(?![0-9])")), F.lit(token)))


def fold_name(x: Column | str) -> Column:
    """Key of a company name: no accents, lower case, letters and digits only, without legal suffixes."""
    plain = F.lower(F.translate(_c(x), ACCENTED, PLAIN))
    words = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", " "), rf"\b({COMPANY_SUFFIXES})\b", " ")
    return F.trim(F.regexp_replace(words, " +", " "))


def iso_date(x: Column | str) -> Column:
    """yyyy-MM-dd of a date written dd/MM/yyyy or d Month yyyy; null for anything else, also for days that do not exist."""
    s = F.trim(_c(x))
    slashed = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
    spelled = F.when(s.rlike(r"^\d{1,2} [A-Z][a-z]+ \d{4}$"), F.try_to_date(s, "d MMMM yyyy"))
    return F.date_format(F.coalesce(slashed, spelled), "yyyy-MM-dd")


def clause_tokens(x: Column | str) -> Column:
    """The different clause numbers in a text after the word Clause or Clauses, in order."""
    lists = F.regexp_extract_all(_c(x), F.lit(r"Clauses? ([0-9]+(?:\.[0-9]+)?(?:(?:, | and )[0-9]+(?:\.[0-9]+)?)*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))))


def tags_out(x: Column | str) -> Column:
    """Markup removed, the commonest entities resolved, blanks collapsed."""
    bare = F.regexp_replace(_c(x), "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return collapse(bare)


def norm_path(x: Column | str) -> Column:
    """Path of a link: without host, query, fragment and trailing slash, in lower case; the root is /."""
    path = F.regexp_replace(F.regexp_replace(_c(x), r"^[A-Za-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.lower(F.when(F.regexp_replace(path, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/+$", "")))


def slug(x: Column | str) -> Column:
    """Lower-case letters and digits, everything between them as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def day_gap(a: Column, b: Column) -> Column:
    """Days between two yyyy-MM-dd texts by arithmetic of 365 and 30, not by the calendar."""
    value = lambda d: F.substring(d, 1, 4).cast("int") * 365 + F.substring(d, 6, 2).cast("int") * 30 + F.substring(d, 9, 2).cast("int")
    return value(b) - value(a)
