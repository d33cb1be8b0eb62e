"""Several values packed in one field: one row per value, with its position.

A field is cut into tokens on the JVM, its skeleton is the string of the tokens' classes (ordinary characters are
masked), and the splitting rule, a list of token ranges, is worked out once for each distinct skeleton. The rules go
back to the rows by the skeleton, and the values are cut out by position. Only distinct skeletons reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.runtime import arrow_safe, broadcast_if, cut

#: What people write for "nothing" (compared in lower case, without the characters around it).
PLACEHOLDERS = ("n/a", "na", "n.a.", "none", "nil", "null", "unknown", "tbc", "tba", "not applicable", "not known", "not stated", "no", "-", "--", "---", "–", "—", "?", ".", "/", "x", "none stated", "nothing", "not recorded", "blank", "empty", "keine", "aucun", "aucune", "none listed", "no clauses", "see report", "pending", "not available")
#: Openings and endings of quotes.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
DELIMITERS = ",;|\n\t\r"
BLANKS = r"\u00a0\u2000-\u200b\u202f\u205f\u2060\u3000\ufeff"

#: Rows of the rule table up to which it is broadcast; above, the planner's join on the skeleton does the same.
RULE_BROADCAST_ROWS = 200_000

_LIST_TOKEN = r"""[,;|\n\t\r]|["'“”‘’«»„]|[^,;|\n\t\r"'“”‘’«»„]+"""
_NUMBER_TOKEN = r"""\d+(?:\.\d+)*|\p{L}+|[^\s\d\p{L}]|\s+"""


def _list_classes(tokens: Column) -> Column:
    """Class of each token of a free-text list: w for ordinary characters, _ for blanks only, else the character."""
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^[,;|\n\t\r\"'“”‘’«»„]$"), t).when(F.trim(F.regexp_replace(t, rf"[\s{BLANKS}]", "")) == "", F.lit("_")).otherwise(F.lit("w")))


def _number_classes(tokens: Column) -> Column:
    """Class of each token of a list of numbers: D with a point, s up to 9, n, Y like a year, x for times, K for Code,
    r for rulings, w for other words, else the character."""

    def one(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when(t.rlike(r"^(19|20)\d\d$"), "Y")
            .when(t.rlike(r"^\d+\."), "D")
            .when(t.rlike(r"^\d$"), "s")
            .when(t.rlike(r"^\d"), "n")
            .when(low.isin("x", "×"), "x")
            .when(low.isin("code", "codes"), "K")
            .when(low.isin("ruling", "rulings", "times", "breaches"), "r")
            .when(t.rlike(r"^\s+$"), " ")
            .when(t.rlike(r"^\p{L}"), "w")
            .otherwise(t)
        )

    return F.transform(tokens, one)


def list_rule(skeleton: str) -> list[tuple[int, int, int]]:
    """Token ranges (first, end, quoted) of a free-text list. A quote opens only at the start of a piece and closes
    only before a delimiter or the end; a doubled double quote inside quotes stays inside. An apostrophe elsewhere is
    an ordinary character, and so is a quote that never closes."""
    out, i, n = [], 0, len(skeleton)

    def closing(at: int, mark: str) -> int | None:
        k = at
        while k < n:
            if skeleton[k] == mark:
                if mark == '"' and k + 1 < n and skeleton[k + 1] == mark:
                    k += 2
                    continue
                rest = k + 1
                while rest < n and skeleton[rest] == "_":
                    rest += 1
                if rest == n or skeleton[rest] in DELIMITERS:
                    return k
            k += 1
        return None

    while i < n:
        if skeleton[i] in DELIMITERS or skeleton[i] == "_":
            i += 1
            continue
        end = closing(i + 1, QUOTES[skeleton[i]]) if skeleton[i] in QUOTES else None
        if end is not None:
            out.append((i, end + 1, 1))
            i = end + 1
            continue
        first = i
        while i < n and skeleton[i] not in DELIMITERS:
            i += 1
        out.append((first, i, 0))
    return out


_NUMBERS = frozenset("DsnY")


def _counts(left: str, right: str) -> bool:
    """Whether of "left x right" the left number is the count and the right one the value."""
    return right == "D" and left != "D" or left == "s" and right in ("n", "Y")


def number_rule(skeleton: str) -> list[tuple[int, int, int]]:
    """Token ranges of the numbers in a list that are values: not those in brackets, not years of a Code, not counts
    (2 x, x 2, 2 rulings)."""
    out, depth = [], 0
    solid = [(k, c) for k, c in enumerate(skeleton) if c != " "]
    for at, (k, c) in enumerate(solid):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c in "DsnY":
            two_before, before, after, two_after = (solid[at + d][1] if 0 <= at + d < len(solid) else "" for d in (-2, -1, 1, 2))
            if depth or after == "r" or (c == "Y" and "K" in (two_before, before, after)):
                continue
            if after == "x" and _counts(c, two_after) or before == "x" and two_before in _NUMBERS and not _counts(two_before, c):
                continue
            out.append((k, k + 1, 0))
    return out


_RULE = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("quoted", T.IntegerType())]))


def split_values(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """One row (id, field, pos, value) per value packed in a field.

    fields: column name -> "list" (free text: delimiters , ; | tab and newline, quotes, doubled quotes) or "numbers"
    (clause numbers among words, notes and year marks). pos counts from 1 in the order of the string, repeats
    included. Null, empty and placeholder fields, and empty and placeholder pieces, give no row; repeated rows give
    repeated results; a null id is kept. Other columns of df are ignored, whatever their names. An empty table gives
    no rows.
    """
    kinds = sorted(set(fields.values()))
    unknown = set(kinds) - {"list", "numbers"}
    if unknown:
        raise ValueError(f"unknown kind of field: {sorted(unknown)}")
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.col(f"`{name}`").cast("string").alias("raw")) for name, kind in fields.items()))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.kind", "p.raw").where(F.col("raw").rlike(r"[^\s,;|]"))
    is_list = F.col("kind") == "list"
    rows = rows.withColumn("tokens", F.when(is_list, F.regexp_extract_all("raw", F.lit(_LIST_TOKEN), F.lit(0))).otherwise(F.regexp_extract_all("raw", F.lit(_NUMBER_TOKEN), F.lit(0))))
    rows = rows.withColumn("skeleton", F.array_join(F.when(is_list, _list_classes(F.col("tokens"))).otherwise(_number_classes(F.col("tokens"))), "")).select("id", "field", "kind", "tokens", "skeleton")

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(list_rule if k == "list" else number_rule)(s) for k, s in zip(b.kind, b.skeleton, strict=True)]
            yield pd.DataFrame({"kind": b.kind, "skeleton": b.skeleton, "rule": [[{"first": a, "end": e, "quoted": q} for a, e, q in r] for r in found]})

    distinct = rows.select("kind", "skeleton").distinct()
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("rule", _RULE)])
    table = cut(distinct.mapInPandas(arrow_safe(rules), schema))
    table = broadcast_if(table, table.count(), RULE_BROADCAST_ROWS)

    joined = rows.join(table, ["kind", "skeleton"])
    edge = f"^[\\s{BLANKS}]+|[\\s{BLANKS}]+$"

    def cut_out(piece: Column) -> Column:
        text = F.array_join(F.slice(F.col("tokens"), piece.first + 1, piece.end - piece.first), "")
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        inner = F.when(F.startswith(text, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(inner)
        plain = F.regexp_replace(F.when(piece.quoted == 1, inner).otherwise(text), edge, "")
        return F.struct(plain.alias("value"), piece.quoted.alias("quoted"))

    whole = F.transform("rule", lambda p: cut_out(p))
    kept = F.filter(whole, lambda v: (v.value != "") & ~F.lower(F.regexp_replace(v.value, r"^[\s(\[\"']+|[\s)\]\"']+$", "")).isin(*PLACEHOLDERS) & v.value.rlike(r"[\p{L}\p{N}]"))
    return joined.select(F.col("id").alias(id_col), "field", F.posexplode(kept).alias("at", "v")).select(id_col, "field", (F.col("at") + 1).cast("int").alias("pos"), F.col("v.value").alias("value"))
