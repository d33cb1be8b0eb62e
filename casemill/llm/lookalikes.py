"""Visually identical text in one consistent form.

Strings and code points that look alike are joined by union-find: code points of the texts with their width and
ligature forms (Unicode compatibility), letters of other scripts with the Latin letters they resemble, kinds of
apostrophe, quote, hyphen and space, invisible characters with nothing, composed with decomposed letters. Of each class
the member that the corpus uses most stands for all, and a multi-pattern automaton rewrites texts greedily, longest
match first. A word of another script, told by a letter that looks like no Latin one, keeps its letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe, spread

#: Letters of other scripts after the Latin letter that they look like.
LETTERS = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СᏟϹ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫͿ", "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥУҮ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ", "n": "ոη", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уүγ",
}
#: Other marks by the mark they look like.
MARKS = {
    "'": "’‘ʼ＇ʹ′`´‛ʻˈ",
    '"': "“”„‟″＂",
    "-": "‐‑‒–−－﹣⁃",
    " ": "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t\n\r\v\f\u2028\u2029\u0085",
}
#: Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e\u034f\u2061\u2062\u2063\u2064\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe0e\ufe0f"

#: Code points whose compatibility forms are always known: Latin with accents, ligatures, full width, letters of formulas.
FORMS = (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800))
#: Code points that are assigned at all: bounds the table of character counts.
CODE_POINTS = 0x110000
#: Distinct words whose forms a worker keeps.
WORDS_KEPT = 200_000
_ACCENTED = re.compile(".[\\u0300-\\u036f]+", re.S)


class UnionFind:
    """Disjoint classes of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values()]


def classes(characters: set[str]) -> list[list[str]]:
    """Classes of look-alike strings among the fixed values and the given characters, with two members or more."""
    u = UnionFind()
    for latin, others in (*LETTERS.items(), *MARKS.items()):
        for c in others:
            u.join(latin, c)
    for c in INVISIBLE:
        u.join("", c)
    fixed = set(u.parent) - {""} | {chr(p) for r in FORMS for p in r}
    for c in sorted(characters | fixed):
        for form in ("NFC", "NFKC", "NFD"):
            other = unicodedata.normalize(form, c)
            if other != c and c not in MARKS and not (form != "NFC" and other[:1] == " ") and c not in "`´":
                u.join(c, other)
    return [c for c in u.classes() if len(c) > 1]


class Rewriter:
    """Rewrites texts into representatives. counts: how often the corpus has each member of a class."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.table: dict[str, str] = {}
        for members in classes({c for c in counts if len(c) == 1}):
            # The empty string stands for its class: what shows nothing is dropped.
            best = "" if "" in members else max(members, key=lambda m: (counts.get(m, 0), m.isascii(), -len(m), [-ord(x) for x in m]))
            self.table |= {m: best for m in members if m and m != best}
        self.automaton = ahocorasick.Automaton()
        for m, best in self.table.items():
            self.automaton.add_word(m, (len(m), best))
        self.automaton.make_automaton()
        # What a word must hold for anything in it to be rewritten: a character that is not ASCII, an ASCII member, or an ASCII
        # string that the corpus writes as one character.
        self.told = re.compile("[^" + "".join(re.escape(chr(p)) for p in range(128) if chr(p) not in self.table) + "]")
        many = sorted(m for m in self.table if len(m) > 1 and m.isascii())
        self.strings = re.compile("|".join(map(re.escape, many))) if many else None
        self.seen: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def once(self, text: str) -> str:
        out, at = [], 0
        for end, (size, best) in self.automaton.iter_long(text):
            out += (text[at : end - size + 1], best)
            at = end + 1
        return "".join(out) + text[at:]

    def _settled(self, text: str) -> str:
        for _ in range(4):  # a dropped character may join a letter with its accent; settles in two rounds
            new = unicodedata.normalize("NFC", self.once(text))
            if new == text:
                break
            text = new
        return text

    def _word(self, text: str) -> str:
        found = self.seen.get(text)
        if found is None:
            out, at = [], 0
            for m in _OTHER_SCRIPT.finditer(text):
                word = unicodedata.normalize("NFC", m[0].translate(_NOTHING))
                if any(c.isalpha() and c not in _LIKE_LATIN for c in word):
                    out += (self._settled(text[at : m.start()]), word)
                    at = m.end()
            found = "".join(out) + self._settled(text[at:])
            if len(self.seen) >= WORDS_KEPT:
                self.seen.clear()
            self.seen[text] = found
        return found

    def __call__(self, text: str) -> str:
        """One form for all texts that look the same; runs of spaces, of whatever kind, become one."""
        words = text.split()
        if self._told(text):
            words = filter(None, [self._word(w) if self._told(w) else w for w in words])
        return " ".join(words)

    def _told(self, text: str) -> bool:
        return self.told.search(text) is not None or self.strings is not None and self.strings.search(text) is not None


#: Words of Greek, Cyrillic, Armenian or Cherokee letters only, with accents and what shows nothing.
_OTHER_SCRIPT = re.compile(rf"(?<!\w)[\u0370-\u058f\u13a0-\u13ff][\u0370-\u058f\u13a0-\u13ff\u0300-\u036f{INVISIBLE}]*(?!\w)")
_NOTHING = dict.fromkeys(map(ord, INVISIBLE))
_LIKE_LATIN = frozenset("".join(LETTERS.values()))


def member_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """How often the texts of a column have each character, and each longer member of a look-alike class. All rows are
    counted; only one row per character that occurs comes to the driver, at most CODE_POINTS and a few hundred."""
    long_members = sorted({m for c in classes(set()) for m in c if len(m) > 1})
    accented = {m for m in long_members if _ACCENTED.fullmatch(m)}
    plain = [m for m in long_members if m not in accented]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            whole = "\0".join(b.t)
            seen.update(whole)
            for m in plain:
                if all(c in seen for c in m) and (n := whole.count(m)):
                    seen[m] += n
            for letter, n in Counter(_ACCENTED.findall(whole)).items():
                for k in range(2, len(letter) + 1):
                    if letter[:k] in accented:
                        seen[letter[:k]] += n
        seen.pop("\0", None)
        yield pd.DataFrame({"m": [m for m, n in seen.items() if n], "n": [n for n in seen.values() if n]})

    rows = texts.select(F.col(f"`{column}`").cast("string").alias("t")).where("t is not null").mapInPandas(arrow_safe(count), "m string, n bigint")
    return {r.m: r.n for r in rows.groupBy("m").agg(F.sum("n").alias("n")).collect()}


def rewriting(rewriter: Rewriter):
    """The rewriter as a column function; null stays null."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rewriter(t))

    return rewrite


def consistent(df: DataFrame, columns: list[str], rewriter: Rewriter) -> DataFrame:
    """df with the given text columns rewritten into one consistent form; null stays null, blank texts become empty,
    all other columns are kept."""
    rewrite = rewriting(rewriter)
    one: dict[str, Column] = {c: rewrite(F.col(f"`{c}`").cast("string")) for c in columns}
    return df.withColumns(one)


#: Quotes in one automaton, and texts that one task streams through it.
QUOTES_AT_ONCE, TEXTS_AT_ONCE = 10_000, 10_000


def find_quotes(quotes: DataFrame, places: DataFrame, rewriter: Rewriter) -> DataFrame:
    """One row (quote_id, place_id) per quote that stands, as a reader sees it, in a text.

    Every quote and every text of a file with quotes is rewritten once; the quotes of a file make an automaton through which
    the texts of the file are streamed. A file with more than QUOTES_AT_ONCE quotes or TEXTS_AT_ONCE texts goes in parts.
    quotes: quote_id, file, quote, one row for each file in which a quote may stand; places: place_id, file, text. Null
    ids or files and null texts give no row, nor does a quote that shows nothing; repeated rows give one row.
    """
    q = quotes.where("quote_id is not null and file is not null and quote is not null").select("quote_id", "file", "quote").distinct()
    p = places.where("place_id is not null and file is not null and text is not null").select("place_id", "file", "text")
    kinds = {**{f.name: f.dataType.simpleString() for f in q.schema.fields}, **{f.name: f.dataType.simpleString() for f in p.schema.fields}}
    asked = q.groupBy("file").agg(F.count("*").alias("n_q"))
    sizes = p.join(asked, "file").groupBy("file", "n_q").agg(F.count("*").alias("n_p")).select("file", F.ceil(F.col("n_q") / QUOTES_AT_ONCE).cast("int").alias("qs"), F.ceil(F.col("n_p") / TEXTS_AT_ONCE).cast("int").alias("ps"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes, "file").withColumn("a", part("quote_id", "qs")).withColumn("b", every("ps")).select("file", "a", "b", F.lit(False).alias("is_text"), F.col("quote_id").cast("string").alias("id"), F.col("quote").alias("text"))
    right = p.join(sizes, "file").withColumn("b", part("place_id", "ps")).withColumn("a", every("qs")).select("file", "a", "b", F.lit(True).alias("is_text"), F.col("place_id").cast("string").alias("id"), "text")
    laid = spread(left.union(right), "file", "a", "b").sortWithinPartitions("file", "a", "b", "is_text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, automaton = None, {}, None
        for b in batches:
            out = []
            for file, a, k, is_text, own, text in zip(b.file, b.a, b.b, b.is_text, b.id, b.text, strict=True):
                if (file, a, k) != key:
                    key, held, automaton = (file, a, k), {}, None
                plain = rewriter(text)
                if not is_text:
                    if plain:
                        held.setdefault(plain, []).append(own)
                    continue
                if automaton is None and held:
                    automaton = ahocorasick.Automaton()
                    for quote in held:
                        automaton.add_word(quote, quote)
                    automaton.make_automaton()
                if held:
                    out += [(i, own) for quote in {quote for _, quote in automaton.iter(plain)} for i in held[quote]]
            yield pd.DataFrame(out, columns=["quote_id", "place_id"])

    found = laid.select("file", "a", "b", "is_text", "id", "text").mapInPandas(arrow_safe(stream), "quote_id string, place_id string").distinct()
    return found.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("quote_id", "place_id")))
