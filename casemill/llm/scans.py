"""Noise in text from scanned pages: page furniture, words broken over lines, misread characters.

Furniture stands at the edges of pages: page numbers, and lines whose shape (characters that are mistaken for one
another folded together, numbers and months masked) runs through the pages of reports. Lines are then read as a noisy
channel: the probability that a character group is seen for another, times the likelihood of the words under counts of
words and word pairs in a clean corpus, decoded by Viterbi over the candidate words of each line. A line break is one
more noise: whether its two halves are one word is decided by the same counts.

All grouping is by page, never by report; a report of any length is many small groups.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe, cut

#: Character groups as they are misread, after what is meant.
CONFUSIONS = {
    "a": "@", "b": "h 8 6", "c": "e", "d": "cl", "e": "c", "f": "t", "g": "q 9", "h": "b", "i": "1 l ! |", "l": "1 i ! |", "m": "rn", "o": "0",
    "q": "g", "s": "5 $", "t": "f 7", "u": "ii ll", "w": "vv", "z": "2", "rn": "m", "cl": "d", "ti": "h", "ll": "u", "vv": "w", "fi": "fl h", "fl": "fi", "ii": "u",
}
#: Marks of a broken word, the last two of which are never part of a word.
BREAK_MARKS = "-‐¬­"
SURE_MARKS = "¬­"
#: Months, in full and short.
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()

#: Candidates differ from the word seen by at most so many misread groups, or one for every so many letters of a longer one.
MAX_MISREAD, LETTERS_A_MISREAD = 2, 4
#: A known word is doubted only where a candidate is so many times as frequent.
DOUBT_RATIO = 50
#: Lines at the top and at the bottom of a page among which its furniture stands: it may have slipped between others.
EDGE_LINES = 3
#: Share of a shape's lines that must stand at page edges, and of its reports in which it must come back, for a running line;
#: it must come back in two reports, or stand on three pages of one.
EDGE_SHARE, REPEAT_SHARE = 0.9, 0.2
#: Chance that a line break without mark breaks a word, by the hint given with the line.
BREAK_PRIOR = {True: 0.5, None: 0.05, False: 0.01}
#: Strength of the single-word counts in the likelihood of word pairs.
PAIR_PRIOR = 50.0
#: Pairs of a doubted word and a candidate up to which they are broadcast (some 200 bytes each); above, they are joined.
DOUBTS_BROADCAST = 100_000
#: Pages in one bucket of the numbering of paragraphs.
PAGE_BUCKET = 1024
#: Distinct words and pairs that a worker counts before it passes them on.
COUNTED = 400_000

_SEEN_FOR: dict[str, list[str]] = {}
for _meant, _seen in CONFUSIONS.items():
    for _s in _seen.split():
        _SEEN_FOR.setdefault(_s, []).append(_meant)
#: Every character as what it may be mistaken for, letter by letter: both sides of a confusion come out the same.
_FOLD = str.maketrans({"c": "e", "f": "t", "7": "t", "i": "l", "1": "l", "!": "l", "|": "l", "0": "o", "5": "s", "$": "s", "@": "a", "q": "g", "9": "g", "2": "z", "d": "el", "u": "ll", "m": "rn", "w": "vv", "h": "tl", "b": "tl", "8": "tl", "6": "tl"})
_CORE = re.compile(r"^[^\w@$|!]+|[^\w@$|]+$")
_WORD = re.compile(r"[^\W\d_](?:[\w'’@$|!-]*[\w@$|])?|[0-9@$|!][\w'’@$|!-]*[^\W\d_][\w'’@$|!-]*|@[\w]*")
_PAGE_NUMBER = re.compile(r"[\[(\-–—\s]*(?:p[a@][gq9][ec]\s*)?(?:\d{1,5}|[ivxl1]{1,7})(?:\s*(?:[o0c][ft]|/)\s*\d{1,5})?[\])\-–—\s]*", re.I)
_CASE_TITLE = re.compile(r"^(?:\d+\s+)?[A-Z]{2,6}/\d+/\d+/\d+\s+[-–—]\s+\S.*\s[vV]{1,2}\s.*", re.S)
_TERMINAL = re.compile(r"[.!?:][\"'”’)\]]*$")


def fold(text: str) -> str:
    """Lower case with characters and groups that are mistaken for one another made equal."""
    return text.lower().translate(_FOLD)


_MONTH_SHAPES = {fold(m) for m in MONTHS}


#: What a worker remembers of tokens, up to so many of them.
TOKENS_KEPT = 300_000
_pieces: dict[str, str] = {}
_cores: dict[str, str] = {}


def _piece(token: str) -> str:
    """A token's part of the shape of its line."""
    if re.fullmatch(r"\W*\d+\W*", token):
        return ""
    if re.search(r"\d{2}|/\d", token):
        return re.sub(r"\d+", "#", token.lower())
    bare = fold(re.sub(r"^\W+|\W+$", "", token))
    return "%" if bare in _MONTH_SHAPES else bare


def _remembered(known: dict[str, str], token: str, make) -> str:
    found = known.get(token)
    if found is None:
        if len(known) >= TOKENS_KEPT:
            known.clear()
        found = known[token] = make(token)
    return found


def shape(text: str) -> str:
    """Shape of a line: folded words, with numbers dropped or masked and months masked."""
    return " ".join(p for token in text.split() if (p := _remembered(_pieces, token, _piece)))


def core(token: str) -> str:
    """A token as the counts know it: lower case, without the marks around it; empty where it is no word."""
    return _remembered(_cores, token, _core)


def _core(token: str) -> str:
    bare = _CORE.sub("", token.replace("’", "'")).lower()
    return bare if _WORD.fullmatch(bare) else ""


def misread_groups(seen: str, meant: str) -> tuple[str, ...] | None:
    """The misread groups (seen>meant), as few as there can be, that turn one word into the other; None if none do."""
    most = max(MAX_MISREAD, len(meant) // LETTERS_A_MISREAD)
    border: dict[tuple[int, int], tuple[str, ...]] = {(0, 0): ()}
    while border:
        (i, j), steps = min(border.items(), key=lambda x: (x[0][0] + x[0][1], len(x[1])))
        del border[i, j]
        if i == len(seen) and j == len(meant):
            return steps or None
        moves = [((i + 1, j + 1), steps)] if seen[i : i + 1] == meant[j : j + 1] != "" else []
        if len(steps) < most:
            moves += [((i + n, j + len(m)), (*steps, f"{seen[i : i + n]}>{m}")) for n in (1, 2) if i + n <= len(seen) for m in _SEEN_FOR.get(seen[i : i + n], ()) if meant.startswith(m, j)]
        for at, way in moves:
            if at not in border or len(way) < len(border[at]):
                border[at] = way
    return None


class _CoreNumbers(dict):
    """Numbers of the cores of tokens, # for tokens with digits, 0 for those that are no words."""

    def __init__(self) -> None:
        self.names, self.numbers = [""], {"": 0}

    def __missing__(self, token: str) -> int:
        c = core(token) or ("#" if re.search(r"\d", token) else "")
        if c not in self.numbers:
            self.numbers[c] = len(self.names)
            self.names.append(c)
        self[token] = n = self.numbers[c]
        return n


def _pieces_of(texts: Iterable[str], tokens: int) -> Iterator[list[str]]:
    """Texts in lists of about so many tokens; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) // 6
        if size >= tokens:
            yield part
            part, size = [], 0
    if part:
        yield part


def corpus_counts(corpus: DataFrame, text: str) -> DataFrame:
    """(key, n): how often all texts of a corpus have each word and each pair of neighbouring words (key with a blank).
    Words with digits count as #. Null texts count nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _CoreNumbers()
        for b in batches:
            for texts in _pieces_of(b.t, COUNTED):
                if len(known) > COUNTED:
                    known = _CoreNumbers()
                tokens = [t.split() for t in texts]
                ids = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64)
                if not len(ids):
                    continue
                names, kinds = known.names, len(known.names)
                words = np.bincount(ids, minlength=kinds)
                words[0] = 0  # what is no word
                inner = np.ones(len(ids), bool)
                inner[np.cumsum([len(t) for t in tokens])[:-1] % len(ids)] = False  # no pair over two texts
                left, right = ids[:-1], ids[1:]
                codes, n = np.unique((left * kinds + right)[inner[1:] & (left > 0) & (right > 0)], return_counts=True)
                some = np.flatnonzero(words)
                yield pd.DataFrame({"key": [names[k] for k in some] + [f"{names[x]} {names[y]}" for x, y in zip((codes // kinds).tolist(), (codes % kinds).tolist(), strict=True)], "n": np.concatenate([words[some], n])})

    rows = corpus.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    return rows.mapInPandas(arrow_safe(count), "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _break_keys(a: str, b: str) -> list[str]:
    return [a, b, a + b, f"{a}-{b}", f"{a} {b}"]


def _halves(a_token: str, b_token: str) -> tuple[str, str] | None:
    """The two cores of a line's last and the next line's first token, where they may be halves of one word at all."""
    marked = a_token[-1:] in BREAK_MARKS
    if not marked and not (b_token[:1].islower() and a_token[-1:].isalpha()) or not re.match(r"[\W_]*[^\W\d_]", b_token):
        return None
    a, b = core(a_token.rstrip(BREAK_MARKS)), core(b_token)
    return (a, b) if a and b and not re.search(r"\d{2}", a + b) else None


def broken(a_token: str, b_token: str, hint: bool | None, count, total: float) -> str | None:
    """The word, as it must be written, that a line's last and the next line's first token are the halves of; None where
    they are two words or a compound that keeps its hyphen. count gives the corpus count of a word, pair or best candidate."""
    halves = _halves(a_token, b_token)
    if halves is None:
        return None
    a, b = halves
    mark = a_token[-1:] if a_token[-1:] in BREAK_MARKS else ""
    whole, compound = count(a + b), count(f"{a}-{b}")
    if mark in SURE_MARKS and mark:
        return a + b if whole >= compound else None
    if mark:
        if whole or compound:
            return a + b if whole > compound else None
        return a + b if not (count(a) and count(b)) and b_token[:1].islower() else None
    if not whole:
        return None
    apart = max(count(a), 0.5) / total * (count(f"{a} {b}") + PAIR_PRIOR * max(count(b), 0.1) / total) / (count(a) + PAIR_PRIOR)
    return a + b if whole / total * BREAK_PRIOR[hint] > apart else None


class _Page:
    """The report lines of one page: [(line_id, text, hint)], with the lines around the page."""

    def __init__(self, row) -> None:
        self.lines = [(x["line_id"], x["text"] or "", x["hint"]) for x in row.lines if not x["furniture"]]
        self.before = (row.before["line_id"], row.before["text"] or "", row.before["hint"]) if row.before is not None else None
        self.after = (row.after["line_id"], row.after["text"] or "", row.after["hint"]) if row.after is not None else None

    def breaks(self) -> list[tuple[tuple, tuple]]:
        """Neighbouring lines, those over the page's edges included."""
        chain = [*([self.before] if self.before else []), *self.lines, *([self.after] if self.after else [])]
        return [(x, y) for x, y in zip(chain, chain[1:], strict=False) if x[1].split() and y[1].split()]

    def break_keys(self) -> set[str]:
        """What the counts must be asked for the line breaks, pairs included."""
        return {k for (_, x, _), (_, y, _) in self.breaks() if (h := _halves(x.split()[-1], y.split()[0])) for k in _break_keys(*h)}

    def words(self) -> set[str]:
        """Words in which characters may be misread: all words, and what the halves over the breaks make."""
        out = {c for _, text, _ in self.lines for t in text.split() if (c := core(t))}
        return out | {k for k in self.break_keys() if " " not in k}


def _parts(word: str) -> list[str]:
    return [p for p in re.split(r"-|'s$", word) if p]


def _known(word: str, n) -> float:
    """Count of a word; of a compound or a genitive, the least count of its members if it has none itself."""
    own = n(word)
    if own or not re.search(r"-|'s$", word):
        return own
    return min((n(p) for p in _parts(word)), default=0)


class ScanRepair:
    """Reads noisy lines. lines: columns file, page_no, line_no, line_id, text and a boolean hint (each named below);
    corpus: clean text of the same kind.

    Rows without file, page or line number have no neighbours: they are only searched for misread words, as pages of
    their own. Null and blank lines have no defect. Lines of equal position follow each other by line_id; rows that
    repeat a line_id are taken once. Other columns are ignored. Without lines there is no result; without corpus no
    word is doubted.
    """

    def __init__(self, lines: DataFrame, corpus: DataFrame, corpus_text: str, file: str = "file", page_no: str = "page_no", line_no: str = "line_no", line_id: str = "line_id", text: str = "text", hint: str | None = "ends_with_linebreak_hyphen") -> None:
        c = lambda name: F.col(f"`{name}`")
        base = lines.select(c(file).cast("string").alias("file"), c(page_no).cast("bigint").alias("page"), c(line_no).cast("bigint").alias("line"), c(line_id).alias("line_id"), c(text).cast("string").alias("text"), (c(hint) if hint else F.lit(None)).cast("boolean").alias("hint")).where("line_id is not null")
        self.id_type = base.schema["line_id"].dataType.simpleString()
        placed = F.col("file").isNotNull() & F.col("page").isNotNull() & F.col("line").isNotNull()
        base = base.withColumn("place", F.when(placed, F.lit("")).otherwise(F.col("line_id").cast("string")))
        grouped = base.groupBy("file", "page", "place").agg(F.array_sort(F.collect_set(F.struct("line", "line_id", "text", "hint"))).alias("rows"))
        self.pages = self._furniture(cut(grouped))
        counts = cut(corpus_counts(corpus, corpus_text))
        self.total = float(counts.where("key not like '% %'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) + 1
        self.decoded = self._decode(counts)

    # Furniture ------------------------------------------------------------------------------------------------------

    def _furniture(self, grouped: DataFrame) -> DataFrame:
        """(file, page, place, lines array<line_id, text, hint, furniture>, before, after)."""

        spread = grouped.select("file", "page", "place", F.size("rows").alias("size_"), F.posexplode("rows").alias("k", "r"))

        def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts = [(t or "").strip() for t in b.text]
                edge = [not p and (k < EDGE_LINES or k >= n - EDGE_LINES) for p, k, n in zip(b.place, b.k, b.size_, strict=True)]
                yield b.assign(shape=[shape(t) if not p else "" for t, p in zip(texts, b.place, strict=True)], edge=edge, alone=[bool(e and t and (_PAGE_NUMBER.fullmatch(t) or _CASE_TITLE.match(t))) for t, e in zip(texts, edge, strict=True)])

        shaped_type = f"file string, page bigint, place string, size_ int, k int, line_id {self.id_type}, text string, hint boolean, shape string, edge boolean, alone boolean"
        lines = cut(spread.select("file", "page", "place", "size_", "k", "r.line_id", "r.text", "r.hint").mapInPandas(arrow_safe(shaped), shaped_type))
        shapes = lines.where("shape != ''").select("file", "page", "shape", "edge")
        per_file = shapes.groupBy("shape", "file").agg(F.count_if("edge").alias("edges"), F.count("*").alias("n"), F.countDistinct("page").alias("on"))
        size = grouped.groupBy("file").agg(F.countDistinct("page").alias("pages"))
        many = per_file.join(size.where("file is not null"), "file")
        running = many.groupBy("shape").agg(F.sum("edges").alias("edges"), F.sum("n").alias("n"), F.count_if(F.col("on") > 1).alias("again"), F.max("on").alias("most"), F.count_if(F.col("pages") > 1).alias("could")).where((F.col("edges") >= EDGE_SHARE * F.col("n")) & ((F.col("again") > 1) | (F.col("most") > 2)) & (F.col("again") >= REPEAT_SHARE * F.col("could"))).select("shape", F.lit(True).alias("running"))

        marked = lines.join(running, "shape", "left").withColumn("f", F.col("alone") | F.col("edge") & F.coalesce("running", F.lit(False)))
        back = marked.groupBy("file", "page", "place").agg(F.array_sort(F.collect_list(F.struct("k", "line_id", "text", "hint", "f"))).alias("rows"))
        pages = back.select("file", "page", "place", F.transform("rows", lambda x: F.struct(x.line_id.alias("line_id"), x.text.alias("text"), x.hint.alias("hint"), x.f.alias("furniture"))).alias("lines"))
        own = F.filter("lines", lambda x: ~x.furniture & (F.trim(x.text) != ""))
        pages = cut(pages.withColumns({"first": F.get(own, F.lit(0)), "last": F.get(own, F.size(own) - 1)}))
        whole = pages.where("place = '' and file is not null")
        before = whole.select("file", (F.col("page") + 1).alias("page"), F.lit("").alias("place"), F.col("last").alias("before"))
        after = whole.select("file", (F.col("page") - 1).alias("page"), F.lit("").alias("place"), F.col("first").alias("after"))
        return cut(pages.drop("first", "last").join(before, ["file", "page", "place"], "left").join(after, ["file", "page", "place"], "left").withColumn("pid", F.xxhash64("file", "page", "place")))

    # Words ----------------------------------------------------------------------------------------------------------

    def _decode(self, counts: DataFrame) -> DataFrame:
        """(file, page, place, decoded array<line_id, text, furniture, broken, misread, joined>)."""

        def types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen: Counter = Counter()
                for row in b.itertuples(index=False):
                    seen.update(_Page(row).words())
                yield pd.DataFrame({"key": list(seen), "pages": list(seen.values())})

        asked = cut(self.pages.mapInPandas(arrow_safe(types), "key string, pages bigint").groupBy("key").agg(F.sum("pages").alias("pages")))
        words = counts.where("key not like '% %'")
        # Words that may be mistaken for one another have the same folded form, so candidates are found by an equi-join on
        # it; the misread groups are worked out for those pairs alone.
        folded = F.pandas_udf(lambda w: w.map(fold), "string")
        distinct = asked.join(words, "key", "left").select(F.col("key").alias("seen"), F.coalesce("n", F.lit(0)).alias("seen_n"), folded("key").alias("fold"))
        book = words.select("key", "n", folded("key").alias("fold"))
        met = distinct.join(book, "fold").where((F.col("key") != F.col("seen")) & (F.col("n") > DOUBT_RATIO * F.col("seen_n")))

        def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(w, v, n, list(steps)) for w, v, n in zip(b.seen, b.key, b.n, strict=True) if (steps := misread_groups(w, v)) is not None]
                yield pd.DataFrame(out, columns=["seen", "key", "n", "steps"])

        possible = met.select("seen", "key", "n").mapInPandas(arrow_safe(candidates), "seen string, key string, n bigint, steps array<string>")
        suspects = cut(possible.select("seen", "key", "n", "steps"))
        rates = {}
        for r in suspects.join(asked.withColumnRenamed("key", "seen"), "seen").where("size(steps) = 1").groupBy(F.col("steps")[0].alias("step")).agg(F.sum("pages").alias("n")).collect():  # at most one row per confusion
            rates[r.step] = r.n
        every = sum(rates.values()) + len(rates) + 1
        chance = {s: math.log((n + 1) / every) for s, n in rates.items()}
        floor, total = math.log(1 / every), self.total
        pages, shared = self._doubted(suspects)

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = set()
                for row in b.itertuples(index=False):
                    page = _Page(row)
                    options = _options(row, page, shared)
                    asked_here = page.break_keys()
                    for _, text, _ in page.lines:
                        cores = [core(t) or "#" for t in text.split()]
                        for i, w in enumerate(cores):
                            if w in options:
                                own = [w, *(o[0] for o in options[w])]
                                left = [cores[i - 1], *(o[0] for o in options.get(cores[i - 1], ()))] if i else []
                                right = [cores[i + 1], *(o[0] for o in options.get(cores[i + 1], ()))] if i + 1 < len(cores) else []
                                asked_here.update((*own, *left, *right))
                                asked_here.update(f"{u} {v}" for v in own for u in left)
                                asked_here.update(f"{v} {u}" for v in own for u in right)
                    asked_here.update([p for k in asked_here if " " not in k and ("-" in k or "'" in k) for p in _parts(k)])
                    out.update((row.pid, k) for k in asked_here)
                yield pd.DataFrame(sorted(out), columns=["pid", "key"])

        found = pages.mapInPandas(arrow_safe(pairs), "pid bigint, key string").join(counts, "key").groupBy("pid").agg(F.collect_list(F.struct("key", "n")).alias("known"))
        ready = pages.join(found, "pid", "left")
        kind = self.id_type

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([{"file": r.file, "page": r.page, "place": r.place, "decoded": _decode_page(r, shared, chance, floor, total)} for r in b.itertuples(index=False)], columns=["file", "page", "place", "decoded"])

        return cut(ready.mapInPandas(arrow_safe(decode), f"file string, page bigint, place string, decoded array<struct<line_id:{kind},text:string,seen:string,furniture:boolean,broken:boolean,misread:boolean,goes_on:string>>"))

    def _doubted(self, suspects: DataFrame):
        """The pages and what their words may mean: a broadcast table of all doubted words while it is small, else a column
        that is joined to the pages by their words."""
        if suspects.count() <= DOUBTS_BROADCAST:
            book: dict[str, list] = {}
            for r in suspects.orderBy("seen", "key").collect():  # at most DOUBTS_BROADCAST rows
                book.setdefault(r.seen, []).append((r.key, r.n, list(r.steps)))
            return self.pages, suspects.sparkSession.sparkContext.broadcast(book)

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(row.pid, w) for row in b.itertuples(index=False) for w in _Page(row).words()], columns=["pid", "key"])

        per_word = suspects.groupBy("seen").agg(F.array_sort(F.collect_list(F.struct("key", "n", "steps"))).alias("options")).withColumnRenamed("seen", "key")
        doubts = self.pages.mapInPandas(arrow_safe(words), "pid bigint, key string").join(per_word, "key").groupBy("pid").agg(F.collect_list(F.struct("key", "options")).alias("doubts"))
        return cut(self.pages.join(doubts, "pid", "left")), None

    # Results --------------------------------------------------------------------------------------------------------

    def defects(self) -> DataFrame:
        """(line_id, defect): page_furniture, broken_word, misread; one row per line and defect."""
        d = self.decoded.select(F.explode("decoded").alias("d"))
        kinds = F.array_compact(F.array(F.when(F.col("d.furniture"), F.lit("page_furniture")), F.when(F.col("d.broken"), F.lit("broken_word")), F.when(F.col("d.misread"), F.lit("misread"))))
        return d.select("d.line_id", F.explode(kinds).alias("defect")).distinct()

    def paragraphs(self) -> DataFrame:
        """(file, paragraph, text): each report as continuous paragraphs, numbered from 1 in reading order. A paragraph
        ends with a line that closes a sentence clearly short of the page's width, and around headings."""

        def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for row in b.itertuples(index=False):
                    own = [x for x in row.decoded if not x["furniture"] and (x["seen"] or "").strip()]
                    width = max((len(x["seen"]) for x in own), default=0)
                    texts, ended, glued = [], None, False
                    for x in own:
                        heading = x["seen"].isupper() and len(x["seen"]) < 0.7 * width
                        if texts and not ended and not heading:
                            texts[-1] = texts[-1] + x["text"] if glued else f"{texts[-1]} {x['text']}"
                        else:
                            texts.append(x["text"])
                        glued = x["goes_on"] is not None
                        if not texts[-1]:
                            texts.pop()
                        ended = heading or bool(_TERMINAL.search(x["text"])) and len(x["seen"]) < 0.85 * width
                    opens = bool(own) and not (own[0]["seen"].isupper() and len(own[0]["seen"]) < 0.7 * width)
                    for k, t in enumerate(texts):
                        last = k + 1 == len(texts)
                        out.append((row.file, row.page, k, t, k == 0 and opens, not (last and not ended), last and bool(own) and own[-1]["goes_on"] is not None))
                yield pd.DataFrame(out, columns=["file", "page", "k", "text", "opens", "closed", "glued"])

        found = cut(self.decoded.where("place = '' and file is not null").mapInPandas(arrow_safe(pieces), "file string, page bigint, k int, text string, opens boolean, closed boolean, glued boolean"))
        # Paragraph numbers over pages: what each page adds, summed over buckets of pages first, so a report may be of any length.
        pages = found.groupBy("file", "page").agg(F.count("*").alias("pieces"), F.min_by("opens", "k").alias("opens"), F.max_by("closed", "k").alias("closed"))
        before = pages.select("file", (F.col("page") + 1).alias("page"), F.col("closed").alias("closed_before"))
        pages = pages.join(before, ["file", "page"], "left").withColumn("on", F.col("opens") & ~F.coalesce("closed_before", F.lit(True)))
        pages = pages.withColumns({"adds": F.col("pieces") - F.col("on").cast("int"), "bucket": F.floor(F.col("page") / PAGE_BUCKET)})
        over = Window.partitionBy("file").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = pages.groupBy("file", "bucket").agg(F.sum("adds").alias("adds")).select("file", "bucket", F.coalesce(F.sum("adds").over(over), F.lit(0)).alias("below"))
        inside = Window.partitionBy("file", "bucket").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        starts = pages.withColumn("within", F.coalesce(F.sum("adds").over(inside), F.lit(0))).join(buckets, ["file", "bucket"]).select("file", "page", "on", (F.col("below") + F.col("within")).alias("start"))
        numbered = found.join(starts, ["file", "page"]).withColumn("paragraph", F.col("start") + F.col("k") + F.when(F.col("on"), 0).otherwise(1))
        parts = numbered.groupBy("file", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page", "k", "text", "glued"))).alias("parts"))
        joined = F.aggregate("parts", F.struct(F.lit("").alias("t"), F.lit(True).alias("g")), lambda acc, p: F.struct(F.concat(acc.t, F.when(acc.g, F.lit("")).otherwise(F.lit(" ")), p.text).alias("t"), p.glued.alias("g")))
        return parts.select("file", F.col("paragraph").cast("int").alias("paragraph"), joined.t.alias("text"))


def _options(row, page: _Page, shared) -> dict[str, list[tuple[str, int, list[str]]]]:
    """What the words of a page may mean: (word, count, misread groups) by word."""
    if shared is not None:
        book = shared.value
        return {w: book[w] for w in page.words() if w in book}
    if row.doubts is None:
        return {}
    return {d["key"]: [(o["key"], o["n"], list(o["steps"])) for o in d["options"]] for d in row.doubts}


def _viterbi(words: list[str], options: dict, n, chance: dict, floor: float, total: float) -> list[str]:
    """The likeliest words behind those seen in a line."""

    def states(w: str) -> list[tuple[str, float]]:
        own = [(w, 0.0)]
        return own + [(v, sum(chance.get(s, floor) for s in steps) - 3.0) for v, _, steps in options.get(w, ())]

    def likelihood(u: str | None, v: str) -> float:
        single = max(_known(v, n), 0.002) / total
        if u is None:
            return math.log(single)
        return math.log((n(f"{u} {v}") + PAIR_PRIOR * single) / (_known(u, n) + PAIR_PRIOR))

    best: dict[str, tuple[float, list[str]]] = {}
    for k, w in enumerate(words):
        new: dict[str, tuple[float, list[str]]] = {}
        choices = states(w)
        if len(choices) == 1 and len(best) == 1:  # nothing to decide between
            (score, path), = best.values()
            best = {w: (score, [*path, w])}
            continue
        for v, channel in choices:
            if k == 0:
                new[v] = (likelihood(None, v) + channel, [v])
            else:
                new[v] = max(((score + likelihood(u, v) + channel, [*path, v]) for u, (score, path) in best.items()), key=lambda x: x[0])
        best = new
    return max(best.values(), key=lambda x: x[0])[1] if best else []


def _restore(token: str, seen: str, meant: str) -> str:
    """The token with the word seen in it replaced, its case and marks kept."""
    at = token.lower().replace("’", "'").find(seen)
    if at < 0:
        return token
    old = token[at : at + len(seen)]
    letters = [c for c in old if c.isalpha()]
    new = meant.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else meant.capitalize() if old[:1].isupper() else meant
    return token[:at] + new + token[at + len(seen) :]


def _decode_page(row, shared, chance: dict, floor: float, total: float) -> list[dict]:
    page = _Page(row)
    options = _options(row, page, shared)
    counts = {x["key"]: x["n"] for x in row.known} if row.known is not None else {}
    n = lambda key: counts.get(key, 0)

    def with_candidates(key: str) -> float:
        return n(key) or max((m for _, m, _ in options.get(key, ())), default=0)

    state = {i: {"broken": False, "misread": False, "goes_on": None, "head": 0, "tail": 0} for i, _, _ in page.lines}
    text_of = {i: t for i, t, _ in page.lines}
    joins: dict = {}
    for (i, x, hint), (j, y, _) in page.breaks():
        a_token, b_token = x.split()[-1], y.split()[0]
        hint = None if hint is None else bool(hint)
        whole = broken(a_token, b_token, hint, with_candidates, total)
        if whole is None:
            if i in state and a_token[-1:] in "-‐" and core(a_token.rstrip(BREAK_MARKS)) and re.match(r"[^\W\d_]", b_token):
                state[i]["goes_on"] = a_token  # a compound that keeps its hyphen
            continue
        a = core(a_token.rstrip(BREAK_MARKS))
        meant = whole
        if not n(whole) and whole in options:
            meant = max(options[whole], key=lambda o: math.log(o[1]) + sum(chance.get(s, floor) for s in o[2]))[0]
        first = next((k for k, (p, q) in enumerate(zip(whole, meant, strict=False)) if p != q), len(whole))
        back = next((k for k, (p, q) in enumerate(zip(whole[::-1], meant[::-1], strict=False)) if p != q), len(whole))
        if i in state:
            state[i] |= {"broken": True, "goes_on": whole, "tail": 1}
            state[i]["misread"] |= meant != whole and first < len(a)
        if j in state:
            state[j]["head"] = 1
            state[j]["misread"] |= meant != whole and len(whole) - back > len(a)
        # Each half is restored where it stands; the misread group belongs to the half that holds it.
        left = meant[: len(a)] if first >= len(a) else meant[: len(meant) - (len(whole) - len(a))]
        joins[i] = (*joins.get(i, (None, None))[:1], (a_token, a, left))
        joins[j] = ((b_token, whole[len(a) :], meant[len(left) :]), *joins.get(j, (None, None))[1:])
    out = []
    for x in row.lines:
        i, seen, furniture = x["line_id"], x["text"] or "", bool(x["furniture"])
        s = state.get(i)
        if furniture or s is None or not seen.strip():
            out.append({"line_id": i, "text": "" if furniture else seen, "seen": seen, "furniture": furniture, "broken": False, "misread": False, "goes_on": None})
            continue
        tokens = text_of[i].split()
        inner = range(s["head"], len(tokens) - s["tail"])
        fixed = list(tokens)
        if any(core(tokens[k]) in options for k in inner):
            seen_words = [core(tokens[k]) or "#" for k in inner]
            for k, u, v in zip(inner, seen_words, _viterbi(seen_words, options, n, chance, floor, total), strict=True):
                if u != v:
                    fixed[k] = _restore(tokens[k], u, v)
                    s["misread"] = True
        head, tail = (*joins.get(i, ()), None, None)[:2]
        if s["head"] and head:
            fixed[0] = _restore(fixed[0], head[1], head[2])
        if s["tail"] and tail:
            fixed[-1] = _restore(tokens[-1].rstrip(BREAK_MARKS), tail[1], tail[2])
        out.append({"line_id": i, "text": " ".join(fixed), "seen": seen, "furniture": False, "broken": s["broken"], "misread": s["misread"], "goes_on": s["goes_on"]})
    return out
