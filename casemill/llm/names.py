"""Variant spellings of names typed by people.

A name is cut into words; they are blocked by phonetic codes, from the front and from the back, compared within their
blocks by Jaro-Winkler similarity (and edit distance, which decides between near scores), and generic words and given
names go through tables of abbreviations and nicknames. Accepted pairs are clustered by connected components. Work in
Python is done once for each distinct name or word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.graph import components
from casemill.runtime import arrow_safe, cut, spread

#: Generic words of company names with their abbreviations and misspellings.
NICKNAMES = {
    "pharma": "pharma pharm pharms pharmaceutical pharmaceuticals pharmac pharmaceuticls pharmaceuticels",
    "biosciences": "biosciences bioscience biosci bioscis biosc biosciance",
    "therapeutics": "therapeutics therapeutic thera theraputics therap therapy",
    "laboratories": "laboratories laboratory labs lab laboratorys",
    "healthcare": "healthcare health hcare care",
    "consumer": "consumer consumers cons",
    "vaccines": "vaccines vaccine vacc vaccs",
    "associates": "associates associate assoc assocs",
}
#: Given names with their short forms.
GIVEN_NAMES = {
    "alexander": "alex", "andrew": "andy", "anthony": "tony", "catherine": "cathy katherine kate", "charles": "charlie", "christopher": "chris", "daniel": "dan danny", "david": "dave", "edward": "ed ted", "elizabeth": "liz beth betty",
    "james": "jim jimmy", "jennifer": "jenny jen", "john": "jack johnny", "joseph": "joe", "margaret": "maggie peggy", "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "patricia": "pat trish", "peter": "pete",
    "richard": "dick rick", "robert": "bob rob bobby", "samuel": "sam", "stephen": "steve steven", "susan": "sue", "thomas": "tom", "timothy": "tim", "william": "bill will billy",
}
#: Words that say nothing about which company is meant.
EMPTY_WORDS = frozenset("ltd limited plc inc incorporated gmbh uk co company corp corporation llc ag sa nv bv the and v by director voluntary admission anonymous authority inter complainant of group holdings".split())
#: Words of known names that go to every worker at once (some 400 bytes each); more go in blocks, with the same rows.
INDEX_NAMES = 50_000
#: Most edits between the tokens of two spellings of one name.
NAME_EDITS = 2
#: Least Jaro-Winkler similarity of two spellings of one name.
NAME_LIKE = 0.9
#: Share of the rows that one reading of a shortened name must have.
DOMINANT = 0.9
#: Length up to which strings are compared by deletions; pieces of longer ones, of which NAME_EDITS edits leave one whole.
SHORT_NAME, PIECES = 24, 2 * NAME_EDITS + 1

_CODES = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
_GIVEN = {w: k for k, ws in GIVEN_NAMES.items() for w in ws.split()}
_GENERIC = {w: k for k, ws in NICKNAMES.items() for w in ws.split()}
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[/;+|]|\s&\s|\sand\s|\n")


def phonetic(token: str) -> str:
    """First letter and the first two different consonant codes after it."""
    out, last = "", _CODES.get(token[:1], "")
    for c in token[1:]:
        code = _CODES.get(c, "")
        if code and code != last:
            out += code
            if len(out) == 2:
                break
        if c not in "hw":
            last = code
    return (token[:1] + out).ljust(3, "0")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (b[j] for j in range(len(b)) if used[j]), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def plain(name: str) -> str:
    """Lower case without accents and apostrophes; dotted initials joined."""
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    s = re.sub(r"[’'`´]", "", s)
    return re.sub(r"\b(?:[a-z]\.\s?){2,}", lambda m: re.sub(r"[^a-z]", "", m[0]) + " ", s)


def _name_tokens(s: str) -> list[str]:
    return [t for t in _WORD.findall(s) if t not in EMPTY_WORDS and t not in _GENERIC]


class Words:
    """One block of the words that typed words are compared with: those of known names, and foreign ones."""

    def __init__(self, words: list[tuple[str, bool]]) -> None:
        self.foreign = dict(words)
        self.blocks: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        self.prefixes: dict[str, list[str]] = defaultdict(list)
        for word, foreign in words:
            entry = (word, _letters(word))
            self.blocks["f", phonetic(word)[:2]].append(entry)
            self.blocks["b", phonetic(word[::-1])[:2]].append(entry)
            if not foreign:
                for n in range(5, len(word)):
                    self.prefixes[word[:n]].append(word)

    def near(self, token: str) -> list[tuple[int, float, str, bool]]:
        """(edits, similarity, word, foreign?) of the words of this block with the fewest edits; 3 edits stand for a longer
        word that begins like the token."""
        foreign = self.foreign.get(token)
        if foreign is not None:
            return [(0, 1.0, token, foreign)]
        if len(token) < 4:
            return []
        most, own = 2 if len(token) >= 7 else 1, _letters(token)
        found: list[tuple[int, float, str, bool]] = []
        for word, letters in {*self.blocks.get(("f", phonetic(token)[:2]), ()), *self.blocks.get(("b", phonetic(token[::-1])[:2]), ())}:
            if abs(len(word) - len(token)) > most or (letters ^ own).bit_count() > 2 * most:
                continue
            d = edits(token, word, most)
            if d <= most and (score := jaro_winkler(token, word)) >= 0.85:
                if d < most:
                    found, most = [], d
                found.append((d, score, word, self.foreign[word]))
        return found or [(3, 0.0, word, False) for word in self.prefixes.get(token, ())]


def _letters(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 31)
    return out


def decided(found: list[tuple[int, float, str, bool]]) -> tuple[int, list[str]]:
    """(edits, known words that a typed word may mean) from what is near it in all blocks; 9 where it means none."""
    if not found:
        return 9, []
    least = min(f[0] for f in found)
    near = sorted((-score, word, foreign) for d, score, word, foreign in found if d == least)
    if least < 3 and (near[0][2] or least > 1 and any(foreign for *_, foreign in near)):
        return 9, []
    own = [(score, word) for score, word, foreign in near if not foreign]
    if 0 < least < 3 and len(own) > 1 and own[1][0] - own[0][0] > 0.01:
        return least, [own[0][1]]
    return least, [word for _, word in own]


def cut_name(name: str) -> tuple[list[tuple[int, str, str | None]], list[tuple[int, str]]]:
    """Words (part of the name, word, the word joined with the next if only a blank or hyphen is between) and generic words
    (part, word) of a typed name."""
    words: list[tuple[int, str, str | None]] = []
    said: list[tuple[int, str]] = []
    for part, text in enumerate(_PART.split(plain(name))):
        end, fresh = 0, True
        for m in _WORD.finditer(text):
            t, gap = m[0], text[end : m.start()]
            close, end = not fresh and re.fullmatch(r"[\s-]{1,2}", gap) is not None, m.end()
            fresh = t in _GENERIC or t in EMPTY_WORDS
            if t in _GENERIC:
                said.append((part, _GENERIC[t]))
            if fresh:
                continue
            if close:
                words[-1] = (*words[-1][:2], words[-1][1] + t)
            words.append((part, t, None))
    return words, said


def mentioned(words: list, said: list, hits: list) -> list[tuple[str, object, int]]:
    """The accepted pairs (mention, entity, edits) of one name.

    words: rows of k, part, token, joined, d, means, ones, initial for each word and each word joined with the next; said:
    generic words by part; hits: rows of entity, needs, got for the known names of several words of which enough may be
    there, got being rows of x, k, joined. A mention is the words meant, with the generic words that decide.
    """
    single = {w["k"]: w for w in words if not w["joined"]}
    joined = {w["k"]: w for w in words if w["joined"]}
    units, k, last = [], 0, max(single, default=-1)
    while k <= last:  # words that were broken in two
        both = joined.get(k)
        whole = both is not None and both["d"] < 3 and both["d"] <= min(single[k]["d"], single[k + 1]["d"])
        units.append(both if whole else single[k])
        k += 2 if whole else 1
    place = {(u["k"], u["joined"]): n for n, u in enumerate(units)}
    out, used = [], set()
    # Names of several words: two of them must be there.
    several = []
    for h in hits:
        got: dict[str, int] = {}
        for g in h["got"]:
            n = place.get((g["k"], g["joined"]))
            if n is not None:
                got[g["x"]] = min(n, got.get(g["x"], n))
        several.append((-len(got), str(h["entity"]), h, got))
    for _, _, h, got in sorted(several, key=lambda x: x[:2]):
        free = {n for n in got.values() if n not in used}
        if len(free) >= max(2, h["needs"] - 1) and max(free) - min(free) < h["needs"] + 1:
            out.append((" ".join(sorted({units[n]["token"] for n in free})), h["entity"], sum(units[n]["d"] for n in free)))
            used |= free
    for n, u in enumerate(units):
        if n in used:
            continue
        ones, mention = list(u["ones"] if u["ones"] is not None else ()), u["token"]
        if len(ones) > 1 or sum(o["n"] for o in ones) > 1:  # several known names have the word: generic words decide
            here = {word for part, word in said if part == u["part"]}
            mention = " ".join((u["token"], *sorted(here)))
            fit = [(len(here & set(o["said"])), o) for o in ones]
            most = max(f for f, _ in fit)
            ones = [o for f, o in fit if f == most and most]
        if sum(o["n"] for o in ones) == 1:
            out.append((mention, ones[0]["entity"], u["d"]))
        elif u["d"] == 9 and u["initial"] is not None:
            out.append((mention, u["initial"], 0))
    return out


class KnownNames:
    """What typed names are compared with, as tables: no part of it has to fit into one machine.

    facts: (entity, words, said, letters) for each known name: its distinctive words, its generic words, its initials.
    words: (token, foreign) for every word of theirs and every foreign word. Foreign is a word made of a beginning and an
    ending that known names combine freely, but that is not known: such a name belongs to somebody else, however near it
    comes to a known one.
    """

    def __init__(self, known: DataFrame) -> None:
        listed = known.where("entity_id is not null and name is not null").select(F.col("entity_id").alias("entity"), F.col("name").cast("string").alias("name")).distinct()
        self.kind = listed.schema["entity"].dataType.simpleString()

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for entity, name in zip(b.entity, b.name, strict=True):
                    every = _WORD.findall(plain(name))
                    own = list(dict.fromkeys(t for t in every if t not in EMPTY_WORDS and t not in _GENERIC))
                    out.append((entity, own, sorted({_GENERIC[t] for t in every if t in _GENERIC}), "".join(t[0] for t in own)))
                yield pd.DataFrame(out, columns=["entity", "words", "said", "letters"])

        self.facts = cut(listed.mapInPandas(arrow_safe(read), f"entity {self.kind}, words array<string>, said array<string>, letters string"))
        parts = self.facts.select(F.explode("words").alias("token")).distinct()
        self.words = cut(parts.select("token", F.lit(False).alias("foreign")).union(self._foreign(parts).join(parts, "token", "left_anti").select("token", F.lit(True))))

    def _foreign(self, parts: DataFrame) -> DataFrame:
        at = F.explode(F.sequence(F.lit(3), F.length("token") - 3)).alias("n")
        split = parts.where("length(token) >= 6").select("token", at).select(F.expr("substring(token, 1, n)").alias("head"), F.expr("substring(token, n + 1)").alias("tail"))
        heads = split.where("length(head) >= 4").groupBy("head").agg(F.count_distinct(F.substring("tail", 1, 1)).alias("ways")).where("ways >= 3").select("head")
        tails = split.where("length(tail) >= 4").groupBy("tail").agg(F.count_distinct(F.expr("right(head, 1)")).alias("ways"), F.count("*").alias("n")).where("ways >= 4 and n >= 5").select("tail")
        # Only the shortest of the beginnings that begin alike, and of the endings that end alike.
        shorter = heads.select("head", F.explode(F.expr("transform(sequence(4, length(head)), n -> substring(head, 1, n))")).alias("as"))
        heads = cut(shorter.join(heads.select(F.col("head").alias("as")), "as").groupBy("head").agg(F.count("*").alias("n")).where("n = 1").select("head"))
        shorter = tails.select("tail", F.explode(F.expr("transform(sequence(4, length(tail)), n -> right(tail, n))")).alias("as"))
        tails = cut(shorter.join(tails.select(F.col("tail").alias("as")), "as").groupBy("tail").agg(F.count("*").alias("n")).where("n = 1").select("tail"))
        spark, made = parts.sparkSession, None
        for block in _blocks(tails, "tail"):
            ends = spark.sparkContext.broadcast([r.tail for r in block.collect()])  # at most about INDEX_NAMES

            def combine(batches: Iterator[pd.DataFrame], ends=ends) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for head in b["head"]:
                        yield pd.DataFrame({"token": [head + e for e in ends.value]})

            one = heads.mapInPandas(arrow_safe(combine), "token string")
            made = one if made is None else made.union(one)
        return made.distinct()

    def meanings(self, tokens: DataFrame) -> DataFrame:
        """(token, d, means, ones, initial): for each distinct typed token the known words it may mean, the known names that
        consist of one of them (by their generic words; n is 2 for several), and the name whose initials it is."""
        spark, near = tokens.sparkSession, None
        for block in _blocks(self.words, "token"):
            words = spark.sparkContext.broadcast(sorted((r.token, r.foreign) for r in block.collect()))  # at most about INDEX_NAMES

            def compare(batches: Iterator[pd.DataFrame], words=words) -> Iterator[pd.DataFrame]:
                book = Words(words.value)
                for b in batches:
                    yield pd.DataFrame({"token": b.token, "found": [[{"d": d, "s": s, "w": w, "f": f} for d, s, w, f in book.near(t)] for t in b.token]})

            one = tokens.mapInPandas(arrow_safe(compare), "token string, found array<struct<d:int,s:double,w:string,f:boolean>>")
            near = one if near is None else near.union(one)
        near = near.groupBy("token").agg(F.flatten(F.collect_list("found")).alias("found"))

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [decided([(x["d"], x["s"], x["w"], x["f"]) for x in found]) for found in b.found]
                yield pd.DataFrame({"token": b.token, "d": [d for d, _ in got], "means": [m for _, m in got]})

        said = near.mapInPandas(arrow_safe(decide), "token string, d int, means array<string>")
        said = cut(said)
        entity = F.struct(F.col("said"), F.when(F.col("low") == F.col("high"), 1).otherwise(2).alias("n"), F.col("low").alias("entity"))
        one_word = self.facts.where("size(words) = 1").select(F.col("words")[0].alias("x"), "said", "entity")
        ones = said.select("token", F.explode("means").alias("x")).join(one_word, "x").groupBy("token", "said").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).groupBy("token").agg(F.collect_list(entity).alias("ones"))
        initials = self.facts.where("size(words) >= 3").groupBy(F.col("letters").alias("token")).agg(F.min("entity").alias("initial"), F.max("entity").alias("high")).where("initial = high").drop("high")
        return said.join(ones, "token", "left").join(initials, "token", "left")

    def hits(self, spread: DataFrame) -> DataFrame:
        """(name, hits): the known names of several words of which a typed name may have enough."""
        parts = self.facts.where("size(words) > 1").select(F.explode("words").alias("x"), "entity", F.concat_ws(" ", "words").alias("whole"), F.size("words").alias("needs"))
        met = spread.select("name", "k", "joined", F.explode("means").alias("x")).join(parts, "x").groupBy("name", "entity", "whole", "needs").agg(F.collect_list(F.struct("x", "k", "joined")).alias("got"))
        return met.where("size(array_distinct(got.x)) >= greatest(2, needs - 1)").groupBy("name").agg(F.collect_list(F.struct("entity", "needs", "got")).alias("hits"))


def _blocks(df: DataFrame, column: str) -> Iterator[DataFrame]:
    """df in parts of about INDEX_NAMES rows, at least one."""
    n = max(1, -(-df.count() // INDEX_NAMES))
    for block in range(n):
        yield df.where(F.pmod(F.xxhash64(column), F.lit(n)) == block)


def find_entities(names: DataFrame, known: DataFrame) -> DataFrame:
    """One row (field, record_id, entity_id) per record, field and known name that is meant there, however spelled.

    Typed names are cut into words, each distinct word is compared with the known words of its phonetic blocks, in blocks
    of INDEX_NAMES words, and the nearest over all blocks are kept; so the rows are the same for every INDEX_NAMES. Of the
    accepted pairs of a mention and a known name the nearest one stands for a mention (equally near ones: none), and a
    mention means the known name of its connected component. names: field, record_id, name; known: entity_id of any type,
    name. Null or blank names, null ids and names that mean nothing known give no row; a name that several known ones fit
    equally well gives none of them; words of fewer than four letters must be equal; repeated rows give one row. Empty
    tables give no rows.
    """
    rows = names.where("record_id is not null and name is not null").select("field", "record_id", F.col("name").cast("string").alias("name"))
    book = KnownNames(known)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [cut_name(name) for name in b.name]
            yield pd.DataFrame({
                "name": b.name,
                "words": [[{"k": k, "part": p, "token": t, "whole": w} for k, (p, t, w) in enumerate(words)] for words, _ in got],
                "said": [[{"part": p, "word": w} for p, w in said] for _, said in got],
            })

    typed = cut(spread(rows.select("name").distinct(), "name").mapInPandas(arrow_safe(read), "name string, words array<struct<k:int,part:int,token:string,whole:string>>, said array<struct<part:int,word:string>>").where("size(words) > 0"))
    each = typed.select("name", F.explode("words").alias("w"))
    single = each.select("name", "w.k", "w.part", "w.token", F.lit(False).alias("joined"))
    every = single.union(each.where("w.whole is not null").select("name", "w.k", "w.part", "w.whole", F.lit(True)))
    means = cut(book.meanings(spread(every.select("token").distinct(), "token")))
    met = cut(every.join(means, "token"))
    grouped = met.groupBy("name").agg(F.collect_list(F.struct("k", "part", "token", "joined", "d", "ones", "initial")).alias("words"))
    whole = grouped.join(typed.select("name", "said"), "name").join(book.hits(met), "name", "left")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, words, said, hits in zip(b.name, b.words, b.said, b.hits, strict=True):
                out += [(name, *m) for m in mentioned(list(words), [(x["part"], x["word"]) for x in said], [] if hits is None else list(hits))]
            yield pd.DataFrame(out, columns=["name", "mention", "entity", "edits"])

    found = cut(whole.mapInPandas(arrow_safe(resolve), f"name string, mention string, entity {book.kind}, edits int"))
    nearest = found.groupBy("mention", "entity").agg(F.min("edits").alias("edits")).groupBy("mention").agg(F.min(F.struct("edits", "entity")).alias("best"), F.collect_list("edits").alias("all"))
    links = nearest.where("size(filter(all, e -> e = best.edits)) = 1").select("mention", F.concat(F.lit("#"), F.col("best.entity").cast("string")).alias("node"))
    # The node of a known name sorts before every mention, so it names its component.
    clusters = components(links, "mention", "node").where("component like '#%' and node not like '#%'").select(F.col("node").alias("mention"), F.substring("component", 2, 1 << 20).cast(book.kind).alias("entity_id"))
    meant = found.select("name", "mention").join(clusters, "mention").select("name", "entity_id").distinct()
    return rows.join(meant, "name").select("field", "record_id", "entity_id").distinct()


_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def deletion_hashes(words: list[str]) -> np.ndarray:
    """Hashes of what is left of each of some words of one length after NAME_EDITS = 2 deletions or fewer, a row a word."""
    m, n = len(words), len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64) + np.uint64(1)
    powers = np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)
    u, v = np.uint64(_UNDO), np.uint64(_UNDO * _UNDO % (1 << 64))
    first, second = np.triu_indices(n, 1)
    with np.errstate(over="ignore"):
        at = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(points * powers, axis=1)], axis=1)
        whole = at[:, -1:]
        one = at[:, :-1] + (whole - at[:, 1:]) * u
        two = at[:, first] + (at[:, second] - at[:, first + 1]) * u + (whole - at[:, second + 1]) * v
    return np.concatenate([whole, one, two], axis=1)


def piece_keys(s: str) -> Iterator[str]:
    """Keys of a long string: it in PIECES, of which two edits leave one whole, and what may equal a piece of another."""
    n = len(s)
    cuts = lambda m: [m * k // PIECES for k in range(PIECES + 1)]
    found = set()
    for m in range(n - NAME_EDITS, n + NAME_EDITS + 1):
        at = cuts(m)
        for k in range(PIECES):
            for start in range(max(0, at[k] - NAME_EDITS), min(n - (at[k + 1] - at[k]), at[k] + NAME_EDITS) + 1):
                found.add(f"{m}|{k}|{s[start : start + at[k + 1] - at[k]]}")
    return iter(found)


def codes(words: str) -> tuple[str, str]:
    """Phonetic codes of sorted words, from their beginnings and from their ends."""
    each = words.split()
    return " ".join(sorted(phonetic(t)[:2] for t in each)), " ".join(sorted(phonetic(t[::-1])[:2] for t in each))


def block_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index, key): strings within NAME_EDITS that agree in a phonetic code, from the front or the back, share a key."""
    at, keys = [], []
    by_length: dict[int, list[int]] = defaultdict(list)
    for n, w in enumerate(words):
        by_length[len(w)].append(n)
    for size, some in by_length.items():
        if size <= SHORT_NAME + NAME_EDITS:
            left = deletion_hashes([words[n] for n in some])
            hashes = [np.unique(row) for row in left]
        else:
            hashes = [np.empty(0, np.uint64) for _ in some]
        if size > SHORT_NAME:
            hashes = [np.concatenate([h, np.array([xxhash.xxh64_intdigest(k) for k in piece_keys(words[n])], np.uint64)]) for h, n in zip(hashes, some, strict=True)]
        for n, h in zip(some, hashes, strict=True):
            for side, code in zip("fb", codes(words[n]), strict=True):
                keys.append(h ^ np.uint64(xxhash.xxh64_intdigest(f"{side}|{code}")))
                at.append(np.full(len(h), n))
    return np.concatenate(at), np.concatenate(keys).view(np.int64)


def generic_groups(sets: list[tuple[tuple[str, ...], int]]) -> dict[tuple[str, ...], tuple[str, ...]]:
    """The group of each set of generic words that stands with one name, by how often it does. Different words are
    different groups; a set of several goes to the most frequent one of them that stands alone too; no word at all goes to
    the group that has DOMINANT of the rows with words, if one has."""
    n = dict(sets)
    out = {}
    for s in n:
        inside = [(n[w,], w) for w in s if len(s) > 1 and (w,) in n]
        out[s] = (max(inside)[1],) if inside else s
    total: Counter = Counter()
    for s, k in sets:
        if s:
            total[out[s]] += k
    if total:
        best, k = max(total.items(), key=lambda x: (x[1], x[0]))
        if () in n and k >= DOMINANT * sum(total.values()):
            out[()] = best
    return out


def cluster_names(names: DataFrame, column: str) -> DataFrame:
    """(form, entity, n): every spelling of one name, with the smallest spelling of its cluster and its number of rows.

    Works without a list of known names. A spelling is reduced to its sorted distinctive words (words broken in two joined
    where the whole is the more frequent, given names by GIVEN_NAMES). Two of them meet where they agree in the phonetic
    codes of their sorted words, from the front or the back, and in what is left after deletions. Every such pair within
    NAME_EDITS and Jaro-Winkler NAME_LIKE is accepted, but for words cut off: a word with which a longer one begins that is
    written as often is near only to whole words written still more often. Accepted pairs are clustered by connected
    components: first those of each block with its most frequent spelling, then all between different components in
    one block. Truncated words, acronyms and initials go to the cluster that has DOMINANT of the rows they may stand for,
    and a cluster is split by its generic words (generic_groups). Null and blank names are left out.
    """
    forms = cut(names.select(F.trim(F.col(f"`{column}`").cast("string")).alias("form")).where("form is not null and form != ''").groupBy("form").agg(F.count("*").alias("n")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for form, n in zip(b.form, b.n, strict=True):
                words, said = cut_name(form)
                tokens = [_GIVEN.get(t, t) for _, t, _ in words] or sorted(set(_WORD.findall(plain(form))))
                wholes = [{"k": k, "a": t, "b": words[k + 1][1], "whole": w} for k, (_, t, w) in enumerate(words) if w]
                out.append((form, n, tokens, wholes, sorted({w for _, w in said})))
            yield pd.DataFrame(out, columns=["form", "n", "tokens", "wholes", "said"])

    typed = cut(spread(forms, "form").mapInPandas(arrow_safe(read), "form string, n bigint, tokens array<string>, wholes array<struct<k:int,a:string,b:string,whole:string>>, said array<string>"))
    # Words broken in two: the whole is written more often than either piece.
    count = typed.select(F.explode("tokens").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    split = typed.select("form", F.explode("wholes").alias("w")).select("form", "w.*")
    of = lambda c: count.select(F.col("t").alias(c), F.col("n").alias(f"n_{c}"))
    broken = split.select("a", "b", "whole").distinct().join(of("whole"), "whole").join(of("a"), "a").join(of("b"), "b").where("n_whole > n_a and n_whole > n_b").select("a", "b")
    mended = split.join(broken, ["a", "b"]).groupBy("form").agg(F.collect_set("k").alias("ks"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for form, n, tokens, said, ks in zip(b.form, b.n, b.tokens, b.said, b.ks, strict=True):
                own, taken, joins = [], -1, set() if ks is None else set(ks)
                for k, t in enumerate(tokens):
                    if k == taken:
                        continue
                    if k in joins:
                        t, taken = t + tokens[k + 1], k + 1
                    own.append(t)
                own = list(dict.fromkeys(own))
                out.append((form, n, " ".join(sorted(own)), "".join(t[0] for t in own), list(said)))
            yield pd.DataFrame(out, columns=["form", "n", "words", "letters", "said"])

    coded = cut(typed.join(mended, "form", "left").mapInPandas(arrow_safe(reduce), "form string, n bigint, words string, letters string, said array<string>"))
    sets = cut(coded.groupBy("words").agg(F.sum("n").alias("n")).withColumn("id", F.xxhash64("words")))
    # A word with which a longer one begins that is written as often is cut off; it is misspelt where it is near a whole
    # word that is written still more often.
    starts = F.explode(F.expr("transform(sequence(5, length(words) - 1), k -> substring(words, 1, k))")).alias("short")
    cut_off = sets.where("instr(words, ' ') = 0 and length(words) > 5").select(starts, "words", "n")
    shortened = cut(cut_off.groupBy("short").agg(F.max("n").alias("most")).join(sets.select(F.col("words").alias("short"), "n"), "short").where("most >= n").select(F.col("short").alias("words"), "most"))
    sides = cut(sets.join(shortened, "words", "left"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                at, keys = block_keys(part.words.tolist())
                yield pd.DataFrame({"key": keys, "id": part.id.to_numpy()[at], "n": part.n.to_numpy()[at], "cut": part.cut.to_numpy()[at]})

    in_block = Window.partitionBy("key")
    top, size = F.min(F.struct("cut", (-F.col("n")).alias("n"), "id")).over(in_block), F.count("*").over(in_block)
    keys = spread(sides.select("words", "id", "n", F.expr("most is not null").alias("cut")), "words").mapInPandas(arrow_safe(keyed), "key bigint, id bigint, n bigint, cut boolean")
    blocks = cut(keys.select("key", "id", top["id"].alias("top"), size.alias("size")).where("size > 1").drop("size"))
    side = lambda s: sides.select(F.col("id").alias("id" if s == "x" else "other"), F.col("words").alias(s), F.col("n").alias(f"n_{s}"), F.col("most").alias(f"most_{s}"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b.x, b.y, strict=True):
                if edits(x, y, NAME_EDITS) <= NAME_EDITS and jaro_winkler(x, y) >= NAME_LIKE and any(a == c for a, c in zip(codes(x), codes(y), strict=True)):
                    out.append((x, y))
            yield pd.DataFrame(out, columns=["x", "y"])

    def accepted(met: DataFrame) -> DataFrame:
        both = met.distinct().join(side("x"), "id").join(side("y"), "other")
        pairs = both.where("most_x is null and (most_y is null or n_x > most_y) or most_y is null and n_y > most_x").select("x", "y")
        return cut(spread(pairs, "x", "y").mapInPandas(arrow_safe(near), "x string, y string"))

    own = sets.select(F.col("words").alias("x"), F.col("words").alias("y"))
    links = accepted(blocks.where("id != top").select("id", F.col("top").alias("other")))
    linked = cut(components(links.union(own), "x", "y"))
    # Pairs inside one component would change nothing. Where a block holds several components, all pairs between them meet.
    part = linked.select(F.xxhash64("node").alias("id"), F.xxhash64("component").alias("part"))
    mixed = blocks.select("key", "id").join(part, "id").select("*", F.min("part").over(in_block).alias("low"), F.max("part").over(in_block).alias("high")).where("low < high")
    mixed = cut(mixed.select("key", "id", "part"))
    between = mixed.join(mixed.select("key", F.col("id").alias("other"), F.col("part").alias("part_b")), "key").where("part < part_b").select("id", "other")
    first = cut(components(accepted(between).union(linked), "x", "y").withColumnRenamed("node", "words").join(sides, "words"))
    # A word cut off that has links after all is misspelt, and stands for nothing longer.
    misspelt = first.where("most is not null").join(first.groupBy("component").count().where("count > 1"), "component").select("words")

    # Shortened names: what each may stand for, by cluster.
    whole = cut_off.join(shortened.join(misspelt, "words", "left_anti"), "words", "left_anti").join(misspelt.withColumnRenamed("words", "short"), "short", "left_anti").join(first.select("words", "component"), "words").select("short", "component", "n")
    initial = first.where("instr(words, ' ') > 0").select(F.explode(F.expr("transform(sequence(0, size(split(words, ' ')) - 1), k -> array_join(array_sort(transform(split(words, ' '), (w, i) -> if(i = k, substring(w, 1, 1), w))), ' '))")).alias("short"), "component", "n")
    acronym = coded.where("length(letters) >= 3 and instr(words, ' ') > 0").select(F.col("letters").alias("short"), "words", "n").join(first.select("words", "component"), "words").select("short", "component", "n")
    stands = whole.union(initial).union(acronym).groupBy("short", "component").agg(F.sum("n").alias("n"))
    short = first.select(F.col("words").alias("short"), F.col("component").alias("own"), F.col("n").alias("n_own"))
    meant = short.join(stands, "short").where("own != component").groupBy("short", "own", "n_own").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("best"))
    longer = meant.where(F.col("best.n") >= F.col("all") * F.lit(DOMINANT)).where("best.n >= n_own").select(F.col("own").alias("x"), F.col("best.component").alias("y"))
    kept = first.select("component").distinct().select(F.col("component").alias("x"), F.col("component").alias("y"))
    second = components(longer.union(kept), "x", "y").select(F.col("node").alias("one"), F.col("component").alias("name"))
    placed = cut(coded.join(first.select("words", F.col("component").alias("one")), "words").join(second, "one").select("form", "n", "name", "said"))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, sets_ in zip(b["name"], b.sets, strict=True):
                made = generic_groups([(tuple(x["said"]), x["n"]) for x in sets_])
                out += [(name, list(s), list(g)) for s, g in made.items()]
            yield pd.DataFrame(out, columns=["name", "said", "group"])

    # A name has at most as many sets as there are sets of the words of NICKNAMES.
    said = placed.groupBy("name", "said").agg(F.sum("n").alias("n")).groupBy("name").agg(F.collect_list(F.struct("said", "n")).alias("sets"))
    grouped = cut(placed.join(said.mapInPandas(arrow_safe(groups), "name string, said array<string>, group array<string>"), ["name", "said"]).select("form", "n", "name", "group"))
    entity = grouped.groupBy("name", "group").agg(F.min("form").alias("entity"))
    return grouped.join(entity, ["name", "group"]).select("form", "entity", "n")


__all__ = ["KnownNames", "cluster_names", "find_entities"]
