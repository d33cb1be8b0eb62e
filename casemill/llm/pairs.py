"""Broken prompt and response pairs: empty, truncated, refusing, copying and foreign answers.

A response is compressed with its prompt as zstandard dictionary: what the prompt already says costs almost nothing,
so few bytes per byte mean a copy; every response is measured. Language comes from scripts and dictionaries of function words,
refusal from a dictionary of phrases. Whether a text may end where it ends is read off a terminal-context model, counted
over all responses: how often the shapes of two tokens stand before a boundary, and how often before more of the
sentence. Texts are read once; the model stays a table and is joined to the ends of the responses.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe, cut

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a of and to in was that is for it with as on by at from this which not be are were had has its his her their would could what did does there been have an or before without",
    "de": "der die das und den dem des ein eine einer eines einem nicht ist war wurde wurden von zu zum zur mit auf für im dass als auch sich bei nach aus werden worden wird hat hatte seien sei kein keine oder über",
    "fr": "le la les des du et un une dans est était que qui pour par sur pas ne avec au aux ce cette ces sous avait avaient été sont ont son sa ses se plus ou",
    "it": "il lo gli della dello delle degli dei del che non è era di da con per sul sulla nella nel una uno sono stato stata avrebbe abbia ha alla al dal dalla come anche la un in e le si",
    "es": "el los las del que no es era y por para con una uno su sus al como fue fueron había ha haber sobre según este esta sin pero lo más la un de en si nadie o",
    "pt": "o os as do da dos das que não é era e por para com uma um seu sua ao à como foi foram havia sobre segundo este esta sem mas mais no na de em a",
    "pl": "i w na z do nie się że jest to oraz przez dla był była było od po jak ale który która które został została za o są",
    "sv": "och att det som en på är av för med den till inte har om ett men var kan från vid eller hade inga",
    "da": "og at det som en på er af for med den til ikke har om et men var kan fra ved eller havde ingen blev",
    "cs": "a v na z do ne se že je to byl byla bylo pro jako ale který která které od po není za o jsou podle",
    "ro": "și în la de cu nu că este pe din pentru care a fost sau mai dar prin sunt o un au al ale",
    "hu": "a az és hogy nem is volt meg egy ez csak már vagy mint de ki el fel azt nincs szerint",
    "tr": "ve bir bu için ile de da olarak olan değil daha çok gibi en ne kadar sonra göre ya ise var yok",
    "fi": "ja on ei että oli se hän mutta kun ovat joka tai myös sen mukaan niin olla ole ollut eikä",
    "nl": "de het een van en dat niet is was voor met op aan bij als zijn werd werden door naar uit over ook nog heeft had deze dit geen om te",
}
#: First and last code points of scripts other than Latin.
SCRIPTS = {"greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "indic": ((0x900, 0xDFF),), "thai": ((0xE00, 0xE7F),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "han": ((0x3040, 0x30FF), (0x3400, 0x9FFF))}
#: How responses name their ruling, and what rulings are called.
RULING_WORDS = "answer|antwort|r[ée]ponse|risposta|respuesta|antwoord|resposta|ruling|outcome|verdict|decision|result"
RULING_VALUES = r"no[_ -]?breach|breach|kein\w*\s+versto(?:ß|ss)|versto(?:ß|ss)|(?:pas|aucune|non)\s*d?['’]?\s*infraction|infraction|nessuna\s+violazione|violazione|sin\s+infracci[oó]n|infracci[oó]n|sem\s+infra[cç][aã]o|infra[cç][aã]o|geen\s+overtreding|overtreding|no[_ -]?appeal|appeal|no[_ -]?overturn|overturn(?:ed)?|upheld|not[_ ]upheld|yes|no|true|false"
#: Turns of phrase of a refusal.
REFUSALS = r"can(?:no|['’])t (?:help|assist|answer|give|provide|offer|comment|say|judge|assess|decide)|cannot (?:help|assist|answer|give|provide|offer|comment|say|judge|assess|decide)|unable to (?:give|provide|help|assist|answer|judge|offer)|won['’]t be (?:providing|giving|offering|able)|will not be (?:providing|giving|offering)|must decline|have to decline|i decline|respectfully decline|rather not|prefer to leave|leave this (?:one )?unanswered|do(?:n['’]t| not) feel comfortable|not comfortable|have to pass|will pass on|pass on this|not something i do|stay away from|no opinion on|not possible for me|guidelines prevent|not permitted|falls outside|outside what i|not appropriate|not be appropriate|qualified adviser|not able to|refuse to|against my|not in a position"

#: The ruling of this project's responses, in lower case: a word for it, a mark, a value.
RULING = rf"(?:{RULING_WORDS})\W{{0,4}}[:=\-–—]\W{{0,4}}(?:{RULING_VALUES})(?!\w)"

_WORD = re.compile(r"[^\W\d_]+")
_REFUSAL = re.compile(REFUSALS)
_LETTERS = re.compile(r"[^\W_]")
_SENTENCE_END = re.compile(r"[.!?:…][\"'”’)\]]*$")
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-Þa]+|a+"), re.compile(r"\d+")

#: Bytes per byte, compressed with the prompt, up to which a response is a copy.
COPY_RATIO = 0.25
#: Bytes of prompt and response up to which zstd's smallest tables hold every position.
SHORT_PAIR = 4096

#: Function words by which one language must lead another.
LANGUAGE_LEAD = 3
#: Least chance of a boundary after a context for a text to end there; after its ruling a text may end wherever others do.
BOUNDARY_CHANCE, BOUNDARY_CHANCE_RULED = 0.5, 0.02
#: Tokens that are counted at once, and distinct tokens whose shapes a worker keeps: bounds of its memory.
TOKENS_AT_ONCE, TOKENS_KEPT = 1_000_000, 300_000

_LANGUAGES = list(FUNCTION_WORDS)
#: Each function word's languages as one number, 32 bits for the count of each.
_PACKED: dict[str, int] = {}
for _n, _l in enumerate(_LANGUAGES):
    for _w in set(FUNCTION_WORDS[_l].split()):
        _PACKED[_w] = _PACKED.get(_w, 0) + (1 << 32 * _n)


def language_counts(text: str) -> list[int]:
    """Function words of each language of FUNCTION_WORDS in a text."""
    packed = sum(filter(None, map(_PACKED.get, _WORD.findall(text.lower()))))
    return [packed >> 32 * n & 0xFFFFFFFF for n in range(len(_LANGUAGES))]


def script(text: str) -> str:
    """The script of most letters of a text that are not ASCII, if they are more than half of all; else latin."""
    if text.isascii():
        return "latin"
    letters = Counter(c for c in text if c.isalpha())
    counts = {s: sum(n for c, n in letters.items() if any(a <= ord(c) <= b for a, b in ranges)) for s, ranges in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if 2 * counts[best] > sum(letters.values()) else "latin"


def other_language(prompt: str, response: str) -> bool:
    """Whether the response is in another script, or its leading language leads that of the prompt there, and trails it in
    the prompt."""
    if script(prompt) != script(response):
        return bool(_LETTERS.search(prompt))
    said, asked = language_counts(response), language_counts(prompt)
    r, q = max(range(len(said)), key=lambda n: (said[n], -n)), max(range(len(asked)), key=lambda n: (asked[n], -n))
    return r != q and said[r] - said[q] >= LANGUAGE_LEAD and asked[q] - asked[r] >= LANGUAGE_LEAD


class _Tokens(dict):
    """Numbers of tokens, with their shape, whether they end a sentence and whether they begin with a capital."""

    def __init__(self) -> None:
        self.shapes: dict[str, int] = {"": 0}
        self.names = [""]
        self.shape, self.ends, self.capital = [], [], []

    def __missing__(self, token: str) -> int:
        shape = _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", token[-24:])))[-6:]
        if shape not in self.shapes:
            self.shapes[shape] = len(self.names)
            self.names.append(shape)
        self.shape.append(self.shapes[shape])
        self.ends.append(bool(_SENTENCE_END.search(token)))
        self.capital.append(token[:1].isupper())
        self[token] = n = len(self)
        return n


def contexts(texts: list[str], rulings: list[list[int]], known: _Tokens) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, key, ruled, ended) of the terminal contexts of some texts.

    A context is the shapes of two tokens of a line, apart where they stand after the beginning of a ruling in the line;
    rulings has these places. counts has key, inner and boundary: how often more of the sentence follows, and how often
    not; the end of a text is no evidence, it may be a cut, but after a ruling. The others tell of each text's last token
    its context, whether that is after a ruling and whether it ends a sentence.
    """
    numbers: list[int] = []
    starts, marks, last = [], [], []
    for text, places in zip(texts, rulings, strict=True):
        at = 0
        for line in text.split("\n"):
            here = next((p - at for p in places if at <= p < at + len(line)), len(line))
            head, tail = line[:here].split(), line[here:].split()
            starts.append(len(numbers))
            numbers.extend(map(known.__getitem__, head))
            marks.append(len(numbers))
            numbers.extend(map(known.__getitem__, tail))
            at += len(line) + 1
        last.append(len(numbers) - 1)
    n = len(numbers)
    ids, starts, marks = np.array(numbers, np.int64), np.array(starts), np.array(marks)
    shape, ends, capital = np.array(known.shape)[ids], np.array(known.ends)[ids], np.array(known.capital)[ids]
    first = np.zeros(n + 1, bool)
    first[starts] = first[n] = True
    ruled = np.zeros(n + 1, np.int64)
    np.add.at(ruled, marks, 1)
    np.add.at(ruled, np.append(starts[1:], n), -1)
    ruled = np.cumsum(ruled)[:n] > 0
    before = np.where(first[:n], 0, np.concatenate([[0], shape[:-1]]))
    boundary = first[1:] | ends & np.concatenate([capital[1:], [True]])
    code = (before * len(known.names) + shape) * 2 + ruled
    last = np.array(last)
    evidence = np.ones(n, bool)
    evidence[last] = ruled[last]
    kinds, rank = np.unique(code, return_inverse=True)
    name = lambda c: f"{c % 2}|{known.names[c // 2 // len(known.names)]}|{known.names[c // 2 % len(known.names)]}"
    keys = np.array([xxhash.xxh64_intdigest(name(c)) for c in kinds.tolist()], np.uint64).view(np.int64)
    count = lambda which: np.bincount(rank[which], minlength=len(kinds))
    counts = pd.DataFrame({"context": keys, "inner": count(evidence & ~boundary), "boundary": count(evidence & boundary)})
    return counts[counts.inner + counts.boundary > 0], keys[rank[last]], ruled[last], ends[last]


class _Reader:
    """Reads one response: what is decided by the text alone, and what is asked of its end."""

    def __init__(self, ruling: str | None, ruling_keys: str | None) -> None:
        self.ruling = re.compile(ruling) if ruling else None
        self.keys = re.compile(ruling_keys, re.I) if ruling_keys else None
        self.copies = _Copies()

    def rulings(self, text: str) -> list[int]:
        if self.ruling is None:
            return []
        low = text.lower()
        return [m.start() for m in self.ruling.finditer(low if len(low) == len(text) else text)]

    def parts(self, content: str) -> tuple[str, bool | None, bool | None]:
        """(text, has a ruling or None if the text must tell, complete JSON or None if it is no JSON)."""
        bare = re.sub(r"^```\w*\s*|\s*```$", "", content.strip())
        if not bare.startswith("{"):
            return content, None, None
        try:
            parsed = json.loads(bare)
        except ValueError:
            return content, False, False
        if not isinstance(parsed, dict):
            return content, False, True
        of_ruling = lambda k: self.keys is not None and self.keys.fullmatch(str(k)) is not None
        answers = [v for k, v in parsed.items() if of_ruling(k)]
        said = " ".join(str(v) for k, v in parsed.items() if isinstance(v, str) and not of_ruling(k))
        return said, any(isinstance(a, bool) or isinstance(a, str) and _LETTERS.search(a) for a in answers), True

    def read(self, prompt: str | None, response: str | None) -> tuple[str | None, str | None, list[int], bool, bool]:
        """(defect or None, text whose end decides or None, places of rulings in it, has a ruling, has a refusal)."""
        if response is None or not _LETTERS.search(response):
            return "empty", None, [], False, False
        text, ruled, complete = self.parts(response)
        text = text.strip()
        places = self.rulings(text) if ruled is None else []
        ruled = bool(places) if ruled is None else ruled
        if not _LETTERS.search(text) and not ruled:
            return "empty" if complete else "truncated", None, [], False, False
        if prompt and other_language(prompt, text):
            return "other_language", None, [], ruled, False
        copied = bool(prompt) and self.copies.ratio(_plain(prompt), _plain(text)) <= COPY_RATIO
        if complete is False:
            return "truncated", None, [], ruled, False
        # A ruling that the prompt has as well is no answer of one's own.
        own = ruled and not (copied and complete is None and self.rulings(prompt))
        refusal = not own and _REFUSAL.search(text.lower()) is not None
        if copied and not own and not refusal:
            return "copies_question", None, [], ruled, False
        return None, text if complete is None else None, places, own, refusal


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


class _Copies:
    """Bytes per byte of a text, compressed with a prompt as dictionary.

    Window and tables follow the length of both: zstd loads only what its tables have room for of a raw dictionary, and
    a row of the table keeps the latest of the positions that begin alike.
    """

    def __init__(self) -> None:
        self.params: dict[int, zstandard.ZstdCompressionParameters] = {}

    def _sized(self, n: int) -> zstandard.ZstdCompressionParameters:
        """For n bytes of prompt and text; the same for all up to SHORT_PAIR."""
        bits = n.bit_length() + 1 if n > SHORT_PAIR else 12
        found = self.params.get(bits)
        if found is None:
            table, search = min(bits, 30), 4 if bits == 12 else 7  # 30 is the most that zstd has
            found = self.params[bits] = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=max(17, table), hash_log=table, chain_log=table, search_log=search, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        return found

    def ratio(self, prompt: bytes, text: bytes) -> float:
        if not text or len(prompt) < 16:
            return 1.0
        own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=self._sized(len(prompt) + len(text)))
        return max(0, len(own.compress(text)) - 8) / len(text)


_READ = "defect string, context bigint, ended boolean, after boolean, ruled boolean, refusal boolean, inner bigint, boundary bigint"


def defects(df: DataFrame, id_col: str, prompt_col: str, response_col: str, ruling: str | None = None, ruling_keys: str | None = None) -> DataFrame:
    """One row (id, defect) per defective pair; defect is empty, other_language, copies_question, truncated or refusal,
    the first that holds in this order.

    ruling is a pattern, in lower case, of how responses give what they are asked for, ruling_keys one of the JSON keys that
    hold it. Where they are given, a response with a ruling is sound unless it is empty, foreign, cut off or the prompt's
    own, and one that comes to its end without a ruling is a refusal; where not, a refusal needs a phrase of REFUSALS. A null,
    blank or letterless response is empty. A null prompt can be neither copied nor differ in language. Repeated rows give
    repeated results, a null id is kept. Other columns of df are ignored. No rows give no rows.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{prompt_col}`").cast("string").alias("prompt"), F.col(f"`{response_col}`").cast("string").alias("response"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, known = _Reader(ruling, ruling_keys), _Tokens()
        for b in batches:
            if len(known) > TOKENS_KEPT:
                known = _Tokens()
            got = [(i, *reader.read(p, r)) for i, p, r in zip(b.id, b.prompt, b.response, strict=True)]
            done = [r for r in got if r[2] is None]
            yield _frame(len(done), id=[r[0] for r in done], defect=[r[1] for r in done], ruled=[r[4] for r in done], refusal=[r[5] for r in done])
            part, size = [], 0
            for row in got:
                if row[2] is not None:
                    part.append(row)
                    size += len(row[2]) // 6
                if part and (size >= TOKENS_AT_ONCE or row is got[-1]):
                    counts, key, after, ended = contexts([r[2] for r in part], [r[3] for r in part], known)
                    yield _frame(len(part), id=[r[0] for r in part], context=key, ended=ended, after=after, ruled=[r[4] for r in part], refusal=[r[5] for r in part])
                    yield _frame(len(counts), **{c: counts[c].to_numpy() for c in counts})
                    part, size = [], 0

    found = cut(rows.mapInPandas(arrow_safe(read), f"id string, {_READ}"))
    model = found.where("inner is not null").groupBy("context").agg(F.sum("inner").alias("inner"), F.sum("boundary").alias("boundary")).select("context", ((F.col("boundary") + 0.5) / (F.col("inner") + F.col("boundary") + 1)).alias("chance"))
    asked = found.where("inner is null").drop("inner", "boundary").join(model, "context", "left")
    chance = F.coalesce("chance", F.col("ended").cast("double"))  # never seen: a sentence's end will do
    cut_off = F.col("context").isNotNull() & (chance < F.when(F.col("after"), BOUNDARY_CHANCE_RULED).otherwise(BOUNDARY_CHANCE))
    declined = F.col("refusal") if ruling is None else ~F.col("ruled")
    defect = F.when(F.col("defect").isNotNull(), F.col("defect")).when(cut_off & ~(F.col("refusal") & F.col("ended")), "truncated").when(cut_off | declined, "refusal")
    return asked.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), defect.alias("defect")).where("defect is not null")


def _frame(n: int, **columns) -> pd.DataFrame:
    """n rows of what was read; columns that are not given are null."""
    none = np.full(n, None, object)
    return pd.DataFrame({c: pd.Series(columns.get(c, none), dtype=None if isinstance(columns.get(c), np.ndarray) else object) for c in ("id", *(x.split()[0] for x in _READ.split(", ")))})


def copy_ratios(df: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    """(id, ratio): bytes per byte of each response, compressed with its prompt; 1 where either is null or blank."""
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{prompt_col}`").cast("string").alias("prompt"), F.col(f"`{response_col}`").cast("string").alias("response"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(RULING, RULING_WORDS)
        for b in batches:
            yield pd.DataFrame({"id": b.id, "ratio": [reader.copies.ratio(_plain(p or ""), _plain(reader.parts(r or "")[0])) for p, r in zip(b.prompt, b.response, strict=True)]})

    made = rows.mapInPandas(arrow_safe(measure), "id string, ratio double")
    return made.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "ratio")


__all__ = ["COPY_RATIO", "RULING", "RULING_WORDS", "copy_ratios", "defects", "language_counts", "other_language"]
