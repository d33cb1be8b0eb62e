"""Evaluation texts leaking into training text.

An evaluation text is probed by windows of its own size (the largest of SIZES words that it has) and, since a part of
it leaks as well, by windows of the smallest part that counts. Windows of documents and probes get 64-bit SimHash
fingerprints; the probes of a size are indexed by the four 16-bit blocks of theirs, so every pair of fingerprints at
most RADIUS = 3 bits apart agrees in a block and is found. Found pairs are verified by the weighted Jaccard similarity of
their shingles of five words, and for what passes the longest run of equal words is told. The evaluation set is the
query set: it goes through in blocks of bounded size, each broadcast, against all documents.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe

WINDOW = 20
#: Sizes of windows in words, besides the smallest part; votes are bytes, so at most 255.
SIZES = (40, 80, 160)
RADIUS = 3
SHINGLE = 5
#: Least weighted similarity of the shingles of two windows.
SIMILARITY = 0.8
#: Pairs of fingerprints that are compared at once: bounds the memory where many probes share a block.
PAIRS_AT_ONCE = 2_000_000
#: Pairs of windows whose words are compared at once.
AT_ONCE = 20_000
#: Characters of evaluation text whose probes are broadcast at once: some 200 bytes of index per word.
BLOCK_CHARS = 4_000_000
#: Words that are fingerprinted at once: bounds the memory (about 250 bytes a word).
CHUNK_WORDS = 200_000
#: Distinct words whose votes a worker keeps, besides those of the probes.
WORDS_KEPT = 500_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words of a text as they are compared: letters and digits only, lower case."""
    return _WORD.findall(text.lower())


class _Votes:
    """The 64 votes of each word, one byte each, as eight uint64 numbers, and its length; sums of windows of at most 255
    words never overflow a byte."""

    def __init__(self) -> None:
        self.ids = _Numbers()
        self.rows = np.zeros((1024, 8), np.uint64)
        self.sizes = np.zeros(1024, np.int64)

    def of(self, tokens: list[str]) -> np.ndarray:
        known = len(self.ids)
        out = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        for t in itertools.islice(reversed(self.ids), len(self.ids) - known):
            n = self.ids[t]
            while n >= len(self.rows):
                self.rows, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.sizes))
            self.rows[n] = np.unpackbits(np.frombuffer(xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")), np.uint8)).view(np.uint64)
            self.sizes[n] = len(t)
        return out

    def forget(self, known: int) -> None:
        """Forgets all but the first known words."""
        self.ids = _Numbers(itertools.islice(self.ids.items(), known))


class _Numbers(dict):
    """Numbers new words from 0, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def vote_totals(ids: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Running totals of the votes of some words."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros((1, 8), np.uint64), np.cumsum(votes[ids], axis=0)])


def fingerprints(totals: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of consecutive words: bit set where more than half of the words vote for it."""
    if len(totals) <= window:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = (totals[window:] - totals[:-window]).view(np.uint8)
    return np.packbits(sums > window // 2, axis=1).view(np.uint64).ravel()


class Probes:
    """The windows of one size of one block of evaluation texts; equal windows are kept once, with all their texts."""

    def __init__(self, texts: list[np.ndarray], owners: list[int], votes: np.ndarray, window: int) -> None:
        self.window = window
        prints, tokens, owner = [np.empty(0, np.uint64)], [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for n, ids in zip(owners, texts, strict=True):
            prints.append(fingerprints(vote_totals(ids, votes), window))
            tokens.append(np.lib.stride_tricks.sliding_window_view(ids, window).astype(np.int32))
            owner.append(np.full(len(prints[-1]), n))
        every = np.concatenate(tokens)
        rows = np.ascontiguousarray(every).view([("", np.int32)] * window).ravel()
        _, first, back = np.unique(rows, return_index=True, return_inverse=True)
        self.tokens, self.prints = every[first], np.concatenate(prints)[first]
        order = np.argsort(back, kind="stable")
        self.owner, self.starts = np.concatenate(owner)[order], np.searchsorted(back[order], np.arange(len(first) + 1))
        self.blocks = []
        for b in range(4):
            part = (self.prints >> np.uint64(16 * b)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            self.blocks.append((order, np.searchsorted(part[order], np.arange((1 << 16) + 1))))

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, probe) for every pair at most radius bits apart; such pairs agree in a block, since radius < 4."""
        at, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b, (order, starts) in enumerate(self.blocks):
            part = (prints >> np.uint64(16 * b)).astype(np.uint16).astype(np.int64)
            counts = starts[part + 1] - starts[part]
            some = np.flatnonzero(counts)
            ends = np.cumsum(counts[some])
            first = 0
            while first < len(some):
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
                n = counts[some[first:last]]
                w = np.repeat(some[first:last], n)
                offset = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                p = order[starts[part[w]] + offset]
                near = np.bitwise_count(prints[w] ^ self.prints[p]) <= radius
                at.append(w[near])
                to.append(p[near])
                first = last
        pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(to)]), axis=1)
        return pairs[0], pairs[1]


def similarities(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the sets of shingles of the windows in the rows of a and b; a shingle weighs as many
    as its words have characters, size being that of each word. That of equal windows is 1."""
    out = np.ones(len(a))
    other = np.flatnonzero((a != b).any(axis=1))
    if not len(other):
        return out
    a, b = a[other], b[other]
    words = np.concatenate([a, b]).astype(np.int64)
    parts = np.lib.stride_tricks.sliding_window_view(words, SHINGLE, axis=1)
    with np.errstate(over="ignore"):
        names = (parts.astype(np.uint64) * np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)).sum(axis=2)
    _, first, rank = np.unique(names.ravel(), return_index=True, return_inverse=True)
    weight = size[parts].sum(axis=2).ravel()[first].astype(float)
    kinds, m = len(first), len(a)
    keys = (np.arange(2 * m) % m)[:, None] * kinds + rank.reshape(names.shape)
    x, y = np.unique(keys[:m]), np.unique(keys[m:])
    total = lambda k: np.bincount(k // kinds, weights=weight[k % kinds], minlength=m)
    both = total(np.intersect1d(x, y, assume_unique=True))
    out[other] = both / (total(x) + total(y) - both)
    return out


def longest_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest run of equal words at equal places in the rows of a and b."""
    run = best = np.zeros(len(a), np.int64)
    for k in range(a.shape[1]):
        run = (run + 1) * (a[:, k] == b[:, k])
        best = np.maximum(best, run)
    return best


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, part: int = WINDOW, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """One row (doc_id, item_id, similarity, run) per document and item of which a window of the item's size, or of part
    consecutive words, stands in the document with that weighted shingle similarity at least, among those within the
    radius: the greatest similarity, and the longest run of equal consecutive words in one window.

    A document with part consecutive words of an item always has its row, with run at least part; what is changed is found
    as far as its fingerprints stay within the radius. Null or short texts on either side, and rows with a null id, give no
    row; items that share a text each give a row; repeated rows give one row. Other columns are ignored. Empty tables give
    no rows.
    """
    if not (0 <= radius <= 3 and SHINGLE <= part <= 255 and 0 < similarity <= 1):
        raise ValueError("radius must be 0 to 3, part 5 to 255 and similarity above 0 and at most 1")
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("doc is not null and text is not null")
    asked = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("extract")).where("item is not null and extract is not null").withColumn("key", F.md5("extract"))
    distinct = asked.groupBy("key").agg(F.first("extract").alias("extract"))
    size = distinct.agg(F.sum(F.length("extract"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    spark = documents.sparkSession
    key_type = docs.schema["doc"].dataType.simpleString()
    found = None
    for block in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()  # bounded by BLOCK_CHARS
        votes = _Votes()
        texts = [votes.of(words(r.extract)) for r in rows]
        sizes: dict[int, list[int]] = {}
        for n, ids in enumerate(texts):
            if len(ids) >= part:
                for own in {part, max((s for s in SIZES if part < s <= len(ids)), default=part)}:
                    sizes.setdefault(own, []).append(n)
        probes = [Probes([texts[n] for n in ns], ns, votes.rows, own) for own, ns in sorted(sizes.items())]
        sent = spark.sparkContext.broadcast((list(votes.ids), probes, np.array([r.key for r in rows], dtype=object)))
        one = docs.mapInPandas(arrow_safe(lambda batches, sent=sent: _scan(batches, *sent.value, part, radius, similarity)), f"doc {key_type}, key string, similarity double, run int")
        found = one if found is None else found.union(one)
    best = found.groupBy("doc", "key").agg(F.max("similarity").alias("similarity"), F.max("run").alias("run"))
    return best.join(asked.select("key", "item").distinct(), "key").select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "similarity", "run")


def _scan(batches: Iterator[pd.DataFrame], vocabulary: list[str], probes: list[Probes], keys: np.ndarray, part: int, radius: int, similarity: float) -> Iterator[pd.DataFrame]:
    votes = _Votes()
    votes.of(vocabulary)
    known = len(votes.ids)

    def flush(tokens: list[np.ndarray], docs: list) -> pd.DataFrame:
        ids = np.concatenate(tokens)
        starts = np.cumsum([0, *map(len, tokens)])
        totals = vote_totals(ids, votes.rows)
        rows = []
        for probe in probes:
            at, to = probe.candidates(fingerprints(totals, probe.window), radius)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + probe.window <= starts[doc + 1]
            at, to, doc = at[inside], to[inside], doc[inside]
            if not len(at):
                continue
            views = np.lib.stride_tricks.sliding_window_view(ids, probe.window)
            same = np.concatenate([(views[at[k : k + AT_ONCE]] == probe.tokens[to[k : k + AT_ONCE]]).all(axis=1) for k in range(0, len(at), AT_ONCE)])
            n = probe.starts[to + 1] - probe.starts[to]
            owner = probe.owner[np.repeat(probe.starts[to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at, to, same = np.repeat(at, n), np.repeat(to, n), np.repeat(same, n)
            pair = np.repeat(doc, n) * len(keys) + owner
            # No other window of this size can say more of a document and an item than an equal one.
            done = np.unique(pair[same])
            rows.append(pd.DataFrame({"pair": done, "similarity": 1.0, "run": probe.window}))
            left = np.flatnonzero(~np.isin(pair, done))
            for k in range(0, len(left), AT_ONCE):
                some = left[k : k + AT_ONCE]
                seen, asked = views[at[some]], probe.tokens[to[some]]
                alike = similarities(seen, asked, votes.sizes)
                good = alike >= similarity
                rows.append(pd.DataFrame({"pair": pair[some][good], "similarity": alike[good], "run": longest_runs(seen[good], asked[good])}))
        if not rows:
            return pd.DataFrame()
        best = pd.concat(rows).groupby("pair", as_index=False).max()
        return pd.DataFrame({"doc": pd.Series([docs[d] for d in best.pair // len(keys)], dtype=object), "key": pd.Series(keys[best.pair.to_numpy() % len(keys)], dtype=object), "similarity": best.similarity, "run": best.run.astype(np.int32)})

    widest = max((p.window for p in probes), default=part)
    for b in batches:
        tokens, docs, size = [], [], 0
        for d, t in zip(b.doc, b.text, strict=True):
            w = words(t)
            for first in range(0, max(1, len(w) - part + 1), CHUNK_WORDS):  # very long texts in overlapping pieces
                piece = w[first : first + CHUNK_WORDS + widest - 1]
                if len(piece) < part:
                    continue
                if len(votes.ids) > known + WORDS_KEPT:
                    if tokens:
                        yield flush(tokens, docs)
                        tokens, docs, size = [], [], 0
                    votes.forget(known)
                tokens.append(votes.of(piece))
                docs.append(d)
                size += len(piece)
                if size >= CHUNK_WORDS:
                    yield flush(tokens, docs)
                    tokens, docs, size = [], [], 0
        if tokens:
            yield flush(tokens, docs)
