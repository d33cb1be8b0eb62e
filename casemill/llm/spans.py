"""Long exact spans shared between records.

Every run of min_len characters holds at least one anchor: the smallest of the hashes of its k-grams, k < min_len
(winnowing, so the choice depends on the run alone). Anchors that only one text has are dropped; around each of the
others a segment is cut that is wide enough for every run of min_len through the anchor. The segments of an anchor are
its reference shard: a generalised suffix automaton is built over them and the segments are streamed through it for
matching statistics. So a text meets only shards with which it has something in common, where broadcasting all shards
to all texts would grow as the square of the corpus. An anchor with more than SHARD_SEGMENTS segments (boilerplate) is
split by the longer anchors in its segments, and what is still hotter by whole runs of min_len, whose owners share them
by definition: each step makes a number of rows that is linear in the segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe, cut

#: Reference segments in one suffix automaton: bounds its memory (about 275 characters each) and its work.
SHARD_SEGMENTS = 400
#: Windows that one call of the hashing takes at once: bounds its memory on very long texts.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Sliding minimum or maximum by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return x if have == width else pick(x[: len(x) - (width - have)], x[width - have :])


def anchors(text: str, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(hashes, positions, also) of the anchors of a text. Of equal k-grams in equal surroundings only the first is listed;
    also has the positions of the others, by the index of the first."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = min_len - k + 1
    hashes, places = [], []
    for at in range(0, max(1, len(points) - min_len + 1), BLOCK):
        c = points[at : at + BLOCK + min_len - 1].astype(np.uint64)
        if len(c) < min_len:
            break
        up, down = _powers.take(len(c) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up[: len(c)])])
            h = (total[k:] - total[:-k]) * down[: len(c) - k + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        least = _extreme(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(_extreme(np.concatenate([pad, least, pad]), width, np.maximum) == h)
        hashes.append(h[chosen])
        places.append(chosen + at)
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64), {}
    h, p = np.concatenate(hashes).view(np.int64), np.concatenate(places)
    _, first = np.unique(p, return_index=True)
    h, p = h[first], p[first]
    also: dict[int, list[int]] = {}
    if len(np.unique(h)) < len(h):
        seen: dict[tuple[int, str], int] = {}
        keep: list[int] = []
        for n, (x, y) in enumerate(zip(h.tolist(), p.tolist(), strict=True)):
            first = seen.setdefault((x, text[max(0, y - min_len + k) : y + min_len]), len(keep))
            if first == len(keep):
                keep.append(n)
            else:
                also.setdefault(first, []).append(y)
        h, p = h[keep], p[keep]
    return h, p, also


class SuffixAutomaton:
    """Generalised suffix automaton of reference texts that knows, for every substring of at least min_len characters,
    the references that contain it."""

    def __init__(self, min_len: int) -> None:
        self.min_len = min_len
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.refs: dict[int, set[int]] = {}

    def _extend(self, last: int, ch: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(ch)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            new = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in nxt[p]:
                nxt[p][ch] = new
                p = link[p]
            if p == -1:
                return new
            q = nxt[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
                return new
        else:
            p, new = last, -1
        clone = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        if new >= 0:
            link[new] = clone
        while p != -1 and nxt[p].get(ch) == q:
            nxt[p][ch] = clone
            p = link[p]
        return clone if new < 0 else new

    def build(self, texts: list[str]) -> SuffixAutomaton:
        for text in texts:
            last = 0
            for ch in text:
                last = self._extend(last, ch)
        for n, text in enumerate(texts):
            at = 0
            for ch in text:
                at = self.next[at][ch]
                up = at
                while up > 0 and self.len[up] >= self.min_len:
                    marks = self.refs.setdefault(up, set())
                    if n in marks:
                        break
                    marks.add(n)
                    up = self.link[up]
        return self

    def matches(self, text: str) -> Iterator[tuple[int, set[int]]]:
        """(end, references) for each place where the last min_len characters stand in references."""
        nxt, link, length, least = self.next, self.link, self.len, self.min_len
        at = size = 0
        for end, ch in enumerate(text, 1):
            while at and ch not in nxt[at]:
                at = link[at]
                size = length[at]
            if ch in nxt[at]:
                at = nxt[at][ch]
                size += 1
            if size >= least:
                while length[link[at]] >= least:
                    at = link[at]
                size = min(size, length[at])
                yield end, self.refs[at]


def _sharded(batches: Iterator[pd.DataFrame], min_len: int, answer) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard, references first; answer(automaton, references, query) gives rows for each query."""
    key, refs, automaton, out = None, [], None, []
    for b in batches:
        for row in b.itertuples(index=False):
            if (row.h, row.sub) != key:
                key, refs, automaton = (row.h, row.sub), [], None
            if row.is_ref:
                refs.append(row)
                continue
            if automaton is None:
                automaton = SuffixAutomaton(min_len).build([r.seg for r in refs])
            out.extend(answer(automaton, refs, row))
        yield pd.DataFrame(out)
        out = []


class SharedSpans:
    """Shared spans of at least min_len characters between the texts of df.

    Texts that are null, empty or shorter than min_len share nothing; rows with a null id are left out; repeated rows
    of one id count as one text each, and never pair with themselves. Columns other than id_col and text_col are
    ignored.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, min_len: int = 200) -> None:
        if min_len < 16:
            raise ValueError("min_len must be 16 or more")
        self.min_len, self.k = min_len, max(8, min_len * 5 // 8)
        self.docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_len))
        self.segments = self._segments()

    def _segments(self) -> DataFrame:
        """(h, sd, seg, id, start, also): the segments around anchors that more than one text has, sd their digest, also the
        other places of the same segment in the text."""
        min_len, k = self.min_len, self.k

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, hs, ps, more = [], [], [], []
                for i, t in zip(b.id, b.text, strict=True):
                    h, p, also = anchors(t, min_len, k)
                    ids.append(np.full(len(h), i))
                    hs.append(h)
                    ps.append(p)
                    more.extend(also.get(n) for n in range(len(h)))
                if ids:
                    yield pd.DataFrame({"id": np.concatenate(ids), "h": np.concatenate(hs), "at": np.concatenate(ps).astype(np.int32), "also": pd.Series(more, dtype=object)})

        found = cut(self.docs.mapInPandas(arrow_safe(find), "id bigint, h bigint, at int, also array<int>"))
        shared = found.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
        places = found.join(shared, "h").groupBy("id").agg(F.collect_list(F.struct("h", "at", "also")).alias("places"))
        side = min_len - k
        return cut(
            self.docs.join(places, "id")
            .select("id", "text", F.explode("places").alias("p"))
            .select("id", F.col("p.h").alias("h"), F.greatest(F.col("p.at") - side, F.lit(0)).alias("start"), F.transform("p.also", lambda x: F.greatest(x - side, F.lit(0))).alias("also"), F.expr(f"substring(text, greatest(p.at - {side}, 0) + 1, p.at + {min_len} - greatest(p.at - {side}, 0))").alias("seg"))
            .withColumn("sd", F.md5("seg"))
        )

    def _laid(self, segs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """segs: (h, sd, seg, ...), distinct by (h, sd). Gives the rows of shards (sub tells those of one hot anchor apart)
        and, of what is too hot for shards, the runs (h, sub, sd, at) of min_len that several segments have, or None."""
        min_len, finer_k = self.min_len, self.min_len - max(1, (self.min_len - self.k) // 4)
        sizes = cut(segs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        shards = segs.join(sizes.where(F.col("n") <= SHARD_SEGMENTS).select("h"), "h").withColumn("sub", F.lit(0).cast("bigint"))
        hot = segs.join(sizes.where(F.col("n") > SHARD_SEGMENTS).select("h"), "h")
        if sizes.where(F.col("n") > SHARD_SEGMENTS).isEmpty():
            return shards, None

        def find(k: int):
            def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for h, sd, seg in zip(b.h, b.sd, b.seg, strict=True):
                        subs, places, _ = anchors(seg, min_len, k)
                        yield pd.DataFrame({"h": h, "sd": sd, "sub": subs, "at": places.astype(np.int32)})

            return arrow_safe(step)

        schema = "h bigint, sd string, sub bigint, at int"
        finer = cut(hot.select("h", "sd", "seg").mapInPandas(find(finer_k), schema).select("h", "sd", "sub").distinct())
        counted = cut(finer.groupBy("h", "sub").agg(F.count("*").alias("n")).where("n > 1"))
        some = finer.join(counted.where(F.col("n") <= SHARD_SEGMENTS).select("h", "sub"), ["h", "sub"])
        hotter = finer.join(counted.where(F.col("n") > SHARD_SEGMENTS).select("h", "sub"), ["h", "sub"]).select("h", "sd").distinct()
        runs = cut(hot.join(hotter, ["h", "sd"]).select("h", "sd", "seg").mapInPandas(find(min_len), schema))
        shared = runs.groupBy("h", "sub").agg(F.min("sd").alias("low"), F.max("sd").alias("high")).where("low < high").select("h", "sub")
        return shards.unionByName(hot.join(some, ["h", "sd"])), runs.join(shared, ["h", "sub"])

    def _streamed(self, answer, schema: str, rows: DataFrame) -> DataFrame:
        """Streams each segment through the automaton of its shard."""
        min_len = self.min_len
        both = rows.withColumn("is_ref", F.explode(F.array(F.lit(True), F.lit(False))))
        laid = both.repartition("h", "sub").sortWithinPartitions("h", "sub", F.col("is_ref").desc())
        return laid.mapInPandas(arrow_safe(lambda batches: _sharded(batches, min_len, answer)), schema)

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every two texts with a run of at least min_len equal characters."""

        def answer(automaton: SuffixAutomaton, refs: list, query) -> list[dict]:
            hit: set[int] = set()
            seen: set[int] = set()
            for _, found in automaton.matches(query.seg):
                if id(found) not in seen:
                    seen.add(id(found))
                    hit |= found
            return [{"sa": refs[r].sd, "sb": query.sd} for r in hit if refs[r].sd < query.sd]

        owners = self.segments.select("sd", "id").distinct()
        # Segments with the same owners lead to the same pairs: one of them stands for all.
        stands = cut(_same_sets(owners, "sd", "id", "head"))
        of = cut(owners.join(stands.where("sd = head").select("sd"), "sd").select(F.col("sd").alias("head"), "id"))
        same = stands.where("sd = head and n > 1").select(F.col("head").alias("ha"), F.col("head").alias("hb"))
        shards, runs = self._laid(self.segments.groupBy("h", "sd").agg(F.min("seg").alias("seg")))
        found = self._streamed(answer, "sa string, sb string", shards)
        linked = found.join(stands.select(F.col("sd").alias("sa"), F.col("head").alias("ha")), "sa").join(stands.select(F.col("sd").alias("sb"), F.col("head").alias("hb")), "sb").select("ha", "hb").distinct()
        links = linked.union(same).distinct()
        wide = links.join(of.select(F.col("head").alias("ha"), F.col("id").alias("x")), "ha").join(of.select(F.col("head").alias("hb"), F.col("id").alias("y")), "hb").where("x != y").select("x", "y")
        if runs is not None:
            # All owners of a run are pairs of the result; runs with the same owners are taken once.
            group = runs.select(F.xxhash64("h", "sub").alias("g"), "sd").join(owners, "sd").select("g", "id").distinct()
            kept = group.join(_same_sets(group, "g", "id", "first").where("g = first").select("g"), "g")
            wide = wide.union(kept.select("g", F.col("id").alias("x")).join(kept.select("g", F.col("id").alias("y")), "g").where("x < y").select("x", "y"))
        return wide.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def spans(self) -> DataFrame:
        """(id, start, end): the maximal stretches of each text that are covered by runs of at least min_len characters that
        another text has as well; end is past the last character."""
        min_len = self.min_len

        def answer(automaton: SuffixAutomaton, refs: list, query) -> list[dict]:
            spans: list[list[int]] = []
            for end, found in automaton.matches(query.seg):
                if query.low == query.high and all(refs[r].low == refs[r].high == query.low for r in found):
                    continue
                if spans and end - min_len <= spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([end - min_len, end])
            return [{"h": query.h, "sd": query.sd, "first": a, "last": b} for a, b in spans]

        segs = self.segments.groupBy("h", "sd").agg(F.min("seg").alias("seg"), F.min("id").alias("low"), F.max("id").alias("high"))
        copies = segs.where((F.col("low") < F.col("high")) & (F.length("seg") >= min_len)).select("h", "sd", F.lit(0).alias("first"), F.length("seg").alias("last"))
        shards, runs = self._laid(segs)
        spans = self._streamed(answer, "h bigint, sd string, first int, last int", shards).union(copies)
        if runs is not None:
            held = runs.join(segs.select("h", "sd", "low", "high"), ["h", "sd"])
            several = held.groupBy("h", "sub").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h", "sub")
            spans = spans.union(runs.join(several, ["h", "sub"]).select("h", "sd", F.col("at").alias("first"), (F.col("at") + min_len).alias("last")))
        places = F.explode(F.concat(F.array("start"), F.coalesce("also", F.array().cast("array<int>"))))
        placed = self.segments.select("h", "sd", "id", places.alias("start")).join(spans, ["h", "sd"]).select("id", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b")).alias("s")).distinct()
        merged = placed.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("spans"))  # a text has no more than it has characters
        none = F.array().cast("array<struct<a:int,b:int>>")
        join = lambda done, s: F.when((F.size(done) > 0) & (s.a <= F.element_at(done, -1).b), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).a.alias("a"), F.greatest(F.element_at(done, -1).b, s.b).alias("b"))))).otherwise(F.concat(done, F.array(s)))
        return merged.select("id", F.explode(F.aggregate("spans", none, join)).alias("s")).select("id", F.col("s.a").alias("start"), F.col("s.b").alias("end"))

    def coverage(self) -> DataFrame:
        """(id, n_chars, shared_chars, share): for each text, how many of its characters stand, within a run of at least
        min_len, also in another text. Texts too short to share anything are listed with 0."""
        lengths = self.docs.groupBy("id").agg(F.max(F.length("text")).alias("n_chars"))
        found = self.spans().groupBy("id").agg(F.sum(F.col("end") - F.col("start")).cast("int").alias("shared_chars"))
        return lengths.join(found, "id", "left").select("id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 6).alias("share"))

    def unshared(self) -> DataFrame:
        """(id, text): the texts without their shared spans; of a repeated id the longest text."""
        texts = self.docs.groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("t")).select("id", F.col("t.text").alias("text"))
        spans = self.spans().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        cuts = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
        rest = F.aggregate(cuts, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda acc, s: F.struct(F.concat(acc.out, F.substring("text", acc.at + 1, s.start - acc.at)).alias("out"), s.end.alias("at")), lambda acc: F.concat(acc.out, F.substring("text", acc.at + 1, F.length("text"))))
        return texts.join(spans, "id", "left").select("id", rest.alias("text"))


def _same_sets(pairs: DataFrame, key: str, member: str, first: str) -> DataFrame:
    """(key, first, n): for each key with its n members the smallest key that has the same members."""
    sets = pairs.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(member).cast("decimal(38,0)")).alias("sig"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("sig2"))
    return sets.join(sets.groupBy("n", "sig", "sig2").agg(F.min(key).alias(first)), ["n", "sig", "sig2"]).select(key, first, "n")
