"""Shared spans and leakage against brute force, and their edge cases."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.llm import leaks
from casemill.llm.spans import SharedSpans, SuffixAutomaton, anchors


def _texts(seed: int, n: int = 40) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(12)) for _ in range(4)]
    out = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for s in shared:
            if rng.random() < 0.25:
                at = rng.randint(0, 10)
                parts += [s[at:], " ".join(word() for _ in range(5))]
        out.append((k, " ".join(parts)))
    return out


def _brute(rows: list[tuple[int, str | None]], n: int) -> tuple[set, dict]:
    where = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            where[t[k : k + n]].add(i)
    pairs = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    cover = {}
    for i, t in rows:
        if t and len(t) >= n:
            hit = bytearray(len(t))
            for k in range(len(t) - n + 1):
                if len(where[t[k : k + n]]) > 1:
                    hit[k : k + n] = b"\1" * n
            cover[i] = sum(hit)
    return pairs, cover


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(spark, seed):
    rows = [*_texts(seed), (100, None), (101, ""), (102, "short"), (103, "ab" * 40), (104, "ab" * 37 + "c"), (105, "x" * 60), (106, _texts(seed)[0][1] + "x" * 45)]
    rows += [(107, rows[3][1]), (108, rows[3][1])]
    made = SharedSpans(spark.createDataFrame(rows, "pane_id bigint, text string"), "pane_id", "text", 40)
    pairs, cover = _brute(rows, 40)
    assert {tuple(r) for r in made.pairs().collect()} == pairs
    assert {r.id: r.shared_chars for r in made.coverage().collect()} == cover
    spans = made.spans().collect()
    assert {i: sum(r.end - r.start for r in spans if r.id == i) for i in cover} == cover and all(r.end - r.start >= 40 for r in spans)
    texts = dict(rows)
    for r in made.unshared().collect():
        cuts, at, rest = sorted((x.start, x.end) for x in spans if x.id == r.id), 0, ""
        for a, b in cuts:
            rest, at = rest + texts[r.id][at:a], b
        assert r.text == rest + texts[r.id][at:]


def test_spans_edges(spark):
    schema = "h string, seg string, pane_id bigint, text string"
    assert SharedSpans(spark.createDataFrame([], schema), "pane_id", "text", 40).pairs().count() == 0
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [("a", "b", 1, long), ("a", "b", 1, long), ("a", "b", None, long), ("a", "b", 2, long[100:300])]
    made = SharedSpans(spark.createDataFrame(rows, schema), "pane_id", "text", 40)
    assert [tuple(r) for r in made.pairs().collect()] == [(1, 2)]
    assert {r.id: (r.n_chars, r.shared_chars, r.share) for r in made.coverage().collect()} == {1: (400, 200, 0.5), 2: (200, 200, 1.0)}


@pytest.mark.parametrize("size", [7, 25])
def test_spans_of_a_hot_anchor(spark, monkeypatch, size):
    from casemill.llm import spans

    monkeypatch.setattr(spans, "SHARD_SEGMENTS", size)
    rng = random.Random(9)
    core = "".join(rng.choice("abcdef ") for _ in range(36))
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(30)) + rng.choice("ab") + core + rng.choice("ab") + rng.choice("ab") + rng.choice("abc") + "".join(rng.choice("abcdef ") for _ in range(30))) for k in range(160)]
    made = SharedSpans(spark.createDataFrame(rows, "pane_id bigint, text string"), "pane_id", "text", 40)
    pairs, cover = _brute(rows, 40)
    assert len(pairs) > 200 and {tuple(r) for r in made.pairs().collect()} == pairs
    assert {r.id: r.shared_chars for r in made.coverage().collect()} == cover


def test_boilerplate_makes_linear_work(spark):
    """One anchor in 20,000 texts that have nothing long enough in common."""
    rng = random.Random(10)
    core = "".join(rng.choice("abcdef ") for _ in range(38))
    rows = [(k, "".join(rng.choices("abcdefghijklmnop ", k=50)) + core + "".join(rng.choices("abcdefghijklmnop ", k=50))) for k in range(20_000)]
    made = SharedSpans(spark.createDataFrame(rows, "pane_id bigint, text string"), "pane_id", "text", 40)
    segs = made.segments.groupBy("h", "sd").agg(F.min("seg").alias("seg"))
    shards, runs = made._laid(segs)
    streamed = shards.count() + (runs.count() if runs is not None else 0)
    assert streamed <= 10 * segs.count()
    assert shards.groupBy("h", "sub").count().agg(F.max("count")).first()[0] <= 400
    where = defaultdict(set)
    for i, t in rows:
        for k in range(len(t) - 39):
            where[hash(t[k : k + 40])].add(i)
    true = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    assert {tuple(r) for r in made.pairs().collect()} == true


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=5), st.text("ab", max_size=30))
def test_automaton(refs, query):
    made = SuffixAutomaton(4).build(refs)
    got = {(end, r) for end, found in made.matches(query) for r in found}
    assert got == {(k + 4, r) for k in range(len(query) - 3) for r, x in enumerate(refs) if query[k : k + 4] in x}


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=20, max_size=60), st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_a_shared_run_shares_an_anchor(run, left, right):
    a = set(anchors(left + run + right, 20, 12)[0].tolist())
    b = set(anchors(run, 20, 12)[0].tolist())
    assert a & b


def test_anchors_over_blocks(monkeypatch):
    from casemill.llm import spans

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij") for _ in range(5000))
    whole = list(zip(*map(list, anchors(text, 40, 25)[:2]), strict=True))
    monkeypatch.setattr(spans, "BLOCK", 300)
    assert list(zip(*map(list, anchors(text, 40, 25)[:2]), strict=True)) == whole


def _leak_rows(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([10, 20, 40, 60])))) for k in range(12)]
    items += [("same", items[3][1]), ("none", None), ("empty", "")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            source = rng.choice(items)[1] or ""
            own = source.split()
            size = rng.choice([18, 19, 20, 21, 30])
            at = rng.randint(0, max(0, len(own) - size))
            words[10:10] = [w.upper() + rng.choice(["", ",", " -", "!"]) for w in own[at : at + size]]
        docs.append((k, " ".join(words)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed, monkeypatch):
    docs, items = _leak_rows(seed)
    docs += [(90, None), (91, ""), (None, docs[0][1]), docs[1]]
    made = lambda: leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id string, extract_text string"), "item_id", "extract_text").where("run >= 20").select("doc_id", "item_id")
    grams = defaultdict(set)
    for i, t in items:
        w = leaks.words(t or "")
        for k in range(len(w) - 19):
            grams[tuple(w[k : k + 20])].add(i)
    true = {(d, i) for d, t in docs if d is not None for w in [leaks.words(t or "")] for k in range(len(w) - 19) for i in grams.get(tuple(w[k : k + 20]), ())}
    assert true and {tuple(r) for r in made().collect()} == true
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 500)  # several blocks of the query set
    monkeypatch.setattr(leaks, "CHUNK_WORDS", 50)  # long texts in pieces
    monkeypatch.setattr(leaks, "WORDS_KEPT", 400)
    assert {tuple(r) for r in made().collect()} == true


def _found(spark, docs, items, **more):
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id string, extract_text string"), "item_id", "extract_text", **more)
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.run) for r in got.collect()}


def test_leaks_tell_similarity_and_run(spark):
    rng = random.Random(4)
    item = [f"x{rng.randint(0, 10**6)}" for _ in range(170)]
    other = [f"y{k}" for k in range(40)]
    changed = [*item[:60], "other", *item[61:160]]
    docs = [(1, " ".join(other + item[5:165] + other)), (2, " ".join(other + changed)), (3, " ".join(other)), (4, " ".join(item[100:121])), (5, " ".join(item[:19]))]
    got = _found(spark, docs, [("a", " ".join(item)), ("b", " ".join(item)), ("c", " ".join(other[:25]))])
    assert got[1, "a"] == got[1, "b"] == (1.0, 160) and got[4, "a"] == (1.0, 20) and not {d for d, _ in got} & {5}
    assert got[1, "c"] == got[3, "c"] == (1.0, 20) and got[2, "a"][0] == 1.0 and got[2, "a"][1] >= 20
    size = [len(w) for w in item]
    a, b = list(range(20)), [*range(10), 99, *range(11, 20)]
    weigh = lambda w: {tuple(w[k : k + 5]): sum((size + [7] * 100)[x] for x in w[k : k + 5]) for k in range(16)}
    x, y = weigh(a), weigh(b)
    both = sum(v for k, v in x.items() if k in y)
    import numpy as np

    assert leaks.similarities(np.array([a, a]), np.array([a, b]), np.array(size + [7] * 100)).tolist() == pytest.approx([1.0, both / (sum(x.values()) + sum(y.values()) - both)])
    assert leaks.longest_runs(np.array([a, a]), np.array([a, b])).tolist() == [20, 10]


def test_changed_passages_are_found(spark):
    """Recall of items with two changed words, among all documents that hold a window as similar as asked for."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=165))) for k in range(40)]
    docs = []
    for k in range(200):
        own = items[k % 40][1].split()
        for at in rng.sample(range(10, 155), 2):
            own[at] = "changed"
        docs.append((k, " ".join(rng.choices(words, k=30) + own + rng.choices(words, k=30))))
    got = _found(spark, docs, items)
    true = {(k, f"i{k % 40}") for k in range(200)}
    assert len(true & set(got)) / len(true) >= 0.9 and set(got) == true & set(got)


def test_leaks_of_boilerplate(spark, monkeypatch):
    rng = random.Random(3)
    same = " ".join(f"b{k}" for k in range(30))
    items = [(f"i{k}", same + " " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(20))) for k in range(50)]
    monkeypatch.setattr(leaks, "PAIRS_AT_ONCE", 7)
    got = _found(spark, [(1, same), (2, "x " + same)], items)
    assert set(got) == {(d, i) for d in (1, 2) for i, _ in items} and {v for v in got.values()} == {(1.0, 20)}


def test_leaks_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string, item string, key string"), spark.createDataFrame([], "item_id string, extract_text string, doc string")
    assert leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "extract_text").count() == 0


def test_candidates_are_all_within_radius():
    rng = random.Random(1)
    votes = leaks._Votes()
    texts = [votes.of([f"w{rng.randint(0, 40)}" for _ in range(60)]) for _ in range(6)]
    probes = leaks.Probes(texts, list(range(6)), votes.rows, 20)
    prints = leaks.fingerprints(leaks.vote_totals(votes.of([f"w{rng.randint(0, 40)}" for _ in range(300)]), votes.rows), 20)
    got = set(zip(*map(list, probes.candidates(prints, 3)), strict=True))
    true = {(a, b) for a, x in enumerate(prints.tolist()) for b, y in enumerate(probes.prints.tolist()) if (x ^ y).bit_count() <= 3}
    assert got == true
