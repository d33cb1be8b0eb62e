"""Core operators on small cases: known answers, brute force, and edges."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.functions import text as t
from casemill.operators import dedupe, deferral, gates, graph, intervals, ledger, metrics, packed, pages, ranking, resolve, voting
from casemill.sources import jsonl
from casemill.streaming import receipts

SCORED = "item string, case string, p double, correct int"


def _scored(spark, rows):
    return spark.createDataFrame([(str(k), c, p, y) for k, (c, p, y) in enumerate(rows)], SCORED).withColumn("g", F.lit("all"))


# Packed values ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "kind", "values"),
    [
        ("12.1, 7.9, 19.1, and 2", "numbers", ["12.1", "7.9", "19.1", "2"]),
        ("Clauses 7.10, 2 x 19.1, 26.2 and 8.1", "numbers", ["7.10", "19.1", "26.2", "8.1"]),
        ("Clauses 26.1 and 14.5 x 3", "numbers", ["26.1", "14.5"]),
        ("29 x 2", "numbers", ["29"]),
        ("Code of 2019 - 7.4 (twice) | 24.3", "numbers", ["7.4", "24.3"]),
        ("2016 Code: 26.2, 29 & 18.2", "numbers", ["26.2", "29", "18.2"]),
        ("6.2 (2019 Code),4.3,\"15.2\"", "numbers", ["6.2", "4.3", "15.2"]),
        ("18.2 | 20.2 (x2),7.4 [2 rulings]", "numbers", ["18.2", "20.2", "7.4"]),
        ("9.9, 9.9 , ", "numbers", ["9.9", "9.9"]),
        ("N/A", "numbers", []),
        ('a b; "c, d" | \'e | f\'\tg', "list", ["a b", "c, d", "e | f", "g"]),
        ('"use of the word ""safe""; any dose",members\' events', "list", ['use of the word "safe"; any dose', "members' events"]),
        ("“letters, 'dear doctor'”, n/a, , -", "list", ["letters, 'dear doctor'"]),
        ("prescriber's aid | 'open, never closed", "list", ["prescriber's aid", "'open", "never closed"]),
        ("", "list", []),
        (" ; ,", "list", []),
        (None, "list", []),
    ],
)
def test_packed(spark, raw, kind, values):
    df = spark.createDataFrame([(1, raw, "clash")], "page_id bigint, f string, skeleton string")
    got = packed.split_values(df, "page_id", {"f": kind}).orderBy("pos").collect()
    assert [r.value for r in got] == values and [r.pos for r in got] == list(range(1, len(values) + 1))


def test_packed_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a,b"), (1, "a,b"), (None, "c"), (2, "x" * 100_000 + "|y")], "id bigint, f string")
    one = sorted(map(tuple, packed.split_values(df, "id", {"f": "list"}).collect()), key=str)
    monkeypatch.setattr(packed, "RULE_BROADCAST_ROWS", 0)  # the other way: a shuffled join
    assert sorted(map(tuple, packed.split_values(df, "id", {"f": "list"}).collect()), key=str) == one and len(one) == 7
    assert packed.split_values(df.limit(0), "id", {"f": "list"}).count() == 0
    with pytest.raises(ValueError, match="kind"):
        packed.split_values(df, "id", {"f": "other"})


@settings(max_examples=200, deadline=None)
@given(st.text('w_,;|\n"\'“”', max_size=14))
def test_list_rule_covers_every_piece(skeleton):
    ranges = packed.list_rule(skeleton)
    assert all(0 <= a < e <= len(skeleton) for a, e, _ in ranges)
    assert all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    inside = {k for a, e, _ in ranges for k in range(a, e)}
    assert all(c in ",;|\n_" for k, c in enumerate(skeleton) if k not in inside)


# Metrics ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [3, 4])
def test_rates_against_a_loop(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice("abc"), rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(83)]
    rows = _scored(spark, [*data, ("a", None, 1), ("b", 0.3, None)])
    good, bad = [p for _, p, y in data if y], [p for _, p, y in data if not y]
    chance = sum((x > y) + (x == y) / 2 for x in good for y in bad) / (len(good) * len(bad))
    assert metrics.auroc(rows, ["g"]).first().auroc == pytest.approx(chance)
    assert metrics.auroc(_scored(spark, [("a", p, 1) for p in good]), ["g"]).first().auroc is None
    mean = lambda xs: sum(xs) / len(xs)
    want = lambda rs: (mean([y for *_, y in rs]), mean([(p - y) ** 2 for _, p, y in rs]), mean([p for _, p, _ in rs]))
    m, w = metrics.means(rows, ["g"]).first(), metrics.case_weighted(rows, ["g"], "case").first()
    assert m.n == len(data) and (m.accuracy, m.brier, m.mean_p) == pytest.approx(want(data))
    each = [want([r for r in data if r[0] == c]) for c in sorted({c for c, *_ in data})]
    assert w.cases == len(each) and (w.accuracy, w.brier, w.mean_p) == pytest.approx(tuple(mean(x) for x in zip(*each, strict=True)))


def test_risk_coverage(spark):
    rows = _scored(spark, [("a", 0.9, 1), ("a", 0.7, 0), ("a", 0.7, 0), ("a", 0.5, 1)])
    points = metrics.risk_coverage(rows, ["g"]).orderBy("accepted").collect()
    assert [(p.threshold, p.accepted, p.errors) for p in points] == [(None, 0, 0), (0.9, 1, 0), (0.7, 3, 2), (0.5, 4, 2)]
    assert points[0].risk is None and points[2].risk == pytest.approx(2 / 3)
    assert metrics.aurc(rows, ["g"]).first().aurc == pytest.approx(0.5 * 2 / 3 + 0.25 * 0.5)


@pytest.mark.parametrize("seed", [1, 2])
def test_bins_against_a_loop(spark, seed):
    rng = random.Random(seed)
    data = sorted((rng.randint(50, 70) / 100, rng.randint(0, 1)) for _ in range(97))
    want, start = [], 0
    for i in range(10):
        if start >= len(data):
            break
        end = min(max(round((i + 1) * len(data) / 10), start + 1), len(data))
        while end < len(data) and data[end][0] == data[end - 1][0]:
            end += 1
        want.append((end - start, data[start][0], data[end - 1][0]))
        start = end
    got = metrics.adaptive_bins(_scored(spark, [("a", p, y) for p, y in data]), ["g"]).orderBy("bin").collect()
    assert [(b.n, b.min_p, b.max_p) for b in got] == want
    assert metrics.metric_set(_scored(spark, []), ["g"]).count() == 0


def test_percentile_interval(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(1000)] + [("a", None)], "g string, v double")
    r = metrics.percentile_interval(rows, ["g"], "v").first()
    assert (r.draws, r.lo, r.hi) == (1000, 24.0, 974.0)


# Votes and deferral -------------------------------------------------------------------------------------------------


def test_votes(spark):
    rows = spark.createDataFrame([("x", 1, "breach", 0.9), ("x", 2, "no_breach", 0.6), ("x", 3, "breach", 0.7), ("y", 1, "b", 0.5), ("y", 2, "a", 0.5)], "item string, r int, answer string, p double")
    got = {r["item"]: r for r in voting.modal(rows, ["item"], "answer").collect()}
    assert got["x"].p == pytest.approx(2 / 3) and (got["x"].answer, got["x"].tied) == ("breach", False)
    assert (got["y"].answer, got["y"].tied) == ("a", True)
    pool = {r["item"]: r for r in voting.linear_pool(rows, ["item"], "answer", "p", "breach", "no_breach").collect()}
    assert pool["x"].pooled == pytest.approx((0.9 + 0.4 + 0.7) / 3) and pool["y"].answer == "no_breach"
    bad = voting.incomplete(rows, ["item"], "r", 3).collect()
    assert [(r["item"], r.n, r.reason) for r in bad] == [("y", 2, "missing")]


def _switches(spark, items):
    rows = [(k, x, y, 0.5) for k, choices in items.items() for x, y in choices]
    df = spark.createDataFrame([*rows, (99, None, 1, 0.5)], "item int, level double, correct int, p double")
    return {r["item"]: r for r in deferral.switch_points(df, ["item"], "level", "correct").collect()}


def test_switch_points_of_items_that_turn_once(spark):
    rng = random.Random(12)
    items, want = {}, {}
    for k in range(40):
        xs = sorted(rng.sample(range(5, 96), rng.randint(1, 7)))
        zeros = rng.randint(0, len(xs))
        items[k] = [(x / 100, int(n >= zeros)) for n, x in enumerate(xs)]
        rng.shuffle(items[k])
        want[k] = (xs[0] / 100 - 0.02, "cap_low") if zeros == 0 else (xs[-1] / 100 + 0.02, "cap_high") if zeros == len(xs) else ((xs[zeros - 1] + xs[zeros]) / 200, "midpoint")
    items[40] = [(0.3, 0), (0.3, 0), (0.3, 1), (0.6, 1)]  # both at one level
    items[41], items[42] = [(0.001, 1)], [(0.999, 0)]
    want |= {40: (0.3, "midpoint"), 41: (0.001, "cap_low"), 42: (0.999, "cap_high")}
    got = _switches(spark, items)
    assert set(got) == set(items) and all(r.monotone for r in got.values())
    assert {k: (round(r.point, 9), r.method) for k, r in got.items()} == {k: (pytest.approx(p), m) for k, (p, m) in want.items()}


def test_switch_points_of_items_that_turn_to_and_fro(spark):
    import numpy as np

    rng = random.Random(13)
    items = {}
    while len(items) < 30:
        xs = [x / 10 for x in range(1, 10)]
        ys = [int(rng.random() < x) for x in xs]
        if ys != sorted(ys):
            items[len(items)] = list(zip(xs, ys, strict=True))
    got = _switches(spark, items)
    for k, choices in items.items():
        x, y = (np.array(v, float) for v in zip(*choices, strict=True))
        # The likelihood on a grid that gets finer around its best point.
        a = b = 0.0
        size = 64.0
        for _ in range(60):
            grid = [(a + i * size / 4, b + j * size / 4) for i in range(-4, 5) for j in range(-4, 5)]
            a, b = max(grid, key=lambda c: (y * (c[0] + c[1] * x) - np.logaddexp(0, c[0] + c[1] * x)).sum())
            size *= 0.7
        if b > 1e-3:
            assert got[k].method == "logistic" and got[k].point == pytest.approx(min(max(-a / b, 0.08), 0.92), abs=2e-3)
        elif b < -1e-3:
            n = sum(v == 0 for _, v in choices)
            assert (got[k].point, got[k].method) == (pytest.approx((xs[n - 1] + xs[n]) / 2), "count_midpoint")


def test_poisson_draws(spark):
    rows = spark.createDataFrame([(f"c{k}", k, 1) for k in range(400)] + [(None, 7, 1)], "c string, v int, n int").withColumn("g", F.lit("all"))
    drawn = metrics.resampled(rows, ["g"], "c", ["n", "v"], 203, 5).collect()
    assert {r.draw for r in drawn} == set(range(203))
    sizes = [r.n for r in drawn]
    mean, spread = sum(sizes) / 203, (sum(x * x for x in sizes) / 203 - (sum(sizes) / 203) ** 2) ** 0.5
    assert mean == pytest.approx(400, abs=6) and spread == pytest.approx(20, rel=0.2)  # the root of 400
    means = metrics.intervals(metrics.resampled(rows, ["g"], "c", ["n", "v"], 400, 6).withColumn("m", F.col("v") / F.col("n")), ["g"], ["m"]).first()
    exact = 1.96 * 115.5 / 20  # the spread of 0 to 399, over the root of 400
    assert (means.lo, means.hi) == (pytest.approx(199.5 - exact, abs=2.5), pytest.approx(199.5 + exact, abs=2.5))
    plan = metrics.resampled(rows, ["g"], "c", ["n"], 1000, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_optimal_budget_may_split_equal_p(spark):
    rows = _scored(spark, [("a", 0.9, 0), ("a", 0.9, 1), ("a", 0.96, 1)])
    assert deferral.optimal_budget(rows, ["g"], 100.0, [25], "item").first().best_loss == 25.0
    r = deferral.budget_comparison(rows, ["g"], 100, [5, 25], "item").orderBy("cost").collect()
    assert [(x.deferred, x.n) for x in r] == [(2, 3), (0, 3)] and [x.always_loss for x in r] == [pytest.approx(100 / 3)] * 2
    assert [x.matched_loss for x in r] == [pytest.approx(10 / 3), pytest.approx(100 / 3)] and [x.best_loss for x in r] == [pytest.approx(5 / 3), pytest.approx(25 / 3)]
    assert deferral.midpoints([5, 15, 25], 100) == [0.975, 0.9, 0.8, 0.375]


def test_levels_and_bins(spark):
    rows = _scored(spark, [("a", 0.9, 1), ("a", 0.9, 1), ("a", 0.97, 0), ("a", 0.5, 1)])
    at5 = deferral.levels(rows, [5], 100, ["g"]).first()
    assert (at5.deferral_rate, at5.accuracy_answered, at5.accuracy_deferred) == (0.75, 0.0, 1.0) and at5.mean_loss == pytest.approx((15 + 100) / 4)
    bins = deferral.implied_bins(rows, ["item"], [5, 15], 100).orderBy("bin").collect()
    assert [(b.bin, b.n) for b in bins] == [(0, 1), (1, 2), (2, 1)] and (bins[0].low, bins[0].high) == (0.95, 1.0)
    assert deferral.implied_bins(rows, ["item"], [-10, 150], 100).count() == 0
    budget = deferral.budget_curve(rows, ["g"], 100.0, 5.0, "item").orderBy("n").collect()
    assert [b.loss for b in budget] == [105.0, 110.0, 115.0, 20.0]
    assert deferral.optimal_budget(rows, ["g"], 100.0, [5, 60], "item").orderBy("cost").collect()[0].best_loss == 20.0


# Ranking, ledgers, intervals ----------------------------------------------------------------------------------------


def test_round_robin(spark):
    rows = [(c, f"{c}{k}") for c, n in (("a", 5), ("b", 2), ("c", 1)) for k in range(n)]
    a = {r.item: r.rank for r in ranking.round_robin(spark.createDataFrame(rows, "case string, item string"), "case", "item", 7).collect()}
    b = {r.item: r.rank for r in ranking.round_robin(spark.createDataFrame(rows[::-1], "case string, item string"), "case", "item", 7).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 9))
    assert {i[0] for i, r in a.items() if r <= 3} == {"a", "b", "c"} and {i[0] for i, r in a.items() if r > 5} == {"a"}


def test_ledger(spark):
    plan = spark.createDataFrame([(1,), (2,), (3,), (4,)], "call_id bigint")
    got = spark.createDataFrame([(1, "ok"), (2, "R"), (3, "ok"), (3, "other"), (9, "ok"), (None, "ok")], "call_id bigint, s string")
    failed = F.col("s") == "R"
    assert {r.call_id: r.state for r in ledger.coverage(plan, got, "call_id", failed).collect()} == {1: "done", 2: "error", 3: "duplicate", 4: "pending"}
    assert {r.call_id for r in ledger.missing(plan, got, "call_id", failed).collect()} == {2, 4}
    assert [r.call_id for r in ledger.missing(plan, got, "call_id", failed, plan.where("call_id < 3")).collect()] == [2]
    assert {r.call_id: r.outcome for r in ledger.classify_import(plan, got, "call_id", failed, F.col("s")).collect()} == {1: "completed", 2: "failed", 3: "conflict", 9: "unknown"}
    assert {r.call_id for r in ledger.orphans(plan, got.where("call_id is not null"), "call_id").collect()} == {9}
    new = spark.createDataFrame([(1, "new"), (7, "new")], "call_id bigint, s string")
    assert {tuple(r) for r in ledger.upsert(got.where("call_id < 3"), new, ["call_id"]).collect()} == {(1, "new"), (2, "R"), (7, "new")}


def test_intervals(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9), ("k", None)], "k string, at int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 5, "c"), ("k", 9, "d"), ("k", None, "e")], "k string, at int, h string")
    assert {(r.k, r.at, r.head) for r in intervals.asof_last(left, right, ["k"], "at", "h", "head").collect()} == {("k", 5, "c"), ("k", 1, None), ("j", 9, None), ("k", None, None)}
    spans = spark.createDataFrame([("k", 0, 3), ("k", 3, 5), ("k", 8, 9), ("k", 8, 8)], "k string, s int, e int")
    assert {(r.s, r.e) for r in intervals.merged(spans, ["k"], "s", "e").collect()} == {(0, 5), (8, 9)}
    assert [(r.s, r.e) for r in intervals.gaps(spans, ["k"], "s", "e").collect()] == [(5, 8)]
    points = spark.createDataFrame([("k", p) for p in range(10)], "k string, at int")
    for slot in (1, 4, 100):
        assert {r.at for r in intervals.in_any_span(points, spans, ["k"], "at", "s", "e", slot).collect()} == {0, 1, 2, 3, 4, 8}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ordered_against_a_loop(spark, seed):
    from casemill.operators.ordered import Ordered

    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.choice([None, 1, 2, 3])) for k in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    made = Ordered(df, ["k"], ["at"]).total("s", F.col("v")).number("n").largest_before("m", F.col("v")).last_seen("l", F.col("v")).neighbour("p", F.col("v")).neighbour("f", F.col("at"), ahead=True).rows()
    got = {(r.k, r.at): (r.s, r.n, r.m, r.l, r.p.v if r.p else "start", r.f.v if r.f else "end") for r in made.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((at, v) for k, at, v in rows if k == key)
        for i, (at, _) in enumerate(own):
            seen = [v for _, v in own[: i + 1] if v is not None]
            before = [v for _, v in own[:i] if v is not None]
            want[key, at] = (sum(seen), i + 1, max(before, default=None), seen[-1] if seen else None, own[i - 1][1] if i else "start", own[i + 1][0] if i + 1 < len(own) else "end")
    assert got == want


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, None), (4, None), (None, "x"), (5, "")], "id bigint, text string")
    assert {tuple(r) for r in dedupe.collapse(df, ["text"], "id").collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1)}
    assert {tuple(r) for r in dedupe.classes(df.distinct(), "id", "text").collect()} == {(1, 1, 2), (2, 1, 2), (5, 5, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)] + [(None, 3), (200, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# Resolution and gates -----------------------------------------------------------------------------------------------


def test_resolve(spark):
    rows = [(None, None, None), ("x", None, None), ("x", "x", None), ("x", "y", "y"), ("x", "y", "z")]
    made = resolve.resolve({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")})
    got = spark.createDataFrame(rows, "a string, b string, c string").select(made.alias("r")).collect()
    assert [(r.r.value, r.r.basis, r.r.conflict) for r in got] == [(None, "none", False), ("x", "single", False), ("x", "unanimous", False), ("y", "majority", True), ("x", "a", True)]
    assert got[4].r.sources == {"a": "x", "b": "y", "c": "z"}


def test_chains(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 100), (50, 50), (None, 1)]
    got = {r.old: (r.end, r.steps) for r in resolve.chain_ends(spark.createDataFrame(links, "old bigint, new bigint"), "old", "new").collect()}
    assert all(got[k] == (20, 20 - k) for k in range(20)) and got[50][0] == 50 and got[100] == (None, None)


def test_gates(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "a string, b string")
    assert [tuple(r) for r in gates.asymmetric(edges, "a", "b").collect()] == [("a", "c")]
    with pytest.raises(gates.GateFailure, match="twice: 1"):
        gates.enforce({"twice": gates.unique(edges, ["a"]), "fine": gates.check(edges, F.col("a").isNotNull())})
    gates.enforce({"fine": edges.limit(0)})


def test_text(spark):
    row = lambda **x: spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} string" for k in x))
    one = lambda c, s: row(s=s).select(c).first()[0]
    assert one(t.case_numbers("s"), "PCA/12/3/07 and PCA/12/3/07, PCA/9/11/21") == ["PCA/12/3/07", "PCA/9/11/21"]
    assert one(t.iso_date("s"), " 5 February 2012 ") == "2012-02-05" and one(t.iso_date("s"), "31/02/2012") is None and one(t.iso_date("s"), "05/12/2012") == "2012-12-05"
    assert one(t.redact("s", t.case_numbers("s")), "PCA/1/2/07, PCA/1/2/071 x") == "[case], PCA/1/2/071 x"
    assert one(t.fold_name("s"), "Pélham & Co. Ltd") == "pelham"
    assert one(t.sentences("s"), "One.  Two!\nThree 3.5 four") == ["One.", "Two!", "Three 3.5 four"]
    assert one(t.clause_tokens("s"), "Clauses 2, 9.1 and 3.2; Clause 2") == ["2", "9.1", "3.2"]
    assert one(t.tags_out("s"), "<p>a&amp;b <b>c</b></p>") == "a&b c" and one(t.norm_path("s"), "https://x.org/A/b/?q#f") == "/a/b"
    assert one(t.upper_ratio("s"), "ABc1") == pytest.approx(2 / 3) and one(t.upper_ratio("s"), "12") == 0
    assert all(one(f("s"), None) is None for f in (t.collapse, t.case_numbers, t.iso_date, t.fold_name, t.slug, t.norm_path))


def test_pages(spark):
    source = "<title>A &amp; B</title><script>x<y</script><h1>Case <b>one</b></h1><p>Text&nbsp;here<br>more</p><a href='/a'>l</a><a href='/a'>m</a><table><tr><th>k</th><td>v</td></tr></table>"
    got = pages.parse_pages(spark.createDataFrame([(1, source), (2, None), (3, "")], "id bigint, html string"), "id", "html").orderBy("id").collect()
    assert got[0].title == "A & B" and got[0].headings[0].text == "Case one" and got[0].links == ["/a"] and got[0].tables == [[["k", "v"]]]
    assert "Text here" in got[0].blocks and "more" in got[0].blocks and got[1].title is None and got[2].blocks == []


# Sources and streams ------------------------------------------------------------------------------------------------


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"call_id": "x", "n": 1}\n\n{"call_id": "y", "n": 2}\nbroken\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("call_id", T.StringType()), T.StructField("n", T.IntegerType())])
    assert jsonl.read_tolerant(spark, str(path), schema).count() == 2
    assert jsonl.read_reporting(spark, str(path), schema).where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        jsonl.read_strict(spark, str(path), schema).collect()
    assert jsonl.read_optional(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    assert jsonl.raw_index(spark, str(path), "call_id").where("call_id = 'x'").first().digest == __import__("hashlib").sha256(b'{"call_id": "x", "n": 1}\n').hexdigest()
    ids = tmp_path / "ids"
    ids.write_text('x\n{"call_id": "y"}\n')
    assert {r.call_id for r in jsonl.read_ids(spark, str(ids)).collect()} == {"x", "y"}
    ids.write_text("x\nx\n")
    with pytest.raises(ValueError, match="repeated"):
        jsonl.read_ids(spark, str(ids))
    made = jsonl.write_generation(spark.createDataFrame([("z", 3)], schema), str(tmp_path / "out"))
    jsonl.append(spark.createDataFrame([("w", 4)], schema), made)
    assert jsonl.read_strict(spark, made, schema).count() == 2
    assert jsonl.file_digests(spark, str(ids)).first().length == 4


def test_streams(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: receipts.stream_table(spark, str(tmp_path / "in"), events)
    calls = receipts.replay(receipts.first_receipts(stream(), "user_id", "ts", "60 days"))
    assert calls.count() == events.select("user_id").distinct().count() == calls.select("user_id").distinct().count()
    want = {(r.w.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = {(r.window_start, r.event_type): r.n for r in receipts.replay(receipts.windowed_counts(stream(), "ts", "1 day", ["event_type"], "60 days"), "complete").collect()}
    assert got == want
    few = events.where("user_id < 5")
    few.write.parquet(str(tmp_path / "few"))
    sessions = receipts.replay(receipts.sessions(receipts.stream_table(spark, str(tmp_path / "few"), events), "ts", "2 hours", ["user_id"], "60 days"), "complete")
    per = defaultdict(int)
    for r in sessions.collect():
        per[r.user_id] += r.n
    assert per == {r.user_id: r["count"] for r in few.groupBy("user_id").count().collect()}


def test_import_classifies_every_receipt(spark, small):
    import __spark_entry__ as entry

    got = entry.queries()["ledger_import_classify_all"](spark, small).agg(F.sum("results")).first()[0]
    assert got == spark.read.parquet(f"{small}/lineitem.parquet").where("l_orderkey is not null").count()


def test_chains_of_orders_are_whole(spark, small):
    import __spark_entry__ as entry

    orders = spark.read.parquet(f"{small}/orders.parquet").groupBy("o_custkey").count()
    most, links = orders.agg(F.max("count") - 1, F.sum(F.col("count") - 1)).first()
    got = entry.queries()["id_chain_orders"](spark, small).agg(F.max("steps"), F.count("end")).first()
    assert tuple(got) == (most, links) and most > 6


# Audits, layout, alignment, identifiers -------------------------------------------------------------------------------


def test_reslices(spark):
    from casemill.operators import audits

    refs = spark.createDataFrame([(1, "s", 0, 3, "abc"), (2, "s", 3, 5, "xx"), (3, "s", 4, 9, "efghi"), (4, "t", 0, 1, "a"), (5, "n", 0, 1, "a"), (6, None, 0, 1, "a"), (7, "s", -1, 2, "ab"), (8, "s", 5, 5, "")], "id int, source string, a int, e int, quote string")
    sources = spark.createDataFrame([("s", "abcdef"), ("n", None)], "source string, text string")
    got = {r.id: r.problem for r in audits.resliced(refs, sources, "source", "a", "e", "text", "quote").collect()}
    assert got == {2: "differs", 3: "out of bounds", 4: "no source", 5: "no source", 7: "out of bounds"}
    assert audits.resliced(refs.limit(0), sources, "source", "a", "e", "text", "quote").count() == 0


def test_verdict_checks_find_every_violation(spark):
    from casemill.operators import audits

    schema = "c string, y int, final string, panel string, board string, dual boolean, flipped boolean"
    rows = [("1", 1, "breach", "breach", None, False, False), ("1", 1, "other", "breach", None, False, False), ("2", 1, "no_breach", "breach", "no_breach", False, False), ("3", 1, None, "breach", None, True, False), ("4", 1, "breach", None, "no_breach", None, None)]
    check = lambda r: {x.check: (x.rows, x.violations) for x in audits.verdict_checks(spark.createDataFrame(r, schema), ["c", "y"], "final", "panel", "board", "dual", "flipped", ["breach", "no_breach"]).collect()}
    assert check(rows) == {"final in domain": (5, 1), "flipped": (5, 1), "dual without panel": (5, 1), "board decides": (5, 1), "key stands once": (5, 1)}
    assert set(check([]).values()) == {(0, 0)}


def test_gates_that_hold_on_the_tables_find_planted_violations(spark, small):
    """What verdict_flips, date_coherence, asymmetric_siblings, roster_difference and date_gate find no case of."""
    v = spark.createDataFrame([("a", True, "breach", "breach"), ("b", False, "breach", "no_breach"), ("c", True, "breach", "no_breach")], "k string, flipped boolean, panel string, board string")
    wrong = F.col("flipped") == (F.col("panel") != F.col("board"))
    assert {r.k for r in gates.check(v, wrong).collect()} == {"a", "b"}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), (None, "a")], "a string, b string")
    assert [tuple(r) for r in gates.asymmetric(edges, "a", "b").collect()] == [("a", "c")]
    left, right = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {tuple(r) for r in gates.set_difference(left, right, ["k"]).collect()} == {("x", "left_only"), ("z", "right_only")}
    dates = spark.createDataFrame([(1, "2020-05-01", "2020-04-01", 2020), (2, "2017-05-01", "2020-04-01", 2020), (3, "2019-12-30", None, 2020), (4, None, None, 2020), (5, "2021-01-01", "2021-02-01", 2020)], "k int, a string, b string, y int")
    got = {r.k: (r.d.first, r.d.second, r.d.basis) for r in dates.select("k", resolve.ordered_dates(F.col("a"), F.col("b"), F.col("y")).alias("d")).collect()}
    assert got == {1: (None, None, "out of order"), 2: (None, "2020-04-01", "year conflict"), 3: ("2019-12-30", None, "stated"), 4: (None, None, "none"), 5: (None, "2021-02-01", "year conflict")}


def test_ladder_and_verdicts_from_lists(spark):
    rows = spark.createDataFrame([("a", "1", "2", "3"), ("b", None, "2", "2"), ("c", None, "2", "3"), ("d", None, None, None)], "k string, x string, y string, z string")
    made = resolve.ladder({"first": [F.col("x")], "second": [F.col("y"), F.col("z")]})
    assert {r.k: tuple(r.r) for r in rows.select("k", made.alias("r")).collect()} == {"a": ("1", "first", False), "b": ("2", "second", False), "c": (None, "second conflict", True), "d": (None, "none", False)}
    said = [("p", "panel", "breach"), ("p", "list", "breach"), ("q", "panel", "breach"), ("q", "board", "no_breach"), ("q", "list", "no_breach"), ("r", "panel", "breach"), ("r", "list", "no_breach"), ("s", "panel", "breach"), ("t", "list", "breach"), ("t", "list", "no_breach"), ("u", "list", "breach")]
    got = {r.k: (r.panel, r.board, r.final, r.dual, r.flipped, r.basis) for r in resolve.verdict_rows(spark.createDataFrame(said, "k string, body string, polarity string"), ["k"], "polarity", "body").collect()}
    assert got["p"] == ("breach", None, "breach", False, False, "unanimous") and got["q"] == ("breach", "no_breach", "no_breach", False, True, "unanimous")
    assert got["r"][2:] == ("no_breach", False, False, "conflict") and got["s"][2:] == (None, False, False, "unlisted") and got["t"][2:4] == (None, True) and got["u"][5] == "list"


def test_renamed_tokens(spark):
    df = spark.createDataFrame([("a", ["1", "2", "2", "3"]), ("b", ["1"]), ("c", None)], "k string, t array<string>")
    fixes = spark.createDataFrame([("a", "2", "9"), ("a", "3", None), ("a", "7", "8"), (None, "1", "x")], "k string, old string, new string")
    assert {r.k: (r.t, r.changed) for r in resolve.rename_tokens(df, "k", "t", fixes, "old", "new").collect()} == {"a": (["1", "9"], True), "b": (["1"], False), "c": (None, False)}


def test_rectangles_and_cells(spark):
    from casemill.operators import audits

    rows = [("ok", k, "c", "v") for k in (1, 2, 3)] + [("dup", k, "c", "v") for k in (1, 2, 2, 3)] + [("few", 1, "c", "v")] + [("odd", k, "c", "v") for k in (1, 2, 4)] + [("mix", k, f"c{k}", f"v{k}") for k in (1, 2, 3)] + [("nil", None, "c", "v")]
    df = spark.createDataFrame(rows, "item string, r int, content string, v string")
    assert {x["item"]: x.problem for x in audits.rectangle(df, ["item"], "r", 3, F.col("content")).collect()} == {"dup": "duplicate", "few": "missing", "odd": "unexpected", "mix": "differs", "nil": "unexpected"}
    for k in (0, 2, -1):
        with pytest.raises(ValueError, match="odd"):
            audits.rectangle(df, ["item"], "r", k, F.col("content"))
    got = {x["item"]: (x.c1, x.c2, x.c3, x.duplicates) for x in audits.cells(df, ["item"], "r", [1, 2, 3], "v").collect()}
    assert got["mix"] == ("v1", "v2", "v3", 0) and got["dup"][3] == 1 and got["few"] == ("v", None, None, 0)


def test_layout(spark):
    from casemill.operators import layout

    ink = [("p", r, a, b) for r in range(8) for a, b in ((10, 190), (220, 400))] + [("p", 9, 10, 400), ("q", 1, 0, 500), ("p", 10, None, 5)]
    boxes = spark.createDataFrame(ink, "page string, r int, a int, b int")
    got = {r.page: r for r in layout.gutters(boxes, "page", "r", "a", "b", 100, 300, 12, 0.8, 0.5, 3).collect()}
    assert (got["p"].rows, got["p"].position, got["p"].state) == (9, 190, "columns") and got["p"].share == pytest.approx(8 / 9)
    assert (got["q"].share, got["q"].position, got["q"].state) == (0.0, None, "single")
    lines = spark.createDataFrame([("p", 90, "full"), ("p", 80, "right"), ("p", 79, "left"), ("p", 70, "left"), ("p", 60, "full"), ("p", 50, "right"), ("p", 40, "left")], "page string, y int, side string")
    order = [r.y for r in layout.reading_order(lines, "page", "y", "side").orderBy("place").collect()]
    assert order == [90, 79, 70, 80, 60, 40, 50]
    cuts = spark.createDataFrame([("p", 75), ("p", 50)], "page string, cut int")
    bands = layout.order_by_bands(lines.where("side != 'full'"), cuts.withColumnRenamed("cut", "y"), "page", "y", "side", "y").orderBy("place").collect()
    assert [(r.y, r.band) for r in bands] == [(79, 0), (80, 0), (70, 1), (50, 1), (40, 2)]
    heads, gaps = spark.createDataFrame([("p", 30), ("p", 70)], "page string, h int"), spark.createDataFrame([("p", 31, 40), ("p", 45, 60), ("p", 75, 80), ("p", 84, 88), ("p", 95, 99)], "page string, a int, b int")
    got = {r.h: (r.cut, r.state) for r in layout.band_cuts(heads, gaps, lines.where("side = 'left'").unionByName(spark.createDataFrame([("p", 90, "left")], lines.schema)), "page", "h", "a", "b", "y", 3.0).collect()}
    assert got == {30: (52.5, "cut"), 70: (None, "undecided")}


def test_alignment(spark):
    from casemill.operators import alignment

    rng = random.Random(2)
    words = [f"w{rng.randint(0, 50)}" for _ in range(200)]
    rows = [(1, " ".join(words), " ".join([*words[20:60], "new", *words[100:103]])), (2, None, "a b"), (3, "a", None), (4, "abcdef", "defabcx")]
    got = {r.k: r for r in alignment.align(spark.createDataFrame(rows, "k int, f string, w string"), "k", "f", "w").collect()}
    assert (got[1].words, got[1].matched) == (44, 40) and got[1].share == pytest.approx(40 / 44) and got[1].differences
    assert got[2].matched == 0 and got[3].share is None and (got[4].pieces, got[4].lost) == (2, 1)
    for _ in range(50):
        whole, part = "".join(rng.choices("ab", k=30)), "".join(rng.choices("abc", k=12))
        sizes, lost = alignment.cover(whole, part)
        at, want, nowhere = 0, [], 0
        while at < len(part):
            best = max((n for n in range(len(part) - at + 1) if part[at : at + n] in whole), default=0)
            want += [best] if best else []
            nowhere += not best
            at += max(best, 1)
        assert (sizes, lost) == (want, nowhere)


def test_identifiers(spark):
    from casemill.functions import ids

    df = spark.createDataFrame([("see auth - 216 / 06/2024 here", ["AUTH/0216/6/24", "AUTH/0007/1/20", "bad"], ["x", "sib_3"], "7", "BATCH_STATE_Ended")], "t string, own array<string>, tags array<string>, r string, s string")
    r = df.select(ids.normalised(F.col("t")).alias("n"), ids.serials(F.col("own")).alias("s"), ids.file_name(F.col("own")).alias("f"), ids.cluster(F.col("tags"), F.lit("c"), "sib_").alias("c"), ids.cluster(F.array(F.lit("sib_1"), F.lit("sib_2")), F.lit("c"), "sib_").alias("two"), ids.cluster(F.array(F.lit("x")), F.lit("c"), "sib_").alias("none"), ids.usable_rank(F.lit("true"), F.lit("0"), F.col("r")).alias("r"), ids.state(F.col("s"), ["ended"]).alias("st"), ids.state(F.lit("odd"), ["ended"]).alias("odd"), ids.no_blanks(F.lit(" a b\n")).alias("b"), F.regexp_like(F.lit("a  (b)\nc"), ids.loose_literal(F.lit("a (b) c"))).alias("l"), ids.residual(F.lit("the 216/06 and AUTH-77 but 99"), F.array(F.lit(216), F.lit(77), F.lit(99))).alias("left")).first()
    assert (r.n, r.s, r.f) == ("AUTH/0216/6/24", [7, 216], "AUTH-0216-6-24__AUTH-0007-1-20__bad.html")
    assert (r.c, r.two, r.none, r.r, r.st, r.odd, r.b, r.l, r.left) == ("sib_3", None, "case:c", 7, "ended", None, "ab", True, [77, 216])


def test_page_parts(spark):
    page = "<h1>Case</h1><div class='field-label'>Company:</div><div class='field-value'><div>Acme <b>Ltd</b></div></div><dl><dt>Date</dt><dd>2020</dd><dd>2021</dd></dl><div role='tabpanel' id='rep'><p>One <a href='/x'>link</a></p><ul><li>item</li></ul></div><script>no</script><div class='tab-pane' id='sum'>Two"
    r = pages.page_parts(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, raw string"), "id", "raw").orderBy("id").collect()
    assert [(i.label, i.value) for i in r[0]["items"]] == [("Company", "Acme Ltd"), ("Date", "2020; 2021")]
    assert [(p.id, p.text) for p in r[0].panes] == [("rep", "One link item"), ("sum", "Two")]
    assert {(s.kind, r[0].text[s.start : s.end].strip(), s.detail) for s in r[0].spans} == {("emphasis", "Ltd", ""), ("link", "link", "/x"), ("list", "item", "")}
    assert r[1].text is None and r[2].text == "" and "no" not in r[0].text.split()


def test_heading_confidence_and_pane_states(spark):
    from casemill.operators import matching

    sure = lambda **e: pages.heading_confidence(**{**dict(date_trailer=F.lit(False), unbalanced_quote=F.lit(False), chars=F.lit(30), words=F.lit(4), terminal=F.lit(False), upper_ratio=F.lit(0.1), numbered=F.lit(False)), **e})
    cases = [({}, "medium"), ({"date_trailer": F.lit(True)}, "low"), ({"chars": F.lit(91), "upper_ratio": F.lit(1.0)}, "low"), ({"tag": F.lit("h2")}, "high"), ({"tag": F.lit("h2"), "terminal": F.lit(True), "words": F.lit(9)}, "low"), ({"upper_ratio": F.lit(0.8)}, "high"), ({"upper_ratio": F.lit(0.9), "in_cell": F.lit(True)}, "low"), ({"terminal": F.lit(True)}, "low"), ({"words": F.lit(10)}, "low"), ({"words": F.lit(10), "numbered": F.lit(True)}, "medium"), ({"words": F.lit(13), "emphasised": F.lit(True)}, "low")]
    assert list(spark.range(1).select(*(sure(**e).alias(f"c{k}") for k, (e, _) in enumerate(cases))).first()) == [w for _, w in cases]
    ids_ = lambda *x: F.array(*(F.lit(i) for i in x)) if x else F.array().cast("array<string>")
    state = lambda own, head, title="", body="": matching.pane_state(own, head, F.lit(title), F.lit(body))
    got = spark.range(1).select(state(ids_("A/1/2/20"), ids_()).alias("a"), state(ids_("A/1/2/20"), ids_("A/1/2/20")).alias("b"), state(ids_("A/1/2/20"), ids_("A/1/3/20")).alias("c"), state(ids_("A/1/2/20"), ids_("A/9/3/20")).alias("d"), state(ids_("A/1/2/20"), ids_("A/9/3/20"), "Paragraph 17").alias("e"), state(ids_("A/1/2/20"), ids_("A/9/3/20"), "", " During its consideration of").alias("f")).first()
    assert list(got) == ["ok", "ok", "title typo", "mismatch", "arises from another", "arises from another"]
