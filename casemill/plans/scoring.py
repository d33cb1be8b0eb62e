"""Queries over scored model answers: metrics, votes, paired comparisons, boards, deferral."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import deferral, ledger, metrics, ranking, voting
from casemill.operators.metrics import rounded
from casemill.runtime import table

ANSWER = r'(?i)answer"?\s*:\s*"?(no_breach|breach|no_appeal|appeal)'
JSON_P = r'"probability": *([01]\.[0-9]+)'
PLAIN_P = r"(?:no_breach|breach|no_appeal|appeal)(?:, | \(|\. p = )([01]\.[0-9]+)"
COSTS = [5, 15, 25, 35, 45]
#: Draws of a bootstrap and their seed.
DRAWS, SEED = 1000, 20260802
TAGS = ["appeal", "inter_company", "multi_case"]

#: SQL of the scored rows, as a list of common table expressions that ends with scored.
SCORED = f"""
latest AS (
  SELECT * FROM responses WHERE call_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY imported_utc DESC NULLS LAST, response_id DESC) = 1),
parsed AS (
  SELECT response_id, call_id, item_id, task, model, protocol, repeat_index, case_number,
         nullif(lower(regexp_extract(content, '{ANSWER}', 1)), '') AS answer,
         CAST(coalesce(nullif(regexp_extract(content, '{JSON_P}', 1), ''), nullif(regexp_extract(content, '{PLAIN_P}', 1), '')) AS DOUBLE) AS p
  FROM latest),
scored AS (
  SELECT r.response_id, r.call_id, r.item_id, r.task, r.model, r.protocol, r.repeat_index, r.case_number, i.label, i.tags, i.split, r.answer, r.p,
         CASE WHEN r.answer = i.label THEN 1 WHEN r.answer IS NOT NULL THEN 0 END AS correct
  FROM parsed r JOIN eval_items i ON r.item_id = i.item_id)"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """The latest import of every call, with its answer and probability."""
    rows = ledger.latest(table(spark, d, "responses").where("call_id is not null"), ["call_id"], [F.col("imported_utc").desc_nulls_last(), F.col("response_id").desc()])
    given = lambda pattern: F.nullif(F.regexp_extract("content", pattern, 1), F.lit(""))
    return rows.select("response_id", "call_id", "item_id", "task", "model", "protocol", "repeat_index", "case_number", F.lower(given(ANSWER)).alias("answer"), F.coalesce(given(JSON_P), given(PLAIN_P)).cast("double").alias("p"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Parsed answers with the label, tags and split of their item."""
    items = table(spark, d, "eval_items").select("item_id", "label", "tags", "split")
    correct = F.when(F.col("answer") == F.col("label"), 1).when(F.col("answer").isNotNull(), 0)
    return parsed(spark, d).join(items, "item_id").withColumn("correct", correct)


def metric_set_by_task(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.metric_set(scored(spark, d), ["task"]))


def metric_set_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.metric_set(scored(spark, d), ["model", "protocol"]))


def adaptive_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.adaptive_bins(scored(spark, d), ["task"]))


def auroc_by_task(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(scored(spark, d), ["task"]))


def ece_by_task(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ece(scored(spark, d), ["task"]))


def case_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.case_weighted(scored(spark, d), ["task"], "case_number"))


def tag_strata(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.by_tag(scored(spark, d), "tags", TAGS, ["task"]))


def overall_and_task(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.overall_and_by(scored(spark, d), "task"))


def risk_coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.risk_coverage(scored(spark, d), ["task"]))


def aurc_by_task(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.aurc(scored(spark, d), ["task"]))


def error_transitions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_transitions(scored(spark, d), ["task"], "label", "answer")


def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    drawn = metrics.cluster_bootstrap(scored(spark, d).where("split = 'test'"), ["task"], "case_number", DRAWS, SEED)
    return rounded(metrics.intervals(drawn, ["task"], ["accuracy", "brier", "ece", "auroc"]))


def tag_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    tagged = scored(spark, d).withColumn("tag", F.explode(F.array_distinct(F.array_intersect("tags", F.array(*map(F.lit, TAGS))))))
    drawn = metrics.cluster_bootstrap(tagged, ["tag"], "case_number", DRAWS, SEED)
    return rounded(metrics.intervals(drawn, ["tag"], ["accuracy", "brier", "ece", "auroc"]))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per (item, repeat, model): the answers under protocols P1 and P2, side by side."""
    rows = scored(spark, d).where("p is not null and correct is not null")
    keys = ["item_id", "repeat_index", "model"]
    one = lambda name: metrics.usable(rows.where(F.col("protocol") == name)).groupBy(*keys, "case_number", "task").agg(F.min_by(F.struct("answer", "correct", "p"), "response_id").alias(name.lower()))
    return one("P1").join(one("P2"), [*keys, "case_number", "task"])


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.paired_deltas(_pairs(spark, d), "p1", "p2", ["task"]))


def paired_delta_ci(spark: SparkSession, d: str) -> DataFrame:
    drawn = ranking.paired_delta_draws(_pairs(spark, d), "p1", "p2", ["task"], "case_number", DRAWS, SEED)
    return rounded(metrics.intervals(drawn, ["task"], ["accuracy_delta", "brier_delta", "mean_p_delta"]))


def paired_drops(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses").where("call_id is not null and item_id is not null and repeat_index is not null and model is not null")
    keys = ["item_id", "repeat_index", "model"]
    planned = rows.where("protocol = 'P1'").select(*keys).distinct().join(rows.where("protocol = 'P2'").select(*keys).distinct(), keys)
    done = _pairs(spark, d).select(*keys).distinct()
    return ranking.drops(planned, done, keys, ["model"])


def modal_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voting.modal(parsed(spark, d).where("answer is not null"), ["item_id", "model", "protocol"], "answer"))


def linear_pool(spark: SparkSession, d: str) -> DataFrame:
    """Over the tasks whose answers are breach and no_breach, which one pool can orient."""
    rows = parsed(spark, d).where("answer is not null and p is not null and task in ('T1', 'T2')")
    return rounded(voting.linear_pool(rows, ["item_id", "model", "protocol"], "answer", "p", "breach", "no_breach"))


def draw_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voting.dispersion(parsed(spark, d).where("answer is not null and p is not null"), ["item_id", "model"], "answer", "p"))


def _items_drawn(spark: SparkSession, d: str) -> DataFrame:
    items = voting.item_dispersion(parsed(spark, d).where("answer is not null and p is not null"), ["item_id", "model"], "answer", "p")
    return items.join(table(spark, d, "eval_items").select("item_id", "case_number"), "item_id")


def dispersion_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voting.dispersion_means(_items_drawn(spark, d), ["model"]))


def dispersion_ci(spark: SparkSession, d: str) -> DataFrame:
    drawn = voting.dispersion_draws(_items_drawn(spark, d), ["model"], "case_number", DRAWS, SEED)
    return rounded(metrics.intervals(drawn, ["model"], ["disagreement", "modal_share", "entropy", "sd"]))


def k_prefix_votes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voting.prefix_votes(parsed(spark, d).where("answer is not null"), ["item_id", "model", "protocol"], "repeat_index", "answer", [1, 3, 5, 7]))


def incomplete_groups(spark: SparkSession, d: str) -> DataFrame:
    return voting.incomplete(table(spark, d, "responses").where("item_id is not null"), ["item_id", "model", "protocol"], "repeat_index", 7)


def common_prefix_board(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.common_prefix_board(scored(spark, d), "task", "model", "repeat_index"))


def headline_runs(spark: SparkSession, d: str) -> DataFrame:
    return ranking.largest_run(parsed(spark, d), "model", "protocol", "response_id")


def deferral_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.levels(scored(spark, d), COSTS, 100, ["task"]))


def matched_budget_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.budget_curve(scored(spark, d).where("split = 'test'"), ["task"], 100.0, 25.0, "response_id"))


def optimal_budget(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.optimal_budget(scored(spark, d), ["task"], 100.0, COSTS, "response_id"))


def budget_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.budget_comparison(scored(spark, d), ["model"], 100, COSTS, "response_id"))


def board_from_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.board_metrics(scored(spark, d), ["model"], ["item_id"], COSTS, 100, "answer", "label"))


def deferral_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.level_intervals(scored(spark, d), COSTS, 100, ["task"], "case_number", DRAWS, SEED))


def implied_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deferral.implied_bins(scored(spark, d), ["item_id", "model"], COSTS, 100))


def monotone_violations(spark: SparkSession, d: str) -> DataFrame:
    """The tables have no cost levels; repeat_index stands for them here and in switch_points."""
    return deferral.monotone_patterns(scored(spark, d), ["item_id", "model", "protocol"], "repeat_index", "correct", "response_id")


def switch_points(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("level", F.col("repeat_index") / F.lit(10.0))
    return rounded(deferral.switch_points(rows, ["item_id", "model", "protocol"], "level", "correct"), 6)


def switch_points_once(spark: SparkSession, d: str) -> DataFrame:
    """The items of switch_points that turn once at most, which SQL can say too."""
    return switch_points(spark, d).where("monotone")


QUERIES = {f.__name__: f for f in (metric_set_by_task, metric_set_by_model, adaptive_bins, auroc_by_task, ece_by_task, case_weighted, tag_strata, overall_and_task, risk_coverage_curve, aurc_by_task, error_transitions, cluster_bootstrap_ci, tag_bootstrap_ci, paired_delta, paired_delta_ci, paired_drops, modal_vote, linear_pool, draw_dispersion, dispersion_means, dispersion_ci, k_prefix_votes, incomplete_groups, common_prefix_board, headline_runs, deferral_levels, matched_budget_loss, optimal_budget, budget_comparison, board_from_levels, deferral_ci, implied_bins, monotone_violations, switch_points, switch_points_once)}


def _bins(by: str, hist: str = "") -> str:
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys)
    xs = ", ".join(f"x.{k}" for k in keys)
    hist = hist or f"SELECT {by}, p, count(*) AS n, sum(correct) AS k FROM ok GROUP BY {by}, p"
    return f"""
ok AS (SELECT * FROM scored WHERE p IS NOT NULL AND correct IS NOT NULL),
hist AS ({hist}),
curve AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {by} ORDER BY p) AS BIGINT) AS c FROM hist),
ends AS (
  SELECT {by}, 0 AS i, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS last, CAST(sum(n) AS BIGINT) AS total FROM hist GROUP BY {by}
  UNION ALL
  SELECT {xs}, x.i + 1, x.last, min(y.c), x.total FROM ends x JOIN curve y ON {same}
   AND y.c >= least(x.total, greatest(CAST(round_even((x.i + 1) * x.total / 10.0, 0) AS BIGINT), x.last + 1))
  WHERE x.i < 10 AND x.last < x.total GROUP BY {xs}, x.i, x.last, x.total),
bins AS (
  SELECT {xs}, x.i - 1 AS bin, sum(y.n) AS n, min(y.p) AS min_p, max(y.p) AS max_p, sum(y.p * y.n) / sum(y.n) AS mean_p, sum(y.k) / sum(y.n) AS accuracy
  FROM ends x JOIN curve y ON {same} AND y.c > x.first AND y.c <= x.last WHERE x.i > 0 GROUP BY {xs}, x.i),
ece AS (SELECT {by}, sum(n * abs(accuracy - mean_p)) / sum(n) AS ece FROM bins GROUP BY {by}),
rk AS (
  SELECT {by}, sum(k) AS pos, sum(n) AS total, sum((c - n + (n + 1) / 2.0) * k) AS ranks FROM curve GROUP BY {by}),
roc AS (SELECT {by}, (ranks - pos * (pos + 1) / 2.0) / nullif(CAST(pos AS DOUBLE) * (total - pos), 0) AS auroc FROM rk)"""


def _metric_set(by: str) -> str:
    keys = [k.strip() for k in by.split(",")]
    using = ", ".join(keys)
    return f"""WITH RECURSIVE {SCORED}, {_bins(by)},
m AS (SELECT {by}, count(*) AS n, avg(correct) AS accuracy, avg((p - correct) * (p - correct)) AS brier, avg(p) AS mean_p FROM ok GROUP BY {by})
SELECT {by}, n, round(accuracy, 9) AS accuracy, round(brier, 9) AS brier, round(mean_p, 9) AS mean_p, round(ece, 9) AS ece, round(auroc, 9) AS auroc
FROM m LEFT JOIN ece USING ({using}) LEFT JOIN roc USING ({using})"""


_POISSON = " + ".join(f"CAST(u >= {x} AS BIGINT)" for x in metrics.POISSON)


def _weights(source: str, cluster: str) -> str:
    """How often each draw takes each cluster of a source."""
    return f"""drawn AS (SELECT c, draw, {_POISSON} AS w FROM (
  SELECT c, d AS draw, ('0x' || substr(md5('{SEED}|' || c || '|' || (d // 4)), 1 + 8 * (d % 4), 8))::BIGINT AS u
  FROM (SELECT DISTINCT {cluster} AS c FROM {source} WHERE {cluster} IS NOT NULL), (SELECT unnest(range({DRAWS})) AS d))),
taken AS (SELECT * FROM drawn WHERE w > 0)"""


def _percentiles(by: str, values: str, names: list[str]) -> str:
    """Percentile intervals of the columns names of a table of drawn values."""
    long = " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM {values}" for m in names)
    return f"""long AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
placed AS (SELECT {by}, metric, v, row_number() OVER (PARTITION BY {by}, metric ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {by}, metric) AS n FROM long)
SELECT {by}, metric, count(*) AS draws, round(max(CASE WHEN i = floor(0.025 * (n - 1)) THEN v END), 9) AS lo, round(max(CASE WHEN i = round_even(0.975 * (n - 1), 0) THEN v END), 9) AS hi FROM placed GROUP BY {by}, metric"""


def _metric_ci(by: str, rows: str) -> str:
    """Bootstrap of the metric set over cases."""
    hist = f"SELECT {by}, draw, p, sum(n * w) AS n, sum(k * w) AS k FROM per JOIN taken ON case_number = c GROUP BY {by}, draw, p"
    return f"""WITH RECURSIVE {SCORED}, usable AS (SELECT * FROM scored WHERE p IS NOT NULL AND correct IS NOT NULL), rowset AS ({rows}),
per AS (SELECT {by}, case_number, p, count(*) AS n, sum(correct) AS k FROM rowset WHERE case_number IS NOT NULL GROUP BY ALL),
{_weights("per", "case_number")}, {_bins(f"{by}, draw", hist)},
m AS (SELECT {by}, draw, sum(k) / sum(n) AS accuracy, sum(k * (1 - p) * (1 - p) + (n - k) * p * p) / sum(n) AS brier FROM hist GROUP BY {by}, draw),
whole AS (SELECT * FROM m LEFT JOIN ece USING ({by}, draw) LEFT JOIN roc USING ({by}, draw)),
{_percentiles(by, "whole", ["accuracy", "brier", "ece", "auroc"])}"""


_OK = f"WITH {SCORED}, ok AS (SELECT * FROM scored WHERE p IS NOT NULL AND correct IS NOT NULL)"
_DESC = """hist AS (SELECT task, p, count(*) AS n, count(*) - sum(correct) AS w FROM ok GROUP BY task, p),
curve AS (SELECT *, CAST(sum(n) OVER (PARTITION BY task ORDER BY p DESC) AS BIGINT) AS accepted, CAST(sum(w) OVER (PARTITION BY task ORDER BY p DESC) AS BIGINT) AS errors, CAST(sum(n) OVER (PARTITION BY task) AS BIGINT) AS total FROM hist)"""
_PAIRS = """
side AS (SELECT item_id, repeat_index, model, case_number, task, protocol, min_by({'a': answer, 'c': correct, 'p': p}, response_id) AS v FROM ok GROUP BY ALL),
pairs AS (SELECT x.item_id, x.repeat_index, x.model, x.case_number, x.task, x.v AS l, y.v AS r FROM side x JOIN side y USING (item_id, repeat_index, model, case_number, task) WHERE x.protocol = 'P1' AND y.protocol = 'P2')"""
_PARSED = f"WITH {SCORED}"
_SPREAD_SQL = """a AS (SELECT item_id, model, answer, count(*) AS n FROM parsed WHERE answer IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
e AS (SELECT item_id, model, CAST(count(*) > 1 AS BIGINT) AS disagreement, max(n) / sum(n) AS modal_share, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM a GROUP BY ALL),
v AS (SELECT item_id, model, count(*) AS draws, stddev_pop(p) AS sd FROM parsed WHERE answer IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
spread AS (SELECT v.*, e.* EXCLUDE (item_id, model), i.case_number FROM v JOIN e USING (item_id, model) JOIN eval_items i USING (item_id))"""

ORACLE_SQL = {
    "metric_set_by_task": _metric_set("task"),
    "metric_set_by_model": _metric_set("model, protocol"),
    "adaptive_bins": f"""WITH RECURSIVE {SCORED}, {_bins("task")}
SELECT task, bin, CAST(n AS BIGINT) AS n, min_p, max_p, round(mean_p, 9) AS mean_p, round(accuracy, 9) AS accuracy, round(accuracy - mean_p, 9) AS gap FROM bins""",
    "auroc_by_task": f"WITH RECURSIVE {SCORED}, {_bins('task')} SELECT task, round(auroc, 9) AS auroc FROM roc",
    "ece_by_task": f"WITH RECURSIVE {SCORED}, {_bins('task')} SELECT task, round(ece, 9) AS ece FROM ece",
    "case_weighted": f"""{_OK}, c AS (SELECT task, case_number, avg(correct) AS a, avg((p - correct) * (p - correct)) AS b, avg(p) AS m FROM ok GROUP BY task, case_number)
SELECT task, count(*) AS cases, round(avg(a), 9) AS accuracy, round(avg(b), 9) AS brier, round(avg(m), 9) AS mean_p FROM c GROUP BY task""",
    "tag_strata": f"""{_OK}, t AS (SELECT *, unnest(list_distinct(list_intersect(tags, {TAGS}))) AS tag FROM ok)
SELECT task, tag, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg((p - correct) * (p - correct)), 9) AS brier, round(avg(p), 9) AS mean_p FROM t GROUP BY task, tag""",
    "overall_and_task": f"""{_OK} SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE 'key' END AS scope, task, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg((p - correct) * (p - correct)), 9) AS brier, round(avg(p), 9) AS mean_p
FROM ok GROUP BY GROUPING SETS ((task), ())""",
    "risk_coverage_curve": f"""{_OK}, {_DESC}
SELECT task, p AS threshold, accepted, errors, round(accepted / total, 9) AS coverage, round(errors / accepted, 9) AS risk FROM curve
UNION ALL SELECT DISTINCT task, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM curve""",
    "aurc_by_task": f"{_OK}, {_DESC} SELECT task, round(sum(n * errors / accepted) / sum(n), 9) AS aurc FROM curve GROUP BY task",
    "error_transitions": f"""{_OK}, h AS (SELECT task, label, answer, p, count(*) AS n FROM ok WHERE correct = 0 GROUP BY ALL)
SELECT task, label, answer, p AS threshold, CAST(sum(n) OVER (PARTITION BY task, label, answer ORDER BY p DESC) AS BIGINT) AS errors FROM h""",
    "cluster_bootstrap_ci": _metric_ci("task", "SELECT * FROM usable WHERE split = 'test'"),
    "tag_bootstrap_ci": _metric_ci("tag", f"SELECT *, unnest(list_distinct(list_intersect(tags, {TAGS}))) AS tag FROM usable"),
    "paired_delta_ci": f"""{_OK}, {_PAIRS},
per AS (SELECT task, case_number, count(*) AS n, sum(l.c - r.c) AS a, sum((l.p - l.c) * (l.p - l.c) - (r.p - r.c) * (r.p - r.c)) AS b, sum(l.p - r.p) AS m FROM pairs GROUP BY task, case_number),
{_weights("per", "case_number")},
sums AS (SELECT task, draw, sum(a * w) / sum(n * w) AS accuracy_delta, sum(b * w) / sum(n * w) AS brier_delta, sum(m * w) / sum(n * w) AS mean_p_delta FROM per JOIN taken ON case_number = c GROUP BY task, draw),
{_percentiles("task", "sums", ["accuracy_delta", "brier_delta", "mean_p_delta"])}""",
    "dispersion_means": f"""{_PARSED}, {_SPREAD_SQL}
SELECT model, count(*) AS items, CAST(sum(draws) AS BIGINT) AS draws, round(avg(disagreement), 9) AS disagreement, round(avg(modal_share), 9) AS modal_share, round(avg(entropy), 9) AS entropy, round(avg(sd), 9) AS sd FROM spread GROUP BY model""",
    "dispersion_ci": f"""{_PARSED}, {_SPREAD_SQL},
per AS (SELECT model, case_number, count(*) AS n, sum(disagreement) AS d, sum(modal_share) AS m, sum(entropy) AS e, sum(sd) AS s FROM spread GROUP BY model, case_number),
{_weights("per", "case_number")},
sums AS (SELECT model, draw, sum(d * w) / sum(n * w) AS disagreement, sum(m * w) / sum(n * w) AS modal_share, sum(e * w) / sum(n * w) AS entropy, sum(s * w) / sum(n * w) AS sd FROM per JOIN taken ON case_number = c GROUP BY model, draw),
{_percentiles("model", "sums", ["disagreement", "modal_share", "entropy", "sd"])}""",
    "deferral_ci": f"""{_OK}, g AS (SELECT CAST(unnest({COSTS}) AS INTEGER) AS cost),
x AS (SELECT task, cost, case_number, CAST((1 - p) * 100 > cost AS BIGINT) AS d, correct FROM ok, g),
per AS (SELECT task, cost, case_number, count(*) AS n, sum(d) AS d, sum(CASE WHEN d = 1 THEN cost ELSE (1 - correct) * 100 END) AS l FROM x GROUP BY ALL),
{_weights("per", "case_number")},
sums AS (SELECT task, cost, draw, sum(d * w) / sum(n * w) AS deferral_rate, sum(l * w) / sum(n * w) AS mean_loss FROM per JOIN taken ON case_number = c GROUP BY task, cost, draw),
{_percentiles("task, cost", "sums", ["deferral_rate", "mean_loss"])}""",
    "budget_comparison": f"""{_OK}, r AS (SELECT model, row_number() OVER o AS n, sum(1 - correct) OVER (PARTITION BY model ORDER BY p, response_id ROWS UNBOUNDED PRECEDING) AS caught, sum(1 - correct) OVER (PARTITION BY model) AS wrong, count(*) OVER (PARTITION BY model) AS total FROM ok WINDOW o AS (PARTITION BY model ORDER BY p, response_id)),
b AS (SELECT * FROM r UNION ALL SELECT DISTINCT model, 0, 0, wrong, total FROM r), g AS (SELECT CAST(unnest({COSTS}) AS INTEGER) AS cost),
own AS (SELECT model, cost, count_if((1 - p) * 100 > cost) AS deferred, avg(CASE WHEN (1 - p) * 100 > cost THEN cost ELSE (1 - correct) * 100 END) AS loss FROM ok, g GROUP BY model, cost),
l AS (SELECT b.model, o.cost, b.n, total, deferred, o.loss AS own, (b.n * o.cost + 100.0::DOUBLE * (wrong - caught)) / total AS loss FROM b JOIN own o ON b.model = o.model)
SELECT model, cost, CAST(any_value(total) AS BIGINT) AS n, CAST(any_value(deferred) AS BIGINT) AS deferred, round(any_value(own), 9) AS own_loss, round(max(CASE WHEN n = deferred THEN loss END), 9) AS matched_loss, round(max(CASE WHEN n = 0 THEN loss END), 9) AS always_loss, round(min(loss), 9) AS best_loss FROM l GROUP BY model, cost""",
    "board_from_levels": f"""{_OK}, v AS (SELECT model, item_id, answer, count(*) AS v, sum(1 - p) AS doubt, any_value(label) AS label FROM ok GROUP BY model, item_id, answer),
e AS (SELECT model, arg_max(answer, v) = any_value(label) AS good, sum(doubt) / sum(v) * 100 AS d FROM v GROUP BY model, item_id HAVING 2 * max(v) > sum(v)),
s AS (SELECT model, CAST(good AS INTEGER) AS correct, list_extract({deferral.midpoints(COSTS, 100)}, CAST(1 + {" + ".join(f"CAST({c} < round(d, 9) AS INTEGER)" for c in COSTS)} AS BIGINT))::DOUBLE AS p FROM e),
h AS (SELECT model, p, count(*) AS n, sum(correct) AS k FROM s GROUP BY model, p),
c AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY p) AS up, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS down, sum(n - k) OVER (PARTITION BY model ORDER BY p DESC) AS wrong FROM h)
SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n), 9) AS accuracy, round(sum(k * (1 - p) * (1 - p) + (n - k) * p * p) / sum(n), 9) AS brier, round(sum(abs(k - n * p)) / sum(n), 9) AS ece,
 round((sum((up - n + (n + 1) / 2.0) * k) - sum(k) * (sum(k) + 1) / 2.0) / nullif(CAST(sum(k) AS DOUBLE) * (sum(n) - sum(k)), 0), 9) AS auroc, round(sum(n * wrong / down) / sum(n), 9) AS aurc FROM c GROUP BY model""",
    "switch_points_once": f"""{_OK}, c AS (SELECT item_id, model, protocol, repeat_index / 10.0::DOUBLE AS x, correct FROM ok WHERE repeat_index IS NOT NULL),
g AS (SELECT item_id, model, protocol, list(x ORDER BY x, correct) AS xs, CAST(count_if(correct = 0) AS BIGINT) AS z, count(*) AS n, max(CASE WHEN correct = 0 THEN x END) AS last_zero, min(CASE WHEN correct = 1 THEN x END) AS first_one FROM c GROUP BY ALL)
SELECT item_id, model, protocol, round(CASE WHEN z = 0 THEN greatest(0.001, xs[1] - 0.02) WHEN z = n THEN least(0.999, xs[n] + 0.02) ELSE (xs[z] + xs[z + 1]) / 2 END, 6) AS point, CASE WHEN z = 0 THEN 'cap_low' WHEN z = n THEN 'cap_high' ELSE 'midpoint' END AS method, true AS monotone
FROM g WHERE coalesce(last_zero <= first_one, true)""",
    "paired_delta": f"""{_OK}, {_PAIRS}
SELECT task, count(*) AS pairs, CAST(count_if(l.a <> r.a) AS BIGINT) AS answer_changes, round(avg(l.c - r.c), 9) AS accuracy_delta, round(avg((l.p - l.c) * (l.p - l.c) - (r.p - r.c) * (r.p - r.c)), 9) AS brier_delta, round(avg(l.p - r.p), 9) AS mean_p_delta FROM pairs GROUP BY task""",
    "paired_drops": f"""{_OK}, {_PAIRS}, src AS (SELECT * FROM responses WHERE call_id IS NOT NULL AND item_id IS NOT NULL AND repeat_index IS NOT NULL AND model IS NOT NULL),
planned AS (SELECT DISTINCT item_id, repeat_index, model FROM src WHERE protocol = 'P1' INTERSECT SELECT DISTINCT item_id, repeat_index, model FROM src WHERE protocol = 'P2'),
done AS (SELECT DISTINCT item_id, repeat_index, model, 1 AS ok FROM pairs)
SELECT model, count(*) AS planned, count(ok) AS complete, count(*) - count(ok) AS dropped FROM planned LEFT JOIN done USING (item_id, repeat_index, model) GROUP BY model""",
    "modal_vote": f"""{_PARSED}, v AS (SELECT item_id, model, protocol, answer, count(*) AS n FROM parsed WHERE answer IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(n) OVER g AS total, max(n) OVER g AS top, row_number() OVER (PARTITION BY item_id, model, protocol ORDER BY n DESC, answer) AS r FROM v WINDOW g AS (PARTITION BY item_id, model, protocol))
SELECT item_id, model, protocol, max(CASE WHEN r = 1 THEN answer END) AS answer, CAST(max(total) AS BIGINT) AS draws, round(max(top) / max(total), 9) AS p, count_if(n = top) > 1 AS tied FROM w GROUP BY item_id, model, protocol""",
    "linear_pool": f"""{_PARSED}, q AS (SELECT item_id, model, protocol, avg(CASE WHEN answer = 'breach' THEN p ELSE 1 - p END) AS pp, count(*) AS draws, count_if(answer = 'breach') AS pos FROM parsed WHERE answer IS NOT NULL AND p IS NOT NULL AND task IN ('T1', 'T2') GROUP BY ALL)
SELECT item_id, model, protocol, draws, round(pp, 9) AS pooled, CASE WHEN abs(pp - 0.5) <= 1e-12 THEN CASE WHEN 2 * pos > draws THEN 'breach' ELSE 'no_breach' END WHEN pp > 0.5 THEN 'breach' ELSE 'no_breach' END AS answer, round(greatest(pp, 1 - pp), 9) AS confidence FROM q""",
    "draw_dispersion": f"""{_PARSED}, a AS (SELECT item_id, model, answer, count(*) AS n FROM parsed WHERE answer IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
e AS (SELECT item_id, model, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY item_id, model) AS t FROM a) GROUP BY ALL),
s AS (SELECT item_id, model, count(*) AS draws, stddev_pop(p) AS sd, min(p) AS low, max(p) AS high FROM parsed WHERE answer IS NOT NULL AND p IS NOT NULL GROUP BY ALL)
SELECT item_id, model, draws, round(entropy, 9) + 0.0 AS entropy, round(sd, 9) AS sd, low, high FROM s JOIN e USING (item_id, model)""",
    "k_prefix_votes": f"""{_PARSED}, k AS (SELECT unnest([1, 3, 5, 7]) AS k),
v AS (SELECT k, item_id, model, protocol, answer, count(*) AS n FROM parsed JOIN k ON repeat_index <= k WHERE answer IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(n) OVER g AS total, max(n) OVER g AS top, row_number() OVER (PARTITION BY k, item_id, model, protocol ORDER BY n DESC, answer) AS r FROM v WINDOW g AS (PARTITION BY k, item_id, model, protocol))
SELECT CAST(k AS INTEGER) AS k, item_id, model, protocol, max(CASE WHEN r = 1 THEN answer END) AS answer, CAST(max(total) AS BIGINT) AS draws, round(max(top) / max(total), 9) AS p, count_if(n = top) > 1 AS tied FROM w GROUP BY k, item_id, model, protocol""",
    "incomplete_groups": """SELECT item_id, model, protocol, count(*) AS n, CASE WHEN count(*) > count(DISTINCT repeat_index) THEN 'duplicate' WHEN min(repeat_index) < 1 OR max(repeat_index) > 7 THEN 'unexpected' ELSE 'missing' END AS reason
FROM responses WHERE item_id IS NOT NULL GROUP BY item_id, model, protocol HAVING NOT (count(*) = 7 AND count(DISTINCT repeat_index) = 7 AND min(repeat_index) = 1 AND max(repeat_index) = 7)""",
    "common_prefix_board": f"""{_OK}, h AS (SELECT task, model, max(repeat_index) AS horizon FROM ok GROUP BY ALL), c AS (SELECT task, min(horizon) AS k FROM h GROUP BY task),
m AS (SELECT ok.task, ok.model, any_value(c.k) AS k, count(*) AS n, avg(correct) AS accuracy, avg((p - correct) * (p - correct)) AS brier FROM ok JOIN c ON ok.task = c.task AND ok.repeat_index <= c.k GROUP BY ok.task, ok.model)
SELECT task, row_number() OVER (PARTITION BY task ORDER BY round(brier, 9) NULLS LAST, model) AS place, model, k, n, round(accuracy, 9) AS accuracy, round(brier, 9) AS brier FROM m""",
    "headline_runs": f"""{_PARSED}, g AS (SELECT model, protocol, count(*) AS n, max(response_id) AS latest FROM parsed GROUP BY ALL)
SELECT model, protocol, n, latest FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, latest DESC, protocol) = 1""",
    "deferral_levels": f"""{_OK}, g AS (SELECT unnest([5, 15, 25, 35, 45]) AS cost), x AS (SELECT task, cost, correct, (1 - p) * 100 > cost AS deferred FROM ok, g)
SELECT task, CAST(cost AS INTEGER) AS cost, count(*) AS n, round(avg(CAST(deferred AS INTEGER)), 9) AS deferral_rate, round(avg(CASE WHEN NOT deferred THEN correct END), 9) AS accuracy_answered, round(avg(CASE WHEN deferred THEN correct END), 9) AS accuracy_deferred, round(avg(CASE WHEN deferred THEN cost ELSE (1 - correct) * 100 END), 9) AS mean_loss FROM x GROUP BY task, cost""",
    "matched_budget_loss": f"""{_OK}, r AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY p, response_id) AS n, sum(1 - correct) OVER (PARTITION BY task ORDER BY p, response_id ROWS UNBOUNDED PRECEDING) AS caught, sum(1 - correct) OVER (PARTITION BY task) AS wrong FROM ok WHERE split = 'test')
SELECT task, n, round(n * 25.0::DOUBLE + 100.0::DOUBLE * (wrong - caught), 9) AS loss FROM r""",
    "optimal_budget": f"""{_OK}, r AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY p, response_id) AS n, sum(1 - correct) OVER (PARTITION BY task ORDER BY p, response_id ROWS UNBOUNDED PRECEDING) AS caught, sum(1 - correct) OVER (PARTITION BY task) AS wrong FROM ok),
b AS (SELECT * FROM r UNION ALL SELECT DISTINCT task, 0, 0, wrong FROM r), g AS (SELECT unnest({COSTS}) AS cost)
SELECT task, CAST(cost AS INTEGER) AS cost, round(min(n * cost + 100.0::DOUBLE * (wrong - caught)), 9) AS best_loss FROM b, g GROUP BY task, cost""",
    "implied_bins": f"""{_OK}, u AS (SELECT item_id, model, avg(1 - p) * 100 AS doubt FROM ok GROUP BY ALL),
b AS (SELECT (SELECT count(*) FROM (SELECT unnest([5, 15, 25, 35, 45]) AS c) WHERE c < round(doubt, 9)) AS bin FROM u),
s AS (SELECT unnest(range(6)) AS bin)
SELECT CAST(s.bin AS INTEGER) AS bin, count(b.bin) AS n, CASE WHEN s.bin = 0 THEN 0.95::DOUBLE ELSE 1 - list_extract([5, 15, 25, 35, 45, 100], CAST(s.bin AS INTEGER) + 1) / 100 END AS low, CASE WHEN s.bin = 0 THEN 1.0::DOUBLE ELSE 1 - list_extract([5, 15, 25, 35, 45], CAST(s.bin AS INTEGER)) / 100 END AS high FROM s LEFT JOIN b ON s.bin = b.bin GROUP BY s.bin""",
    "monotone_violations": f"""{_OK}, f AS (SELECT item_id, model, protocol, correct, lag(correct) OVER (PARTITION BY item_id, model, protocol ORDER BY repeat_index, response_id) AS before FROM ok WHERE repeat_index IS NOT NULL)
SELECT item_id, model, protocol, count(*) AS levels, CAST(coalesce(count_if(before > correct), 0) AS BIGINT) AS falls, coalesce(count_if(before > correct), 0) = 0 AS monotone FROM f GROUP BY item_id, model, protocol""",
}
