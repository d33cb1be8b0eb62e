"""Queries over plans and receipts, and over the event log: coverage, imports, upserts, latest rows, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import intervals, ledger
from casemill.runtime import table


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("call_id"), "o_orderstatus", "o_orderdate")


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("call_id"), F.col("l_linenumber").cast("int").alias("line"), "l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).alias("payload"))


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time with or without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def _failed() -> Column:
    return F.col("l_returnflag") == "R"


def ledger_coverage(spark: SparkSession, d: str) -> DataFrame:
    states = ledger.coverage(_plan(spark, d), _receipts(spark, d), "call_id", _failed())
    return states.groupBy("state").agg(F.count("*").alias("calls"), F.sum("receipts").alias("receipts"), F.sum("failures").alias("failures"))


def ledger_orphans(spark: SparkSession, d: str) -> DataFrame:
    """All receipts, against the plan of orders that are not in process: that is what makes orphans."""
    half = _plan(spark, d).where("o_orderstatus <> 'P'")
    return ledger.orphans(half, _receipts(spark, d), "call_id").groupBy("l_linestatus").agg(F.count("*").alias("receipts"), F.count_distinct("call_id").alias("calls"))


def ledger_missing_export(spark: SparkSession, d: str) -> DataFrame:
    return ledger.missing(_plan(spark, d), _receipts(spark, d), "call_id", _failed()).select("call_id", "o_orderstatus")


def ledger_import_classify_all(spark: SparkSession, d: str) -> DataFrame:
    known = _plan(spark, d).where("o_orderstatus <> 'F'")
    return ledger.classify_import(known, _receipts(spark, d), "call_id", _failed(), F.col("payload")).groupBy("outcome").agg(F.count("*").alias("calls"), F.sum("results").alias("results"))


def ledger_status_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _receipts(spark, d)
    done, other = rows.where("l_linestatus = 'O'"), rows.where("l_linestatus <> 'O'")
    return ledger.merge_by_priority([done, other], ["call_id"], [F.col("line")]).select("call_id", "line", "l_linestatus", "source")


def catalog_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.catalog_conflicts(_receipts(spark, d), "call_id", F.col("payload"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    old = ledger.latest(events.where("ts < timestamp'2024-01-16'"), ["user_id", "event_type"], order)
    new = ledger.latest(events.where("ts >= timestamp'2024-01-16'"), ["user_id", "event_type"], order)
    return ledger.upsert(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


def latest_row_wins(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


def first_import_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses").where("call_id is not null")
    return ledger.latest(rows, ["call_id"], [F.col("imported_utc").asc_nulls_last(), F.col("response_id")]).select("call_id", "response_id", "item_id")


def late_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "responses").where("requested_utc is not null and imported_utc is not null")
    hours = F.floor((_micros("imported_utc") - _micros("requested_utc")) / F.lit(3_600_000_000)).cast("bigint")
    return rows.groupBy("model", F.least(hours, F.lit(48)).alias("hours")).agg(F.count("*").alias("n"))


def asof_heading(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", _micros("ts").alias("at"), "event_type")
    marks = events.where("event_type = 'view'").select("user_id", "at", "event_id")
    rows = events.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    return intervals.asof_last(rows, marks.withColumnRenamed("event_id", "mark"), ["user_id"], "at", "mark", "last_view").select("event_id", "last_view")


def range_containment(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", F.floor(_micros("ts") / F.lit(1_000_000)).cast("bigint").alias("at"), "event_type")
    spans = events.where("event_type = 'error'").select("user_id", F.col("at").alias("s"), (F.col("at") + 86_400).alias("e"))
    return intervals.in_any_span(events.where("event_type = 'click'"), spans, ["user_id"], "at", "s", "e", 86_400).select("event_id", "user_id")


def baseline_clusters(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", F.floor(_micros("ts") / F.lit(1_000_000)).cast("bigint").alias("at"))
    out = intervals.clusters(events, ["user_id"], "at", 6 * 3600)
    return out.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.floor(_micros("ts") / F.lit(1_000_000)).cast("bigint").alias("s"))
    return intervals.merged(events.withColumn("e", F.col("s") + 43_200), ["user_id"], "s", "e")


def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.floor(_micros("ts") / F.lit(1_000_000)).cast("bigint").alias("s"))
    return intervals.gaps(events.withColumn("e", F.col("s") + 43_200), ["user_id"], "s", "e")


def value_runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.runs(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", F.col("first").cast("bigint").alias("first"), "length")


def spans_to_next(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("event_type = 'error'").select("user_id", _micros("ts").alias("at"))
    return intervals.spans_from_starts(events, ["user_id"], "at")


QUERIES = {f.__name__: f for f in (ledger_coverage, ledger_orphans, ledger_missing_export, ledger_import_classify_all, ledger_status_merge, catalog_conflicts, upsert_latest, latest_row_wins, first_import_wins, late_imports, asof_heading, range_containment, baseline_clusters, interval_union, interval_gaps, value_runs, spans_to_next)}

_SEC = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"
_MERGED = f"""s AS (SELECT user_id, {_SEC} AS s, {_SEC} + 43200 AS e FROM events),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, g)"""

ORACLE_SQL = {
    "ledger_coverage": """WITH r AS (SELECT l_orderkey AS call_id, count(*) AS receipts, count_if(l_returnflag = 'R') AS failures FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, coalesce(receipts, 0) AS receipts, coalesce(failures, 0) AS failures FROM orders LEFT JOIN r ON o_orderkey = call_id)
SELECT CASE WHEN receipts = 0 THEN 'pending' WHEN receipts = failures THEN 'error' WHEN receipts - failures > 1 THEN 'duplicate' ELSE 'done' END AS state, count(*) AS calls, CAST(sum(receipts) AS BIGINT) AS receipts, CAST(sum(failures) AS BIGINT) AS failures FROM b GROUP BY 1""",
    "ledger_orphans": """SELECT l_linestatus, count(*) AS receipts, count(DISTINCT l_orderkey) AS calls FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1""",
    "ledger_missing_export": """SELECT CAST(o_orderkey AS BIGINT) AS call_id, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')""",
    "ledger_import_classify_all": """WITH r AS (SELECT l_orderkey AS c, count(*) AS results, count_if(l_returnflag = 'R') AS f, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey % 3 END) AS d FROM lineitem GROUP BY 1),
o AS (SELECT r.*, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN d > 1 THEN 'conflict' WHEN d = 0 THEN 'failed' WHEN results - f > 1 THEN 'repeated' ELSE 'completed' END AS outcome FROM r LEFT JOIN orders ON o_orderkey = c AND o_orderstatus <> 'F')
SELECT outcome, count(*) AS calls, CAST(sum(results) AS BIGINT) AS results FROM o GROUP BY 1""",
    "ledger_status_merge": """SELECT CAST(l_orderkey AS BIGINT) AS call_id, CAST(l_linenumber AS INTEGER) AS line, l_linestatus, CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS INTEGER) AS source FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, l_linenumber) = 1""",
    "catalog_conflicts": """SELECT CAST(l_orderkey AS BIGINT) AS call_id, count(*) AS rows, count(DISTINCT l_partkey % 3) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey % 3) > 1""",
    "upsert_latest": """WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, late ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_type, event_id, value FROM l QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY late DESC) = 1""",
    "latest_row_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "first_import_wins": "SELECT call_id, response_id, item_id FROM responses WHERE call_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY imported_utc ASC NULLS LAST, response_id) = 1",
    "late_imports": """SELECT model, least(CAST(floor((epoch_us(imported_utc) - epoch_us(requested_utc)) / 3600000000) AS BIGINT), 48) AS hours, count(*) AS n FROM responses WHERE requested_utc IS NOT NULL AND imported_utc IS NOT NULL GROUP BY 1, 2""",
    "asof_heading": """WITH v AS (SELECT user_id, ts, max(event_id) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "range_containment": f"""WITH e AS (SELECT event_id, user_id, {_SEC} AS at, event_type FROM events)
SELECT event_id, user_id FROM e c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error' AND x.user_id = c.user_id AND c.at >= x.at AND c.at < x.at + 86400)""",
    "baseline_clusters": f"""WITH e AS (SELECT user_id, {_SEC} AS "at" FROM events), n AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at") <= 21600 THEN 0 ELSE 1 END AS fresh FROM e),
c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY "at", fresh DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM n)
SELECT user_id, cluster, count(*) AS n, min("at") AS first, max("at") AS last FROM c GROUP BY 1, 2""",
    "interval_union": f"WITH {_MERGED} SELECT user_id, s, e FROM u",
    "interval_gaps": f"WITH {_MERGED}, n AS (SELECT user_id, e AS s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS e FROM u) SELECT user_id, s, e FROM n WHERE e IS NOT NULL",
    "value_runs": """WITH o AS (SELECT user_id, event_type, row_number() OVER w AS i, lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, event_type, min(i) AS first, count(*) AS length FROM g GROUP BY user_id, g, event_type""",
    "spans_to_next": """WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) AS "at" FROM events WHERE event_type = 'error') SELECT user_id, "at", lead("at") OVER (PARTITION BY user_id ORDER BY "at") AS next FROM s""",
}
