"""Queries on plans, parsed payloads, segments, changes and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text as t
from casemill.operators import intervals, plans, ranking
from casemill.runtime import table

SEED = 20260802
HEADING = "^[A-Z][A-Z /]+$"


def call_plan(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "task", "case_number")
    return plans.call_plan(items, "item_id", ["task", "case_number"], 3, ["P1", "P2"], SEED)


def repeat_identity(spark: SparkSession, d: str) -> DataFrame:
    return plans.repeat_identity(table(spark, d, "responses").where("item_id is not null"), ["item_id", "model", "protocol"], "repeat_index", F.md5("question"))


def rank_waves(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").where("case_number is not null").select("item_id", "case_number", "extract_text")
    ranked = ranking.round_robin(items, "case_number", "item_id", SEED)
    return plans.waves(ranked, "rank", [20, 50, 100], F.octet_length("extract_text"))


def rank_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return ranking.contiguous(table(spark, d, "responses").where("repeat_index is not null"), ["item_id", "model"], "repeat_index")


def parsed_payloads(spark: SparkSession, d: str) -> DataFrame:
    return plans.parsed(table(spark, d, "responses"), "response_id", "content", "answer", "probability", ["breach", "no_breach"])


def payload_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = F.map_keys(F.from_json("content", "map<string,string>"))
    return table(spark, d, "responses").where("content like '{%'").select(F.array_join(F.array_sort(keys), ",").alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))


def fetch_changes(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("fetched_utc").asc_nulls_first(), F.col("page_id")]
    return plans.changes(table(spark, d, "pages").where("file is not null"), ["file"], order, "page_id", ["title", "respondent", "clause_breach", "keywords", "completed_date"])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    panes = table(spark, d, "panes").where("text is not null").select("pane_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return intervals.offsets(panes, ["pane_id"], ["line"], F.length("text"))


def pane_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    ends = lines.groupBy("pane_id").agg(F.max("end").alias("size"))
    spans = intervals.spans_from_starts(lines.where(F.col("text").rlike(HEADING)), ["pane_id"], "start")
    return spans.join(ends, "pane_id").select("pane_id", "start", F.coalesce("next", "size").alias("end"))


def segment_texts(spark: SparkSession, d: str) -> DataFrame:
    segs = pane_segments(spark, d).withColumnRenamed("start", "s").withColumnRenamed("end", "e")
    panes = table(spark, d, "panes").select("pane_id", "text")
    cut = F.expr("substring(text, cast(s + 1 as int), cast(e - s as int))")
    return segs.join(panes, "pane_id").select("pane_id", F.col("s").alias("start"), F.md5(t.collapse(cut)).alias("digest"))


def line_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    marks = lines.where(F.col("text").rlike(HEADING)).select("pane_id", "line", F.col("text").alias("h"))
    rows = intervals.asof_last(lines.select("pane_id", "line", "text"), marks, ["pane_id"], "line", "h", "heading")
    return rows.groupBy("heading").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def line_inner_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.trim("text"), " +")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    rows = table(spark, d, "pdf_lines").where("text is not null").select(F.explode(inner).alias("word"))
    return rows.where("word rlike '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n"))


def clause_inventory(spark: SparkSession, d: str) -> DataFrame:
    """All clauses of verdict rows, against the clauses that the items of the evaluation name under their Code year."""
    v = table(spark, d, "cases").select(F.explode("verdicts").alias("v")).select(F.col("v.code_year").alias("year"), F.col("v.clause").alias("clause"))
    items = table(spark, d, "eval_items").select(F.col("clause_ref.code_year").alias("year"), F.col("clause_ref.clause").alias("clause"))
    book = items.where("year is not null and clause is not null").distinct()
    years = book.select("year").distinct().withColumn("_y", F.lit(True))
    asked = v.distinct().join(years, "year", "left").join(book.withColumn("_b", F.lit(True)), ["year", "clause"], "left")
    exists = F.when(F.col("_y").isNull(), "unknown edition").when(F.col("_b"), "yes").otherwise("no")
    return asked.groupBy("year", exists.alias("listed")).agg(F.count("*").alias("clauses"))


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    reasons = F.array_compact(F.array(F.when(F.col("source").isNull(), "no source"), F.when(F.col("text").isNull(), "no text"), F.when(F.col("text") == "", "empty text"), F.when(F.col("lang").isNull(), "no language"), F.when(F.col("n_chars") != F.length("text"), "stale size")))
    made = docs.select("doc_id", F.array_join(F.array_sort(reasons), "; ").alias("reasons"))
    return made.where("reasons != ''").groupBy("reasons").agg(F.count("*").alias("docs"))


def item_digests(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return items.select("item_id", plans.canonical_digest({"task": F.col("task"), "label": F.col("label"), "split": F.col("split"), "case_number": F.col("case_number")}).alias("digest"))


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts")
    return table(spark, d, "events").groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("revenue", F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double")))
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(best)).where("place <= 2").select("o_custkey", "o_orderkey", "place")


QUERIES = {f.__name__: f for f in (call_plan, repeat_identity, rank_waves, rank_contiguity, parsed_payloads, payload_keys, fetch_changes, pane_segments, segment_texts, line_headings, line_inner_vocabulary, clause_inventory, exclusion_reasons, item_digests, tumbling_counts, event_pivot, revenue_rollup, top_orders)}

_LINES = """l AS (SELECT pane_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM panes WHERE text IS NOT NULL),
o AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY pane_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
z AS (SELECT pane_id, max(start + length(text)) AS size FROM o GROUP BY pane_id),
s AS (SELECT pane_id, start, coalesce(lead(start) OVER (PARTITION BY pane_id ORDER BY start), size) AS e FROM o JOIN z USING (pane_id) WHERE regexp_matches(text, '^[A-Z][A-Z /]+$'))"""
_BLANKS = r"[ \t\r\n\x{A0}\x{2003}\x{2009}\x{202F}\x{3000}]+"
_CHANGED = " , ".join(f"CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER w THEN '{c}' END" for c in ("title", "respondent", "clause_breach", "keywords", "completed_date"))

ORACLE_SQL = {
    "call_plan": f"""WITH p AS (SELECT item_id, task, case_number, protocol, CAST(repeat_index AS INTEGER) AS repeat_index FROM eval_items, (SELECT unnest(['P1', 'P2']) AS protocol), (SELECT unnest([1, 2, 3]) AS repeat_index) WHERE item_id IS NOT NULL)
SELECT *, substr(sha256(concat_ws(chr(10), '{SEED}', item_id, protocol, CAST(repeat_index AS VARCHAR))), 1, 24) AS call_id FROM p""",
    "repeat_identity": """SELECT item_id, model, protocol, count(*) AS n, count(DISTINCT md5(question)) AS versions, count(DISTINCT repeat_index) AS repeats FROM responses WHERE item_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT md5(question)) > 1""",
    "rank_waves": f"""WITH deep AS (SELECT item_id, case_number, extract_text, row_number() OVER (PARTITION BY case_number ORDER BY md5('{SEED}|item|' || item_id), item_id) AS depth FROM eval_items WHERE case_number IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY depth, md5('{SEED}|case|' || case_number), case_number, item_id) AS rank FROM deep)
SELECT CAST(CASE WHEN rank <= 20 THEN 1 WHEN rank <= 50 THEN 2 WHEN rank <= 100 THEN 3 ELSE 4 END AS INTEGER) AS wave, count(*) AS n, CAST(sum(strlen(extract_text)) AS BIGINT) AS size FROM r GROUP BY 1""",
    "rank_contiguity": "SELECT item_id, model, count(DISTINCT repeat_index) AS n, max(repeat_index) AS top, count(DISTINCT repeat_index) = max(repeat_index) AND min(repeat_index) = 1 AS contiguous FROM responses WHERE repeat_index IS NOT NULL GROUP BY 1, 2",
    "parsed_payloads": """WITH j AS (SELECT response_id, CASE WHEN content LIKE '{%' AND json_valid(content) THEN content END AS c, content FROM responses),
p AS (SELECT *, json_extract_string(c, '$.answer') AS answer, TRY_CAST(json_extract_string(c, '$.probability') AS DOUBLE) AS probability FROM j)
SELECT response_id, CASE WHEN answer IN ('breach', 'no_breach') THEN answer END AS answer, CASE WHEN probability BETWEEN 0 AND 1 THEN probability END AS probability,
CASE WHEN content IS NULL THEN 'null' WHEN content NOT LIKE '{%' THEN 'no json' WHEN c IS NULL THEN 'malformed' WHEN answer IS NULL OR answer NOT IN ('breach', 'no_breach') THEN 'answer out of domain' WHEN probability IS NULL OR probability NOT BETWEEN 0 AND 1 THEN 'probability out of range' ELSE 'valid' END AS status FROM p""",
    "payload_keys": "SELECT array_to_string(list_sort(CASE WHEN json_valid(content) THEN json_keys(content) END), ',') AS keys, count(*) AS n FROM responses WHERE content LIKE '{%' GROUP BY 1",
    "fetch_changes": f"""WITH c AS (SELECT file, page_id, row_number() OVER w AS f, list_filter([{_CHANGED}], lambda x: x IS NOT NULL) AS c FROM pages WHERE file IS NOT NULL WINDOW w AS (PARTITION BY file ORDER BY fetched_utc ASC NULLS FIRST, page_id))
SELECT file, page_id, CAST(f AS INTEGER) AS "fetch", array_to_string(c, ',') AS changed FROM c WHERE f > 1""",
    "pane_segments": f'WITH {_LINES} SELECT pane_id, start, e AS "end" FROM s',
    "segment_texts": f"WITH {_LINES} SELECT s.pane_id, s.start, md5(trim(regexp_replace(substr(p.text, s.start + 1, s.e - s.start), '{_BLANKS}', ' ', 'g'))) AS digest FROM s JOIN panes p USING (pane_id)",
    "line_headings": f"""WITH {_LINES}, h AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '^[A-Z][A-Z /]+$') THEN text END IGNORE NULLS) OVER (PARTITION BY pane_id ORDER BY line) AS heading FROM l)
SELECT heading, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM h GROUP BY heading""",
    "line_inner_vocabulary": """WITH w AS (SELECT string_split_regex(trim(text), ' +') AS w FROM pdf_lines WHERE text IS NOT NULL), u AS (SELECT unnest(w[2:len(w) - 1]) AS word FROM w WHERE len(w) > 2)
SELECT word, count(*) AS n FROM u WHERE regexp_matches(word, '^[a-z]+$') GROUP BY word""",
    "clause_inventory": """WITH v AS (SELECT unnest(verdicts) AS v FROM cases), x AS (SELECT DISTINCT v.code_year AS year, v.clause AS clause FROM v), b AS (SELECT DISTINCT clause_ref.code_year AS year, clause_ref.clause AS clause FROM eval_items WHERE clause_ref.code_year IS NOT NULL AND clause_ref.clause IS NOT NULL)
SELECT year, CASE WHEN year IS NULL OR year NOT IN (SELECT year FROM b) THEN 'unknown edition' WHEN clause IN (SELECT clause FROM b WHERE b.year = x.year) THEN 'yes' ELSE 'no' END AS listed, count(*) AS clauses FROM x GROUP BY 1, 2""",
    "exclusion_reasons": """WITH r AS (SELECT list_sort(list_filter([CASE WHEN source IS NULL THEN 'no source' END, CASE WHEN text IS NULL THEN 'no text' END, CASE WHEN text = '' THEN 'empty text' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN n_chars <> length(text) THEN 'stale size' END], lambda x: x IS NOT NULL)) AS r FROM documents)
SELECT array_to_string(r, '; ') AS reasons, count(*) AS docs FROM r WHERE len(r) > 0 GROUP BY 1""",
    "item_digests": """SELECT item_id, sha256(concat('{', '"case_number":', CASE WHEN case_number IS NULL THEN 'null' ELSE concat('"', case_number, '"') END, ',', '"label":', CASE WHEN label IS NULL THEN 'null' ELSE concat('"', label, '"') END, ',', '"split":', CASE WHEN split IS NULL THEN 'null' ELSE concat('"', split, '"') END, ',', '"task":', CASE WHEN task IS NULL THEN 'null' ELSE concat('"', task, '"') END, '}')) AS digest FROM eval_items""",
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "event_pivot": "SELECT user_id, " + ", ".join(f"count_if(event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "revenue_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "top_orders": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 2",
}
