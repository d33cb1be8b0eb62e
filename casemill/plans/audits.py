"""Queries that look at the data again, and on identifiers, ladders, aliases, pairs and cells of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import ids
from casemill.functions import text as t
from casemill.operators import alignment, audits, deferral, gates, intervals, layout, ledger, matching, plans, ranking, resolve, vocabulary, voting
from casemill.operators.metrics import rounded
from casemill.plans import scoring
from casemill.plans.corpus import _CASE, _ISO, _VERDICTS
from casemill.runtime import table

SEED = 20260802
#: How reports say what was ruled: the beginning, and the clauses.
RULED = r"(?:^|[^A-Za-z])([Nn]o [Bb]reach(?:es)?|[Bb]reach(?:es)?) of Clauses? ([0-9]+(?:[.][0-9]+)?(?:(?:, | and )[0-9]+(?:[.][0-9]+)?)*) (?:was|were) ruled"
#: Years that a field names as those of a Code.
STATED = r"([0-9]{4}) Code|Code of ([0-9]{4})"


def line_reslices(spark: SparkSession, d: str) -> DataFrame:
    """Lines that do not stand in the flow text of their report where the lines before put them."""
    lines = table(spark, d, "pdf_lines").where("text is not null")
    placed = intervals.offsets(lines.select("line_id", "file", "page_no", "line_no", "text"), ["file"], ["page_no", "line_no"], F.length("text"))
    found = audits.resliced(placed.withColumnRenamed("text", "quote"), table(spark, d, "pdf_records").select("file", "flow_text"), "file", "start", "end", "flow_text", "quote")
    return found.select("line_id", "problem")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_number", F.explode("verdicts").alias("v")).select("case_number", "v.*")


def _case_panes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "cases").select("case_number", F.explode("source_files").alias("file"))
    return table(spark, d, "panes").where("text is not null").join(files, "file")


def prose_not_listed(spark: SparkSession, d: str) -> DataFrame:
    """Rulings that the panes of a case tell and none of its verdict rows has."""
    found = audits.statements(_case_panes(spark, d), ["case_number"], "text", RULED)
    v = _verdicts(spark, d)
    listed = v.select("case_number", "clause", F.col("panel").alias("polarity")).union(v.select("case_number", "clause", "final"))
    return audits.unlisted(found, listed, ["case_number", "clause", "polarity"])


def verdict_audit(spark: SparkSession, d: str) -> DataFrame:
    return audits.verdict_checks(_verdicts(spark, d), ["case_number", "clause", "code_year"], "final", "panel", "appeal_board", "dual_ruling", "flipped_on_appeal", ["breach", "no_breach"])


def correction_audit(spark: SparkSession, d: str) -> DataFrame:
    """Corrections whose quote stands in no pane of their case byte for byte, or that fit not exactly one verdict row."""
    made = table(spark, d, "slot_corrections").select("correction_id", "case_number", "to_clause", "quote")
    panes = _case_panes(spark, d).select("case_number", "text")
    stands = made.join(panes, "case_number").where(F.contains("text", F.col("quote"))).select("correction_id").distinct().withColumn("stands", F.lit(True))
    rows = _verdicts(spark, d).groupBy("case_number", F.col("clause").alias("to_clause")).agg(F.count("*").alias("rows"))
    both = made.join(stands, "correction_id", "left").join(rows, ["case_number", "to_clause"], "left").fillna(0, ["rows"])
    return both.select("correction_id", F.coalesce("stands", F.lit(False)).alias("stands"), "rows").where("not stands or rows != 1")


def corrected_clauses(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "cases").select("case_number", F.expr("transform(verdicts, v -> v.clause)").alias("clauses")).where("case_number is not null and clauses is not null")
    made = resolve.rename_tokens(lists, "case_number", "clauses", table(spark, d, "slot_corrections"), "from_clause", "to_clause")
    return made.select("case_number", F.array_join("clauses", ",").alias("clauses"), "changed")


def import_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Later imports of a call against its first one, field by field."""
    rows = table(spark, d, "responses").where("call_id is not null")
    first = ledger.latest(rows, ["call_id"], [F.col("imported_utc").asc_nulls_last(), F.col("response_id")])
    later = rows.join(first.select("response_id"), "response_id", "left_anti")
    claimed = later.select("response_id", "call_id", *_ALIAS)
    source = claimed.select("response_id", "call_id").join(first.select("call_id", *_ALIAS), "call_id")
    return ledger.alias_mismatches(claimed, source, ["response_id", "call_id"], _ALIAS)


_ALIAS = ["item_id", "model", "protocol", "repeat_index", "question", "content", "stop_reason", "imported_utc"]


def pair_keys(spark: SparkSession, d: str) -> DataFrame:
    """Items of the same case, clause, year and extract under one key, with their tasks."""
    items = table(spark, d, "eval_items")
    key = plans.pair_key(F.col("case_number"), F.col("clause_ref.clause"), F.col("clause_ref.code_year"), F.array(F.md5("extract_text")))
    return items.groupBy(key.alias("key")).agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"))


def _paired_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").where("case_number is not null").select("item_id", "case_number", "task", F.md5("extract_text").alias("x"))
    pair = items.groupBy("case_number", "x").agg(F.count_distinct("task").alias("tasks"))
    return items.join(pair, ["case_number", "x"], "left").select("item_id", "case_number", (F.coalesce("tasks", F.lit(0)) > 1).alias("paired"))


def paired_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.round_robin(_paired_items(spark, d), "case_number", "item_id", SEED, F.col("paired")).select("item_id", "paired", "rank")


def rectangle_problems(spark: SparkSession, d: str) -> DataFrame:
    return audits.rectangle(table(spark, d, "responses").where("item_id is not null"), ["item_id", "model", "protocol"], "repeat_index", 7, F.md5("question"))


def answer_cells(spark: SparkSession, d: str) -> DataFrame:
    return audits.cells(scoring.parsed(spark, d).where("item_id is not null"), ["item_id", "model", "protocol"], "repeat_index", [1, 2, 3, 4, 5, 6, 7], "answer")


def vote_board(spark: SparkSession, d: str) -> DataFrame:
    """Entries of single draws and, derived from them, of votes over draws: their accuracy by model and protocol."""
    labels = table(spark, d, "eval_items").select("item_id", "label")
    drawn = scoring.parsed(spark, d).where("answer is not null")
    one = lambda rows, entry: rows.join(labels, "item_id").groupBy("model", "protocol").agg(F.count("*").alias("n"), F.avg((F.col("answer") == F.col("label")).cast("int")).alias("accuracy")).withColumn("entry", F.lit(entry))
    return rounded(one(drawn, "draw").unionByName(one(voting.modal(drawn, ["item_id", "model", "protocol"], "answer"), "vote")))


def switch_summary(spark: SparkSession, d: str) -> DataFrame:
    """How items turn that turn once at most, by model: methods, and on which side of their levels they are censored."""
    rows = scoring.switch_points_once(spark, d)
    censored = F.when(F.col("method") == "cap_low", "low").when(F.col("method") == "cap_high", "high").otherwise("none")
    return rows.groupBy("model", "method", censored.alias("censored")).agg(F.count("*").alias("items"))


def year_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The Code year of each page: what it declares, else what its clause fields state, else the year of its case."""
    first = lambda c: [F.nullif(F.regexp_extract(c, STATED, g), F.lit("")) for g in (1, 2)]
    stated = [F.coalesce(*first(c)) for c in ("clause_breach", "clause_no_breach", "related_clauses")]
    made = resolve.ladder({"declared": [F.nullif(F.trim("applicable_code_year"), F.lit(""))], "stated": stated, "case": [t.case_year("case_number")]})
    return table(spark, d, "pages").select("page_id", made.alias("r")).select("page_id", "r.value", "r.basis", "r.refused")


def page_dates(spark: SparkSession, d: str) -> DataFrame:
    made = resolve.ordered_dates(t.iso_date("recieved_date"), t.iso_date("completed_date"), t.case_year("case_number").cast("int"))
    return table(spark, d, "pages").select("page_id", made.alias("r")).select("page_id", F.col("r.first").alias("received"), F.col("r.second").alias("completed"), "r.basis")


def pane_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each report belongs to the pages of its file, by the identifiers of its first 140 characters."""
    none = F.array().cast("array<string>")
    numbers = lambda c: F.coalesce(t.case_numbers(c), none)
    declared = table(spark, d, "pages").where("file is not null").select("file", F.explode(numbers("case_number")).alias("i"), "title").groupBy("file").agg(F.array_sort(F.collect_set("i")).alias("own"), F.max("title").alias("title"))
    panes = table(spark, d, "panes").where("pane = 'report' and text is not null")
    both = panes.join(declared, "file", "left").select("pane_id", "text", F.coalesce("own", none).alias("own"), "title", F.substring("text", 1, 140).alias("head"))
    return both.select("pane_id", matching.pane_state(F.col("own"), numbers("head"), F.col("title"), F.col("text")).alias("state"))


def case_id_forms(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form, serial and file name of the identifiers of cases, as read back from a loose spelling of them."""
    loose = F.regexp_replace("case_number", "/", " - ")
    made = ids.normalised(loose)
    return table(spark, d, "cases").select("case_id", made.alias("canonical"), ids.serial(made).alias("serial"), ids.file_name(F.array(F.col("case_number"))).alias("file_name"), (made == F.col("case_number")).alias("same"))


def residual_serials(spark: SparkSession, d: str) -> DataFrame:
    """Serials of a pane's own identifiers that are left in its text after these were taken out."""
    own = t.case_numbers("text")
    panes = table(spark, d, "panes").where("text is not null").select("pane_id", t.redact("text", own).alias("rest"), ids.serials(own).alias("own"))
    return panes.select("pane_id", F.size("own").alias("serials"), F.array_join(ids.residual(F.col("rest"), F.col("own")).cast("array<string>"), ",").alias("left"))


def item_clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").groupBy(ids.cluster(F.col("tags"), F.col("case_number"), "inter_").alias("cluster")).agg(F.count("*").alias("items"))


def slash_compounds(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("complainant").union(table(spark, d, "panes").select("text"))
    return vocabulary.slash_votes(pages, "complainant")


def cost_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plans.cost_bound(table(spark, d, "responses"), ["model"], "question", 5e-7, 2.5e-6, 1024, 4096))


def cumulative_calls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as planned calls, lines not yet returned as responses, returned ones as completed ledger rows."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call"), F.concat_ws("|", "l_linenumber", "l_linestatus").alias("payload"), "l_returnflag")
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("call"))
    return ledger.cumulative(plan, lines.where("l_returnflag = 'N'"), lines.where("l_returnflag = 'A'"), "call", "payload")


def url_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("completed_date is not null").select("page_id", ids.url_parts(F.concat(F.lit("/cases/"), F.right("completed_date", F.lit(4)), F.lit("/"), "file")).alias("u")).select("page_id", "u.year", "u.root", "u.rest")


def date_gate(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every date check over pages, also of those that hold."""
    made = page_dates(spark, d)
    return gates.report({"out of order": made.where("basis = 'out of order'"), "year conflict": made.where("basis = 'year conflict'"), "received without completed": made.where("received is not null and completed is null")})


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as boxes on pages, one page a supplier: the tables have no coordinates."""
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("row"), (q * 10).alias("x0"), (q * 10 + F.round(F.col("l_tax") * 1000).cast("int")).alias("x1"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("y"), F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "N", "right").otherwise("full").alias("side"))


def page_gutters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(layout.gutters(_boxes(spark, d), "page", "row", "x0", "x1", 180, 420, 12, 0.95, 0.8, 3))


def page_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, d).select("page", "y", "side"), "page", "y", "side")


def page_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(spark, d).select("page", "y", "side")
    return layout.order_by_bands(rows.where("side != 'full'"), rows.where("side = 'full'").select("page", "y"), "page", "y", "side", "y")


def page_band_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the left lines of a page as strips, its full lines as headings."""
    rows = _boxes(spark, d).select("page", "y", "side")
    left = rows.where("side = 'left'").select("page", "y")
    gaps = intervals.gaps(left.select("page", "y", (F.col("y") + 1).alias("e")), ["page"], "y", "e").select("page", F.col("y").alias("low"), F.col("e").alias("high"))
    return rounded(layout.band_cuts(rows.where("side = 'full'").select("page", F.col("y").alias("head")), gaps, left, "page", "head", "low", "high", "y", 50.0))


def flow_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How far the summary of a report and its report pane bear each other out."""
    texts = table(spark, d, "panes").where("text is not null").groupBy("file").agg(F.max(F.when(F.col("pane") == "report", F.col("text"))).alias("report"), F.max(F.when(F.col("pane") == "summary", F.col("text"))).alias("summary"))
    flows = table(spark, d, "pdf_records").where("flow_text is not null").select(F.col("html_file").alias("file"), "flow_text")
    return alignment.align(flows.join(texts, "file").select("file", "flow_text", "report"), "file", "report", "flow_text")


def call_identity(spark: SparkSession, d: str) -> DataFrame:
    return plans.carry_identity(table(spark, d, "responses"), ["model", "protocol"], ["call_id", "item_id", "repeat_index"])


def deferral_bands(spark: SparkSession, d: str) -> DataFrame:
    """How models defer at each cost: at 0.40 or more, at 0.05 or less, or between."""
    made = deferral.levels(scoring.scored(spark, d), scoring.COSTS, 100, ["model"])
    return made.select("model", "cost", plans.banded(F.col("deferral_rate"), 0.40, 0.05).alias("band"))


QUERIES = {f.__name__: f for f in (line_reslices, prose_not_listed, verdict_audit, correction_audit, corrected_clauses, import_aliases, pair_keys, paired_rank, rectangle_problems, answer_cells, vote_board, switch_summary, year_ladder, page_dates, pane_states, case_id_forms, residual_serials, item_clusters, slash_compounds, cost_bounds, cumulative_calls, url_years, date_gate, page_gutters, page_reading_order, page_bands, page_band_cuts, flow_alignment, call_identity, deferral_bands)}

_FILES = "f AS (SELECT case_number, unnest(source_files) AS file FROM cases), cp AS (SELECT f.case_number, p.text FROM panes p JOIN f USING (file) WHERE p.text IS NOT NULL)"
_STATED = lambda c: f"nullif(concat(regexp_extract({c}, '{STATED}', 1), regexp_extract({c}, '{STATED}', 2)), '')"
_PAGE_DATES = f"""dd AS (SELECT page_id, {_ISO.format("recieved_date")} AS a, {_ISO.format("completed_date")} AS b, TRY_CAST(split_part(case_number, '/', 4) AS INTEGER) + 2000 AS y FROM pages),
pd AS (SELECT page_id, CASE WHEN coalesce(a > b, false) OR coalesce(CAST(substr(a, 1, 4) AS INTEGER) NOT BETWEEN y - 1 AND y, false) THEN NULL ELSE a END AS received, CASE WHEN coalesce(a > b, false) THEN NULL ELSE b END AS completed,
 CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN coalesce(a > b, false) THEN 'out of order' WHEN coalesce(CAST(substr(a, 1, 4) AS INTEGER) NOT BETWEEN y - 1 AND y, false) THEN 'year conflict' ELSE 'stated' END AS basis FROM dd)"""
_MISMATCH = ", ".join(f"CASE WHEN l.{c} IS DISTINCT FROM f.{c} THEN '{c}' END" for c in _ALIAS)
_CELLS = ", ".join(f"min(CASE WHEN repeat_index = {k} THEN answer END) AS c{k}" for k in range(1, 8))

_BOXES = """b AS (SELECT l_suppkey AS page, l_orderkey AS row, CAST(l_quantity AS INTEGER) * 10 AS x0, CAST(l_quantity AS INTEGER) * 10 + CAST(round(l_tax * 1000) AS INTEGER) AS x1, l_orderkey * 8 + l_linenumber AS y,
 CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'N' THEN 'right' ELSE 'full' END AS side FROM lineitem)"""

ORACLE_SQL = {
    "line_reslices": """WITH o AS (SELECT line_id, file, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file ORDER BY page_no NULLS FIRST, line_no NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM pdf_lines WHERE text IS NOT NULL),
p AS (SELECT line_id, CASE WHEN flow_text IS NULL THEN 'no source' WHEN s + length(text) > length(flow_text) THEN 'out of bounds' WHEN substr(flow_text, s + 1, length(text)) <> text THEN 'differs' END AS problem FROM o LEFT JOIN pdf_records r USING (file) WHERE o.file IS NOT NULL)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "prose_not_listed": f"""WITH {_FILES}, {_VERDICTS}, s AS (SELECT case_number, unnest(regexp_extract_all(text, '{RULED}', 0)) AS s FROM cp),
c AS (SELECT DISTINCT case_number, CASE WHEN regexp_matches(regexp_extract(s, '{RULED}', 1), '^[Nn]o') THEN 'no_breach' ELSE 'breach' END AS polarity, unnest(regexp_extract_all(regexp_extract(s, '{RULED}', 2), '[0-9]+(?:[.][0-9]+)?', 0)) AS clause FROM s)
SELECT case_number, clause, polarity FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.case_number = c.case_number AND v.v.clause = c.clause AND (v.v.panel = c.polarity OR v.v.final = c.polarity))""",
    "verdict_audit": f"""WITH {_VERDICTS}, x AS (SELECT case_number, unnest(v) FROM v)
SELECT 'final in domain' AS "check", count(*) AS rows, CAST(coalesce(count_if(final NOT IN ('breach', 'no_breach')), 0) AS BIGINT) AS violations FROM x
UNION ALL SELECT 'flipped', count(*), CAST(coalesce(count_if(flipped_on_appeal <> coalesce(panel <> appeal_board, false)), 0) AS BIGINT) FROM x
UNION ALL SELECT 'dual without panel', count(*), CAST(count_if(dual_ruling AND panel IS NOT NULL) AS BIGINT) FROM x
UNION ALL SELECT 'board decides', count(*), CAST(coalesce(count_if(appeal_board <> final), 0) AS BIGINT) FROM x
UNION ALL SELECT 'key stands once', CAST(coalesce(sum(n), 0) AS BIGINT), CAST(count_if(n > 1) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY case_number, clause, code_year)""",
    "correction_audit": f"""WITH {_FILES}, {_VERDICTS}, r AS (SELECT case_number, v.clause AS clause, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT correction_id, case_number, to_clause, EXISTS (SELECT 1 FROM cp WHERE cp.case_number = c.case_number AND contains(cp.text, c.quote)) AS stands FROM slot_corrections c)
SELECT correction_id, stands, coalesce(n, 0) AS rows FROM s LEFT JOIN r ON s.case_number = r.case_number AND s.to_clause = r.clause WHERE NOT stands OR coalesce(n, 0) <> 1""",
    "corrected_clauses": """WITH o AS (SELECT case_number, from_clause, min(to_clause) AS n FROM slot_corrections WHERE case_number IS NOT NULL AND from_clause IS NOT NULL GROUP BY 1, 2),
l AS (SELECT case_number, list_transform(verdicts, lambda x: x.clause) AS c FROM cases WHERE case_number IS NOT NULL AND verdicts IS NOT NULL),
u AS (SELECT case_number, c, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM l),
m AS (SELECT u.case_number, i, CASE WHEN o.from_clause IS NOT NULL THEN o.n ELSE x END AS y, x FROM u LEFT JOIN o ON u.case_number = o.case_number AND u.x = o.from_clause),
d AS (SELECT case_number, y, min(i) AS i FROM m WHERE y IS NOT NULL GROUP BY 1, 2), e AS (SELECT case_number, x, min(i) AS i FROM m WHERE x IS NOT NULL GROUP BY 1, 2),
a AS (SELECT case_number, string_agg(y, ',' ORDER BY i) AS s FROM d GROUP BY 1), b AS (SELECT case_number, string_agg(x, ',' ORDER BY i) AS s FROM e GROUP BY 1)
SELECT l.case_number, coalesce(a.s, '') AS clauses, coalesce(a.s, '') <> coalesce(b.s, '') AS changed FROM l LEFT JOIN a USING (case_number) LEFT JOIN b USING (case_number)""",
    "import_aliases": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY imported_utc ASC NULLS LAST, response_id) AS i FROM responses WHERE call_id IS NOT NULL),
m AS (SELECT l.response_id, l.call_id, array_to_string(list_filter([{_MISMATCH}], lambda x: x IS NOT NULL), ',') AS mismatch FROM r l JOIN r f ON l.call_id = f.call_id AND f.i = 1 WHERE l.i > 1)
SELECT * FROM m WHERE mismatch <> ''""",
    "pair_keys": """WITH k AS (SELECT sha256(concat('{"p0":', CASE WHEN case_number IS NULL THEN 'null' ELSE concat('"', case_number, '"') END, ',"p1":', CASE WHEN clause_ref.clause IS NULL THEN 'null' ELSE concat('"', clause_ref.clause, '"') END, ',"p2":', coalesce(CAST(clause_ref.code_year AS VARCHAR), 'null'), ',"p3":[', CASE WHEN extract_text IS NULL THEN 'null' ELSE concat('"', md5(extract_text), '"') END, ']}')) AS key, task FROM eval_items)
SELECT key, count(*) AS items, coalesce(array_to_string(list_sort(list_distinct(list(task) FILTER (task IS NOT NULL))), ','), '') AS tasks FROM k GROUP BY key""",
    "paired_rank": f"""WITH i AS (SELECT item_id, case_number, task, md5(extract_text) AS x FROM eval_items WHERE case_number IS NOT NULL), p AS (SELECT case_number, x, count(DISTINCT task) AS n FROM i WHERE x IS NOT NULL GROUP BY 1, 2),
j AS (SELECT item_id, i.case_number, coalesce(n, 0) > 1 AS paired FROM i LEFT JOIN p ON i.case_number = p.case_number AND i.x = p.x),
deep AS (SELECT *, row_number() OVER (PARTITION BY case_number ORDER BY concat(CASE WHEN paired THEN '0' ELSE '1' END, md5('{SEED}|item|' || item_id)), item_id) AS depth FROM j)
SELECT item_id, paired, row_number() OVER (ORDER BY depth, md5('{SEED}|case|' || case_number), case_number, item_id) AS rank FROM deep""",
    "rectangle_problems": """WITH g AS (SELECT item_id, model, protocol, count(*) AS n, count(DISTINCT repeat_index) AS d, count(repeat_index) AS r, count_if(NOT coalesce(repeat_index BETWEEN 1 AND 7, false)) AS o, count(DISTINCT md5(question)) AS c FROM responses WHERE item_id IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT item_id, model, protocol, n, CASE WHEN r > d THEN 'duplicate' WHEN o > 0 THEN 'unexpected' WHEN d < 7 THEN 'missing' WHEN c > 1 THEN 'differs' END AS problem FROM g) SELECT * FROM p WHERE problem IS NOT NULL""",
    "answer_cells": f"""WITH {scoring.SCORED} SELECT item_id, model, protocol, {_CELLS}, count(*) - count(DISTINCT repeat_index) AS duplicates FROM parsed WHERE item_id IS NOT NULL AND repeat_index BETWEEN 1 AND 7 GROUP BY 1, 2, 3""",
    "vote_board": f"""WITH {scoring.SCORED}, dr AS (SELECT * FROM parsed WHERE answer IS NOT NULL), c AS (SELECT item_id, model, protocol, answer, count(*) AS n FROM dr GROUP BY ALL),
m AS (SELECT item_id, model, protocol, answer FROM c QUALIFY row_number() OVER (PARTITION BY item_id, model, protocol ORDER BY n DESC, answer) = 1),
e AS (SELECT 'draw' AS entry, item_id, model, protocol, answer FROM dr UNION ALL SELECT 'vote', item_id, model, protocol, answer FROM m)
SELECT model, protocol, entry, count(*) AS n, round(avg(CAST(answer = label AS INTEGER)), 9) AS accuracy FROM e JOIN eval_items i ON e.item_id = i.item_id GROUP BY 1, 2, 3""",
    "switch_summary": f"""WITH w AS ({scoring.ORACLE_SQL["switch_points_once"]}) SELECT model, method, CASE method WHEN 'cap_low' THEN 'low' WHEN 'cap_high' THEN 'high' ELSE 'none' END AS censored, count(*) AS items FROM w GROUP BY 1, 2, 3""",
    "year_ladder": f"""WITH w AS (SELECT page_id, nullif(trim(applicable_code_year), '') AS a, list_distinct(list_filter([{_STATED("clause_breach")}, {_STATED("clause_no_breach")}, {_STATED("related_clauses")}], lambda x: x IS NOT NULL)) AS b, TRY_CAST(split_part(case_number, '/', 4) AS INTEGER) + 2000 AS c FROM pages)
SELECT page_id, CASE WHEN a IS NOT NULL THEN a WHEN len(b) = 1 THEN b[1] WHEN len(b) = 0 THEN CAST(c AS VARCHAR) END AS value, CASE WHEN a IS NOT NULL THEN 'declared' WHEN len(b) = 1 THEN 'stated' WHEN len(b) > 1 THEN 'stated conflict' WHEN c IS NOT NULL THEN 'case' ELSE 'none' END AS basis, a IS NULL AND len(b) > 1 AS refused FROM w""",
    "page_dates": f"WITH {_PAGE_DATES} SELECT * FROM pd",
    "date_gate": f"""WITH {_PAGE_DATES} SELECT 'out of order' AS gate, CAST(count_if(basis = 'out of order') AS BIGINT) AS violations FROM pd UNION ALL SELECT 'year conflict', CAST(count_if(basis = 'year conflict') AS BIGINT) FROM pd
UNION ALL SELECT 'received without completed', CAST(count_if(received IS NOT NULL AND completed IS NULL) AS BIGINT) FROM pd""",
    "pane_states": f"""WITH d AS (SELECT file, title, unnest(regexp_extract_all(case_number, '{_CASE}', 1)) AS i FROM pages WHERE file IS NOT NULL), o AS (SELECT file, list_distinct(list(i)) AS own, max(title) AS title FROM d GROUP BY file),
p AS (SELECT pane_id, text, title, coalesce(own, []) AS own, regexp_extract_all(substr(text, 1, 140), '{_CASE}', 1) AS head FROM panes LEFT JOIN o USING (file) WHERE pane = 'report' AND text IS NOT NULL)
SELECT pane_id, CASE WHEN len(head) = 0 OR list_has_any(own, head) THEN 'ok' WHEN list_has_any(list_transform(own, lambda x: split_part(x, '/', 2)), list_transform(head, lambda x: split_part(x, '/', 2))) THEN 'title typo'
 WHEN coalesce(regexp_matches(title, '(?i)Paragraph 17|During (?:its|the) consideration of'), false) OR regexp_matches(text, '(?i)^\\s*During (?:its|the) consideration of') THEN 'arises from another' ELSE 'mismatch' END AS state FROM p""",
    "case_id_forms": """SELECT case_id, concat_ws('/', upper(split_part(case_number, '/', 1)), lpad(split_part(case_number, '/', 2), 4, '0'), CAST(CAST(split_part(case_number, '/', 3) AS INTEGER) AS VARCHAR), right(split_part(case_number, '/', 4), 2)) AS canonical, CAST(split_part(case_number, '/', 2) AS INTEGER) AS serial,
 replace(case_number, '/', '-') || '.html' AS file_name, true AS same FROM cases""",
    "residual_serials": f"""WITH n AS (SELECT pane_id, text, list_distinct(regexp_extract_all(text, '{_CASE}', 1)) AS own FROM panes WHERE text IS NOT NULL),
r AS (SELECT pane_id, list_distinct(list_transform(own, lambda x: CAST(split_part(x, '/', 2) AS INTEGER))) AS s, list_reduce(list_prepend(text, list_reverse_sort(own)), lambda a, i: regexp_replace(a, regexp_escape(i) || '([^0-9]|$)', '[case]\\1', 'g')) AS rest FROM n),
m AS (SELECT pane_id, s, list_transform(regexp_extract_all(rest, '(?i)(?:\\b[a-z]{{2,6}}[ \t]?[/\\\\-][ \t]?([0-9]{{2,5}})\\b)|(?:\\b([0-9]{{2,5}})[ \t]*[/\\\\,-][ \t]*[0-9])', 0), lambda x: CAST(regexp_extract(x, '([0-9]{{2,5}})', 1) AS INTEGER)) AS k FROM r)
SELECT pane_id, CAST(len(s) AS INTEGER) AS serials, array_to_string(list_transform(list_sort(list_intersect(k, s)), lambda x: CAST(x AS VARCHAR)), ',') AS "left" FROM m""",
    "call_identity": "SELECT model, protocol, count(*) AS n, bool_and(call_id IS NOT NULL AND item_id IS NOT NULL AND repeat_index IS NOT NULL) AS whole FROM responses GROUP BY 1, 2",
    "deferral_bands": f"""WITH {scoring.SCORED}, ok AS (SELECT * FROM scored WHERE p IS NOT NULL AND correct IS NOT NULL), g AS (SELECT CAST(unnest({scoring.COSTS}) AS INTEGER) AS cost), r AS (SELECT model, cost, avg(CAST((1 - p) * 100 > cost AS INTEGER)) AS rate FROM ok, g GROUP BY 1, 2)
SELECT model, cost, CASE WHEN rate >= 0.40 THEN 'high' WHEN rate <= 0.05 THEN 'low' ELSE 'between' END AS band FROM r""",
    "item_clusters": """WITH c AS (SELECT case_number, coalesce(list_filter(tags, lambda x: starts_with(x, 'inter_')), []) AS o FROM eval_items) SELECT CASE WHEN len(o) = 0 THEN 'case:' || case_number WHEN len(o) = 1 THEN o[1] END AS cluster, count(*) AS items FROM c GROUP BY 1""",
    "slash_compounds": """WITH x AS (SELECT complainant AS t FROM pages UNION ALL SELECT text FROM panes), m AS (SELECT unnest(regexp_extract_all(t, '[A-Za-z]+ ?/ ?[A-Za-z]+', 0)) AS m FROM x WHERE t IS NOT NULL),
c AS (SELECT lower(regexp_extract(m, '([A-Za-z]+) ?/( ?)([A-Za-z]+)', 1)) AS "left", lower(regexp_extract(m, '([A-Za-z]+) ?/( ?)([A-Za-z]+)', 3)) AS "right", regexp_extract(m, '([A-Za-z]+) ?/( ?)([A-Za-z]+)', 2) AS gap FROM m)
SELECT "left", "right", CAST(count_if(gap = '') AS BIGINT) AS closed, CAST(count_if(gap = ' ') AS BIGINT) AS spaced, CASE WHEN count_if(gap = '') > count_if(gap = ' ') THEN 'closed' WHEN count_if(gap = ' ') > count_if(gap = '') THEN 'spaced' ELSE 'tie' END AS decision FROM c GROUP BY 1, 2""",
    "cost_bounds": "SELECT model, count(*) AS calls, CAST(coalesce(sum(strlen(question)), 0) AS BIGINT) AS bytes, round((coalesce(sum(strlen(question)), 0) + 1024 * count(*)) * 5e-7::DOUBLE + 4096 * count(*) * 2.5e-6::DOUBLE, 9) AS bound FROM responses GROUP BY model",
    "cumulative_calls": """WITH l AS (SELECT l_orderkey AS call, concat_ws('|', CAST(l_linenumber AS VARCHAR), l_linestatus) AS payload, l_returnflag AS f FROM lineitem), r AS (SELECT call, min(payload) AS p FROM l WHERE f = 'N' GROUP BY call), g AS (SELECT call, min(payload) AS p FROM l WHERE f = 'A' GROUP BY call)
SELECT DISTINCT o_orderkey AS call, coalesce(r.p, g.p) AS payload, CASE WHEN r.call IS NOT NULL THEN 'response' WHEN g.call IS NOT NULL THEN 'ledger' ELSE 'missing' END AS source FROM orders LEFT JOIN r ON o_orderkey = r.call LEFT JOIN g ON o_orderkey = g.call""",
    "url_years": """WITH u AS (SELECT page_id, concat('/cases/', right(completed_date, 4), '/', file) AS u FROM pages WHERE completed_date IS NOT NULL), x AS (SELECT page_id, CASE WHEN page_id IS NOT NULL THEN u END AS u FROM u)
SELECT page_id, TRY_CAST(nullif(regexp_extract(u, '^(.*?)/([0-9]{4})(?:/(.*))?$', 2), '') AS INTEGER) AS year, nullif(regexp_extract(u, '^(.*?)/([0-9]{4})(?:/(.*))?$', 1), '') AS root, nullif(regexp_extract(u, '^(.*?)/([0-9]{4})(?:/(.*))?$', 3), '') AS rest FROM x""",
    "page_gutters": f"""WITH {_BOXES.replace("b AS", "every AS", 1)}, b AS (SELECT * FROM every WHERE x1 > x0), w AS (SELECT page, row, min(x0) AS lo, max(x1) AS hi FROM b GROUP BY ALL), c AS (SELECT unnest(range(180, 420)) AS position),
u AS (SELECT w.page, position, count(*) AS n, count_if(lo < position + 12) AS l, count_if(hi > position) AS r FROM w, c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND b.row = w.row AND b.x0 < position + 12 AND b.x1 > position) GROUP BY 1, 2),
t AS (SELECT page, count(*) AS rows FROM w GROUP BY page), x AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, position) = 1),
s AS (SELECT t.page, rows, position, coalesce(n, 0) / rows AS share, coalesce(l >= 3 AND r >= 3, false) AS enough FROM t LEFT JOIN x USING (page))
SELECT page, rows, CAST(position AS INTEGER) AS position, round(share, 9) AS share, CASE WHEN share >= 0.95 AND enough THEN 'columns' WHEN share >= 0.8 AND share < 0.95 THEN 'refused' ELSE 'single' END AS state FROM s""",
    "page_reading_order": f"""WITH {_BOXES}, k AS (SELECT page, y, side, CASE side WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END AS s, CAST(sum(CASE WHEN side = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y DESC, CASE side WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM b)
SELECT page, y, side, block, row_number() OVER (PARTITION BY page ORDER BY block, s, y DESC) AS place FROM k""",
    "page_bands": f"""WITH {_BOXES}, k AS (SELECT page, y, side, CAST(coalesce(sum(CASE WHEN side = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS band FROM b)
SELECT page, y, side, band, row_number() OVER (PARTITION BY page ORDER BY band, side, y DESC) AS place FROM k WHERE side <> 'full'""",
    "page_band_cuts": f"""WITH {_BOXES}, l AS (SELECT DISTINCT page, y FROM b WHERE side = 'left'), g AS (SELECT page, y + 1 AS low, lead(y) OVER (PARTITION BY page ORDER BY y) AS high FROM l), h AS (SELECT page, y AS head FROM b WHERE side = 'full'),
p AS (SELECT g.page, low, high, (SELECT max(head) FROM h WHERE h.page = g.page AND head <= low) AS head FROM g WHERE high > low),
r AS (SELECT *, high - low AS w, row_number() OVER (PARTITION BY page, head ORDER BY high - low DESC, low DESC) AS i FROM p WHERE head IS NOT NULL),
t AS (SELECT page, head, max(CASE WHEN i = 1 THEN w END) AS width, max(CASE WHEN i = 2 THEN w END) AS rival, max(CASE WHEN i = 1 THEN (low + high) / 2 END) AS mid FROM r GROUP BY page, head)
SELECT page, head, CASE WHEN coalesce(width - rival > 50, true) THEN round(mid, 9) END AS cut, width, rival, CASE WHEN coalesce(width - rival > 50, true) THEN 'cut' ELSE 'undecided' END AS state FROM t""",
}
