"""Queries over cases, pages, panes and documents: ranking, identity, resolution, text, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import text as t
from casemill.operators import dedupe, gates, graph, intervals, pages, ranking, resolve, vocabulary
from casemill.operators.metrics import rounded
from casemill.runtime import table

SEED = 20260802
DECIDED_APPEALS = ["no appeal", "respondent appeal", "complainant appeal", ""]


# Order and identity -------------------------------------------------------------------------------------------------


def round_robin_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source")
    return ranking.round_robin(docs, "source", "doc_id", SEED)


def prefix_union(spark: SparkSession, d: str) -> DataFrame:
    ranked = round_robin_rank(spark, d)
    return ranking.prefix(ranked, "rank", 200, F.col("source") == "helpdesk_log").select("doc_id", "rank")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ranking.stratified_sample(docs, "source", "doc_id", 100, SEED)


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", ranking.hash_split("source", SEED).alias("split"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    panes = table(spark, d, "panes")
    return panes.select("pane_id", ranking.content_id("file", "pane", F.sha2("text", 256)).alias("content_id"))


def dedupe_siblings(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "task", "case_number", F.sha2("extract_text", 256).alias("digest"))
    return dedupe.collapse(items, ["task", "case_number", "digest"], "item_id")


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.classes(table(spark, d, "documents"), "doc_id", "text")


def repeated_fetches(spark: SparkSession, d: str) -> DataFrame:
    pages_ = table(spark, d, "pages").where("file is not null")
    return pages_.groupBy("file").agg(F.count("*").alias("fetches"), F.min("page_id").alias("first_page"), F.count_distinct("completed_date").alias("versions"))


def sibling_components(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases")
    declared = cases.select(F.col("case_number").alias("a"), F.explode("sibling_cases").alias("b"))
    known = cases.select(F.col("case_number").alias("b")).distinct()
    by_case = cases.select(F.col("case_number").alias("a"), F.explode("source_files").alias("f"))
    by_file = by_case.join(by_case.groupBy("f").agg(F.min("a").alias("b")), "f").select("a", "b")
    loops = cases.select(F.col("case_number").alias("a"), F.col("case_number").alias("b"))
    return graph.components(declared.join(known, "b", "left_semi").select("a", "b").union(by_file).union(loops), "a", "b")


def id_chain_orders(spark: SparkSession, d: str) -> DataFrame:
    """Where the chain of each customer's orders in turn ends: every order counts, and chains are as long as customers buy."""
    from pyspark.sql import Window

    orders = table(spark, d, "orders").where("o_custkey is not null").select(F.col("o_orderkey").cast("bigint").alias("id"), "o_custkey")
    links = orders.select(F.col("id").alias("old"), F.lead("id").over(Window.partitionBy("o_custkey").orderBy("id")).alias("new"))
    return resolve.chain_ends(links, "old", "new")


def case_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    key = t.case_sort_key("case_number")
    rows = table(spark, d, "cases").where("case_number is not null").select("case_number", key.alias("k")).where("k.year is not null")
    place = F.row_number().over(Window.partitionBy("k.year", "k.month").orderBy("k.serial", "case_number"))
    return rows.select("case_number", F.col("k.year").alias("year"), F.col("k.month").alias("month"), place.alias("place"))


# Witnesses ----------------------------------------------------------------------------------------------------------


def _page_per_case(spark: SparkSession, d: str) -> DataFrame:
    """The latest fetch of each page, by case number."""
    from casemill.operators.ledger import latest

    rows = latest(table(spark, d, "pages").where("file is not null"), ["file"], [F.col("fetched_utc").desc_nulls_last(), F.col("page_id").desc()])
    return rows.withColumn("case", F.explode(t.case_numbers("case_number")))


def received_dates(spark: SparkSession, d: str) -> DataFrame:
    side = _page_per_case(spark, d).groupBy("case").agg(F.min(t.iso_date("recieved_date")).alias("page_date"))
    cases = table(spark, d, "cases").select("case_number", F.col("dates.received.value").alias("case_date"))
    both = cases.join(side, cases.case_number == side.case, "left")
    made = resolve.resolve({"page": F.col("page_date"), "case": F.col("case_date")})
    return both.select("case_number", made.alias("r")).select("case_number", F.col("r.value").alias("value"), F.col("r.basis").alias("basis"), F.col("r.conflict").alias("conflict"))


def code_year_witnesses(spark: SparkSession, d: str) -> DataFrame:
    side = _page_per_case(spark, d).groupBy("case").agg(F.min(F.nullif(F.trim("applicable_code_year"), F.lit(""))).alias("page_year"))
    cases = table(spark, d, "cases").select("case_number", F.col("code_year.value").cast("string").alias("case_year"), t.case_year("case_number").alias("id_year"))
    both = cases.join(side, cases.case_number == side.case, "left")
    made = resolve.resolve({"case": F.col("case_year"), "page": F.col("page_year")})
    return both.select("case_number", made.alias("r"), "id_year").select("case_number", F.col("r.value").alias("value"), F.col("r.basis").alias("basis"), (F.col("r.value").cast("int") <= F.col("id_year")).alias("in_force"))


def observed_code_years(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.nullif(F.trim("applicable_code_year"), F.lit("")).alias("year"), t.iso_date("completed_date").alias("day"))
    return rows.where("year is not null").groupBy("year").agg(F.count("*").alias("pages"), F.min("day").alias("first"), F.max("day").alias("last"))


def date_coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cases").select("case_number", F.col("dates.received.value").alias("received"), F.col("dates.completed.value").alias("completed"))
    return gates.check(rows, F.col("received") <= F.col("completed")).withColumn("gap", t.day_gap(F.col("received"), F.col("completed")).cast("bigint"))


def appeal_fold(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.col("appeal"))
    side = F.when(low.contains("no appeal"), "none").when(low.contains("respondent") & low.contains("complainant"), "both").when(low.contains("respondent"), "respondent").when(low.contains("complainant"), "complainant")
    return table(spark, d, "pages").groupBy(side.alias("by")).agg(F.count("*").alias("pages"))


def row_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "cases").select("case_number", F.explode("verdicts").alias("v")).select("case_number", F.col("v.clause").alias("clause"), "v.panel", "v.appeal_board", "v.final")
    said = v.select("case_number", "clause", F.lit("panel").alias("body"), F.col("panel").alias("polarity")).union(v.select("case_number", "clause", F.lit("board"), F.col("appeal_board"))).union(v.select("case_number", "clause", F.lit("list"), "final")).where("polarity is not null")
    return resolve.verdict_rows(said, ["case_number", "clause"], "polarity", "body")


def verdict_flips(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "cases").select("case_number", F.explode("verdicts").alias("v")).select("case_number", "v.*")
    wrong = F.col("flipped_on_appeal") == (F.col("panel").isNotNull() & F.col("appeal_board").isNotNull() & (F.col("panel") != F.col("appeal_board")))
    return gates.check(v, wrong).groupBy("basis").agg(F.count("*").alias("violations"))


def canonical_spelling(spark: SparkSession, d: str) -> DataFrame:
    return resolve.canonical_spelling(table(spark, d, "pages"), t.fold_name("respondent"), "respondent")


def clause_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All verdict rows, against a book of the parent clauses that they name themselves."""
    v = table(spark, d, "cases").select("case_number", F.explode("verdicts").alias("v")).select("case_number", F.col("v.code_year").alias("year"), F.col("v.clause").alias("clause")).where("year is not null and clause is not null")
    book = v.groupBy("year", F.regexp_replace("clause", r"\.[^.]*$", "").alias("clause")).agg(F.max("clause").alias("text"))
    return resolve.lookup_with_parent(v, book, ["year"], "clause", "text")


def reviewed_overrides(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases").select("case_number", F.col("appeal.by").alias("by"))
    reviewed = table(spark, d, "slot_corrections").where("case_number is not null").groupBy("case_number").agg(F.min("to_clause").alias("value")).withColumn("pin", F.when(F.length("value") > 3, F.sha2(F.lit("none"), 256)).otherwise(F.sha2(F.lit("respondent"), 256)))
    return resolve.override(cases, reviewed, ["case_number"], "by", "value", "pin", F.col("by"))


# Text ---------------------------------------------------------------------------------------------------------------


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t.sentences("text")).alias("sentences"))


def repeated_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(t.sentences("text")).alias("s"))
    return s.groupBy(t.sentence_key("s").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("docs > 1")


def redact_ids(spark: SparkSession, d: str) -> DataFrame:
    panes = table(spark, d, "panes").where("text is not null")
    own = t.case_numbers("text")
    return panes.select("pane_id", F.size(own).alias("ids"), F.md5(t.redact("text", own)).alias("digest"))


def upper_ratios(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pdf_lines").where("text is not null")
    return rounded(lines.select("line_id", t.upper_ratio("text").alias("ratio")))


def headings(spark: SparkSession, d: str) -> DataFrame:
    panes = table(spark, d, "panes").where("text is not null").select("pane_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rounded(pages.headings(panes, "text"))


def section_offsets(spark: SparkSession, d: str) -> DataFrame:
    panes = table(spark, d, "panes").where("text is not null").select("pane_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    placed = intervals.offsets(panes, ["pane_id"], ["line"], F.length("text"))
    return placed.where(F.col("text").rlike("^[A-Z][A-Z /]+$")).select("pane_id", "line", "start", "end")


def clause_mentions(spark: SparkSession, d: str) -> DataFrame:
    panes = table(spark, d, "panes").where("text is not null").select("pane_id", F.explode(t.clause_tokens("text")).alias("clause"))
    key = t.clause_sort_key("clause")
    return panes.groupBy("clause", key.major.alias("major"), key.minor.alias("minor")).agg(F.count("*").alias("panes"))


def token_multiset(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.multiset_difference(table(spark, d, "pdf_records").select("file", F.col("flow_text").alias("text")), table(spark, d, "pdf_lines").select("file", "text"), "file", "text")


def hyphen_decisions(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.hyphen_votes(table(spark, d, "documents"), "text")


def contamination_containment(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases").where("case_number is not null").select("case_number")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "case_number", F.explode(t.case_numbers("text")).alias("stated"))
    status = F.when(F.col("stated") == F.col("case_number"), "contaminated").when(F.col("known").isNotNull(), "recognised").otherwise("unknown")
    joined = docs.join(cases.select(F.col("case_number").alias("known")).distinct(), F.col("stated") == F.col("known"), "left")
    return joined.select("doc_id", "stated", status.alias("status"))


def page_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("title is not null").select("page_id", t.slug("title").alias("slug"), t.norm_path("url").alias("path"))


# Gates --------------------------------------------------------------------------------------------------------------


def vocabulary_coverage(spark: SparkSession, d: str) -> DataFrame:
    return gates.vocabulary(table(spark, d, "pages"), "appeal", DECIDED_APPEALS)


def candidate_accounting(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kept = docs.where("source is not null and text is not null and text <> ''")
    excluded = docs.where("source is null").select("doc_id").union(docs.where("text is null or text = '' or lang is null").select("doc_id"))
    return gates.accounting(docs.where("doc_id is not null"), kept, excluded, ["doc_id"]).groupBy("fate").agg(F.count("*").alias("docs"))


def asymmetric_siblings(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "cases").select(F.col("case_number").alias("a"), F.explode("sibling_cases").alias("b"))
    return gates.asymmetric(edges, "a", "b")


def roster_difference(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "cases").select(F.explode("source_files").alias("file"))
    return gates.set_difference(files, table(spark, d, "pages").select("file"), ["file"])


def field_values(spark: SparkSession, d: str) -> DataFrame:
    return gates.value_counts(table(spark, d, "pages"), ["applicable_code_year", "appeal"])


def _gates(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    cases, panes, items = table(spark, d, "cases"), table(spark, d, "panes"), table(spark, d, "eval_items")
    return {
        "case_number unique": gates.unique(cases.where("case_number is not null"), ["case_number"]),
        "pane unique": gates.unique(panes, ["file", "pane"]),
        "pane domain": gates.check(panes, F.col("pane").isin("report", "summary")),
        "held-out cases": items.where("case_number is not null").join(cases.select("case_number"), "case_number", "left_semi"),
        "responses of items": gates.not_in(table(spark, d, "responses"), ["item_id"], items),
        "corrections of cases": gates.not_in(table(spark, d, "slot_corrections"), ["case_number"], cases),
        "dates in order": gates.check(cases, F.col("dates.received.value") <= F.col("dates.completed.value")),
        "pdf pages": gates.check(table(spark, d, "pdf_records"), F.col("n_pages") > 0),
    }


def gate_report(spark: SparkSession, d: str) -> DataFrame:
    return gates.report(_gates(spark, d))


def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "panes").where("text is not null").select("pane", F.length("text").alias("n"))
    return rows.groupBy("pane").agg(F.count("*").alias("panes"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


QUERIES = {f.__name__: f for f in (round_robin_rank, prefix_union, stratified_sample, hash_split, content_ids, dedupe_siblings, exact_copies, repeated_fetches, sibling_components, id_chain_orders, case_order, received_dates, code_year_witnesses, observed_code_years, date_coherence, appeal_fold, row_verdicts, verdict_flips, canonical_spelling, clause_lookup, reviewed_overrides, sentence_counts, repeated_sentences, redact_ids, upper_ratios, headings, section_offsets, clause_mentions, token_multiset, hyphen_decisions, contamination_containment, page_slugs, vocabulary_coverage, candidate_accounting, asymmetric_siblings, roster_difference, field_values, gate_report, table_sizes)}

_ROBIN = f"""deep AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|item|' || doc_id), doc_id) AS INTEGER) AS depth FROM documents WHERE source IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (ORDER BY depth, md5('{SEED}|case|' || source), source, doc_id) AS rank FROM deep)"""
_CASE = r"\b([A-Z]{2,6}/[0-9]+/[0-9]{1,2}/[0-9]{2})\b"
_BLANKS = r"[ \t\r\n\x{A0}\x{2003}\x{2009}\x{202F}\x{3000}]+"
_COLLAPSE = f"trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'))"
_SENT = f"list_filter(string_split(regexp_replace({_COLLAPSE}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_ISO = "CASE WHEN regexp_full_match(trim({0}), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN strftime(try_strptime(trim({0}), '%d/%m/%Y'), '%Y-%m-%d') WHEN regexp_full_match(trim({0}), '[0-9]{{1,2}} [A-Z][a-z]+ [0-9]{{4}}') THEN strftime(try_strptime(trim({0}), '%d %B %Y'), '%Y-%m-%d') END"
_PAGES = f"""pg AS (SELECT *, unnest(list_distinct(regexp_extract_all(case_number, '{_CASE}', 1))) AS c FROM (SELECT * FROM pages WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY fetched_utc DESC NULLS LAST, page_id DESC) = 1))"""
_VERDICTS = "v AS (SELECT case_number, unnest(verdicts) AS v FROM cases)"
_RESOLVE = "CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN a IS NULL OR b IS NULL THEN 'single' WHEN a = b THEN 'unanimous' ELSE '{0}' END"
_FOLD = """trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(respondent, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')), '[^a-z0-9]+', ' ', 'g'), '\\b(ltd|limited|plc|inc|gmbh|uk|co|company|corp|corporation|llc|ag|sa)\\b', ' ', 'g'), ' +', ' ', 'g'))"""

ORACLE_SQL = {
    "round_robin_rank": f"WITH {_ROBIN} SELECT doc_id, source, depth, rank FROM ranked",
    "prefix_union": f"WITH {_ROBIN} SELECT doc_id, rank FROM ranked WHERE rank <= 200 OR source = 'helpdesk_log'",
    "stratified_sample": f"""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), r AS (SELECT doc_id, d.source, s.size, md5('{SEED}|sample|' || doc_id) AS k, row_number() OVER (PARTITION BY d.source ORDER BY md5('{SEED}|sample|' || doc_id), doc_id) AS p FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source FROM r ORDER BY p, size DESC, k, doc_id LIMIT 100""",
    "hash_split": f"SELECT doc_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5('{SEED}|' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents WHERE source IS NOT NULL)",
    "content_ids": "SELECT pane_id, substr(sha256(concat_ws(chr(10), file, pane, sha256(text))), 1, 16) AS content_id FROM panes",
    "dedupe_siblings": """SELECT item_id, min(item_id) OVER g AS keeper, count(*) OVER g AS n FROM (SELECT DISTINCT item_id, task, case_number, sha256(extract_text) AS digest FROM eval_items WHERE item_id IS NOT NULL) WINDOW g AS (PARTITION BY task, case_number, digest)""",
    "exact_copies": """SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text), length(text)) AS class, count(*) OVER (PARTITION BY md5(text), length(text)) AS copies FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL""",
    "repeated_fetches": "SELECT file, count(*) AS fetches, min(page_id) AS first_page, count(DISTINCT completed_date) AS versions FROM pages WHERE file IS NOT NULL GROUP BY file",
    "sibling_components": """WITH RECURSIVE f AS (SELECT case_number, unnest(source_files) AS f FROM cases), s AS (SELECT case_number AS a, unnest(sibling_cases) AS b FROM cases),
e AS (SELECT a, b FROM s WHERE b IN (SELECT case_number FROM cases) UNION SELECT x.case_number, y.case_number FROM f x JOIN f y USING (f)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT case_number AS node, case_number AS m FROM cases WHERE case_number IS NOT NULL UNION SELECT r.node, u.b FROM r JOIN u ON r.m = u.a)
SELECT node, min(m) AS component FROM r GROUP BY node""",
    "id_chain_orders": """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS old, max(o_orderkey) OVER w AS e, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_custkey IS NOT NULL WINDOW w AS (PARTITION BY o_custkey))
SELECT old, CAST(e AS BIGINT) AS "end", n - r AS steps FROM o WHERE r < n""",
    "case_order": """WITH k AS (SELECT case_number, TRY_CAST(split_part(case_number, '/', 4) AS INTEGER) AS year, TRY_CAST(split_part(case_number, '/', 3) AS INTEGER) AS month, TRY_CAST(split_part(case_number, '/', 2) AS INTEGER) AS serial FROM cases WHERE case_number IS NOT NULL)
SELECT case_number, year, month, CAST(row_number() OVER (PARTITION BY year, month ORDER BY serial, case_number) AS INTEGER) AS place FROM k WHERE year IS NOT NULL""",
    "received_dates": f"""WITH {_PAGES}, p AS (SELECT c, min({_ISO.format('recieved_date')}) AS a FROM pg GROUP BY c), j AS (SELECT cases.case_number, a, dates.received.value AS b FROM cases LEFT JOIN p ON cases.case_number = c)
SELECT case_number, coalesce(a, b) AS value, {_RESOLVE.format('page')} AS basis, coalesce(a <> b, false) AS conflict FROM j""",
    "code_year_witnesses": f"""WITH {_PAGES}, p AS (SELECT c, min(nullif(trim(applicable_code_year), '')) AS b FROM pg GROUP BY c), j AS (SELECT cases.case_number, CAST(code_year.value AS VARCHAR) AS a, b, TRY_CAST(split_part(cases.case_number, '/', 4) AS INTEGER) + 2000 AS y FROM cases LEFT JOIN p ON cases.case_number = c)
SELECT case_number, coalesce(a, b) AS value, {_RESOLVE.format('case')} AS basis, CAST(coalesce(a, b) AS INTEGER) <= y AS in_force FROM j""",
    "observed_code_years": f"SELECT nullif(trim(applicable_code_year), '') AS year, count(*) AS pages, min({_ISO.format('completed_date')}) AS first, max({_ISO.format('completed_date')}) AS last FROM pages WHERE nullif(trim(applicable_code_year), '') IS NOT NULL GROUP BY 1",
    "date_coherence": """WITH d AS (SELECT case_number, dates.received.value AS received, dates.completed.value AS completed FROM cases)
SELECT case_number, received, completed, CAST((substr(completed, 1, 4)::INT - substr(received, 1, 4)::INT) * 365 + (substr(completed, 6, 2)::INT - substr(received, 6, 2)::INT) * 30 + substr(completed, 9, 2)::INT - substr(received, 9, 2)::INT AS BIGINT) AS gap FROM d WHERE received > completed""",
    "appeal_fold": """SELECT CASE WHEN contains(lower(appeal), 'no appeal') THEN 'none' WHEN contains(lower(appeal), 'respondent') AND contains(lower(appeal), 'complainant') THEN 'both' WHEN contains(lower(appeal), 'respondent') THEN 'respondent' WHEN contains(lower(appeal), 'complainant') THEN 'complainant' END AS "by", count(*) AS pages FROM pages GROUP BY 1""",
    "row_verdicts": f"""WITH {_VERDICTS}, s AS (SELECT case_number, v.clause AS clause, 'panel' AS body, v.panel AS polarity FROM v UNION ALL SELECT case_number, v.clause, 'board', v.appeal_board FROM v UNION ALL SELECT case_number, v.clause, 'list', v.final FROM v),
h AS (SELECT case_number, clause, bool_or(body = 'panel' AND polarity = 'breach') AS pb, bool_or(body = 'panel' AND polarity = 'no_breach') AS pn, bool_or(body = 'board' AND polarity = 'breach') AS bb, bool_or(body = 'board' AND polarity = 'no_breach') AS bn, bool_or(body = 'list' AND polarity = 'breach') AS lb, bool_or(body = 'list' AND polarity = 'no_breach') AS ln FROM s WHERE polarity IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN pb AND NOT pn THEN 'breach' WHEN pn AND NOT pb THEN 'no_breach' END AS panel, CASE WHEN bb AND NOT bn THEN 'breach' WHEN bn AND NOT bb THEN 'no_breach' END AS board, CASE WHEN lb AND NOT ln THEN 'breach' WHEN ln AND NOT lb THEN 'no_breach' END AS final FROM h),
f AS (SELECT *, CASE WHEN bb OR bn THEN board ELSE panel END AS heard FROM r)
SELECT case_number, clause, panel, board, final, (pb AND pn) OR (bb AND bn) OR (lb AND ln) AS dual, coalesce(panel <> board, false) AS flipped, CASE WHEN NOT (lb OR ln) THEN 'unlisted' WHEN NOT (bb OR bn OR pb OR pn) THEN 'list' WHEN heard = final THEN 'unanimous' ELSE 'conflict' END AS basis FROM f""",
    "verdict_flips": f"WITH {_VERDICTS} SELECT v.basis AS basis, count(*) AS violations FROM v WHERE v.flipped_on_appeal <> coalesce(v.panel <> v.appeal_board, false) GROUP BY 1",
    "canonical_spelling": f"""WITH k AS (SELECT {_FOLD} AS key, respondent FROM pages WHERE respondent IS NOT NULL), c AS (SELECT key, respondent, count(*) AS n FROM k WHERE key <> '' GROUP BY 1, 2)
SELECT key, respondent, n, count(*) OVER (PARTITION BY key) AS spellings, CAST(sum(n) OVER (PARTITION BY key) AS BIGINT) AS rows FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, length(respondent), respondent) = 1""",
    "clause_lookup": f"""WITH {_VERDICTS}, x AS (SELECT case_number, v.code_year AS year, v.clause AS clause FROM v WHERE v.code_year IS NOT NULL AND v.clause IS NOT NULL),
book AS (SELECT year, regexp_replace(clause, '\\.[^.]*$', '') AS clause, max(clause) AS text FROM x GROUP BY 1, 2)
SELECT x.case_number, x.year, x.clause, coalesce(a.text, b.text) AS text, CASE WHEN a.text IS NOT NULL THEN 'own' WHEN b.text IS NOT NULL THEN 'parent' ELSE 'missing' END AS rung
FROM x LEFT JOIN book a ON x.year = a.year AND x.clause = a.clause LEFT JOIN book b ON x.year = b.year AND contains(x.clause, '.') AND regexp_replace(x.clause, '\\.[^.]*$', '') = b.clause""",
    "reviewed_overrides": """WITH r AS (SELECT case_number, min(to_clause) AS value FROM slot_corrections WHERE case_number IS NOT NULL GROUP BY 1), j AS (SELECT c.case_number, c.appeal."by" AS "by", r.value, CASE WHEN length(r.value) > 3 THEN 'none' ELSE 'respondent' END AS pin FROM cases c LEFT JOIN r ON c.case_number = r.case_number)
SELECT case_number, CASE WHEN value IS NOT NULL AND pin = "by" THEN value ELSE "by" END AS "by", coalesce(value IS NOT NULL AND pin = "by", false) AS by_reviewed, coalesce(value IS NOT NULL AND pin <> "by", false) AS by_stale FROM j""",
    "sentence_counts": f"SELECT doc_id, CAST(len({_SENT}) AS INTEGER) AS sentences FROM documents WHERE text IS NOT NULL",
    "repeated_sentences": f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS text FROM documents WHERE text IS NOT NULL)
SELECT substr(sha256({_COLLAPSE}), 1, 12) AS key, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""",
    "redact_ids": f"""WITH n AS (SELECT pane_id, text, list_distinct(regexp_extract_all(text, '{_CASE}', 1)) AS own FROM panes WHERE text IS NOT NULL)
SELECT pane_id, CAST(len(own) AS INTEGER) AS ids, md5(list_reduce(list_prepend(text, list_reverse_sort(own)), lambda a, i: regexp_replace(a, regexp_escape(i) || '([^0-9]|$)', '[case]\\1', 'g'))) AS digest FROM n""",
    "upper_ratios": "SELECT line_id, round(coalesce(length(regexp_replace(text, '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0), 0), 9) AS ratio FROM pdf_lines WHERE text IS NOT NULL",
    "headings": """WITH l AS (SELECT pane_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM panes WHERE text IS NOT NULL),
r AS (SELECT *, coalesce(length(regexp_replace(text, '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0), 0) AS ratio, upper(trim(text)) AS u FROM l WHERE trim(text) <> '' AND length(text) <= 120)
SELECT pane_id, CAST(line AS INTEGER) AS line, round(ratio, 9) AS ratio, CASE WHEN u LIKE 'CASE %' THEN 'case' WHEN u LIKE '%APPEAL BOARD%' THEN 'appeal_ruling' WHEN u LIKE '%RULING%' THEN 'ruling' WHEN u LIKE '%APPEAL%' THEN 'appeal' WHEN u LIKE '%COMPLAINT%' THEN 'complaint' WHEN u LIKE '%RESPONSE%' THEN 'response' ELSE 'other' END AS token,
CASE WHEN regexp_matches(trim(text), '^(?i)(?:complaint|case) (?:received|completed)\b') OR (length(text) - length(replace(text, '"', ''))) % 2 = 1 OR length(replace(text, '“', '')) <> length(replace(text, '”', '')) OR length(trim(text)) > 90 THEN 'low' WHEN ratio >= 0.8 THEN 'high' WHEN regexp_matches(trim(text), '[.;,]$') THEN 'low'
 WHEN len(string_split_regex(trim(text), ' +')) <= 6 OR len(string_split_regex(trim(text), ' +')) <= 12 AND regexp_matches(trim(text), '^[0-9]+[.)]? ') THEN 'medium' ELSE 'low' END AS confidence FROM r""",
    "section_offsets": """WITH l AS (SELECT pane_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM panes WHERE text IS NOT NULL),
o AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY pane_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l)
SELECT pane_id, CAST(line AS INTEGER) AS line, start, start + length(text) AS "end" FROM o WHERE regexp_matches(text, '^[A-Z][A-Z /]+$')""",
    "clause_mentions": """WITH m AS (SELECT pane_id, unnest(regexp_extract_all(text, 'Clauses? ([0-9]+(?:\\.[0-9]+)?(?:(?:, | and )[0-9]+(?:\\.[0-9]+)?)*)', 1)) AS s FROM panes WHERE text IS NOT NULL), c AS (SELECT DISTINCT pane_id, unnest(regexp_extract_all(s, '([0-9]+(?:\\.[0-9]+)?)', 1)) AS clause FROM m)
SELECT clause, CAST(split_part(clause, '.', 1) AS INTEGER) AS major, coalesce(TRY_CAST(nullif(split_part(clause, '.', 2), '') AS INTEGER), -1) AS minor, count(*) AS panes FROM c GROUP BY clause""",
    "token_multiset": """WITH a AS (SELECT file, unnest(string_split(trim(regexp_replace(flow_text, '[ \\t\\r\\n]+', ' ', 'g')), ' ')) AS token, 1 AS s FROM pdf_records WHERE flow_text IS NOT NULL AND file IS NOT NULL), b AS (SELECT file, unnest(string_split(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), ' ')) AS token, -1 AS s FROM pdf_lines WHERE text IS NOT NULL AND file IS NOT NULL),
u AS (SELECT file, token, sum(s) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE token <> '' GROUP BY 1, 2)
SELECT file, CAST(coalesce(sum(d) FILTER (d > 0), 0) AS BIGINT) AS only_left, CAST(coalesce(-sum(d) FILTER (d < 0), 0) AS BIGINT) AS only_right FROM u GROUP BY file""",
    "hyphen_decisions": """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '([a-z]+(?:-[a-z]+)*)', 1)) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT w, count(*) AS n FROM w GROUP BY w)
SELECT h.w AS pair, coalesce(c.n, 0) AS closed, h.n AS hyphened, CASE WHEN coalesce(c.n, 0) > h.n THEN 'closed' ELSE 'hyphened' END AS decision FROM c h LEFT JOIN c ON c.w = replace(h.w, '-', '') WHERE regexp_matches(h.w, '^[a-z]+-[a-z]+$')""",
    "contamination_containment": f"""WITH s AS (SELECT DISTINCT doc_id, case_number, unnest(regexp_extract_all(text, '{_CASE}', 1)) AS stated FROM documents WHERE text IS NOT NULL)
SELECT doc_id, stated, CASE WHEN stated = case_number THEN 'contaminated' WHEN stated IN (SELECT case_number FROM cases WHERE case_number IS NOT NULL) THEN 'recognised' ELSE 'unknown' END AS status FROM s""",
    "page_slugs": """SELECT page_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lower(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', ''), ''), CASE WHEN url IS NOT NULL THEN '/' END)) AS path FROM pages WHERE title IS NOT NULL""",
    "vocabulary_coverage": "SELECT lower(trim(appeal)) AS value, count(*) AS n, lower(trim(appeal)) IN ('no appeal', 'respondent appeal', 'complainant appeal', '') AS decided FROM pages WHERE appeal IS NOT NULL GROUP BY 1",
    "candidate_accounting": """SELECT CASE WHEN k AND e THEN 'both' WHEN k THEN 'kept' WHEN e THEN 'excluded' ELSE 'lost' END AS fate, count(*) AS docs FROM (SELECT doc_id, coalesce(source IS NOT NULL AND text <> '', false) AS k, source IS NULL OR text IS NULL OR text = '' OR lang IS NULL AS e FROM documents WHERE doc_id IS NOT NULL) GROUP BY 1""",
    "asymmetric_siblings": "WITH e AS (SELECT case_number AS a, unnest(sibling_cases) AS b FROM cases) SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e x WHERE x.a = e.b AND x.b = e.a)",
    "roster_difference": """WITH l AS (SELECT DISTINCT unnest(source_files) AS file FROM cases), r AS (SELECT DISTINCT file FROM pages)
SELECT file, 'left_only' AS side FROM (SELECT file FROM l EXCEPT SELECT file FROM r) UNION ALL SELECT file, 'right_only' FROM (SELECT file FROM r EXCEPT SELECT file FROM l)""",
    "field_values": "SELECT 'applicable_code_year' AS field, applicable_code_year AS value, count(*) AS n FROM pages GROUP BY 2 UNION ALL SELECT 'appeal', appeal, count(*) FROM pages GROUP BY 2",
    "gate_report": """SELECT 'case_number unique' AS gate, count(*) AS violations FROM (SELECT case_number FROM cases WHERE case_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'pane unique', count(*) FROM (SELECT file, pane FROM panes GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'pane domain', count(*) FROM panes WHERE pane NOT IN ('report', 'summary')
UNION ALL SELECT 'held-out cases', count(*) FROM eval_items WHERE case_number IN (SELECT case_number FROM cases)
UNION ALL SELECT 'responses of items', count(*) FROM responses r WHERE item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM eval_items i WHERE i.item_id = r.item_id)
UNION ALL SELECT 'corrections of cases', count(*) FROM slot_corrections s WHERE case_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.case_number = s.case_number)
UNION ALL SELECT 'dates in order', count(*) FROM cases WHERE dates.received.value > dates.completed.value
UNION ALL SELECT 'pdf pages', count(*) FROM pdf_records WHERE n_pages <= 0""",
    "table_sizes": "SELECT pane, count(*) AS panes, CAST(min(length(text)) AS INTEGER) AS least, quantile_cont(length(text), 0.5) AS median, CAST(max(length(text)) AS INTEGER) AS most FROM panes WHERE text IS NOT NULL GROUP BY pane",
}
