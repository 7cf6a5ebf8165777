"""Queries over reports, narratives and the whole review."""

from __future__ import annotations

import datetime as dt
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.operators import prompts as pr
from casequarry.operators import report as rp
from casequarry.operators.conditions import deterministic_results
from casequarry.operators.model import call_model, join_responses
from casequarry.operators.narrative import narratives as written_narratives
from casequarry.plans import inputs
from casequarry.plans.catalog import query
from casequarry.plans.queries_checks import CHECKED, MAX_PROMPT, all_results
from casequarry.plans.queries_intake import CFG, big
from casequarry.plans.queries_model import CLASSIFY_STAGES, by_size, digest
from casequarry.plans.review import ModelSteps, review_cases
from casequarry.plans.sqlparts import CASES, CLASSIFIED, DOCS, FLAGS, PARSED, RESULTS, lit, with_
from casequarry.scale import cut_lineage
from casequarry.sources.records import DOCUMENT_FIELDS, ISSUE_FIELDS, record_digests, record_items
from casequarry.sources.sinks import CONDITION_FIELDS, export_reports


# Columns of results that recommendations read, and those that a whole report shows.
ADVISED = ("case_id", *rp.ORDER, "condition_name", "status", "severity")
SHOWN = (*ADVISED, "doc_id", "analyst_message", "check_type")


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deterministic_results(inputs.home_documents(spark, sf_dir), CFG, inputs.AS_OF)


_STATUS = "CASE WHEN coalesce(blocking, false) OR coalesce(needs_review, false) THEN 'needs_analyst_action' ELSE 'ready_for_review' END"


@query(with_(CASES, DOCS, PARSED, RESULTS, FLAGS) + f"""
SELECT c.case_id, coalesce(blocking, false) AS blocking, coalesce(needs_review, false) AS needs_review, {_STATUS} AS case_status
FROM cases c LEFT JOIN flags USING (case_id)""")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: are the dated documents of each case fresh and valid, and what does that make of the case?"""
    flags = rp.attention_flags(inputs.home_cases(spark, sf_dir), rule_results(spark, sf_dir))
    return flags.select("case_id", "blocking", "needs_review", rp.final_status(F.col("requires_analyst_attention")).alias("case_status"))


_ALL_FLAGS = FLAGS.replace("FROM results", "FROM all_results")


@query(with_(*CHECKED, _ALL_FLAGS) + """
SELECT c.case_id, coalesce(blocking, false) AS blocking, coalesce(needs_review, false) AS needs_review,
  coalesce(blocking, false) OR coalesce(needs_review, false) AS requires_analyst_attention FROM cases c LEFT JOIN flags USING (case_id)""")
def attention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = rp.attention_flags(inputs.home_cases(spark, sf_dir), all_results(spark, sf_dir))
    return flags.select("case_id", "blocking", "needs_review", "requires_analyst_attention")


_INVENTORY = """inventory AS (SELECT d.*, coalesce(c.detected_type, d.doc_type) AS classified_as, CAST(c.confidence AS DOUBLE) AS confidence
  FROM docs d LEFT JOIN classified c USING (doc_id))"""


@query(with_(DOCS, CLASSIFIED, _INVENTORY) + """
SELECT case_id, doc_id, file_name, doc_type, category, status, document_date AS upload_timestamp, classified_as,
  confidence AS classification_confidence, false AS manually_overridden FROM inventory""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.inventory(inputs.case_documents(spark, sf_dir), inputs.classifications(spark, sf_dir)).drop("doc_seq")


_RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"


@query(with_(*CHECKED) + f"""
SELECT case_id, condition_name, doc_id, severity, status, analyst_message, CAST(row_number() OVER (
  PARTITION BY case_id ORDER BY {_RANK}, condition_seq, doc_seq NULLS FIRST) AS BIGINT) AS place
FROM all_results WHERE status <> 'pass'""")
def flagged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.placed_issues(all_results(spark, sf_dir))
    return rows.select("case_id", "condition_name", "doc_id", "severity", "status", "analyst_message", "place")


_MANUAL = f"manual AS (SELECT case_id, doc_id, doc_seq FROM classified WHERE detected_type = {lit(fv.NEEDS_MANUAL)})"
_ADVICE = f"""names AS (
  SELECT case_id, 'blocking' AS kind, condition_seq AS s, doc_seq AS d, condition_name AS name FROM all_results WHERE status = 'fail' AND severity = 'error'
  UNION ALL SELECT case_id, 'review', condition_seq, doc_seq, condition_name FROM all_results WHERE status = 'needs_review'
  UNION ALL SELECT case_id, 'unclassified', 0, doc_seq, doc_id FROM manual),
failures AS (SELECT case_id, count(*) AS failed FROM docs WHERE status = 'failed' GROUP BY case_id),
advice AS (
  SELECT case_id, kind, CAST(row_number() OVER (PARTITION BY case_id, kind ORDER BY s, d NULLS FIRST) AS BIGINT) AS place, name, NULL AS message FROM names
  UNION ALL SELECT case_id, 'failed_documents', NULL, NULL, failed || ' document(s) failed extraction and need manual review.' FROM failures WHERE case_id IN (SELECT case_id FROM cases)
  UNION ALL SELECT case_id, 'all_clear', NULL, NULL, {lit(fv.MSG_ALL_CLEAR)} FROM cases
    WHERE case_id NOT IN (SELECT case_id FROM names) AND case_id NOT IN (SELECT case_id FROM failures))"""


@query(with_(*CHECKED, CLASSIFIED, _MANUAL, _ADVICE) + "SELECT case_id, kind, place, name, message FROM advice")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = cut_lineage(all_results(spark, sf_dir).select(*ADVISED), "results")
    return rp.recommendations(
        inputs.home_cases(spark, sf_dir), inputs.case_documents(spark, sf_dir), inputs.classifications(spark, sf_dir), results
    )


_GROUPED = """grouped AS (SELECT case_id, kind, string_agg(name, ', ' ORDER BY place) AS names, count(*) AS n FROM advice
  WHERE name IS NOT NULL GROUP BY case_id, kind)"""
_LINES_OF_ADVICE = """
SELECT case_id, kind, CASE kind WHEN 'blocking' THEN 'Blocking issues found in: ' || names || '. Analyst must resolve before proceeding.'
  WHEN 'review' THEN 'Items requiring analyst review: ' || names || '.' ELSE n || ' document(s) could not be auto-classified: ' || names END AS line FROM grouped
UNION ALL SELECT case_id, kind, message FROM advice WHERE name IS NULL"""


@query(with_(*CHECKED, CLASSIFIED, _MANUAL, _ADVICE, _GROUPED) + _LINES_OF_ADVICE)
def advice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations as the lines of a report; all cases here have lines a reader can take."""
    return rp.advice_lines(recommendations(spark, sf_dir), MAX_PROMPT)


_COUNTS = """counted AS (
  SELECT c.case_id, count(r.status) AS total, count(CASE WHEN status = 'pass' THEN 1 END) AS passed, count(CASE WHEN status = 'fail' THEN 1 END) AS failed,
         count(CASE WHEN status = 'needs_review' THEN 1 END) AS review FROM cases c LEFT JOIN all_results r USING (case_id) GROUP BY c.case_id),
spare AS (SELECT case_id, 'Automated review complete. ' || total || ' conditions checked: ' || passed || ' passed, ' || failed || ' failed, ' || review ||
  ' require analyst review. Please review flagged issues before making a decision.' AS narrative_summary FROM counted)"""


@query(with_(*CHECKED, _COUNTS) + "SELECT case_id, narrative_summary FROM spare")
def fallback_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.fallback_narrative(inputs.home_cases(spark, sf_dir), all_results(spark, sf_dir))


_SUMMARY = f"""inventory_lines AS (SELECT case_id, count(*) AS n, string_agg('- ' || file_name || ' -> ' || classified_as || ' (confidence: ' ||
    coalesce(CAST(confidence AS VARCHAR), 'None') || ')', chr(10) ORDER BY doc_seq) AS lines FROM inventory GROUP BY case_id),
check_lines AS (SELECT case_id, string_agg('- [' || upper(status) || '] ' || condition_name || ': ' || analyst_message, chr(10) ORDER BY condition_seq, doc_seq) AS lines
  FROM all_results GROUP BY case_id),
summaries AS (
  SELECT c.case_id, c.ck, 'Write a summary of this case for an analyst.' || chr(10) || 'Case: ' || c.case_id || chr(10) || 'Country: germany' || chr(10) ||
    'Process: consumer_credit' || chr(10) || chr(10) || 'Documents (' || coalesce(i.n, 0) || '):' || chr(10) || coalesce(i.lines, '') || chr(10) || chr(10) ||
    'Checks:' || chr(10) || coalesce(k.lines, '') || {lit(pr.SUMMARY_TAIL)} AS prompt
  FROM cases c LEFT JOIN inventory_lines i USING (case_id) LEFT JOIN check_lines k USING (case_id))"""


@query(with_(*CHECKED, CLASSIFIED, _INVENTORY, _SUMMARY) + "SELECT case_id, CAST(length(prompt) AS BIGINT) AS prompt_chars, sha256(prompt) AS prompt_hash FROM summaries")
def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = inputs.home_cases(spark, sf_dir)
    stock = rp.inventory(inputs.case_documents(spark, sf_dir), inputs.classifications(spark, sf_dir))
    rows = pr.summary_prompts(cases, stock, all_results(spark, sf_dir), MAX_PROMPT)
    return rows.select("case_id", big("prompt_chars").alias("prompt_chars"), digest("prompt").alias("prompt_hash"))


def case_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives from replies by the number of the case: two in three are written, the others failed or missing."""
    cases = inputs.home_cases(spark, sf_dir)
    stock = rp.inventory(inputs.case_documents(spark, sf_dir), inputs.classifications(spark, sf_dir))
    n = F.col("case_id").cast("bigint")
    replies = cases.where(n % 5 != 0).select(
        "case_id",
        F.when(n % 3 != 0, F.concat(F.lit("  Summary of "), "case_id", F.lit(".\n"))).alias("raw_response"),
        F.when(n % 3 == 0, "timeout").alias("error"),
    )
    ask = partial(join_responses, responses=replies, keys=["case_id"])
    return written_narratives(cases, stock, cut_lineage(all_results(spark, sf_dir), "results"), CFG, ask)


_NARRATIVES = """narratives AS (SELECT c.case_id, CASE WHEN ck % 5 <> 0 AND ck % 3 <> 0 THEN 'Summary of ' || c.case_id || '.' ELSE narrative_summary END AS narrative_summary
  FROM cases c JOIN spare USING (case_id))"""


@query(with_(*CHECKED, _COUNTS, _NARRATIVES) + "SELECT case_id, narrative_summary FROM narratives")
def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_narratives(spark, sf_dir)


def _report_inputs(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reports are made over results that were written first, as in a whole review: they hold model replies.

    ``columns`` are those that the reports show; others, made of many texts, are not made just to be written.
    """
    results = all_results(spark, sf_dir)
    results = cut_lineage(results.select(*columns) if columns else results, "results")
    return inputs.home_cases(spark, sf_dir), inputs.case_documents(spark, sf_dir), inputs.classifications(spark, sf_dir), results


_REPORT_FIGURES = """stock AS (SELECT case_id, count(*) AS n_documents, count(CASE WHEN status = 'failed' THEN 1 END) AS n_failed FROM docs GROUP BY case_id),
unread AS (SELECT case_id, count(*) AS n_manual FROM manual GROUP BY case_id),
checks AS (SELECT case_id, count(*) AS n_results, count(CASE WHEN status <> 'pass' THEN 1 END) AS n_flagged,
  count(CASE WHEN status = 'fail' AND severity = 'error' THEN 1 END) AS n_blocking, count(CASE WHEN status = 'needs_review' THEN 1 END) AS n_review
  FROM all_results GROUP BY case_id)"""


@query(with_(*CHECKED, CLASSIFIED, _MANUAL, _ALL_FLAGS, _COUNTS, _REPORT_FIGURES) + f"""
SELECT c.case_id, coalesce(n_documents, 0) AS n_documents, coalesce(n_failed, 0) AS n_failed, coalesce(n_manual, 0) AS n_manual, coalesce(n_results, 0) AS n_results,
  coalesce(n_flagged, 0) AS n_flagged, coalesce(n_blocking, 0) AS n_blocking, coalesce(n_review, 0) AS n_review, narrative_summary, {_STATUS} AS case_status
FROM cases c LEFT JOIN stock USING (case_id) LEFT JOIN unread USING (case_id) LEFT JOIN checks USING (case_id) LEFT JOIN flags USING (case_id) JOIN spare USING (case_id)""")
def case_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.build_reports(*_report_inputs(spark, sf_dir))
    return rows.drop("country", "process_type", "requires_analyst_attention", "generated_at")


@query(with_(*CHECKED, _ALL_FLAGS) + f"""
SELECT c.case_id, {_STATUS} AS status, coalesce(blocking, false) OR coalesce(needs_review, false) AS requires_analyst_attention
FROM cases c LEFT JOIN flags USING (case_id)""")
def process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.process_summary(inputs.home_cases(spark, sf_dir), all_results(spark, sf_dir))


@query(with_(*CHECKED, CLASSIFIED, _MANUAL, _INVENTORY, _ADVICE, _ALL_FLAGS, _COUNTS, _REPORT_FIGURES) + f"""
SELECT 'condition_results' AS table_name, case_id, CAST(to_json({{'condition_name': condition_name, 'status': status, 'severity': severity,
  'analyst_message': analyst_message, 'check_type': CASE WHEN condition_seq < 3 THEN 'deterministic' ELSE 'llm_assisted' END, 'doc_seq': doc_seq}}) AS VARCHAR) AS item FROM all_results
UNION ALL SELECT 'flagged_issues', case_id, CAST(to_json({{'condition_name': condition_name, 'status': status, 'severity': severity, 'analyst_message': analyst_message,
  'severity_rank': {_RANK}, 'doc_id': doc_id}}) AS VARCHAR) FROM all_results WHERE status <> 'pass'
UNION ALL SELECT 'document_inventory', case_id, CAST(to_json({{'doc_id': doc_id, 'file_name': file_name, 'doc_type': doc_type, 'category': category, 'status': status,
  'upload_timestamp': document_date, 'classified_as': classified_as, 'classification_confidence': confidence, 'manually_overridden': false}}) AS VARCHAR) FROM inventory
UNION ALL SELECT 'recommendations', case_id, CAST(to_json({{'kind': kind, 'place': place, 'name': name, 'message': message}}) AS VARCHAR) FROM advice
UNION ALL SELECT 'reports', c.case_id, CAST(to_json({{'case_status': {_STATUS}, 'n_documents': coalesce(n_documents, 0), 'n_failed': coalesce(n_failed, 0),
  'n_manual': coalesce(n_manual, 0), 'n_results': coalesce(n_results, 0), 'n_flagged': coalesce(n_flagged, 0), 'n_blocking': coalesce(n_blocking, 0),
  'n_review': coalesce(n_review, 0), 'narrative_summary': narrative_summary}}) AS VARCHAR)
  FROM cases c LEFT JOIN stock USING (case_id) LEFT JOIN unread USING (case_id) LEFT JOIN checks USING (case_id) LEFT JOIN flags USING (case_id) JOIN spare USING (case_id)""")
def exported_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table that is handed out."""
    tables = export_reports(rp.report_tables(*_report_inputs(spark, sf_dir)))
    shown = {
        "condition_results": [*CONDITION_FIELDS, "doc_seq"],
        "flagged_issues": ["condition_name", "status", "severity", "analyst_message", "severity_rank", "doc_id"],
        "document_inventory": list(DOCUMENT_FIELDS),
        "recommendations": ["kind", "place", "name", "message"],
        "reports": ["case_status", "n_documents", "n_failed", "n_manual", "n_results", "n_flagged", "n_blocking", "n_review", "narrative_summary"],
    }
    items = [
        tables[name].select(F.lit(name).alias("table_name"), "case_id", F.to_json(F.struct(*shown[name]), {"ignoreNullFields": "false"}).alias("item"))
        for name in tables
    ]
    return reduce(DataFrame.unionByName, items)


_RECORDS = """documents_json AS (SELECT case_id, string_agg(CAST(to_json({'doc_id': doc_id, 'file_name': file_name, 'doc_type': doc_type, 'category': category,
    'status': status, 'upload_timestamp': document_date, 'classified_as': classified_as, 'classification_confidence': confidence, 'manually_overridden': false}) AS VARCHAR),
    ',' ORDER BY doc_seq) AS list FROM inventory GROUP BY case_id),
conditions_json AS (SELECT case_id, string_agg(CAST(to_json({'condition_name': condition_name, 'status': status, 'severity': severity, 'analyst_message': analyst_message,
    'check_type': CASE WHEN condition_seq < 3 THEN 'deterministic' ELSE 'llm_assisted' END}) AS VARCHAR), ',' ORDER BY condition_seq, doc_seq NULLS FIRST) AS list
  FROM all_results GROUP BY case_id),
issues_json AS (SELECT case_id, string_agg(CAST(to_json({'condition_name': condition_name, 'severity': severity, 'status': status, 'analyst_message': analyst_message}) AS VARCHAR),
    ',' ORDER BY """ + _RANK + """, condition_seq, doc_seq NULLS FIRST) AS list FROM all_results WHERE status <> 'pass' GROUP BY case_id),
advice_json AS (SELECT case_id, string_agg(CAST(to_json(line) AS VARCHAR), ',' ORDER BY list_position(['blocking', 'review', 'failed_documents', 'unclassified', 'all_clear'], kind)) AS list
  FROM (""" + _LINES_OF_ADVICE + """) GROUP BY case_id),
records_json AS (
  SELECT c.case_id, '{"case_id":' || to_json(c.case_id) || ',"generated_at":"1998-07-01T08:30:00.000Z","document_inventory":[' || coalesce(d.list, '') ||
    '],"condition_results":[' || coalesce(r.list, '') || '],"flagged_issues":[' || coalesce(i.list, '') || '],"narrative_summary":' || to_json(narrative_summary) ||
    ',"recommendations":[' || coalesce(a.list, '') || '],"requires_analyst_attention":' || (coalesce(blocking, false) OR coalesce(needs_review, false)) || '}' AS record
  FROM cases c JOIN spare USING (case_id) LEFT JOIN flags USING (case_id) LEFT JOIN documents_json d USING (case_id) LEFT JOIN conditions_json r USING (case_id)
    LEFT JOIN issues_json i USING (case_id) LEFT JOIN advice_json a USING (case_id))"""


@query(with_(*CHECKED, CLASSIFIED, _MANUAL, _INVENTORY, _ADVICE, _GROUPED, _ALL_FLAGS, _COUNTS, _RECORDS) + """
SELECT case_id, CAST(length(record) AS BIGINT) AS chars, sha256(record) AS record_hash FROM records_json""")
def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a case as one JSON record, by length and digest."""
    tables = rp.report_tables(*_report_inputs(spark, sf_dir, *SHOWN), generated_at=dt.datetime(1998, 7, 1, 8, 30))
    return record_digests(record_items(tables, ISSUE_FIELDS[:4]))


def _whole_review(spark: SparkSession, sf_dir: str):
    docs = inputs.text_documents(spark, sf_dir).drop("country", "country_code", "process_type")
    cases = docs.select("case_id").distinct().withColumns({"country": F.lit(fv.COUNTRY), "process_type": F.lit(fv.PROCESS)})
    names = [c["condition_name"] for c in CFG.conditions if c["check_type"] == "llm_assisted"]
    none = docs.select("case_id", F.lit(None).cast("string").alias("raw_response"), F.lit("offline").alias("error")).distinct()
    model = ModelSteps(
        classify=partial(join_responses, responses=inputs.type_replies(docs), keys=["doc_id"]),
        extract=partial(call_model, model_fn=by_size, keys=["doc_id"]),
        conditions=partial(join_responses, responses=inputs.condition_replies(cases, names), keys=["case_id", "condition_name"]),
        narrative=partial(join_responses, responses=none, keys=["case_id"]),
    )
    return review_cases(cases, docs, CFG, model, inputs.AS_OF)


@query(with_(*[p.replace("CASE WHEN doc_id % 5 <> 4 THEN 'germany' ELSE 'austria' END AS country", "'germany' AS country") for p in CLASSIFY_STAGES], f"""
typed AS (SELECT t.case_id, t.doc_id, t.k, CASE WHEN c.detected_type <> {lit(fv.NEEDS_MANUAL)} THEN c.detected_type ELSE '' END AS doc_type
  FROM texts t LEFT JOIN classes c USING (doc_id))""") + """
SELECT case_id, count(*) AS documents, count(CASE WHEN doc_type IN ('', 'unknown_document') OR doc_type IS NULL THEN 1 END) AS skipped,
  count(CASE WHEN doc_type = 'salary_slip' THEN 1 END) AS salary_slips FROM typed GROUP BY case_id""")
def reviewed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole review over the texts, model steps included; figures read off its reports."""
    rows = _whole_review(spark, sf_dir).tables.document_inventory
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count(F.when(F.col("status") == fv.DOC_SKIPPED, 1)).alias("skipped"),
        F.count(F.when(F.col("doc_type") == "salary_slip", 1)).alias("salary_slips"),
    )
