"""Queries over completeness, validation, conditions and cross-document checks."""

from __future__ import annotations

import dataclasses
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.dates import months_before, parse_date
from casequarry.operators import completeness as co
from casequarry.operators import conditions as cond
from casequarry.operators import crossdoc as cd
from casequarry.operators import prompts as pr
from casequarry.operators import validate as va
from casequarry.operators.model import join_responses
from casequarry.plans import inputs
from casequarry.plans.catalog import query
from casequarry.plans.queries_intake import CFG, big
from casequarry.plans.queries_model import digest
from casequarry.plans.sqlparts import CASES, DOCS, FIELDS, PARSED, RECORDS, RESULTS, lit, with_
from casequarry.sources.config import ReviewConfig, condition_row

MAX_PROMPT = 32000


# Completeness -------------------------------------------------------------------------------------
_CATEGORIES = """categories AS (SELECT * FROM (VALUES
  (0, 'income_proof', 'salary_slip', 1, 6, 'Income proof documents (salary slips)'),
  (1, 'identity', 'identity_document', 1, 2, 'Identity documents'),
  (2, 'application', 'loan_application', 1, 1, 'Loan application form')) AS v(pos, category, doc_type, low, high, description)),
found AS (
  SELECT c.case_id, g.pos, g.category, g.low, g.high, g.description, count(d.doc_id) AS found
  FROM cases c CROSS JOIN categories g LEFT JOIN docs d ON d.case_id = c.case_id AND (d.doc_type = g.doc_type OR d.category = g.category)
  WHERE c.country = 'germany' GROUP BY ALL)"""


@query(with_(CASES, DOCS, _CATEGORIES) + "SELECT case_id, category, found FROM found")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = co.category_counts(inputs.cases(spark, sf_dir), inputs.case_documents(spark, sf_dir), CFG)
    return rows.select("case_id", "category", "found")


@query(with_(CASES, DOCS, _CATEGORIES) + """
SELECT case_id, category, found, 'Category ''' || description || ''': ' || CASE WHEN found < low
  THEN 'requires at least ' || low || ' document(s), found ' || found ELSE 'accepts at most ' || high || ' document(s), found ' || found END AS issue
FROM found WHERE found < low OR found > high""")
def category_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = co.category_issues(inputs.cases(spark, sf_dir), inputs.case_documents(spark, sf_dir), CFG)
    return rows.select("case_id", "category", "found", "issue")


_ANCHORS = """anchors AS (
  SELECT CAST(o_custkey AS VARCHAR) AS case_id, max(o_totalprice) AS loan_amount FROM orders WHERE o_orderkey % 6 = 4 GROUP BY o_custkey)"""
_REQUIREMENTS = """held AS (
  SELECT c.case_id, count(CASE WHEN category = 'income_proof' AND doc_type IN ('salary_slip', 'tax_return') THEN 1 END) AS n0,
         count(CASE WHEN category = 'income_proof' AND doc_type = 'salary_slip' THEN 1 END) AS n0s,
         count(CASE WHEN category = 'income_proof' AND doc_type = 'tax_return' THEN 1 END) AS n0t,
         count(CASE WHEN category = 'identity' AND doc_type = 'identity_document' THEN 1 END) AS n1,
         count(CASE WHEN category = 'application' AND doc_type = 'loan_application' THEN 1 END) AS n2
  FROM cases c LEFT JOIN docs d USING (case_id) GROUP BY c.case_id),
issues AS (
  SELECT case_id, 'Category ''income_proof'': need at least 1 of [''salary_slip'', ''tax_return''], found ' || n0 AS issue FROM held WHERE n0 < 1
  UNION ALL SELECT case_id, 'Category ''income_proof'': max 2 accepted, found ' || n0 FROM held WHERE n0 > 2
  UNION ALL SELECT case_id, 'Category ''income_proof'', type ''salary_slip'': need 2, found ' || n0s FROM held WHERE n0s < 2
  UNION ALL SELECT case_id, 'Category ''income_proof'', type ''tax_return'': need 1, found ' || n0t FROM held WHERE n0t < 1
  UNION ALL SELECT h.case_id, 'Category ''identity'': ' || CASE WHEN n1 < 1 THEN 'need at least 1 of [''identity_document''], found ' || n1 ELSE 'max 2 accepted, found ' || n1 END
    FROM held h LEFT JOIN anchors a USING (case_id) WHERE (n1 < 1 OR n1 > 2) AND coalesce(a.loan_amount > 100000, true)
  UNION ALL SELECT case_id, 'Category ''application'': ' || CASE WHEN n2 < 1 THEN 'need at least 1 of [''loan_application''], found ' || n2 ELSE 'max 1 accepted, found ' || n2 END
    FROM held WHERE n2 < 1 OR n2 > 1)"""


@query(with_(CASES, DOCS, _ANCHORS, _REQUIREMENTS) + "SELECT case_id, issue FROM issues")
def requirement_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = inputs.anchors(spark, sf_dir)
    docs = inputs.case_documents(spark, sf_dir)
    return co.requirement_issues(inputs.cases(spark, sf_dir), docs, inputs.REQUIREMENTS, anchors).select("case_id", "issue")


@query(with_(_ANCHORS) + "SELECT case_id, 'identity' AS category FROM anchors WHERE NOT coalesce(loan_amount > 100000, true)")
def waived_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.requirement_applies(inputs.anchors(spark, sf_dir), inputs.REQUIREMENTS)


_PROCESS_ANCHORS = """process_cases AS (SELECT *, CASE WHEN ck % 3 = 0 THEN 'mortgage' ELSE 'consumer_credit' END AS process_type FROM cases WHERE country = 'germany'),
first_docs AS (
  SELECT case_id, min(CASE WHEN doc_type = 'loan_application' THEN doc_seq END) AS request, min(CASE WHEN doc_type = 'salary_slip' THEN doc_seq END) AS slip
  FROM records WHERE status = 'extracted' AND members <> '' GROUP BY case_id),
amounts AS (SELECT doc_seq, CASE WHEN kind IN ('int', 'float') THEN CAST(text AS DOUBLE) END AS amount FROM fields WHERE field IN ('loan_amount', 'net_salary')),
judged AS (
  SELECT p.case_id, p.process_type, r.amount AS loan, i.amount AS salary FROM process_cases p JOIN first_docs f USING (case_id)
  LEFT JOIN amounts r ON r.doc_seq = f.request LEFT JOIN amounts i ON i.doc_seq = f.slip),
waived AS (
  SELECT case_id, 'identity' AS category FROM judged WHERE NOT coalesce(loan > 100000, true)
  UNION ALL SELECT case_id, 'income_proof' FROM judged
  WHERE process_type = 'mortgage' AND NOT coalesce(CASE WHEN loan <> 0 THEN salary / loan < 0.5 END OR loan IS NULL, true))"""


@query(with_(CASES, DOCS, FIELDS, RECORDS, _PROCESS_ANCHORS) + "SELECT case_id, category FROM waived")
def waived_by_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of two processes that the records of a case make unnecessary."""
    cfg = dataclasses.replace(CFG, requirements=inputs.PROCESS_REQUIREMENTS)
    anchors = co.anchor_records(inputs.process_cases(spark, sf_dir), inputs.case_documents(spark, sf_dir), cfg)
    return co.waived_by_anchors(anchors, cfg)


@query(with_(CASES, DOCS, FIELDS, RECORDS, _PROCESS_ANCHORS, """process_held AS (
  SELECT case_id, process_type, count(CASE WHEN category = 'income_proof' AND doc_type IN ('salary_slip', 'tax_return') THEN 1 END) AS n0,
         count(CASE WHEN category = 'income_proof' AND doc_type = 'salary_slip' THEN 1 END) AS n0s,
         count(CASE WHEN category = 'income_proof' AND doc_type = 'tax_return' THEN 1 END) AS n0t,
         count(CASE WHEN category = 'identity' AND doc_type = 'identity_document' THEN 1 END) AS n1,
         count(CASE WHEN category = 'application' AND doc_type = 'loan_application' THEN 1 END) AS n2
  FROM process_cases c LEFT JOIN docs d USING (case_id) GROUP BY case_id, process_type),
required AS (
  SELECT process_type, category, types, low, high FROM (VALUES
    ('consumer_credit', 'income_proof', '[''salary_slip'', ''tax_return'']', 1, 2), ('consumer_credit', 'identity', '[''identity_document'']', 1, 2),
    ('consumer_credit', 'application', '[''loan_application'']', 1, 1), ('mortgage', 'identity', '[''identity_document'']', 2, 2),
    ('mortgage', 'income_proof', '[''salary_slip'']', 1, 1), ('mortgage', 'application', '[''loan_application'']', 1, 9)) AS v(process_type, category, types, low, high)),
process_found AS (
  SELECT h.*, r.category, types, low, high, CASE r.category WHEN 'identity' THEN n1 WHEN 'application' THEN n2 ELSE CASE h.process_type WHEN 'mortgage' THEN n0s ELSE n0 END END AS n
  FROM process_held h JOIN required r USING (process_type) WHERE (case_id, r.category) NOT IN (SELECT case_id, category FROM waived))""") + """
SELECT case_id, category, 'Category ''' || category || ''': ' || CASE WHEN n < low THEN 'need at least ' || low || ' of ' || types || ', found ' || n
  ELSE 'max ' || high || ' accepted, found ' || n END AS issue FROM process_found WHERE n < low OR n > high
UNION ALL SELECT case_id, category, 'Category ''income_proof'', type ''salary_slip'': need 2, found ' || n0s FROM process_found
  WHERE process_type = 'consumer_credit' AND category = 'income_proof' AND n0s < 2
UNION ALL SELECT case_id, category, 'Category ''income_proof'', type ''tax_return'': need 1, found ' || n0t FROM process_found
  WHERE process_type = 'consumer_credit' AND category = 'income_proof' AND n0t < 1""")
def process_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cases of two processes lack, each by the requirements of its own."""
    cfg = dataclasses.replace(CFG, requirements=inputs.PROCESS_REQUIREMENTS)
    rows = co.process_requirement_issues(inputs.process_cases(spark, sf_dir), inputs.case_documents(spark, sf_dir), cfg)
    return rows.select("case_id", "category", "issue")


_QUALITY = """gaps AS (
  SELECT doc_id, string_agg(CASE WHEN kind = 'null' AND field NOT LIKE '\\_%' ESCAPE '\\' THEN field END, ',' ORDER BY field) AS null_fields,
         count(CASE WHEN kind = 'null' AND field NOT LIKE '\\_%' ESCAPE '\\' THEN 1 END) AS nulls, count(*) AS fields
  FROM fields GROUP BY doc_id)"""


@query(with_(DOCS, FIELDS, _QUALITY) + """
SELECT d.doc_id, d.doc_type, CASE WHEN status = 'extracted' THEN null_fields END AS null_fields,
       CASE WHEN status = 'failed' THEN 'extraction_failed' END AS issue,
       CASE WHEN status = 'failed' THEN 0.0 ELSE round(1 - CAST(nulls AS DOUBLE) / greatest(fields, 1), 2) END AS extraction_completeness
FROM docs d LEFT JOIN gaps USING (doc_id) WHERE status = 'failed' OR (status = 'extracted' AND nulls > 0)""")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc, _ = co.extraction_quality(inputs.case_documents(spark, sf_dir))
    return per_doc.select("doc_id", "doc_type", F.array_join("null_fields", ",").alias("null_fields"), "issue", "extraction_completeness")


@query(with_(DOCS) + """
SELECT case_id, count(*) AS total_documents, count(CASE WHEN status = 'extracted' THEN 1 END) AS extracted,
       count(CASE WHEN status = 'failed' THEN 1 END) AS failed,
       round(CAST(count(CASE WHEN status = 'extracted' THEN 1 END) AS DOUBLE) / greatest(count(*), 1), 2) AS overall_quality
FROM docs GROUP BY case_id""")
def case_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.extraction_quality(inputs.case_documents(spark, sf_dir))[1]


# Validation ---------------------------------------------------------------------------------------
_SPECS = "specs AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(f['doc_type'])}, {f['pos']}, {lit(f['name'])}, {lit(f['type'])}, {'true' if f['required'] else 'false'})" for f in CFG.fields
) + ") AS v(doc_type, pos, name, type, required))"
_VALIDATED = """checked AS (
  SELECT d.doc_id, s.pos, CASE
    WHEN f.field IS NULL OR f.kind = 'null' THEN CASE WHEN s.required THEN 'Missing required field: ' || s.name END
    WHEN s.type = 'float' AND f.kind NOT IN ('float', 'int', 'bool') THEN s.name || ': expected number, got str'
    WHEN s.type = 'boolean' AND f.kind <> 'bool' THEN s.name || ': expected boolean, got str'
    WHEN s.type = 'string' AND f.kind <> 'string' THEN s.name || ': expected string, got float'
    WHEN s.name IN ('last_name', 'taxpayer_name') AND NOT regexp_matches(f.text, '^Kunde [1-4]') THEN s.name || ': ''' || f.text || ''' doesn''t match pattern Kunde [1-4]'
    END AS error
  FROM docs d JOIN specs s USING (doc_type) LEFT JOIN fields f ON f.doc_id = d.doc_id AND f.field = s.name)"""


def patterned() -> ReviewConfig:
    cfg = dataclasses.replace(CFG)
    cfg.fields = [dict(f, pattern="Kunde [1-4]" if f["name"] in ("last_name", "taxpayer_name") else None) for f in CFG.fields]
    return cfg


@query(with_(DOCS, FIELDS, _SPECS, _VALIDATED) + """
SELECT d.doc_id, coalesce(string_agg(c.error, ';' ORDER BY c.pos), '') AS errors FROM docs d LEFT JOIN checked c USING (doc_id) GROUP BY d.doc_id""")
def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va.validate_fields(inputs.home_documents(spark, sf_dir), patterned())
    return rows.select("doc_id", F.array_join("errors", ";").alias("errors"))


_RULES = """hits AS (
  SELECT d.doc_id, d.doc_type, d.day,
    (d.doc_type = 'bank_statement' AND k % 31 <> 0 AND amount < -10000)
    OR (d.doc_type = 'loan_application' AND k % 13 <> 0 AND k % 5 >= 3) AS warned,
    d.doc_type = 'identity_document' AND coalesce(d.day < DATE '1998-06-30', false) AS expired FROM parsed d)"""


@query(with_(DOCS, PARSED, _RULES) + """
SELECT doc_id, CASE WHEN warned THEN 'flag_for_review (severity: warning)' ELSE '' END AS triggered FROM hits""")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va.triggered_rules(inputs.home_documents(spark, sf_dir), CFG)
    return rows.select("doc_id", F.array_join("triggered", ";").alias("triggered"))


@query(with_(DOCS, PARSED, _RULES) + """
SELECT doc_id, CASE WHEN warned THEN 'flag_for_review (severity: warning)' WHEN expired THEN 'flag_for_review (severity: error)' ELSE '' END AS triggered FROM hits""")
def rule_hits_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va.triggered_rules(inputs.home_documents(spark, sf_dir), CFG, inputs.AS_OF)
    return rows.select("doc_id", F.array_join("triggered", ";").alias("triggered"))


# Conditions ---------------------------------------------------------------------------------------
def value_conditions() -> ReviewConfig:
    """Conditions for the value operators, for a condition on all documents, and for one that cannot be run."""

    def row(name: str, types: list[str], field: str, operator: str, value, message: str, on_fail: str = "needs_review") -> dict:
        return condition_row(
            country=fv.COUNTRY, process_type=fv.PROCESS, condition_seq=len(rows), condition_name=name, description=name,
            applies_to=types, check_type=cond.DETERMINISTIC, field=field, operator=operator, value=value, sources=None,
            llm_logic=None, on_fail=on_fail, severity="error", analyst_message=message,
        )

    rows: list[dict] = []
    for args in [
        ("salary_above", ["salary_slip"], "net_salary", "greater_than", 100000, "salary {net_salary} too low", "fail"),
        ("income_below", ["tax_return", "loan_application"], "total_income", "less_than", "2e5", "income {total_income} in {doc_id}"),
        ("signed", ["loan_application"], "signature_present", "equals", True, "signature is {signature_present}", "fail"),
        ("not_this_name", ["identity_document", "bank_statement"], "last_name", "not_equals", "Kunde 7", ""),
        ("not_a_number", ["identity_document"], "last_name", "greater_than", 5, "{last_name} {nothing}"),
        ("recent", [], "document_date", "within_months", 12, "old: {document_date}"),
        ("odd_operator", ["tax_return"], "taxpayer_name", "like", "Kunde", ""),
        ("broken_months", ["loan_application"], "applicant_name", "within_months", "soon", "x {applicant_name}"),
    ]:
        rows.append(row(*args))
    return dataclasses.replace(CFG, conditions=rows)


VALUES = value_conditions()
_REASON = "'Condition check error: invalid literal for int() with base 10: ''soon'''"
_VALUE_RESULTS = f"""looked AS (
  SELECT p.*, n.text AS name_text, s.text AS signature_text, s.kind AS signature_kind, k % 31 = 0 AS amount_is_text,
         CASE WHEN amount = 0 AND k % 31 <> 0 THEN NULL ELSE CAST(amount AS VARCHAR) END AS amount_text,
         CAST(strptime(document_date, '%Y-%m-%d') AS DATE) AS own_day
  FROM parsed p
  LEFT JOIN fields n ON n.doc_id = p.doc_id AND n.field IN ('employee_name', 'account_holder', 'taxpayer_name', 'last_name', 'applicant_name')
  LEFT JOIN fields s ON s.doc_id = p.doc_id AND s.field = 'signature_present'),
checks AS (
  SELECT case_id, doc_id, 'salary_above' AS name, amount_text AS value, amount > 100000 AS passed, 'fail' AS on_fail,
         'salary ' || coalesce(amount_text, 'MISSING') || ' too low' AS message, amount_text || ' > 100000' AS reason FROM looked WHERE doc_type = 'salary_slip'
  UNION ALL
  SELECT case_id, doc_id, 'income_below', CASE WHEN doc_type = 'tax_return' THEN amount_text END, amount < 200000, 'needs_review',
         'income ' || CASE WHEN doc_type = 'tax_return' AND amount_text IS NOT NULL THEN '{{total_income}}' ELSE 'MISSING' END || ' in ' ||
         CASE WHEN doc_type = 'tax_return' AND amount_text IS NOT NULL THEN '{{doc_id}}' ELSE doc_id END, amount_text || ' < 2e5' FROM looked WHERE doc_type IN ('tax_return', 'loan_application')
  UNION ALL
  SELECT case_id, doc_id, 'signed', CASE WHEN signature_text = 'True' THEN 'True' END, true, 'fail', 'signature is MISSING', 'True == True'
  FROM looked WHERE doc_type = 'loan_application'
  UNION ALL
  SELECT case_id, doc_id, 'not_this_name', CASE WHEN doc_type = 'identity_document' THEN name_text END, name_text <> 'Kunde 7', 'needs_review',
         '', name_text || ' != Kunde 7'
  FROM looked WHERE doc_type IN ('identity_document', 'bank_statement')
  UNION ALL
  SELECT case_id, doc_id, 'not_a_number', name_text, false, 'needs_review',
         CASE WHEN name_text IS NULL THEN 'Field ''last_name'' not found in ' || doc_id ELSE '{{last_name}} {{nothing}}' END, 'Cannot compare ' || name_text || ' > 5'
  FROM looked WHERE doc_type = 'identity_document'
  UNION ALL
  SELECT case_id, doc_id, 'recent', coalesce(CASE WHEN doc_type = 'tax_return' THEN date_text END, document_date),
         CASE WHEN doc_type = 'tax_return' AND date_text IS NOT NULL THEN day ELSE own_day END >= DATE '1997-06-30', 'needs_review',
         'old: ' || coalesce(CASE WHEN doc_type = 'tax_return' THEN date_text END, document_date),
         CASE WHEN doc_type = 'tax_return' AND date_text = '31.02.2001' THEN 'Cannot parse date: Cannot parse date: ''31.02.2001'''
              ELSE 'Date ' || CASE WHEN doc_type = 'tax_return' AND date_text IS NOT NULL THEN day ELSE own_day END || ' is ' ||
                   date_diff('day', CASE WHEN doc_type = 'tax_return' AND date_text IS NOT NULL THEN day ELSE own_day END, DATE '1998-06-30') || ' days old (cutoff: 1997-06-30)' END
  FROM looked
  UNION ALL
  SELECT case_id, doc_id, 'odd_operator', name_text, false, 'needs_review', '', 'Unknown operator: like' FROM looked WHERE doc_type = 'tax_return'),
value_results AS (
  SELECT case_id, doc_id, name AS condition_name, value, CASE WHEN value IS NULL THEN 'needs_review' WHEN coalesce(passed, false) THEN 'pass' ELSE on_fail END AS status,
         CASE WHEN value IS NOT NULL AND coalesce(passed, false) THEN 'info' ELSE 'error' END AS severity,
         CASE WHEN value IS NOT NULL AND coalesce(passed, false) THEN 'Check passed' ELSE message END AS analyst_message,
         CASE WHEN value IS NULL THEN 'field_missing' ELSE reason END AS reason FROM checks
  UNION ALL
  SELECT case_id, NULL, 'broken_months', NULL, 'needs_review', 'error', {_REASON}, NULL
  FROM looked WHERE doc_type = 'loan_application' GROUP BY case_id HAVING count(name_text) > 0
  UNION ALL
  SELECT l.case_id, l.doc_id, 'broken_months', NULL, 'needs_review', 'error', 'x MISSING', 'field_missing'
  FROM looked l WHERE doc_type = 'loan_application' AND case_id NOT IN (SELECT case_id FROM looked WHERE doc_type = 'loan_application' AND name_text IS NOT NULL))"""


@query(with_(DOCS, PARSED, FIELDS, _VALUE_RESULTS) + "SELECT case_id, doc_id, condition_name, status, severity, analyst_message, value, reason FROM value_results")
def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cond.deterministic_results(inputs.home_documents(spark, sf_dir), VALUES, inputs.AS_OF)
    details = F.col("details")
    return rows.select(
        "case_id", "doc_id", "condition_name", "status", "severity", "analyst_message",
        F.try_element_at(details, F.lit("value")).alias("value"), F.try_element_at(details, F.lit("reason")).alias("reason"),
    )


@query(with_(DOCS) + """
SELECT doc_id, condition_name FROM docs JOIN (VALUES ('salary_slip', 'salary_above'), ('tax_return', 'income_below'), ('loan_application', 'income_below'),
  ('loan_application', 'signed'), ('identity_document', 'not_this_name'), ('bank_statement', 'not_this_name'), ('identity_document', 'not_a_number'),
  ('tax_return', 'odd_operator'), ('loan_application', 'broken_months')) AS v(doc_type, condition_name) USING (doc_type)
UNION ALL SELECT doc_id, 'recent' FROM docs""")
def condition_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cond.condition_targets(inputs.home_documents(spark, sf_dir), VALUES).select("doc_id", "condition_name")


@query(with_(DOCS, PARSED, FIELDS, _VALUE_RESULTS) + """
SELECT doc_id, name AS condition_name, value FROM checks
UNION ALL SELECT doc_id, 'broken_months', name_text FROM looked WHERE doc_type = 'loan_application'""")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that each condition reads, for all conditions and documents."""
    targets = cond.condition_targets(inputs.home_documents(spark, sf_dir), VALUES)
    return targets.select("doc_id", "condition_name", cond.looked_up(targets, VALUES)["text"].alias("value"))


@query(with_(DOCS, PARSED, RESULTS) + """
SELECT case_id, doc_id, condition_name, status, severity, analyst_message, CASE WHEN date_text IS NULL THEN 'field_missing'
  WHEN day IS NULL THEN 'Cannot parse date: Cannot parse date: ''31.02.2001''' WHEN condition_name = 'identity_document_validity'
  THEN 'Expiry ' || day || CASE WHEN day >= DATE '1998-06-30' THEN ' is valid' ELSE ' has passed' END
  ELSE 'Date ' || day || ' is ' || date_diff('day', day, DATE '1998-06-30') || ' days old (cutoff: 1998-03-30)' END AS reason FROM results""")
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cond.deterministic_results(inputs.home_documents(spark, sf_dir), CFG, inputs.AS_OF)
    reason = F.try_element_at(F.col("details"), F.lit("reason")).alias("reason")
    return rows.select("case_id", "doc_id", "condition_name", "status", "severity", "analyst_message", reason)


@query(with_(DOCS, PARSED) + "SELECT doc_id, date_text, day FROM parsed")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = inputs._order_columns(inputs.table(spark, sf_dir, "orders"))
    return rows.select(k.cast("string").alias("doc_id"), F.col("_date").alias("date_text"), parse_date(F.col("_date")).alias("day"))


@query("""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_orderkey % 40 AS INTEGER)) AS DATE) AS day FROM orders""")
def months_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "orders")
    months = (F.col("o_orderkey") % 40).cast("int")
    return rows.select("o_orderkey", months_before(F.col("o_orderdate").cast("date"), months).alias("day"))


_GATHERED = """sources AS (SELECT * FROM (VALUES
  ('income_consistency', 0, 'salary_slip'), ('income_consistency', 1, 'loan_application'),
  ('applicant_name_consistency', 0, 'loan_application'), ('applicant_name_consistency', 1, 'identity_document')) AS v(condition_name, pos, doc_type)),
per_type AS (
  SELECT case_id, condition_name, pos, doc_type, count(*) AS n, '### ' || doc_type || chr(10) ||
    string_agg('{"doc_id": "' || doc_id || '"' || CASE WHEN members = '' THEN '' ELSE ', ' || members END || '}', chr(10) ORDER BY doc_seq) AS block
  FROM records JOIN sources USING (doc_type) GROUP BY case_id, condition_name, pos, doc_type),
gathered AS (
  SELECT case_id, condition_name, CAST(sum(n) AS BIGINT) AS source_docs, string_agg(doc_type, ',' ORDER BY pos) AS sources_used,
         string_agg(block, chr(10) ORDER BY pos) AS blocks FROM per_type GROUP BY case_id, condition_name)"""


@query(with_(DOCS, FIELDS, RECORDS, _GATHERED) + f"""
SELECT case_id, condition_name, source_docs, sources_used, CAST(length(blocks) AS BIGINT) AS source_chars,
  CASE WHEN length(blocks) <= {MAX_PROMPT} THEN sha256(blocks) END AS blocks_hash FROM gathered""")
def gathered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cond.gather_sources(inputs.home_documents(spark, sf_dir), CFG, MAX_PROMPT)
    rows = rows.withColumn("blocks", F.array_join("source_blocks", "\n"))
    return rows.select(
        "case_id", "condition_name", big("source_docs").alias("source_docs"), F.array_join("sources_used", ",").alias("sources_used"),
        big("source_chars").alias("source_chars"), digest("blocks").alias("blocks_hash"),
    )


_MODEL_CONDITIONS = [c for c in CFG.conditions if c["check_type"] == cond.WITH_MODEL]
_CONDITION_HEADS = "model_conditions AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lit(c['condition_name'])}, {lit(c['severity'])}, {lit(c['analyst_message'])}, "
    + lit(
        f"Check that documents agree with each other.\nName: {c['condition_name']}\nDescription: {c['description']}\n"
        f"Sources: {', '.join(c['sources'])}\nLogic: {c['llm_logic']}\n\nData:\n"
    )
    + ")"
    for i, c in enumerate(_MODEL_CONDITIONS)
) + ") AS v(i, condition_name, severity, own_message, head))"


@query(with_(CASES, DOCS, FIELDS, RECORDS, _GATHERED, _CONDITION_HEADS) + f"""
SELECT case_id, condition_name, CAST(length(prompt) AS BIGINT) AS prompt_chars, CASE WHEN length(prompt) <= {MAX_PROMPT} THEN sha256(prompt) END AS prompt_hash
FROM (SELECT c.case_id, m.condition_name, head || blocks || {lit(pr.CONDITION_TAIL)} AS prompt FROM cases c CROSS JOIN model_conditions m
      LEFT JOIN gathered g ON g.case_id = c.case_id AND g.condition_name = m.condition_name)""")
def condition_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cond.model_condition_prompts(inputs.home_cases(spark, sf_dir), inputs.home_documents(spark, sf_dir), CFG)
    return rows.select("case_id", "condition_name", big("prompt_chars").alias("prompt_chars"), digest("prompt").alias("prompt_hash"))


MODEL_RESULTS = f"""replied AS (
  SELECT c.case_id, c.ck, m.*, (c.ck + m.i) % 7 AS form, g.sources_used, g.blocks, length(head || blocks || {lit(pr.CONDITION_TAIL)}) AS chars
  FROM cases c CROSS JOIN model_conditions m LEFT JOIN gathered g ON g.case_id = c.case_id AND g.condition_name = m.condition_name),
model_results AS (
  SELECT case_id, 3 + i AS condition_seq, condition_name, sources_used,
    CASE WHEN blocks IS NULL OR chars > {MAX_PROMPT} THEN 'needs_review' WHEN form = 0 THEN 'pass' WHEN form = 1 THEN 'fail' ELSE 'needs_review' END AS status,
    CASE WHEN blocks IS NOT NULL AND chars <= {MAX_PROMPT} AND form = 0 THEN 'info' ELSE severity END AS severity,
    CASE WHEN blocks IS NULL THEN {lit(fv.MSG_NO_SOURCES)}
      WHEN chars > {MAX_PROMPT} THEN 'Prompt blocked by guardrails: Prompt exceeds max length (' || chars || ' > {MAX_PROMPT})'
      WHEN form = 0 THEN 'fine' WHEN form = 1 THEN 'differs' WHEN form = 2 THEN own_message WHEN form = 3 THEN 'unsure'
      WHEN form = 4 THEN 'Could not parse LLM response: invalid JSON' WHEN form = 5 THEN 'LLM error: timeout'
      ELSE 'LLM error: no reply recorded' END AS analyst_message,
    CASE WHEN blocks IS NULL THEN 'reason=missing_sources' WHEN chars > {MAX_PROMPT} THEN 'blocked=True'
      WHEN form = 0 THEN 'comparison_summary=same' WHEN form = 4 THEN 'raw={{"status": ' WHEN form = 5 THEN 'error=timeout'
      WHEN form = 6 THEN 'error=no reply recorded' ELSE '' END AS details
  FROM replied)"""


def ask_conditions(spark: SparkSession, sf_dir: str):
    replies = inputs.condition_replies(inputs.home_cases(spark, sf_dir), [c["condition_name"] for c in _MODEL_CONDITIONS])
    return partial(join_responses, responses=replies, keys=["case_id", "condition_name"])


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cond.check_all(
        inputs.home_cases(spark, sf_dir), inputs.home_documents(spark, sf_dir), CFG, ask_conditions(spark, sf_dir), inputs.AS_OF
    )


@query(with_(CASES, DOCS, FIELDS, RECORDS, _GATHERED, _CONDITION_HEADS, MODEL_RESULTS) + """
SELECT case_id, condition_name, status, severity, analyst_message, coalesce(sources_used, '') AS sources_used, details FROM model_results""")
def model_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cond.check_with_model(
        inputs.home_cases(spark, sf_dir), inputs.home_documents(spark, sf_dir), CFG, ask_conditions(spark, sf_dir)
    )
    details = F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select(
        "case_id", "condition_name", "status", "severity", "analyst_message", F.array_join("sources_used", ",").alias("sources_used"), details.alias("details")
    )


CHECKED = [CASES, DOCS, PARSED, FIELDS, RECORDS, RESULTS, _GATHERED, _CONDITION_HEADS, MODEL_RESULTS, """all_results AS (
  SELECT case_id, condition_seq, doc_seq, doc_id, condition_name, status, severity, analyst_message FROM results
  UNION ALL SELECT case_id, condition_seq, NULL, NULL, condition_name, status, severity, analyst_message FROM model_results)"""]


@query(with_(*CHECKED) + "SELECT case_id, doc_id, condition_name, status, severity, analyst_message FROM all_results")
def all_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_results(spark, sf_dir).select("case_id", "doc_id", "condition_name", "status", "severity", "analyst_message")


# Across documents ---------------------------------------------------------------------------------
_PRICES = """prices AS (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price FROM lineitem),
means AS (SELECT l_partkey, avg(price) AS mean, count(price) AS n FROM prices GROUP BY l_partkey),
near AS (SELECT p.*, mean, n, abs(price - mean) / greatest(mean, 1.0) AS dev FROM prices p JOIN means USING (l_partkey))"""


def _prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = inputs.table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    return cd.numeric_consistency(rows, ["l_partkey"], "price", tolerance_percent=50.0)


@query(with_(_PRICES) + """
SELECT l_partkey, n AS value_count, count(CASE WHEN n >= 2 AND dev > 0.5 THEN 1 END) = 0 AS is_consistent, CASE WHEN n >= 2 THEN round(mean, 2) END AS average,
  count(CASE WHEN n >= 2 AND dev > 0.5 THEN 1 END) AS outlier_count FROM near GROUP BY l_partkey, n, mean""")
def numeric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir)[0].drop("reason")


@query(with_(_PRICES) + """
SELECT l_partkey, l_orderkey, l_linenumber, round(dev * 100, 1) AS deviation_percent FROM near WHERE n >= 2 AND dev > 0.5""")
def numeric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir)[1].drop("price")


def _ask_by_rule(good: str):
    """Answers prompts by the number of their case."""

    def ask(prompts: DataFrame) -> DataFrame:
        n = F.col("case_id").cast("bigint") % 5
        reply = F.when(n < 2, good).when(n == 2, '{"cut": ')
        error = F.when(n == 3, "timeout").when(n == 4, "no reply recorded")
        return prompts.withColumns({"raw_response": reply, "error": error})

    return ask


_FAILED_SQL = "CASE n WHEN 2 THEN 'invalid JSON' WHEN 3 THEN 'timeout' WHEN 4 THEN 'no reply recorded' END"


def name_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on the documents of a case, all under one field name."""
    docs = inputs.home_documents(spark, sf_dir)
    fields = docs.select("case_id", "doc_seq", F.concat_ws(".", "doc_type", "doc_id").alias("source"), F.explode("extracted_data").alias("name", "v"))
    named = fields.where(F.col("name").isin([f for f in inputs.NAME_FIELDS]))
    return named.select("case_id", F.lit("name").alias("field"), "doc_seq", "source", F.col("v.text").alias("value"))


_NAMES = """names AS (SELECT case_id, string_agg('- ' || doc_type || '.' || doc_id || ': ' || text, chr(10) ORDER BY doc_seq) AS lines
  FROM fields WHERE field IN ('employee_name', 'account_holder', 'taxpayer_name', 'last_name', 'applicant_name') GROUP BY case_id)"""


@query(with_(DOCS, FIELDS, _NAMES) + f"""
SELECT case_id, sha256('Do these values of the field name mean the same?' || chr(10) || lines || {lit(pr.SEMANTIC_TAIL)}) AS prompt_hash FROM names""")
def semantic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.semantic_prompts(name_values(spark, sf_dir), cd.MODEL_INPUT_CHARS)
    return rows.select("case_id", digest("prompt").alias("prompt_hash"))


@query(with_(DOCS, FIELDS, _NAMES) + f"""
SELECT case_id, 'name' AS field, CASE WHEN n < 2 THEN true END AS is_consistent, CASE WHEN n < 2 THEN 'Kunde' END AS canonical_value,
  CAST(CASE WHEN n < 2 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence, {_FAILED_SQL} AS error FROM (SELECT case_id, CAST(case_id AS BIGINT) % 5 AS n FROM names)""")
def semantic_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = _ask_by_rule('{"is_consistent": true, "canonical_value": "Kunde", "confidence": 0.9}')
    return cd.semantic_consistency(name_values(spark, sf_dir), ask)


_LINES = """case_lines AS (
  SELECT case_id, string_agg(doc_type || '.' || doc_id || ': ' || record, chr(10) ORDER BY doc_seq) AS lines
  FROM records WHERE status = 'extracted' AND members <> '' GROUP BY case_id)"""


@query(with_(DOCS, FIELDS, RECORDS, _LINES) + f"""
SELECT case_id, sha256('Find contradictions between the documents of a credit case.' || chr(10) || chr(10) || 'Documents:' || chr(10) || lines ||
  chr(10) || chr(10) || 'Focus on: income, employment' || {lit(pr.CONTRADICTION_TAIL)}) AS prompt_hash FROM case_lines""")
def contradiction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.contradiction_prompts(inputs.home_documents(spark, sf_dir), cd.MODEL_INPUT_CHARS, ["income", "employment"])
    return rows.select("case_id", digest("prompt").alias("prompt_hash"))


_FOUND = (
    '{"contradictions_found": true, "contradictions": [{"type": "income_mismatch", "severity": "high", "description": "differs", '
    '"documents_involved": ["a", "b"], "fields_involved": ["net_salary"], "fraud_signal": false}, {"type": "other", "severity": "low"}], '
    '"overall_risk_assessment": "medium", "recommendation": "escalate"}'
)


@query(with_(DOCS, FIELDS, RECORDS, _LINES) + f"""
SELECT case_id, CASE WHEN n < 2 THEN true END AS contradictions_found, CASE WHEN n < 2 THEN 'medium' END AS overall_risk_assessment,
  CASE WHEN n < 2 THEN 'escalate' ELSE 'flag_for_review' END AS recommendation, {_FAILED_SQL} AS error
FROM (SELECT case_id, CAST(case_id AS BIGINT) % 5 AS n FROM case_lines)""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.contradictions(inputs.home_documents(spark, sf_dir), _ask_by_rule(_FOUND))[0]


@query(with_(DOCS, FIELDS, RECORDS, _LINES) + """
SELECT case_id, CAST(pos AS BIGINT) AS pos, type, severity, docs FROM case_lines,
  (VALUES (0, 'income_mismatch', 'high', 'a,b'), (1, 'other', 'low', NULL)) AS v(pos, type, severity, docs) WHERE CAST(case_id AS BIGINT) % 5 < 2""")
def contradiction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cd.contradictions(inputs.home_documents(spark, sf_dir), _ask_by_rule(_FOUND))[1]
    return rows.select("case_id", big("pos").alias("pos"), "type", "severity", F.array_join("documents_involved", ",").alias("docs"))


_PAIRS = """anchor AS (SELECT case_id, arg_min(doc_id, doc_seq) AS doc_a, arg_min(record, doc_seq) AS record_a FROM records WHERE doc_type = 'identity_document' GROUP BY case_id),
pairs AS (SELECT r.case_id, doc_a, r.doc_id AS doc_b, record_a, r.record AS record_b FROM records r JOIN anchor USING (case_id) WHERE r.doc_type = 'loan_application')"""


@query(with_(DOCS, FIELDS, RECORDS, _PAIRS) + f"""
SELECT case_id, doc_a, doc_b, sha256('Are these two person records the same entity?' || chr(10) || chr(10) || 'A: ' || record_a || chr(10) || 'B: ' || record_b || {lit(pr.ENTITY_TAIL)}) AS prompt_hash FROM pairs""")
def entity_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cd.anchored_pairs(inputs.home_documents(spark, sf_dir), "identity_document", "loan_application")
    return pr.entity_prompts(pairs).select("case_id", "doc_a", "doc_b", digest("prompt").alias("prompt_hash"))


@query(with_(DOCS, FIELDS, RECORDS, _PAIRS) + f"""
SELECT doc_a, doc_b, CASE WHEN n < 2 THEN false END AS is_same_entity, CAST(CASE WHEN n < 2 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN n < 2 THEN 'last_name,x' END AS matching,
  CASE WHEN n < 2 THEN 'other person' ELSE 'Resolution failed: ' || {_FAILED_SQL} END AS reasoning FROM (SELECT *, CAST(case_id AS BIGINT) % 5 AS n FROM pairs)""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cd.anchored_pairs(inputs.home_documents(spark, sf_dir), "identity_document", "loan_application")
    ask = _ask_by_rule('{"is_same_entity": false, "confidence": 0.25, "matching_fields": ["last_name", "x"], "reasoning": "other person"}')
    rows = cd.resolve_entities(pairs, ask)
    return rows.select("doc_a", "doc_b", "is_same_entity", "confidence", F.array_join("matching_fields", ",").alias("matching"), "reasoning")


# A third of the documents has the same person's name with a letter more, and some have none.
_ENTITY_SQL = """named AS (
  SELECT case_id, doc_id, doc_seq, 'Person ' || chr(CAST(97 + doc_seq // 3 % 5 * 3 AS INTEGER)) || CASE WHEN doc_seq % 3 = 0 THEN 'x' ELSE '' END AS name
  FROM docs WHERE doc_seq % 11 <> 0),
named_places AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY array_to_string(list_sort(string_split(lower(name), ' ')), ' '), doc_seq) AS place FROM named),
same AS (
  SELECT a.case_id, a.doc_seq AS a, b.doc_seq AS b FROM named_places a JOIN named_places b ON a.case_id = b.case_id AND b.place - a.place BETWEEN 1 AND 3
  WHERE levenshtein(a.name, b.name) <= 1 AND (a.doc_seq + b.doc_seq) % 7 <> 0),
reach AS (
  SELECT case_id, doc_seq AS node, doc_seq AS root FROM docs
  UNION
  SELECT r.case_id, CASE WHEN s.a = r.node THEN s.b ELSE s.a END, r.root FROM reach r JOIN same s ON s.case_id = r.case_id AND r.node IN (s.a, s.b))"""


@query("WITH RECURSIVE " + with_(DOCS, _ENTITY_SQL).strip().removeprefix("WITH") + " SELECT d.case_id, d.doc_id, min(root) AS entity FROM docs d JOIN reach r ON r.case_id = d.case_id AND r.node = d.doc_seq GROUP BY ALL")
def case_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a case: neighbours by name are compared, and what is accepted is closed over."""
    k = F.col("doc_seq")
    letter = F.chr((97 + F.floor(k / 3) % 5 * 3).cast("int"))
    name = F.when(k % 11 != 0, F.concat(F.lit("Person "), letter, F.when(k % 3 == 0, "x").otherwise("")))
    docs = inputs.home_documents(spark, sf_dir).withColumn("name", name)

    def ask(prompts: DataFrame) -> DataFrame:
        sure = F.when((F.col("seq_a") + F.col("seq_b")) % 7 != 0, "0.9").otherwise("0.2")
        verdict = F.when(F.levenshtein("name_a", "name_b") <= 1, "true").otherwise("false")
        reply = F.concat(F.lit('{"is_same_entity": '), verdict, F.lit(', "confidence": '), sure, F.lit("}"))
        return prompts.withColumns({"raw_response": reply, "error": F.lit(None).cast("string")})

    return cd.case_entities(docs, cd.resolve_entities(cd.neighbouring_pairs(docs, "name"), ask))


_RULE_TABLE = [
    dict(name="income_match", description="incomes agree", fields=["net_salary", "total_income"], severity="warning"),
    dict(name="same_person", description="names agree", fields=["last_name", "applicant_name"], severity="error"),
]


@query(with_(CASES, DOCS, FIELDS, RECORDS, _LINES) + f"""
SELECT case_id, sha256('Validate the documents of a ' || country || ' case.' || chr(10) || chr(10) || 'Documents:' || chr(10) || lines || chr(10) || chr(10) ||
  'Rules:' || chr(10) || '- income_match: incomes agree [fields: net_salary, total_income; severity: warning]' || chr(10) ||
  '- same_person: names agree [fields: last_name, applicant_name; severity: error]' || {lit(pr.VALIDATE_TAIL)}) AS prompt_hash
FROM case_lines JOIN cases USING (case_id)""")
def cross_validation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.case_documents(spark, sf_dir)
    rows = pr.cross_validation_prompts(inputs.cases(spark, sf_dir), docs, _RULE_TABLE, cd.MODEL_INPUT_CHARS)
    return rows.select("case_id", digest("prompt").alias("prompt_hash"))


@query(with_(CASES) + """
SELECT case_id, CAST(pos AS BIGINT) AS pos, rule_name, passed, severity FROM cases,
  (VALUES (0, 'income_match', true, 'warning'), (1, 'same_person', false, 'error')) AS v(pos, rule_name, passed, severity) WHERE ck % 5 < 2""")
def cross_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = (
        '{"validations": [{"rule_name": "income_match", "passed": true, "details": "ok", "severity": "warning"}, '
        '{"rule_name": "same_person", "passed": false, "details": "differs", "severity": "error"}]}'
    )
    made = _ask_by_rule(reply)(inputs.cases(spark, sf_dir))
    rows = cd.parse_cross_validation(made)
    return rows.select("case_id", big("pos").alias("pos"), "rule_name", "passed", "severity")


# Cases of more characters than this are asked about in several prompts; most cases here are.
PAIRED_CHARS = 600
_STEP = PAIRED_CHARS // 4
_PAIRED = f"""case_texts AS (
  SELECT case_id, doc_seq, line, length(line) + 1 AS len, CAST(sum(length(line) + 1) OVER (PARTITION BY case_id ORDER BY doc_seq) AS BIGINT) AS stop,
    sum(length(line) + 1) OVER (PARTITION BY case_id) - 1 AS chars
  FROM (SELECT case_id, doc_seq, doc_type || '.' || doc_id || ': ' || record AS line FROM records WHERE status = 'extracted' AND members <> '')),
blocks AS (
  SELECT case_id, CASE WHEN chars <= {PAIRED_CHARS} THEN 0 ELSE 2 * ((stop - len) // {_STEP}) + CAST(len > {_STEP} AS INT) END AS block,
    string_agg(line, chr(10) ORDER BY doc_seq) AS text FROM case_texts GROUP BY case_id, block),
placed AS (SELECT case_id, text, row_number() OVER (PARTITION BY case_id ORDER BY block) - 1 AS k, count(*) OVER (PARTITION BY case_id) AS n FROM blocks),
pairs AS (
  SELECT a.case_id, b.k * (b.k - 1) // 2 + a.k AS part, a.text || chr(10) || b.text AS text FROM placed a JOIN placed b ON a.case_id = b.case_id AND a.k < b.k
  UNION ALL SELECT case_id, 0, text FROM placed WHERE n = 1)"""


@query(with_(DOCS, FIELDS, RECORDS, _PAIRED) + f"""
SELECT case_id, part, sha256('Find contradictions between the documents of a credit case.' || chr(10) || chr(10) || 'Documents:' || chr(10) || text ||
  {lit(pr.CONTRADICTION_TAIL)}) AS prompt_hash FROM pairs""")
def paired_contradiction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that take several prompts: any two of their documents are together in one."""
    rows = pr.contradiction_prompts(inputs.home_documents(spark, sf_dir), PAIRED_CHARS)
    return rows.select("case_id", "part", digest("prompt").alias("prompt_hash"))


@query(with_(DOCS, FIELDS, RECORDS, _PAIRED) + """
SELECT case_id, 0 AS part, 'same' AS type, 'b,a' AS docs FROM pairs GROUP BY case_id UNION ALL SELECT case_id, part, 'own', 'd' || part FROM pairs""")
def paired_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions out of several prompts: one that all of a case's prompts report is listed once."""

    def ask(prompts: DataFrame) -> DataFrame:
        own = F.concat(F.lit('{"type": "own", "documents_involved": ["d'), F.col("part").cast("string"), F.lit('"]}'))
        same = F.when(F.col("part") % 2 == 0, '{"type": "same", "documents_involved": ["b", "a"], "fields_involved": ["f", "g"]}').otherwise(
            '{"type": "other", "documents_involved": ["a", "b"], "fields_involved": ["g", "f"]}'
        )
        reply = F.concat(F.lit('{"contradictions_found": true, "contradictions": ['), same, F.lit(", "), own, F.lit("]}"))
        return prompts.withColumns({"raw_response": reply, "error": F.lit(None).cast("string")})

    rows = cd.contradictions(inputs.home_documents(spark, sf_dir), ask, max_chars=PAIRED_CHARS)[1]
    return rows.select("case_id", "part", "type", F.array_join("documents_involved", ",").alias("docs"))


@query(with_(CASES, DOCS, FIELDS, RECORDS, _PAIRED, f"""asked AS (
  SELECT case_id, part, length('Validate the documents of a ' || country || ' case.' || chr(10) || chr(10) || 'Documents:' || chr(10) || text || chr(10) || chr(10) ||
    'Rules:' || chr(10) || '- income_match: incomes agree [fields: net_salary, total_income; severity: warning]' || chr(10) ||
    '- same_person: names agree [fields: last_name, applicant_name; severity: error]' || {lit(pr.VALIDATE_TAIL)}) AS n
  FROM pairs JOIN cases USING (case_id))""") + """
SELECT case_id, 'income_match' AS rule_name, bool_and(n % 3 = 0) AS passed, arg_min('n' || n, CASE WHEN n % 3 = 0 THEN 1000000 ELSE 0 END + part) AS details,
  arg_min(CASE WHEN n % 3 = 0 THEN 'info' ELSE 'warning' END, CASE WHEN n % 3 = 0 THEN 1000000 ELSE 0 END + part) AS severity
FROM asked WHERE n % 3 < 2 GROUP BY case_id
UNION ALL SELECT case_id, 'same_person', true, 'ok', 'error' FROM asked WHERE n % 3 < 2 GROUP BY case_id""")
def paired_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules checked in several prompts of a case, and their replies merged to one row per rule."""

    def ask(prompts: DataFrame) -> DataFrame:
        n = F.length("prompt")
        good = F.when(n % 3 == 0, '"passed": true, "severity": "info"').otherwise('"passed": false, "severity": "warning"')
        reply = F.concat(
            F.lit('{"validations": [{"rule_name": "income_match", "details": "n'), n.cast("string"), F.lit('", '), good,
            F.lit('}, {"rule_name": "same_person", "passed": true, "details": "ok", "severity": "error"}]}'),
        )
        return prompts.withColumns({"raw_response": F.when(n % 3 < 2, reply).otherwise('{"cut": '), "error": F.lit(None).cast("string")})

    docs = inputs.case_documents(spark, sf_dir)
    return cd.cross_validations(inputs.cases(spark, sf_dir), docs, _RULE_TABLE, ask, PAIRED_CHARS).drop("pos")


@query(with_(DOCS) + "SELECT doc_id, 'type' AS by FROM docs WHERE doc_type = 'tax_return' UNION ALL SELECT doc_id, 'category' FROM docs WHERE category = 'identity'")
def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.case_documents(spark, sf_dir)
    typed = cd.documents_by_type(docs, "tax_return").select("doc_id", F.lit("type").alias("by"))
    return typed.unionByName(cd.documents_by_category(docs, "identity").select("doc_id", F.lit("category").alias("by")))


@query(with_(DOCS, FIELDS, RECORDS) + """
SELECT * FROM (SELECT case_id, doc_type, doc_id, doc_seq, n AS doc_count, CASE WHEN n = 1 THEN record
  WHEN members <> '' THEN '{"doc_id": "' || doc_id || '", "period": ' || coalesce('"' || document_period || '"', 'null') || ', ' || members || '}' END AS record
FROM (SELECT *, count(*) OVER (PARTITION BY case_id, doc_type) AS n FROM records)) WHERE record IS NOT NULL""")
def merged_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.merged_extraction(inputs.case_documents(spark, sf_dir))


@query(with_(DOCS, FIELDS, RECORDS) + """
SELECT case_id, doc_seq, doc_type || '.' || doc_id || ': ' || record AS line FROM records WHERE status = 'extracted' AND members <> ''""")
def extracted_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.extracted_data(inputs.case_documents(spark, sf_dir))
