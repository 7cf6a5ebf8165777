"""Queries over sources, intake, guards and redaction."""

from __future__ import annotations

import copy
import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions import text as tx
from casequarry.functions.jsonobj import unexpected_keys
from casequarry.operators.classify import apply_overrides, types_as_of_runs
from casequarry.operators.guards import input_verdict, output_verdict, redact
from casequarry.operators.prompts import with_schema
from casequarry.plans import inputs
from casequarry.plans.catalog import query
from casequarry.plans.sqlparts import (
    ATTEMPTS, CASES, CLASSIFIED, DOCS, ENTROPY, PII_FLAGS, REDACTED, TEXTS, TYPE_BY_LINE, lit, screened, with_,
)
from casequarry.sources.config import ReviewConfig, default_config
from casequarry.sources.intake import attach_case, create_cases as new_cases, intake, new_documents

CFG = default_config()


def with_defaults() -> ReviewConfig:
    """The default country plus one schema that any country falls back to."""
    cfg = default_config()
    shared = dict(country="_defaults", doc_type="bank_statement")
    cfg.schemas.append(dict(shared, schema_country="ANY", business_unit="general"))
    cfg.fields.append(dict(shared, pos=0, name="iban", type="string", required=True, pattern=None, alias=[], reasoning=None))
    return cfg


def guard_settings(**changes: dict) -> ReviewConfig:
    guards = copy.deepcopy(fv.GUARDS)
    for section, values in changes.items():
        guards[section].update(values)
    return dataclasses.replace(default_config(), guards=guards)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


@query("""
SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 32) AS case_id,
       CASE WHEN c_nationkey % 5 = 4 THEN 'austria' ELSE 'germany' END AS country,
       'consumer_credit' AS process_type, 'intake' AS status
FROM customer""")
def create_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.cases(spark, sf_dir).withColumnRenamed("case_id", "request_key")
    return new_cases(requests).drop("created_at")


@query("""
SELECT CAST(page_id % 50 AS VARCHAR) AS case_id,
       substr(sha256(CAST(page_id % 50 AS VARCHAR) || '/' || page_id || '/' || CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE url END), 1, 32) AS doc_id,
       CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE url END AS file_name, 'pending' AS status,
       sha256(html || CASE WHEN page_id % 7 = 0 THEN chr(65533) ELSE '' END) AS text_hash
FROM pages""")
def document_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    broken = F.when(p % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit(b""))
    uploads = inputs.table(spark, sf_dir, "pages").select(
        (p % 50).cast("string").alias("case_id"),
        F.when(p % 4 != 0, F.col("url")).alias("file_name"),
        p.alias("doc_seq"),
        F.lit(None).cast("timestamp").alias("upload_timestamp"),
        F.concat(F.col("html").cast("binary"), broken).alias("content"),
    )
    return intake(uploads).select(
        "case_id", "doc_id", "file_name", "status", F.sha2(F.col("text_content").cast("binary"), 256).alias("text_hash")
    )


@query(with_(CASES, DOCS) + """
SELECT d.doc_id, c.country, CASE WHEN c.country = 'germany' THEN 'DE' END AS country_code, 'consumer_credit' AS process_type
FROM docs d JOIN cases c USING (case_id)""")
def documents_with_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = attach_case(inputs.case_documents(spark, sf_dir), inputs.cases(spark, sf_dir), CFG)
    return docs.select("doc_id", "country", "country_code", "process_type")


@query(with_(CASES, DOCS) + f"""
SELECT d.doc_id, CASE WHEN country = 'germany' AND d.doc_type <> {lit(fv.NEEDS_MANUAL)} THEN 'DE'
                      WHEN d.doc_type = 'bank_statement' THEN 'ANY' END AS schema_country,
       CASE WHEN country = 'germany' AND d.doc_type <> {lit(fv.NEEDS_MANUAL)} THEN 'retail_credit'
            WHEN d.doc_type = 'bank_statement' THEN 'general' END AS business_unit
FROM docs d JOIN cases c USING (case_id)""")
def extraction_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = attach_case(inputs.case_documents(spark, sf_dir), inputs.cases(spark, sf_dir), CFG)
    return with_schema(docs, with_defaults()).select("doc_id", "schema_country", "business_unit")


@query(with_(CASES) + """
SELECT case_id, condition_seq, condition_name, check_type FROM cases,
  (VALUES (0, 'salary_slip_freshness', 'deterministic'), (1, 'bank_statement_freshness', 'deterministic'),
          (2, 'identity_document_validity', 'deterministic'), (3, 'income_consistency', 'llm_assisted'),
          (4, 'applicant_name_consistency', 'llm_assisted')) AS v(condition_seq, condition_name, check_type)
WHERE country = 'germany'""")
def conditions_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = inputs.cases(spark, sf_dir).join(CFG.condition_table(spark), ["country", "process_type"])
    return due.select("case_id", "condition_seq", "condition_name", "check_type")


@query("""
SELECT p_partkey, key, regexp_full_match(key, '[a-zA-Z0-9_]+') AS is_safe FROM (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'doc_' || p_partkey ELSE p_type END AS key FROM part)""")
def safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    key = F.when(p % 3 == 0, F.col("p_brand")).when(p % 3 == 1, F.concat(F.lit("doc_"), p.cast("string"))).otherwise(F.col("p_type"))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).withColumn("is_safe", tx.is_safe_key(F.col("key")))


_NEWEST = f"""newest AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, arg_max({TYPE_BY_LINE}, (l_shipdate, 'analyst_' || l_linenumber)) AS new_type,
         arg_max('analyst_' || l_linenumber, (l_shipdate, 'analyst_' || l_linenumber)) AS analyst_id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey)"""


@query(with_(DOCS, _NEWEST) + """
SELECT d.doc_id, d.case_id, coalesce(n.new_type, d.doc_type) AS doc_type,
       CASE WHEN n.new_type IS NOT NULL THEN d.doc_type END AS old_type
FROM docs d LEFT JOIN newest n USING (doc_id)""")
def overridden_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _overridden(spark, sf_dir)
    return docs.select("doc_id", "case_id", "doc_type", "old_type")


@query(with_(DOCS, CLASSIFIED, _NEWEST) + """
SELECT d.doc_id, coalesce(n.new_type, c.detected_type) AS detected_type,
       CASE WHEN n.new_type IS NOT NULL THEN 1.0 ELSE CAST(c.confidence AS DOUBLE) END AS confidence,
       n.new_type IS NOT NULL AS manually_overridden, n.analyst_id AS override_by,
       CASE WHEN c.doc_id IS NULL THEN '' ELSE 'r' || d.doc_id END AS reasoning,
       CAST(CASE WHEN c.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS alternatives
FROM docs d LEFT JOIN classified c USING (doc_id) LEFT JOIN newest n USING (doc_id)
WHERE c.doc_id IS NOT NULL OR n.new_type IS NOT NULL""")
def overridden_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _overridden(spark, sf_dir)
    return rows.select(
        "doc_id", "detected_type", "confidence", "manually_overridden", "override_by", "reasoning",
        big(F.size("alternative_types")).alias("alternatives"),
    )


def _overridden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return apply_overrides(
        inputs.case_documents(spark, sf_dir), inputs.classifications(spark, sf_dir), inputs.overrides(spark, sf_dir)
    )


@query(with_(CASES) + """
SELECT case_id, CASE WHEN ck % 5 = 0 OR ck % 7 = 0 THEN 'germany' ELSE country END AS country,
  CASE WHEN ck % 3 = 0 THEN 'consumer_credit' ELSE 'other' END AS process_type FROM cases""")
def defaulted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without a country or a process type take those of the process that is run."""
    n = F.col("case_id").cast("bigint")
    country = F.when(n % 5 == 0, None).when(n % 7 == 0, "").otherwise(F.col("country"))
    process = F.when(n % 3 != 0, "other").when(n % 2 == 0, "")
    given = inputs.cases(spark, sf_dir).withColumns({"country": country, "process_type": process})
    return CFG.filled(given).select("case_id", "country", "process_type")


@query(with_(DOCS, f"""made AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, l_shipdate AS ts, arg_max({TYPE_BY_LINE}, 'analyst_' || l_linenumber) AS new_type,
         max('analyst_' || l_linenumber) AS analyst_id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL),
runs AS (SELECT doc_id, doc_type, run_id, CAST(started_at AS TIMESTAMP) AS started_at FROM docs,
  (VALUES ('first', '1994-06-17 12:00:00'), ('second', '1996-03-01 00:00:00'), ('third', '2001-01-01 00:00:00')) AS v(run_id, started_at))""") + """
SELECT r.doc_id, r.run_id, coalesce(m.new_type, r.doc_type) AS doc_type, m.analyst_id AS override_by
FROM runs r ASOF LEFT JOIN made m ON r.doc_id = m.doc_id AND r.started_at >= m.ts""")
def types_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of every case, with overrides in between: each sees the types of its time."""
    starts = F.array(
        *[
            F.struct(F.lit(name).alias("run_id"), F.lit(at).cast("timestamp_ntz").alias("started_at"))
            for name, at in (("first", "1994-06-17 12:00:00"), ("second", "1996-03-01 00:00:00"), ("third", "2001-01-01 00:00:00"))
        ]
    )
    runs = inputs.cases(spark, sf_dir).select("case_id", F.inline(starts))
    rows = types_as_of_runs(inputs.case_documents(spark, sf_dir), runs, inputs.overrides(spark, sf_dir))
    return rows.select("doc_id", "run_id", "doc_type", "override_by")


@query("""
WITH given AS (SELECT doc_id, doc_id % 2 AS c, coalesce(text, '') AS text, doc_id % 3 = 0 AS known FROM documents),
first AS (SELECT c, text, min(doc_id) AS doc_id FROM given WHERE NOT known GROUP BY c, text)
SELECT CAST(c AS VARCHAR) AS case_id, doc_id AS doc_seq, sha256(text) AS text_hash FROM first
WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.known AND g.c = first.c AND g.text = first.text)""")
def fresh_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose text their case does not hold yet, a third of the documents being there already."""
    uploads = inputs.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 2).cast("string").alias("case_id"), F.lit("a.txt").alias("file_name"), F.col("doc_id").alias("doc_seq"),
        F.lit(None).cast("timestamp").alias("upload_timestamp"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )
    came = intake(uploads)
    held = F.col("doc_seq") % 3 == 0
    return new_documents(came.where(~held), came.where(held)).select("case_id", "doc_seq", F.col("original_input_hash").alias("text_hash"))


# Guards -------------------------------------------------------------------------------------------
@query(with_(TEXTS) + """
SELECT doc_id, k % 4 <> 0 AND text <> original AS tampered FROM texts""")
def hash_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    stored = F.when(d % 4 == 0, "").otherwise(F.sha2(F.col("text").cast("binary"), 256))
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select(d.cast("string").alias("doc_id"), tx.hash_tampered(inputs.spliced_text(), stored).alias("tampered"))


@query(with_(TEXTS) + """
SELECT doc_id, length(text) > 32000 AS prompt_too_long, length(text) > 10000 AS reply_too_long FROM texts""")
def length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text_content")
    return inputs.text_documents(spark, sf_dir).select(
        "doc_id", tx.too_long(text, 32000).alias("prompt_too_long"), tx.too_long(text, 10000).alias("reply_too_long")
    )


@query(with_(TEXTS) + """
SELECT doc_id, CASE WHEN regexp_matches(text, 'ignore previous instructions') THEN 'ignore previous instructions'
  WHEN regexp_matches(text, 'you are now') THEN 'you are now' WHEN regexp_matches(text, 'pretend you are') THEN 'pretend you are'
  WHEN regexp_matches(text, 'act as if') THEN 'act as if' END AS pattern FROM texts""")
def blocked_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = CFG.guards["input_guards"]["blocked_content_patterns"]
    return inputs.text_documents(spark, sf_dir).select("doc_id", tx.first_match(F.col("text_content"), patterns).alias("pattern"))


@query(with_(TEXTS) + """
SELECT doc_id, regexp_matches(text, '(?i)```\\s*(system|assistant|user)\\s*\\n') OR regexp_matches(text, '(?i)<\\|?(system|assistant|user)\\|?>')
  OR regexp_matches(text, '(?i)\\n(system|assistant|user)\\s*:') AS suspect FROM texts""")
def role_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.text_documents(spark, sf_dir).select("doc_id", tx.role_structure(F.col("text_content")).alias("suspect"))


@query("""
WITH turns AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '```' || role || chr(10) WHEN 1 THEN chr(10) || upper(role) || ' : ' ELSE '<|' || role || '>' END || text AS text FROM conversations)
SELECT conv_id, turn, regexp_matches(text, '(?i)```\\s*(system|assistant|user)\\s*\\n') OR regexp_matches(text, '(?i)<\\|?(system|assistant|user)\\|?>')
  OR regexp_matches(text, '(?i)\\n(system|assistant|user)\\s*:') AS suspect FROM turns""")
def role_markers_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    opened = (
        F.when(turn % 3 == 0, F.concat(F.lit("```"), role, F.lit("\n")))
        .when(turn % 3 == 1, F.concat(F.lit("\n"), F.upper(role), F.lit(" : ")))
        .otherwise(F.concat(F.lit("<|"), role, F.lit(">")))
    )
    rows = inputs.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.role_structure(F.concat(opened, "text")).alias("suspect"))


@query(with_(TEXTS, ENTROPY) + """
SELECT doc_id, round(bits, 6) AS max_bits, coalesce(bits > 4.5, false) AS high_entropy, coalesce(windows, 0) AS windows
FROM texts LEFT JOIN entropy USING (doc_id)""")
def entropy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_documents(spark, sf_dir).withColumn("bits", tx.max_window_entropy("text_content"))
    return docs.select(
        "doc_id",
        F.round("bits", 6).alias("max_bits"),
        F.coalesce(F.col("bits") > fv.ENTROPY_THRESHOLD, F.lit(False)).alias("high_entropy"),
        big(tx.entropy_window_count(F.col("text_content"))).alias("windows"),
    )


@query(with_(TEXTS, REDACTED) + f"""
SELECT doc_id, CAST(n1 + n2 + n3 + n4 AS BIGINT) AS matches, {PII_FLAGS} AS flags, sha256(t4) AS text_hash FROM redacted""")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redact(inputs.text_documents(spark, sf_dir), "text_content", CFG.pii_patterns(), "country_code")
    return found.select(
        "doc_id",
        F.col("pii_count").alias("matches"),
        F.array_join("pii_flags", ",").alias("flags"),
        F.sha2(F.col("pii_text").cast("binary"), 256).alias("text_hash"),
    )


@query(with_(TEXTS, ENTROPY, screened("text", "texts")) + """
SELECT s.doc_id, reason IS NULL AS passed,
       CASE WHEN reason IS NULL THEN CASE WHEN coalesce(bits > 4.5, false) THEN 'HIGH_ENTROPY_SEGMENT' ELSE '' END
            WHEN reason LIKE 'Prompt exceeds%' THEN 'INPUT_TOO_LONG' WHEN reason LIKE 'Injection%' THEN 'INJECTION_PATTERN_MATCH'
            ELSE 'STRUCTURAL_INJECTION_SUSPECT' END AS flags, reason
FROM screened s LEFT JOIN entropy e USING (doc_id)""")
def input_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened_rows = input_verdict(inputs.text_documents(spark, sf_dir), "text_content", CFG)
    return screened_rows.select(
        "doc_id", F.col("in_passed").alias("passed"), F.array_join("in_flags", ",").alias("flags"), F.col("in_reason").alias("reason")
    )


@query(with_(TEXTS, ENTROPY, REDACTED, screened("text", "redacted")) + f"""
SELECT s.doc_id, CASE WHEN tampered THEN 'Document text was tampered with after ingestion' ELSE reason END AS reason,
       CASE WHEN tampered THEN 'TAMPERING_DETECTED'
            WHEN reason IS NULL THEN concat_ws(',', CASE WHEN coalesce(bits > 4.5, false) THEN 'HIGH_ENTROPY_SEGMENT' END, nullif({PII_FLAGS}, ''))
            WHEN reason LIKE 'Prompt exceeds%' THEN 'INPUT_TOO_LONG' WHEN reason LIKE 'Injection%' THEN 'INJECTION_PATTERN_MATCH'
            ELSE 'STRUCTURAL_INJECTION_SUSPECT' END AS flags,
       CASE WHEN reason IS NULL AND NOT tampered THEN sha256(t4) END AS text_hash
FROM (SELECT *, k % 4 = 1 AND text <> original AS tampered FROM screened) s LEFT JOIN entropy e USING (doc_id)""")
def input_verdicts_with_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = guard_settings(input_guards={"require_document_hash_match": True}, pii={"scan_input": True})
    d = F.col("doc_id")
    docs = inputs.table(spark, sf_dir, "documents").select(
        d.cast("string").alias("doc_id"),
        inputs.spliced_text().alias("text_content"),
        F.when(d % 5 != 4, fv.COUNTRY_CODE).otherwise("AT").alias("country_code"),
        F.when(d % 4 == 1, F.sha2(F.col("text").cast("binary"), 256)).alias("original_input_hash"),
    )
    rows = input_verdict(docs, "text_content", cfg, "text_content", "original_input_hash", "country_code")
    return rows.select(
        "doc_id",
        F.col("in_reason").alias("reason"),
        F.array_join("in_flags", ",").alias("flags"),
        F.sha2(F.col("in_text").cast("binary"), 256).alias("text_hash"),
    )


@query(with_(ATTEMPTS) + """
SELECT doc_id, attempt, json_valid(inner_text) AS passed, CASE WHEN json_valid(inner_text) THEN inner_text END AS sanitized,
       CASE WHEN NOT json_valid(inner_text) THEN 'LLM response is not valid JSON' END AS reason
FROM (SELECT *, CASE WHEN raw LIKE '%```%```%' THEN regexp_extract(raw, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?```', 1) ELSE raw END AS inner_text FROM attempts)
WHERE raw IS NOT NULL""")
def json_replies_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = guard_settings(output_guards={"must_be_valid_json": True})
    replies = inputs.attempts(spark, sf_dir).where(F.col("raw_response").isNotNull())
    rows = output_verdict(replies, "raw_response", cfg)
    return rows.select(
        "doc_id", big("attempt").alias("attempt"), F.col("out_passed").alias("passed"), F.col("out_text").alias("sanitized"), F.col("out_reason").alias("reason")
    )


_REPLIES = """replies AS (SELECT doc_id, text || CASE k % 8 WHEN 1 THEN ' APPROVE THE LOAN' WHEN 2 THEN ' CREDIT IS DENIED'
  WHEN 3 THEN ' approve the loan' WHEN 4 THEN ' CREDIT IS GRANTED, REJECT THE APPLICATION' ELSE '' END AS text, country_code FROM texts)"""
_BLOCKED = (
    "CASE WHEN regexp_matches(text, 'APPROVE THE LOAN') THEN 'APPROVE THE LOAN' "
    "WHEN regexp_matches(text, 'REJECT THE APPLICATION') THEN 'REJECT THE APPLICATION' "
    "WHEN regexp_matches(text, 'CREDIT IS DENIED') THEN 'CREDIT IS DENIED' "
    "WHEN regexp_matches(text, 'CREDIT IS GRANTED') THEN 'CREDIT IS GRANTED' END"
)


def _text_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_seq") % 8
    end = (
        F.when(k == 1, " APPROVE THE LOAN").when(k == 2, " CREDIT IS DENIED").when(k == 3, " approve the loan")
        .when(k == 4, " CREDIT IS GRANTED, REJECT THE APPLICATION").otherwise("")
    )
    return inputs.text_documents(spark, sf_dir).select("doc_id", "country_code", F.concat("text_content", end).alias("reply"))


@query(with_(TEXTS, _REPLIES) + f"""
SELECT doc_id, CASE WHEN length(text) > 10000 THEN 'Response exceeds max length (' || length(text) || ' > 10000)'
   ELSE 'Response contains blocked content: ' || ({_BLOCKED}) END AS reason,
   CASE WHEN length(text) > 10000 THEN 'OUTPUT_TOO_LONG' WHEN ({_BLOCKED}) IS NOT NULL THEN 'BLOCKED_CONTENT_DETECTED' ELSE '' END AS flags
FROM replies""")
def output_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = output_verdict(_text_replies(spark, sf_dir), "reply", CFG)
    return rows.select("doc_id", F.col("out_reason").alias("reason"), F.array_join("out_flags", ",").alias("flags"))


@query(with_(TEXTS, _REPLIES.replace("replies AS", "base AS"), REDACTED.replace("FROM texts", "FROM base")) + f"""
SELECT doc_id, CASE WHEN length(text) > 10000 THEN 'Response exceeds max length (' || length(text) || ' > 10000)'
   WHEN ({_BLOCKED}) IS NOT NULL THEN 'Response contains blocked content: ' || ({_BLOCKED})
   WHEN {PII_FLAGS} <> '' THEN 'PII detected in LLM output' END AS reason,
   CASE WHEN length(text) > 10000 THEN 'OUTPUT_TOO_LONG' WHEN ({_BLOCKED}) IS NOT NULL THEN 'BLOCKED_CONTENT_DETECTED' ELSE {PII_FLAGS} END AS flags
FROM redacted""")
def output_verdicts_blocking_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = guard_settings(pii={"scan_output": True, "action": "block"})
    rows = output_verdict(_text_replies(spark, sf_dir), "reply", cfg, country_code_col="country_code")
    return rows.select("doc_id", F.col("out_reason").alias("reason"), F.array_join("out_flags", ",").alias("flags"))


@query(with_(ATTEMPTS) + """
SELECT doc_id, attempt, CASE WHEN json_valid(inner_text) AND json_type(inner_text) = 'OBJECT' AND json_exists(inner_text, '$.v') THEN 'v' ELSE '' END AS unexpected
FROM (SELECT *, CASE WHEN raw LIKE '%```%```%' THEN regexp_extract(raw, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?```', 1) ELSE raw END AS inner_text FROM attempts)
WHERE raw IS NOT NULL""")
def unexpected_reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = inputs.attempts(spark, sf_dir).where(F.col("raw_response").isNotNull())
    odd = unexpected_keys(F.col("raw_response"), F.array(F.lit("k"), F.lit("name")))
    return replies.select("doc_id", big("attempt").alias("attempt"), F.array_join(odd, ",").alias("unexpected"))
