"""Queries over prompts, model replies, attempts, step results and classification."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions import text as tx
from casequarry.functions.jsonobj import missing_keys, parse_object
from casequarry.functions.values import record_json
from casequarry.operators import prompts as pr
from casequarry.operators import summaries as sm
from casequarry.operators.classify import apply_classification, classify, unclassified
from casequarry.operators.model import (
    ask_each_once, call_in_flight, call_model, join_responses, judge_attempts, last_failed, resolve_attempts, run_step, run_steps, to_traces,
)
from casequarry.operators.stepdata import (
    extraction_eligibility, extraction_status, flatten_last_wins, flatten_prefixed, merge_step_overrides,
)
from casequarry.plans import inputs
from casequarry.plans.catalog import query
from casequarry.plans.queries_intake import CFG, big, guard_settings, with_defaults
from casequarry.plans.sqlparts import (
    ATTEMPTS, CASES, DOCS, RESOLVED, TEXTS, TYPE_BY_KEY, TYPE_REPLIES, lit, screened, with_,
)
from casequarry.sources.intake import attach_case

TYPES = pr.type_blocks(CFG)[fv.COUNTRY]
BLOCKS = {t: b for (_, t), b in pr.schema_blocks(CFG).items()}


def digest(c: str):
    return F.sha2(F.col(c).cast("binary"), 256)


# Prompts ------------------------------------------------------------------------------------------
CLASSIFY_SQL = (
    f"CASE WHEN country = 'germany' THEN {lit(pr.CLASSIFY_HEAD)} || country || {lit(pr.CLASSIFY_TYPES)} || {lit(TYPES)} || "
    f"{lit(pr.CLASSIFY_TEXT)} || substr(text, 1, 3000) || {lit(pr.CLASSIFY_TAIL)} END"
)
BLOCK_SQL = "CASE doc_type " + " ".join(f"WHEN {lit(t)} THEN {lit(b)}" for t, b in BLOCKS.items()) + " END"
TYPED_TEXTS = f"typed AS (SELECT *, {TYPE_BY_KEY.format(k='k', other=fv.NEEDS_MANUAL)} AS doc_type FROM texts)"
EXTRACT_SQL = (
    f"CASE WHEN country = 'germany' THEN {BLOCK_SQL} || {lit('')} || {lit(chr(10) * 2 + 'Document:' + pr.FENCE)} || text || "
    f"{lit(pr.EXTRACT_TAIL)} END"
)


@query(with_(TEXTS) + f"""
SELECT doc_id, sha256(prompt) AS prompt_hash, length(prompt) AS chars FROM (SELECT doc_id, {CLASSIFY_SQL} AS prompt FROM texts)""")
def classification_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.classification_prompts(inputs.text_documents(spark, sf_dir), CFG)
    return rows.select("doc_id", digest("prompt").alias("prompt_hash"), big(F.length("prompt")).alias("chars"))


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_documents(spark, sf_dir)
    typed = inputs._case((F.col("doc_seq") % 6).cast("int"), [F.lit(t) for t in inputs.TYPES])
    return docs.withColumn("doc_type", F.coalesce(typed, F.lit(fv.NEEDS_MANUAL)))


@query(with_(TEXTS, TYPED_TEXTS) + f"""
SELECT doc_id, sha256(prompt) AS prompt_hash, length(prompt) AS chars FROM (SELECT doc_id, {EXTRACT_SQL} AS prompt FROM typed)""")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.extraction_prompts(typed_texts(spark, sf_dir), CFG)
    return rows.select("doc_id", digest("prompt").alias("prompt_hash"), big(F.length("prompt")).alias("chars"))


@query(with_(ATTEMPTS) + f"""
SELECT doc_id, attempt, sha256('A step failed and has to be corrected.' || chr(10) || 'Step: extract_fields' || chr(10) || chr(10) ||
  'Original prompt:' || chr(10) || 'Extract ' || doc_id || chr(10) || chr(10) || 'Failed answer:' || chr(10) || coalesce(raw, '') ||
  chr(10) || chr(10) || 'Errors:' || chr(10) || '- ' || problem || chr(10) || chr(10) || 'Context:' || chr(10) || {lit(pr.REFLECT_TAIL)}) AS prompt_hash
FROM judged WHERE NOT good""")
def reflection_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _judged(spark, sf_dir).where(~F.col("success"))
    original = F.concat(F.lit("Extract "), F.col("doc_id").cast("string"))
    prompt = pr.reflection_prompt(F.col("step_name"), original, F.col("raw_response"), F.col("problem"))
    return failed.withColumn("prompt", prompt).select("doc_id", big("attempt").alias("attempt"), digest("prompt").alias("prompt_hash"))


# The model step -----------------------------------------------------------------------------------
def by_length(batch: pd.DataFrame) -> list[str]:
    """A stand-in model: names a type by the length of the document part of the prompt."""
    replies = []
    for prompt in batch["prompt"]:
        size = len(prompt.split(pr.CLASSIFY_TEXT, 1)[1]) - len(pr.CLASSIFY_TAIL)
        if size % 11 == 0:
            raise ValueError(f"no answer for {size}")
        replies.append(f'{{"detected_type": "{inputs.TYPES[size % 5]}", "confidence": 0.{size % 10}}}')
    return replies


@query(with_(TEXTS, f"prompts AS (SELECT doc_id, country, length(substr(text, 1, 3000)) AS size FROM texts WHERE country = 'germany')") + """
SELECT doc_id, CASE WHEN size % 11 <> 0 THEN '{"detected_type": "' || CASE size % 5 WHEN 0 THEN 'salary_slip' WHEN 1 THEN 'bank_statement'
  WHEN 2 THEN 'tax_return' WHEN 3 THEN 'identity_document' ELSE 'loan_application' END || '", "confidence": 0.' || size % 10 || '}' END AS raw_response,
  CASE WHEN size % 11 = 0 THEN 'no answer for ' || size END AS error FROM prompts""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = pr.classification_prompts(inputs.text_documents(spark, sf_dir), CFG)
    asked = prompts.where(F.col("prompt").isNotNull()).select("doc_id", "prompt")
    return call_model(asked, by_length, ["doc_id"]).select("doc_id", "raw_response", "error")


REQUIRED = ["v"]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_attempts(inputs.attempts(spark, sf_dir), CFG, REQUIRED, 3)


@query(with_(ATTEMPTS, RESOLVED) + """
SELECT doc_id, CASE WHEN first_good IS NOT NULL THEN 'success' WHEN last_is_object = 1 THEN 'soft_success' ELSE 'failed' END AS outcome,
       CAST(coalesce(first_good, last_attempt) AS BIGINT) AS attempts, CASE WHEN first_good IS NOT NULL THEN '' ELSE last_problem END AS problem
FROM resolved""")
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve_attempts(_judged(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "outcome", big("attempts").alias("attempts"), "problem")


_TRACES = """traces AS (
  SELECT j.doc_id, j.attempt, problem, CASE WHEN good THEN 'success' WHEN attempt < 3 THEN 'failed_retrying' ELSE 'failed_terminal' END AS status
  FROM judged j JOIN resolved r USING (doc_id) WHERE r.first_good IS NULL OR j.attempt <= r.first_good)"""


@query(with_(ATTEMPTS, RESOLVED, _TRACES) + """
SELECT doc_id, CAST(attempt AS BIGINT) AS attempt, status, problem AS validation_errors FROM traces""")
def attempt_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_traces(_judged(spark, sf_dir), ["doc_id", "step_name"])
    return rows.select(
        "doc_id", big("attempt").alias("attempt"), F.col("trace_status").alias("status"), F.array_join("validation_errors", ";").alias("validation_errors")
    )


@query(with_(ATTEMPTS, RESOLVED, _TRACES) + """
SELECT doc_id, CAST(max(attempt) AS BIGINT) AS attempt, arg_max(problem, attempt) AS problem, arg_max(status, attempt) AS status
FROM traces WHERE status <> 'success' GROUP BY doc_id""")
def last_failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_failed(to_traces(_judged(spark, sf_dir), ["doc_id", "step_name"]), ["doc_id"])
    return rows.select("doc_id", big("attempt").alias("attempt"), "problem", F.col("trace_status").alias("status"))


@query(with_(ATTEMPTS) + """
SELECT doc_id, attempt, CASE WHEN json_exists(clean, '$.v') THEN 'absent' ELSE 'absent,v' END AS missing FROM judged
WHERE good OR problem LIKE 'Schema%'""")
def missing_reply_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = inputs.attempts(spark, sf_dir).withColumn("r", parse_object(F.col("raw_response"))["record"])
    lacks = F.array_join(missing_keys(F.col("r"), ["k", "absent", "v"]), ",")
    return read.where(F.col("r").isNotNull()).select("doc_id", big("attempt").alias("attempt"), lacks.alias("missing"))


@query(with_(ATTEMPTS, RESOLVED) + """
SELECT doc_id, CASE WHEN first_good IS NOT NULL THEN 'success' WHEN last_is_object = 1 THEN 'soft_success'
         WHEN last_problem IN ('timeout', 'no reply recorded', '') OR last_attempt < 3 THEN 'model_error' ELSE 'failed' END AS outcome,
       CAST(coalesce(first_good, 3) AS BIGINT) AS attempts,
       CASE WHEN first_good IS NOT NULL THEN '' WHEN last_attempt < 3 THEN 'no reply recorded' ELSE last_problem END AS problem
FROM (SELECT doc_id, first_good, last_attempt, last_problem, CASE WHEN last_attempt < 3 THEN 0 ELSE last_is_object END AS last_is_object FROM resolved)""")
def step_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes from running the step in rounds, each attempt answered from the table of replies."""
    recorded = inputs.attempts(spark, sf_dir).select("doc_id", "attempt", "raw_response", "error")
    prompts = recorded.select("doc_id").distinct().withColumn("prompt", F.concat(F.lit("Extract "), F.col("doc_id").cast("string")))
    step = dict(CFG.steps[0], output_schema=REQUIRED)
    ask = partial(join_responses, responses=recorded, keys=["doc_id", "attempt"])
    results, _ = run_step(prompts, step, ask, CFG, ["doc_id"])
    return results.select("doc_id", "outcome", big("attempts").alias("attempts"), "problem")


def by_size(batch: pd.DataFrame) -> list[str]:
    """A stand-in model: every seventh size never gives JSON, every fifth only on a second try."""
    replies = []
    for prompt in batch["prompt"]:
        size = len(prompt.split("Document:" + pr.FENCE, 1)[1].rsplit(pr.EXTRACT_TAIL, 1)[0])
        again = "Failed answer:" in prompt
        if size % 7 == 0 or (size % 5 == 0 and not again):
            replies.append("not json")
        else:
            earlier = "Earlier results:" in prompt
            replies.append(f'{{"chars": {size}, "again": {str(again).lower()}, "earlier": {str(earlier).lower()}}}')
    return replies


_CHAIN_STEPS = [
    dict(CFG.steps[0], pos=0, name="extract", max_retries=2),
    dict(CFG.steps[0], pos=1, name="verify", max_retries=1, retry_on_failure=False, inject_previous_results=True),
]
_REFLECT_EXTRA = len(
    "A step failed and has to be corrected.\nStep: extract\n\nOriginal prompt:\n\n\nFailed answer:\nnot json\n\nErrors:\n- "
    "JSON parse error: invalid JSON\n\nContext:\n" + pr.REFLECT_TAIL
)
_EARLIER_EXTRA = len("\n\nEarlier results:\n- extract.again: \n- extract.chars: \n- extract.earlier: false")


@query(with_(
    TEXTS, TYPED_TEXTS, f"base AS (SELECT doc_id, country, doc_type, text, length(text) AS size, {EXTRACT_SQL} AS prompt FROM typed)",
    screened("prompt", "base"),
    f"""chained AS (SELECT *, CASE WHEN prompt IS NULL THEN 'skipped' WHEN reason IS NOT NULL THEN 'failed'
      WHEN size % 7 = 0 THEN 'failed' WHEN size % 5 = 0 AND length(prompt) + {_REFLECT_EXTRA} > 32000 THEN 'failed' ELSE 'extracted' END AS status,
      size % 5 <> 0 AND length(prompt) + {_EARLIER_EXTRA} + length(CAST(size AS VARCHAR)) + 5 <= 32000 AS verified FROM screened)""",
) + """
SELECT doc_id, status, CASE WHEN status = 'extracted' THEN '{"again": ' || CASE WHEN verified OR size % 5 <> 0 THEN 'false' ELSE 'true' END ||
  ', "chars": ' || size || ', "earlier": ' || CASE WHEN verified THEN 'true' ELSE 'false' END || '}' END AS data FROM chained""")
def chained_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps: the second sees the first one's results and may fail without failing the document."""
    eligible = extraction_eligibility(typed_texts(spark, sf_dir), CFG)
    ready = eligible.where(F.col("skip_reason").isNull())
    ask = partial(call_model, model_fn=by_size, keys=["doc_id"])
    extracted, _, _ = run_steps(ready, _CHAIN_STEPS, ask, CFG)
    rows = extraction_status(eligible, extracted)
    data = F.when(F.col("status") == fv.DOC_EXTRACTED, record_json(F.col("extracted_data")))
    return rows.select("doc_id", "status", data.alias("data"))


@query("""
WITH t AS (SELECT event_type, event_id, value, event_id % 5 AS k FROM events)
SELECT event_type AS doc_type, CAST(count(*) AS BIGINT) AS attempts, CAST(count(CASE WHEN k < 3 THEN 1 END) AS BIGINT) AS successes,
  CAST(count(CASE WHEN k = 4 THEN 1 END) AS BIGINT) AS terminal, true AS quantiles_hold, true AS documents_hold FROM t GROUP BY event_type""")
def trace_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of two halves merged: counts are exact, quantiles and different documents within the sketches' bounds."""
    k = F.col("event_id") % 5
    traces = inputs.table(spark, sf_dir, "events").select(
        F.lit("extract").alias("step_name"), F.col("event_type").alias("doc_type"), F.lit("all").alias("day"), (F.col("event_id") / 3).cast("bigint").alias("doc_id"),
        F.when(k < 3, fv.TRACE_SUCCESS).when(k == 3, fv.TRACE_RETRYING).otherwise(fv.TRACE_TERMINAL).alias("trace_status"), F.lit(False).alias("blocked"),
        F.concat(F.lit("p"), k.cast("string")).alias("problem"), F.col("value").alias("duration_ms"), "event_id",
    )
    halves = [sm.summarise_traces(traces.where(F.col("event_id") % 2 == h)) for h in (0, 1)]
    merged = sm.read_summary(sm.merge_summaries(*halves)).drop("step_name", "day", "blocked")
    # Shares of the values below and up to each estimate, against the estimate's rank.
    seen = traces.join(F.broadcast(merged.select("doc_type", *[f"p{q * 100:.0f}_ms" for q in sm.QUANTILES])), "doc_type")
    holds = F.lit(True)
    for q in sm.QUANTILES:
        est = F.col(f"p{q * 100:.0f}_ms")
        holds = holds & (F.avg((F.col("duration_ms") < est).cast("double")) <= q + 0.03) & (F.avg((F.col("duration_ms") <= est).cast("double")) >= q - 0.03)
    exact = seen.groupBy("doc_type").agg(holds.alias("quantiles_hold"), F.countDistinct("doc_id").alias("_docs"))
    close = F.abs(F.col("documents") - F.col("_docs")) <= 0.06 * F.col("_docs") + 1
    return merged.join(exact, "doc_type").select("doc_type", "attempts", "successes", "terminal", "quantiles_hold", close.alias("documents_hold"))


@query(with_(TEXTS, """shared AS (SELECT doc_id, 'Summarise: ' || substr(text, 1, 40) || ' of ' || (k % 3) AS prompt FROM texts)""") + """
SELECT doc_id, sha256(prompt) AS prompt_hash, CASE WHEN length(prompt) % 7 <> 0 THEN 'reply of ' || length(prompt) || ' to ' || prompt END AS reply,
  CASE WHEN length(prompt) % 7 = 0 THEN 'no reply to ' || length(prompt) END AS error FROM shared""")
def shared_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one prompt share its reply: each different prompt is asked once, several at a time."""

    def one(prompt: str, temperature: float, backend: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError(f"no reply to {len(prompt)}")
        return f"reply of {len(prompt)} to {prompt}"

    docs = inputs.text_documents(spark, sf_dir)
    head = F.concat(F.lit("Summarise: "), F.substring("text_content", 1, 40), F.lit(" of "), (F.col("doc_seq") % 3).cast("string"))
    made = ask_each_once(docs.select("doc_id", head.alias("prompt")), partial(call_in_flight, ask_one=one, keys=["prompt_hash"]))
    return made.select("doc_id", digest("prompt").alias("prompt_hash"), F.col("raw_response").alias("reply"), "error")


@query(with_(TEXTS) + """
SELECT doc_id, k % 4 <> 0 AND text <> original AS blocked FROM texts WHERE text <> '' AND country = 'germany'""")
def tampered_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts changed after intake are not asked about: the digest of what came in goes with them."""
    cfg = guard_settings(input_guards={"require_document_hash_match": True})
    came = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("_hash"))
    stored = F.when(F.col("doc_seq") % 4 != 0, F.col("_hash")).otherwise("")
    docs = inputs.text_documents(spark, sf_dir).where(F.col("country") == fv.COUNTRY)
    docs = docs.join(came, "doc_id").withColumn("original_input_hash", stored).drop("_hash")
    reply = '{"detected_type": "tax_return", "confidence": 0.9, "alternative_types": [], "reasoning": "r"}'
    rows = classify(docs, cfg, partial(call_model, model_fn=lambda b: [reply] * len(b), keys=["doc_id"]))
    said = F.lit(f"Blocked by guardrails: {fv.REASON_TAMPERED}")
    return rows.select("doc_id", F.coalesce(F.col("reasoning") == said, F.lit(False)).alias("blocked"))


# Step results -------------------------------------------------------------------------------------
_STEP_CELLS = """cells AS (
  SELECT event_id // 3 AS doc_id, event_id % 3 AS pos, 'k' AS field, regexp_extract(props, '(\\d+)', 1) AS cell FROM events
  UNION ALL SELECT event_id // 3, event_id % 3, event_type, '"' || user_id || '"' FROM events)"""


@query(with_(_STEP_CELLS) + """
SELECT doc_id, '{' || string_agg('"s' || pos || '.' || field || '": ' || cell, ', ' ORDER BY 's' || pos || '.' || field) || '}' AS data
FROM cells GROUP BY doc_id""")
def prefixed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_prefixed(inputs.step_results(spark, sf_dir), ["doc_id"])
    return flat.select("doc_id", record_json(F.col("data")).alias("data"))


@query(with_(_STEP_CELLS, "latest AS (SELECT doc_id, field, arg_max(cell, pos) AS cell FROM cells GROUP BY doc_id, field)") + """
SELECT doc_id, '{' || string_agg('"' || field || '": ' || cell, ', ' ORDER BY field) || '}' AS data FROM latest GROUP BY doc_id""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_last_wins(inputs.step_results(spark, sf_dir), ["doc_id"])
    return flat.select("doc_id", record_json(F.col("data")).alias("data"))


_OVERRIDES = """placed AS (
  SELECT user_id AS run_id, event_type AS step, min(event_id) AS place, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
settings AS (
  SELECT p.run_id, p.place, 'temperature' AS setting, CAST(p.last % 10 AS VARCHAR) AS value FROM placed p
  UNION ALL SELECT p.run_id, p.place, 'k' || (p.last % 3), p.step FROM placed p)"""


@query(with_(_OVERRIDES) + "SELECT run_id, setting, arg_max(value, place) AS value FROM settings GROUP BY run_id, setting")
def merged_step_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_step_overrides(inputs.step_overrides(spark, sf_dir), ["run_id"], "extract")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props || chr(10) || 'end' ELSE '`' || props END AS cleaned
FROM events""")
def stripped_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p, line = F.col("event_id"), F.col("props"), F.lit("\n")
    text = (
        F.when(e % 4 == 0, F.concat(F.lit("  ```json\r\n"), p, F.lit("\n ``` \ntext after\n")))
        .when(e % 4 == 1, F.concat(line, p, F.lit(" \t\n")))
        .when(e % 4 == 2, F.concat(F.lit("```\n"), p, F.lit("\nend")))
        .otherwise(F.concat(F.lit("`"), p))
    )
    return inputs.table(spark, sf_dir, "events").select("event_id", tx.strip_fences(text).alias("cleaned"))


@query(with_(ATTEMPTS) + """
SELECT doc_id, CAST(attempt AS BIGINT) AS attempt, CASE WHEN NOT json_valid(clean) THEN 'invalid JSON' WHEN json_type(clean) <> 'OBJECT' THEN 'Expected JSON object, got list' ELSE '' END AS error,
  json_extract_string(object, '$.k') AS k, CAST(len(json_keys(object)) AS BIGINT) AS fields
FROM (SELECT *, CASE WHEN json_valid(clean) AND clean LIKE '{%' THEN clean END AS object FROM cleaned) WHERE raw IS NOT NULL""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, strict=False)


@query(with_(ATTEMPTS) + """
SELECT doc_id, CAST(attempt AS BIGINT) AS attempt, CASE WHEN NOT json_valid(clean) THEN 'invalid JSON' WHEN json_type(clean) <> 'OBJECT' THEN 'Expected JSON object, got list' ELSE '' END AS error,
  json_extract_string(object, '$.k') AS k, CAST(len(json_keys(object)) AS BIGINT) AS fields
FROM (SELECT *, CASE WHEN json_valid(clean) AND clean LIKE '{%' THEN clean END AS object FROM cleaned) WHERE raw IS NOT NULL""")
def parsed_replies_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, strict=True)
    kind = F.when(F.col("error").startswith("Expected JSON") | (F.col("error") == ""), F.col("error")).otherwise("invalid JSON")
    return rows.withColumn("error", kind)


def _parsed(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    rows = inputs.attempts(spark, sf_dir).where(F.col("raw_response").isNotNull())
    read = rows.withColumn("p", parse_object(F.col("raw_response"), strict))
    record = F.col("p.record")
    return read.select(
        "doc_id",
        big("attempt").alias("attempt"),
        F.col("p.error").alias("error"),
        F.try_element_at(record, F.lit("k"))["text"].alias("k"),
        big(F.when(record.isNotNull(), F.size(record))).alias("fields"),
    )


@query(with_(CASES, DOCS) + f"""
SELECT doc_id, CASE WHEN doc_type = {lit(fv.NEEDS_MANUAL)} THEN 'unclassified' WHEN doc_type = 'tax-return' THEN 'unsafe_key'
   WHEN country <> 'germany' AND doc_type <> 'bank_statement' THEN 'no_schema' END AS skip_reason
FROM (SELECT doc_id, case_id, CASE WHEN doc_type = 'tax_return' THEN 'tax-return' ELSE doc_type END AS doc_type FROM docs) JOIN cases USING (case_id)""")
def extraction_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = attach_case(inputs.case_documents(spark, sf_dir), inputs.cases(spark, sf_dir), CFG)
    named = F.when(F.col("doc_type") == "tax_return", "tax-return").otherwise(F.col("doc_type"))
    return extraction_eligibility(docs.withColumn("doc_type", named), with_defaults()).select("doc_id", "skip_reason")


# Classification -----------------------------------------------------------------------------------
CLASSIFY_STAGES = [
    TEXTS, TYPE_REPLIES, f"prompted AS (SELECT *, {CLASSIFY_SQL} AS prompt FROM type_replies)", screened("prompt", "prompted"),
    f"""classes AS (
  SELECT case_id, doc_id, k, CASE WHEN prompt IS NULL OR reason IS NOT NULL OR form <> 'good' OR c100 < 75 THEN {lit(fv.NEEDS_MANUAL)}
           ELSE {TYPE_BY_KEY.format(k='k', other=fv.UNKNOWN_DOCUMENT)} END AS detected_type,
         CASE WHEN prompt IS NULL OR reason IS NOT NULL OR form <> 'good' THEN 0.0 ELSE c100 / 100.0 END AS confidence,
         CASE WHEN prompt IS NULL THEN {lit(fv.MSG_NO_TYPES)} WHEN reason IS NOT NULL THEN 'Blocked by guardrails: ' || reason
              WHEN form = 'missing' THEN 'LLM error: no reply recorded' WHEN form = 'error' THEN 'LLM error: timeout'
              WHEN form = 'list' THEN 'JSON parse error: Expected JSON object, got list. Raw: [1,2]'
              WHEN form = 'broken' THEN 'JSON parse error: invalid JSON. Raw: {{"detected_type": "x' ELSE 'r' || k END AS reasoning,
         CAST(CASE WHEN prompt IS NULL OR reason IS NOT NULL OR form <> 'good' THEN 0 ELSE 1 END AS BIGINT) AS alternatives
  FROM screened WHERE NOT (prompt IS NOT NULL AND reason IS NULL AND form = 'word') AND text <> '')""",
]


def classified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_documents(spark, sf_dir)
    replies = inputs.type_replies(docs)
    return classify(docs, CFG, partial(join_responses, responses=replies, keys=["doc_id"]))


@query(with_(*CLASSIFY_STAGES) + "SELECT doc_id, detected_type, CAST(confidence AS DOUBLE) AS confidence, reasoning, alternatives FROM classes")
def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_texts(spark, sf_dir).select(
        "doc_id", "detected_type", "confidence", "reasoning", big(F.size("alternative_types")).alias("alternatives")
    )


@query(with_(*CLASSIFY_STAGES) + f"""
SELECT t.doc_id, CASE WHEN c.detected_type IS NOT NULL AND c.detected_type <> {lit(fv.NEEDS_MANUAL)} THEN c.detected_type ELSE '' END AS doc_type
FROM texts t LEFT JOIN classes c USING (doc_id)""")
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_documents(spark, sf_dir)
    return apply_classification(docs, classified_texts(spark, sf_dir)).select("doc_id", "doc_type")


@query(with_(*CLASSIFY_STAGES) + f"SELECT case_id, doc_id FROM classes WHERE detected_type = {lit(fv.NEEDS_MANUAL)}")
def unclassified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unclassified(classified_texts(spark, sf_dir)).select("case_id", "doc_id")
