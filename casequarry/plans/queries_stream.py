"""Queries that run a stream to its end and read what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.plans import inputs
from casequarry.plans.catalog import query
from casequarry.plans.queries_intake import CFG
from casequarry.plans.queries_model import REQUIRED
from casequarry.plans.sqlparts import ATTEMPTS, DOCS, ENTROPY, FLAGS, PARSED, PII_FLAGS, REDACTED, RESOLVED, RESULTS, TEXTS, screened, with_
from casequarry.scale import new_path
from casequarry.streaming import attempts as sa
from casequarry.streaming import intake as si
from casequarry.streaming import rollup as sr


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: one file of that name, or all files of a folder of that name."""
    schema = inputs.table(spark, sf_dir, name).schema
    # A stream's path has to be a folder unless it is a pattern; this one matches the table's name only.
    return si.read_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)


@query(with_(TEXTS, ENTROPY, REDACTED, screened("text", "redacted")) + f"""
SELECT s.doc_id, reason IS NULL AS passed, reason, CASE WHEN reason IS NULL THEN CASE WHEN coalesce(bits > 4.5, false) THEN 'HIGH_ENTROPY_SEGMENT' ELSE '' END
  WHEN reason LIKE 'Prompt exceeds%' THEN 'INPUT_TOO_LONG' WHEN reason LIKE 'Injection%' THEN 'INJECTION_PATTERN_MATCH' ELSE 'STRUCTURAL_INJECTION_SUSPECT' END AS flags,
  CAST(n1 + n2 + n3 + n4 AS BIGINT) AS matches, sha256(t4) AS text_hash, {PII_FLAGS} AS pii
FROM screened s LEFT JOIN entropy e USING (doc_id)""")
def streamed_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.text_columns(_stream(spark, sf_dir, "documents"))
    path = new_path(spark, "intake")
    si.write_intake(si.stream_intake(docs, CFG), path, f"{path}-log").awaitTermination()
    rows = spark.read.parquet(path)
    return rows.select(
        "doc_id", F.col("in_passed").alias("passed"), F.col("in_reason").alias("reason"), F.array_join("in_flags", ",").alias("flags"),
        F.col("pii_count").alias("matches"), F.sha2(F.col("pii_text").cast("binary"), 256).alias("text_hash"), F.array_join("pii_flags", ",").alias("pii"),
    )


@query(with_(DOCS, PARSED, RESULTS, FLAGS, """tallies AS (SELECT case_id, count(CASE WHEN status = 'pass' THEN 1 END) AS passed,
  count(CASE WHEN status = 'fail' AND severity = 'error' THEN 1 END) AS blocking, count(CASE WHEN status = 'needs_review' THEN 1 END) AS in_review FROM results GROUP BY case_id)""") + """
SELECT d.case_id, count(*) AS documents, count(CASE WHEN doc_type = 'salary_slip' OR category = 'income_proof' THEN 1 END) AS n_income_proof,
  count(CASE WHEN doc_type = 'identity_document' OR category = 'identity' THEN 1 END) AS n_identity,
  count(CASE WHEN doc_type = 'loan_application' OR category = 'application' THEN 1 END) AS n_application,
  coalesce(any_value(t.passed), 0) AS passed, coalesce(any_value(t.blocking), 0) AS blocking, coalesce(any_value(t.in_review), 0) AS in_review,
  CASE WHEN coalesce(any_value(t.blocking), 0) > 0 OR coalesce(any_value(t.in_review), 0) > 0 THEN 'needs_analyst_action' ELSE 'ready_for_review' END AS case_status
FROM docs d LEFT JOIN tallies t USING (case_id) GROUP BY d.case_id""")
def streamed_case_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.document_columns(_stream(spark, sf_dir, "orders")).withColumns(
        {"country": F.lit(fv.COUNTRY), "process_type": F.lit(fv.PROCESS)}
    )
    path = new_path(spark, "rollup")
    rollup = sr.case_rollup(docs, CFG, inputs.AS_OF)
    sr.write_rollup(rollup, path, f"{path}-log").awaitTermination()
    return sr.current_rollup(spark, path)


@query(with_(ATTEMPTS, RESOLVED) + """
SELECT doc_id, CASE WHEN first_good IS NOT NULL THEN 'success' WHEN last_is_object = 1 THEN 'soft_success' ELSE 'failed' END AS outcome,
       CAST(coalesce(first_good, last_attempt) AS BIGINT) AS attempts, CASE WHEN first_good IS NOT NULL THEN '' ELSE last_problem END AS problem
FROM resolved WHERE first_good IS NOT NULL OR last_attempt = 3""")
def streamed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of steps whose replies arrive as a stream; a step without its last reply has none yet."""
    replies = inputs.attempt_columns(_stream(spark, sf_dir, "events"))
    path = new_path(spark, "attempts")
    sa.write_attempts(sa.stream_attempts(replies, CFG, REQUIRED, 3, ["doc_id"]), path, f"{path}-log").awaitTermination()
    rows = spark.read.parquet(path).where(F.col("kind") == sa.RESULT)
    return rows.select("doc_id", "outcome", F.col("attempt").cast("bigint").alias("attempts"), "problem")
