"""Digests from intake to the prompts of a review."""

import dataclasses
import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from casequarry.operators.model import call_model
from casequarry.plans.queries_intake import guard_settings
from casequarry.plans.review import ModelSteps, review_cases
from casequarry.sources.intake import intake, new_documents
from casequarry.sources.config import default_config

UPLOADS = "case_id string, file_name string, doc_seq long, upload_timestamp timestamp, content binary"


def uploads(spark, rows):
    return intake(spark.createDataFrame([(c, f"{k}.txt", k, None, t.encode()) for c, k, t in rows], UPLOADS))


def test_a_text_changed_after_intake_is_blocked_in_a_review(spark):
    docs = uploads(spark, [("a", 1, "same text"), ("a", 2, "changed text"), ("a", 3, "typed and changed")])
    changed = F.when(F.col("doc_seq") > 1, F.concat("text_content", F.lit(" !"))).otherwise(F.col("text_content"))
    docs = docs.withColumn("text_content", changed).withColumn("doc_type", F.when(F.col("doc_seq") == 3, "salary_slip").otherwise(""))
    cases = spark.createDataFrame([("a", "germany", "consumer_credit")], "case_id string, country string, process_type string")
    asked = []

    def says(reply):
        return partial(call_model, model_fn=lambda frame: [reply] * len(frame), keys=["case_id"])

    model = ModelSteps(
        classify=says('{"detected_type": "salary_slip", "confidence": 0.9, "alternative_types": [], "reasoning": "r"}'),
        extract=says('{"net_salary": 10.5, "pay_period": "2024-01"}'),
        conditions=says('{"status": "pass", "analyst_message": "ok", "details": {}}'),
        narrative=says("fine"),
    )
    for required in (True, False):
        cfg = dataclasses.replace(guard_settings(input_guards={"require_document_hash_match": required}))
        review = review_cases(cases, docs, cfg, model, dt.date(2024, 5, 31))
        classes = {r.doc_id: r.reasoning for r in review.classifications.collect()}
        status = {r.doc_seq: (r.status, classes[r.doc_id]) for r in review.documents.collect()}
        asked.append(status)
        blocked = {r.doc_id for r in review.step_results.where("outcome = 'blocked'").collect()}
        assert len(blocked) == (1 if required else 0)  # the typed one goes on to extraction and is blocked there too
    said = "Blocked by guardrails: Document text was tampered with after ingestion"
    assert asked[0] == {1: ("extracted", "r"), 2: ("skipped", said), 3: ("failed", said)}
    assert asked[1] == {k: ("extracted", "r") for k in (1, 2, 3)}


def test_repeated_uploads_are_left_out(spark):
    known = uploads(spark, [("a", 1, "x"), ("b", 2, "y")])
    docs = uploads(spark, [("a", 3, "x"), ("a", 4, "y"), ("a", 6, "y"), ("a", 5, "y"), ("b", 3, "x"), ("b", 4, "y"), ("c", 1, ""), ("c", 2, "")])
    got = sorted((r.case_id, r.doc_seq) for r in new_documents(docs, known).collect())
    assert got == [("a", 4), ("b", 3), ("c", 1)]
    assert new_documents(docs, known).columns == docs.columns
    assert new_documents(docs, docs).count() == 0
    assert default_config().guards["input_guards"]["require_document_hash_match"] is False
