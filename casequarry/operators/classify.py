"""Classification of documents and analyst overrides."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.jsonobj import parse_object
from casequarry.functions.values import field_of, to_float
from casequarry.operators.guards import input_verdict, mark_tampered, output_verdict
from casequarry.operators.prompts import classification_prompts
from casequarry.scale import as_of_join, lookup, settle
from casequarry.sources.config import ReviewConfig

ALTERNATIVES = "array<struct<type:string,confidence:double>>"


def parse_classification(
    replies: DataFrame, keep: list[str], threshold: float = fv.CONFIDENCE_THRESHOLD, strict: bool = False
) -> DataFrame:
    """Read replies in ``reply_text`` and gate them by confidence.

    A type below the threshold becomes NEEDS_MANUAL_CLASSIFICATION; equal passes. An unreadable reply
    becomes a manual row; a confidence that is no number leaves the document without a row. Rows without
    a reply say why in ``_never``.
    """
    if "_never" not in replies.columns:
        replies = replies.withColumn("_never", F.lit(None).cast("string"))
    read = settle(replies, _p=F.when(F.col("_never").isNull(), parse_object(F.col("reply_text"), strict)))
    record, bad = F.col("_p.record"), F.col("_p.record").isNull()
    given = field_of(record, "confidence")
    confidence = F.when(bad | given.isNull(), 0.0).otherwise(to_float(given))
    read = settle(read, _c=confidence).where(F.col("_c").isNotNull())
    type_value, reason = field_of(record, "detected_type"), field_of(record, "reasoning")
    detected = F.when(type_value.isNull(), fv.NEEDS_MANUAL).otherwise(type_value["text"])
    raw = F.substring("reply_text", 1, fv.CLASSIFIER_RAW_CHARS)
    unreadable = F.concat(F.lit("JSON parse error: "), F.col("_p.error"), F.lit(". Raw: "), raw)
    alternatives = F.coalesce(
        F.from_json(field_of(record, "alternative_types")["text"], ALTERNATIVES), F.array().cast(ALTERNATIVES)
    )
    return read.select(
        *keep,
        F.when(bad | (F.col("_c") < threshold), fv.NEEDS_MANUAL).otherwise(detected).alias("detected_type"),
        F.col("_c").alias("confidence"),
        alternatives.alias("alternative_types"),
        F.coalesce("_never", F.when(bad, unreadable).when(reason.isNull(), "").otherwise(reason["text"])).alias("reasoning"),
        F.lit(False).alias("manually_overridden"),
        F.lit(None).cast("string").alias("override_by"),
    )


def classify(
    docs: DataFrame,
    cfg: ReviewConfig,
    ask: Callable[[DataFrame], DataFrame],
    threshold: float = fv.CONFIDENCE_THRESHOLD,
    keep: tuple[str, ...] = ("case_id", "doc_id", "doc_seq"),
) -> DataFrame:
    """One classification per document with text; ``ask`` adds ``raw_response, error`` to prompts.

    Without registered types, with a blocked prompt, a model error or an unreadable reply the document is
    left for manual classification, with the reason. All of it is one pass over the documents.
    """
    keep = list(keep)
    texts = docs.where(F.coalesce(F.col("text_content"), F.lit("")) != "")
    prompts = input_verdict(classification_prompts(mark_tampered(texts, cfg), cfg), "prompt", cfg)
    # Only the prompt's presence is needed after the call, not the prompt.
    prompts = prompts.withColumn("_typed", F.col("prompt").isNotNull())
    country = [c for c in ("country_code",) if c in prompts.columns]
    made = ask(prompts.select(*keep, "prompt", "in_passed", "in_reason", "_typed", *country))
    never = (
        F.when(~F.col("_typed"), fv.MSG_NO_TYPES)
        .when(~F.col("in_passed"), F.concat(F.lit("Blocked by guardrails: "), "in_reason"))
        .when(F.col("error").isNotNull(), F.concat(F.lit(fv.MSG_MODEL_ERROR), "error"))
    )
    readable = output_verdict(made.withColumn("_never", never), "raw_response", cfg)
    return parse_classification(readable, keep, threshold)


def apply_classification(docs: DataFrame, classifications: DataFrame) -> DataFrame:
    """Documents with the detected type, where there is one; joined on the document's own key."""
    found = classifications.select("case_id", "doc_id", F.col("detected_type").alias("_type"))
    typed = F.when(F.col("_type") != fv.NEEDS_MANUAL, F.col("_type")).otherwise(F.col("doc_type"))
    joined = docs.join(found, ["case_id", "doc_id"], "left").withColumn("doc_type", typed)
    return joined.select(*docs.columns)


def unclassified(classifications: DataFrame) -> DataFrame:
    return classifications.where(F.col("detected_type") == fv.NEEDS_MANUAL).select("case_id", "doc_seq", "doc_id")


def latest_overrides(overrides: DataFrame, until: dt.datetime | None = None) -> DataFrame:
    """The newest override of each document, of those made by ``until``."""
    if until is not None:
        overrides = overrides.where(F.col("ts") <= F.lit(until))
    newest = F.max_by(F.struct("doc_type", "analyst_id"), F.struct("ts", "analyst_id", "doc_type"))
    return (
        overrides.groupBy("case_id", "doc_id")
        .agg(newest.alias("_o"))
        .select("case_id", "doc_id", F.col("_o.doc_type").alias("new_type"), F.col("_o.analyst_id").alias("analyst_id"))
    )


def apply_overrides(
    docs: DataFrame,
    classifications: DataFrame,
    overrides: DataFrame,
    respect_overrides: bool = True,
    until: dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Set document types by hand; returns (documents with ``old_type``, classifications).

    An overridden classification has confidence 1.0 and keeps its alternatives and reasoning. With
    ``respect_overrides=False`` an existing classification wins, as when a case is processed again. ``until`` is when the
    run began: overrides made later are left to the next one.
    """
    newest = latest_overrides(overrides, until)
    if not respect_overrides:
        newest = newest.join(classifications, ["case_id", "doc_id"], "left_anti")
    keys = ["case_id", "doc_id"]
    typed = docs.join(newest, keys, "left").select(
        *[F.coalesce("new_type", "doc_type").alias("doc_type") if c == "doc_type" else F.col(c) for c in docs.columns],
        F.when(F.col("new_type").isNotNull(), F.col("doc_type")).alias("old_type"),
    )
    # An override of a document that was never classified makes a classification of its own.
    known = newest.join(docs.select(*keys, "doc_seq"), keys)
    hand = F.col("new_type").isNotNull()
    merged = classifications.join(known.withColumnRenamed("doc_seq", "_seq"), keys, "full").select(
        *keys,
        F.coalesce("doc_seq", "_seq").alias("doc_seq"),
        F.coalesce("new_type", "detected_type").alias("detected_type"),
        F.when(hand, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("alternative_types", F.array().cast(ALTERNATIVES)).alias("alternative_types"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        (hand | F.coalesce("manually_overridden", F.lit(False))).alias("manually_overridden"),
        F.coalesce("analyst_id", "override_by").alias("override_by"),
    )
    return typed, merged


def types_as_of_runs(docs: DataFrame, runs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Types that each run of a case saw: (run_id, case_id, doc_id, doc_type, override_by).

    ``runs`` (run_id, case_id, started_at) may be many per case. A document has the type of its newest override made by
    the start of the run, else its own.
    """
    keys = ["case_id", "doc_id"]
    own = docs.select(*keys, F.col("doc_type").alias("_own"))
    seen = lookup(own, runs.select("case_id", "run_id", "started_at"), ["case_id"], how="inner")
    made = overrides.select(*keys, "ts", "analyst_id", "doc_type")
    met = as_of_join(seen, made, keys, "started_at", "ts", ["analyst_id", "doc_type"])
    return met.select("run_id", *keys, F.coalesce("doc_type", "_own").alias("doc_type"), F.col("analyst_id").alias("override_by"))
