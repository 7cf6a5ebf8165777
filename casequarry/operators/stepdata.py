"""Results of steps: flattening, overrides, which documents are extracted at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.text import is_safe_key
from casequarry.functions.values import empty_record
from casequarry.operators.prompts import with_schema
from casequarry.sources.config import ReviewConfig


def _fields(step_results: DataFrame, *columns: str) -> DataFrame:
    return step_results.select(*columns, F.explode("data").alias("field", "value"))


def flatten_prefixed(step_results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All results of a key in one record, fields named ``step.field``.

    A group is the fields of one document, bounded by the size of its replies.
    """
    cells = F.array_sort(F.collect_list(F.struct("step_pos", "field", "step", "value")))
    named = F.transform(cells, lambda c: F.struct(F.concat_ws(".", c["step"], c["field"]), c["value"]))
    return _fields(step_results, *keys, "step", "step_pos").groupBy(*keys).agg(F.map_from_entries(named).alias("data"))


def flatten_last_wins(step_results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All results of a key in one record; the later step's value stays."""
    latest = (
        _fields(step_results, *keys, "step_pos").groupBy(*keys, "field").agg(F.max_by("value", "step_pos").alias("value"))
    )
    cells = F.array_sort(F.collect_list(F.struct("field", "value")))
    return latest.groupBy(*keys).agg(F.map_from_entries(cells).alias("data"))


def merge_step_overrides(overrides: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Overrides aimed at ``target``, merged in the order they were first set; (keys, setting, value).

    ``overrides``: keys, seq, from_step, target_step, settings MAP<STRING,STRING>. Setting the same
    from/target again replaces the settings but keeps the place in the order.
    """
    name = F.concat_ws("->", "from_step", "target_step")
    aimed = overrides.withColumn("_name", name).where(F.col("_name").endswith(f"->{target}"))
    placed = aimed.groupBy(*keys, "_name").agg(F.min("seq").alias("_place"), F.max_by("settings", "seq").alias("_s"))
    cells = placed.select(*keys, "_place", F.explode("_s").alias("setting", "value"))
    return cells.groupBy(*keys, "setting").agg(F.max_by("value", "_place").alias("value"))


def extraction_eligibility(docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Adds the schema columns and ``skip_reason``: null for documents that go into extraction."""
    unclassified = F.coalesce(F.col("doc_type"), F.lit("")).isin("", fv.NEEDS_MANUAL, fv.UNKNOWN_DOCUMENT)
    safe = is_safe_key(F.col("country")) & is_safe_key(F.col("doc_type"))
    return with_schema(docs, cfg).withColumn(
        "skip_reason",
        F.when(unclassified, "unclassified").when(~safe, "unsafe_key").when(F.col("schema_key").isNull(), "no_schema"),
    )


def extraction_status(eligible: DataFrame, extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Status and data of every document: skipped, failed or extracted."""
    got = extracted.select(key, F.col("status").alias("_status"), F.col("extracted_data").alias("_data"))
    rest = [c for c in eligible.columns if c not in ("status", "extracted_data")]
    return eligible.join(got, key, "left").select(
        *rest,
        F.when(F.col("skip_reason").isNotNull(), fv.DOC_SKIPPED).otherwise(F.coalesce("_status", F.lit(fv.DOC_FAILED))).alias("status"),
        F.coalesce("_data", empty_record()).alias("extracted_data"),
    )
