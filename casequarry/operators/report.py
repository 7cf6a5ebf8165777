"""The review report of a case.

A report is one row of figures, status and narrative per case. Its lists (documents, condition results, flagged
issues, recommendations, extracted data) are tables of their own with a row per item, the case's key and the columns
that order them, so no row and no task ever holds a case's list, however long it is.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.values import record_json
from casequarry.scale import bounded_text, with_places


def _stock(docs: DataFrame, classifications: DataFrame) -> DataFrame:
    found = classifications.select(
        "case_id", "doc_id", "detected_type", "confidence", F.col("manually_overridden").alias("_hand")
    )
    return docs.join(found, ["case_id", "doc_id"], "left").select(
        "case_id",
        "doc_id",
        "doc_seq",
        "file_name",
        "doc_type",
        "category",
        "status",
        "upload_timestamp",
        F.coalesce("detected_type", "doc_type").alias("classified_as"),
        F.col("confidence").alias("classification_confidence"),
        F.coalesce("_hand", F.lit(False)).alias("manually_overridden"),
        "detected_type",
    )


def inventory(docs: DataFrame, classifications: DataFrame) -> DataFrame:
    """Documents with what they were classified as; without a classification, their own type."""
    return _stock(docs, classifications).drop("detected_type")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(fv.SEVERITY_RANK))
    for name, place in fv.SEVERITY_RANK.items():
        rank = F.when(severity == name, place).otherwise(rank)
    return rank


ORDER = ["condition_seq", "type_pos", "doc_seq"]


def flagged_issues(results: DataFrame) -> DataFrame:
    """Results that did not pass, with their rank; order by severity_rank, condition_seq, type_pos, doc_seq."""
    return results.where(F.col("status") != "pass").withColumn("severity_rank", severity_rank(F.col("severity")))


def placed_issues(results: DataFrame) -> DataFrame:
    """Flagged issues with their ``place`` in the case, from 1 on."""
    return with_places(flagged_issues(results), ["case_id"], ["severity_rank", *ORDER])


def attention_flags(cases: DataFrame, results: DataFrame) -> DataFrame:
    """blocking, needs_review and requires_analyst_attention of every case, also of those without results."""
    flags = results.groupBy("case_id").agg(
        F.bool_or((F.col("severity") == "error") & (F.col("status") == "fail")).alias("_b"),
        F.bool_or(F.col("status") == "needs_review").alias("_r"),
    )
    blocking, review = F.coalesce("_b", F.lit(False)), F.coalesce("_r", F.lit(False))
    return cases.join(flags, "case_id", "left").select(
        *cases.columns,
        blocking.alias("blocking"),
        review.alias("needs_review"),
        (blocking | review).alias("requires_analyst_attention"),
    )


def final_status(attention: Column) -> Column:
    return F.when(attention, fv.CASE_NEEDS_ACTION).otherwise(fv.CASE_READY)


def _blocking() -> Column:
    return (F.col("status") == "fail") & (F.col("severity") == "error")


_COUNTS = ("total", "pass", "fail", "needs_review", "n_flagged", "n_blocking")


def result_counts(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Figures over the results of every case, by one partial aggregation."""
    status = F.col("status")
    counts = results.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(status == s, 1)).alias(s) for s in ("pass", "fail", "needs_review")],
        F.count(F.when(status != "pass", 1)).alias("n_flagged"),
        F.count(F.when(_blocking(), 1)).alias("n_blocking"),
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS]
    return cases.select("case_id").join(counts, "case_id", "left").select("case_id", *filled)


def _fallback() -> Column:
    return F.format_string(fv.MSG_FALLBACK, "total", "pass", "fail", "needs_review")


def fallback_narrative(cases: DataFrame, results: DataFrame) -> DataFrame:
    """The sentence a report carries when the model wrote none."""
    return result_counts(cases, results).select("case_id", _fallback().alias("narrative_summary"))


def _document_counts(docs: DataFrame, classifications: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = docs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("status") == fv.DOC_FAILED, 1)).alias("n_failed")
    )
    manual = classifications.where(F.col("detected_type") == fv.NEEDS_MANUAL).groupBy("case_id")
    return own, manual.agg(F.count(F.lit(1)).alias("n_manual"))


def _figures(cases: DataFrame, docs: DataFrame, classifications: DataFrame, results: DataFrame) -> DataFrame:
    """All figures of every case."""
    own, manual = _document_counts(docs, classifications)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_failed", "n_manual")]
    return (
        result_counts(cases, results)
        .join(own, "case_id", "left")
        .join(manual, "case_id", "left")
        .select("case_id", *_COUNTS, *zero)
    )


# What a recommendation is about, in the order of a report's lines.
ADVICE = ("blocking", "review", "failed_documents", "unclassified", "all_clear")


def recommendations(cases: DataFrame, docs: DataFrame, classifications: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, kind, place, name, message): what an analyst should look at, item by item.

    ``blocking`` and ``review`` name conditions, ``unclassified`` documents, in their place; ``failed_documents`` and
    ``all_clear`` are one row with their message. ``advice_lines`` joins names to the lines of a report.
    """
    first = [F.lit(0).alias("condition_seq"), F.lit(0).alias("type_pos")]
    mark = F.when(_blocking(), "blocking").when(F.col("status") == "needs_review", "review")
    checks = results.select("case_id", mark.alias("kind"), *ORDER, F.col("condition_name").alias("name")).where("kind IS NOT NULL")
    manual = classifications.where(F.col("detected_type") == fv.NEEDS_MANUAL).select("case_id", "doc_id")
    unread = docs.join(manual, ["case_id", "doc_id"]).select("case_id", F.lit("unclassified").alias("kind"), *first, "doc_seq", F.col("doc_id").alias("name"))
    names = with_places(checks.unionByName(unread), ["case_id", "kind"], ORDER).select("case_id", "kind", "place", "name")
    counts = _figures(cases, docs, classifications, results)
    clear = F.col("n_blocking") + F.col("needs_review") + F.col("n_failed") + F.col("n_manual") == 0
    said = counts.select(
        "case_id",
        F.when(F.col("n_failed") > 0, "failed_documents").when(clear, "all_clear").alias("kind"),
        F.when(F.col("n_failed") > 0, F.format_string(fv.MSG_FAILED_DOCS, "n_failed")).otherwise(fv.MSG_ALL_CLEAR).alias("message"),
    ).where("kind IS NOT NULL")
    return names.unionByName(said, allowMissingColumns=True)


def advice_lines(advice: DataFrame, max_chars: int) -> DataFrame:
    """(case_id, kind, line) for reading: names joined to the line of their kind where that has at most ``max_chars``."""
    joined = bounded_text(advice.where("name IS NOT NULL"), ["case_id", "kind"], ["place"], "name", max_chars, ", ")
    line = (
        F.when(F.col("kind") == "blocking", F.format_string(fv.MSG_BLOCKING, "text"))
        .when(F.col("kind") == "review", F.format_string(fv.MSG_REVIEW, "text"))
        .otherwise(F.format_string(fv.MSG_UNCLASSIFIED, "line_count", "text"))
    )
    named = joined.select("case_id", "kind", F.when(F.col("text").isNotNull(), line).alias("line"))
    return named.unionByName(advice.where("name IS NULL").select("case_id", "kind", F.col("message").alias("line")))


def build_reports(
    cases: DataFrame,
    docs: DataFrame,
    classifications: DataFrame,
    results: DataFrame,
    narratives: DataFrame | None = None,
    generated_at: dt.datetime | None = None,
) -> DataFrame:
    """One row per case: figures, status, narrative. Documents and results are grouped once each."""
    facts = cases.select("case_id", "country", "process_type").join(_figures(cases, docs, classifications, results), "case_id")
    spare = _fallback()
    if narratives is not None:
        facts = facts.join(narratives, "case_id", "left")
        spare = F.coalesce("narrative_summary", spare)
    attention = (F.col("n_blocking") > 0) | (F.col("needs_review") > 0)
    return facts.select(
        "case_id",
        "country",
        "process_type",
        final_status(attention).alias("case_status"),
        attention.alias("requires_analyst_attention"),
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
        spare.alias("narrative_summary"),
        "n_documents",
        "n_failed",
        "n_manual",
        F.col("total").alias("n_results"),
        "n_flagged",
        "n_blocking",
        F.col("needs_review").alias("n_review"),
    )


@dataclass
class ReportTables:
    """A report's row per case and its lists, a row per item."""

    reports: DataFrame
    document_inventory: DataFrame
    extraction_results: DataFrame
    condition_results: DataFrame
    flagged_issues: DataFrame
    recommendations: DataFrame


def report_tables(
    cases: DataFrame,
    docs: DataFrame,
    classifications: DataFrame,
    results: DataFrame,
    narratives: DataFrame | None = None,
    generated_at: dt.datetime | None = None,
) -> ReportTables:
    """The report and all its lists."""
    data = docs.where(F.size("extracted_data") > 0)
    return ReportTables(
        build_reports(cases, docs, classifications, results, narratives, generated_at),
        inventory(docs, classifications),
        data.select("case_id", "doc_seq", "doc_id", "doc_type", record_json(F.col("extracted_data")).alias("record")),
        results,
        flagged_issues(results),
        recommendations(cases, docs, classifications, results),
    )


def process_summary(cases: DataFrame, results: DataFrame) -> DataFrame:
    """What processing a case answers: its status and whether an analyst has to look at it."""
    flags = attention_flags(cases.select("case_id"), results)
    return flags.select("case_id", final_status(F.col("requires_analyst_attention")).alias("status"), "requires_analyst_attention")
