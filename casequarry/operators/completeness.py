"""Does a case hold the documents it needs, and are the extracted ones filled in?

Documents are counted per case, type and category first; everything after that works on the counts, so
a case with very many documents weighs no more than any other.
"""

from __future__ import annotations

import json
import logging
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry import fixed_values as fv
from casequarry.functions.values import empty_record, field_of
from casequarry.operators.validate import rule_column
from casequarry.scale import config_table, lenient, mixes_types
from casequarry.sources.config import REQUIREMENT_SCHEMA, ReviewConfig

log = logging.getLogger(__name__)


def _counts(docs: DataFrame) -> DataFrame:
    return (
        docs.groupBy("case_id", F.col("doc_type").alias("_type"), F.col("category").alias("_category"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _as_fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def category_counts(cases: DataFrame, docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Documents per case and required category, categories without documents included."""
    wanted = cases.select("case_id", "country", "process_type").join(
        cfg.category_table(cases.sparkSession), ["country", "process_type"]
    )
    fits = F.array_contains("doc_types", F.col("_type")) | (F.col("_category") == F.col("category"))
    group = ["case_id", "pos", "category", "description", "min_required", "max_accepted"]
    return (
        wanted.join(_counts(docs), "case_id", "left")
        .groupBy(*group)
        .agg(F.coalesce(F.sum(F.when(F.coalesce(fits, F.lit(False)), F.col("_n"))), F.lit(0)).alias("found"))
    )


def category_issues(cases: DataFrame, docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(case_id, pos, category, found, issue) for categories with too few or too many documents."""
    low = F.format_string(fv.MSG_CATEGORY_MIN, "description", "min_required", "found")
    high = F.format_string(fv.MSG_CATEGORY_MAX, "description", "max_accepted", "found")
    issue = F.when(F.col("found") < F.col("min_required"), low).when(F.col("found") > F.col("max_accepted"), high)
    return (
        category_counts(cases, docs, cfg)
        .select("case_id", "pos", "category", "found", issue.alias("issue"))
        .where(F.col("issue").isNotNull())
    )


def requirement_applies(anchors: DataFrame, requirements: list[dict]) -> DataFrame:
    """(case_id, category) of requirements whose condition is false for the case's anchor row.

    Conditions are SQL expressions over the anchor columns. One that cannot be evaluated, or is null,
    counts as true.
    """
    cells, work = [], anchors
    for r in requirements:
        if not r.get("condition"):
            continue
        try:
            mixed = mixes_types(anchors, r["condition"])
        except AnalysisException as exc:
            log.warning("condition of %s cannot be evaluated, taken as true: %s", r["category"], exc)
            continue
        if mixed:
            log.warning("condition of %s compares a text with another type, taken as true", r["category"])
            continue
        with lenient(work.sparkSession):  # null where it cannot be evaluated for a case
            work = work.withColumn(f"_met{len(cells)}", F.coalesce(F.expr(r["condition"]).cast("boolean"), F.lit(True)))
        cells.append(F.when(~F.col(f"_met{len(cells)}"), r["category"]))
    skipped = F.filter(F.array(*cells).cast("array<string>"), lambda c: c.isNotNull())
    return work.select("case_id", F.explode(skipped).alias("category"))


def requirement_issues(
    cases: DataFrame, docs: DataFrame, requirements: list[dict], anchors: DataFrame | None = None
) -> DataFrame:
    """(case_id, pos, issue_seq, category, issue): documents in the category and of an accepted type.

    All cases have the same requirements here; ``process_requirement_issues`` takes those of their processes.
    """
    rows = F.from_json(F.lit(json.dumps(requirements)), f"array<struct<{_as_fields(REQUIREMENT_SCHEMA)}>>")
    wanted = cases.select("case_id", F.inline(rows))
    if anchors is not None:
        wanted = wanted.join(requirement_applies(anchors, requirements), ["case_id", "category"], "left_anti")
    return _issues(wanted, docs)


def anchor_records(cases: DataFrame, docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(case_id, country, process_type, roles): the record that stands for each role in a case.

    A role's record is that of the case's first extracted document of a type that a requirement of this role accepts.
    Records are picked by a partial aggregation, so a case of very many documents sends one per type and task.
    """
    accepted = {(r["country"], r["process_type"], t, r["role"]) for r in cfg.requirements if r["role"] for t in r["doc_types"]}
    rows = [dict(zip(("country", "process_type", "doc_type", "role"), a, strict=True)) for a in sorted(accepted)]
    roles = config_table(cases.sparkSession, rows, "country string, process_type string, doc_type string, role string")
    held = docs.where((F.col("status") == fv.DOC_EXTRACTED) & (F.size("extracted_data") > 0))
    first = held.groupBy("case_id", "doc_type").agg(F.min_by(F.struct("doc_seq", "extracted_data"), "doc_seq").alias("_d"))
    placed = cases.select("case_id", "country", "process_type").join(first, "case_id")
    chosen = placed.join(roles, ["country", "process_type", "doc_type"]).groupBy("case_id", "country", "process_type", "role")
    chosen = chosen.agg(F.min_by("_d.extracted_data", "_d.doc_seq").alias("record"))
    # A process has few roles.
    return chosen.groupBy("case_id", "country", "process_type").agg(
        F.map_from_entries(F.collect_list(F.struct("role", "record"))).alias("roles")
    )


def _anchor_column(role: str, name: str, cfg: ReviewConfig) -> Column:
    """A field of a role's record, of the type that the schemas of the role's documents declare."""
    types = {t for r in cfg.requirements if r["role"] == role for t in r["doc_types"]}
    kinds = [f["type"] for f in cfg.fields if f["doc_type"] in types and f["name"] == name]
    return rule_column(field_of(F.try_element_at("roles", F.lit(role)), name), kinds[0] if kinds else "string")


def waived_by_anchors(anchors: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(case_id, category) of requirements whose condition is false for the records of their case.

    Conditions are SQL expressions over ``role.field``. Each different one is evaluated once a case, however many
    requirements and processes share it; its requirements are joined afterwards. One that cannot be evaluated, or is
    null, counts as true; so does any in a case without records.
    """
    roles = {r["role"] for r in cfg.requirements if r["role"]}
    work, known = anchors, {}
    for text in dict.fromkeys(r["condition"] for r in cfg.requirements if r["condition"]):
        columns, sql = {}, text
        for role, name in sorted({m for m in re.findall(r"\b(\w+)\.(\w+)\b", text) if m[0] in roles}):
            column = f"_a{len(known)}_{role}_{name}"
            columns[column] = _anchor_column(role, name, cfg)
            sql = re.sub(rf"\b{re.escape(role)}\.{re.escape(name)}\b", f"`{column}`", sql)
        try:
            # Only records are in sight: a name from elsewhere must not resolve.
            mixed = mixes_types(anchors.select(*[c.alias(n) for n, c in columns.items()]), sql)
        except (AnalysisException, ParseException) as exc:
            log.warning("condition %r cannot be evaluated, taken as true: %s", text, str(exc).splitlines()[0])
            continue
        if mixed:
            log.warning("condition %r compares a text with another type, taken as true", text)
            continue
        work = work.withColumns(columns)
        with lenient(work.sparkSession):  # null where it cannot be evaluated for a case
            work = work.withColumn(f"_met{len(known)}", F.coalesce(F.expr(sql).cast("boolean"), F.lit(True)))
        known[text] = len(known)
    rows = [
        {k: r[k] for k in ("country", "process_type", "category")} | {"_no": known[r["condition"]] + 1}
        for r in cfg.requirements
        if r["condition"] in known
    ]
    table = config_table(anchors.sparkSession, rows, "country string, process_type string, category string, _no int")
    met = F.array(*[F.col(f"_met{k}") for k in range(len(known))]).cast("array<boolean>")
    judged = work.select("case_id", "country", "process_type", met.alias("_met")).join(table, ["country", "process_type"])
    return judged.where(~F.try_element_at("_met", F.col("_no"))).select("case_id", "category")


def process_requirement_issues(cases: DataFrame, docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(case_id, pos, issue_seq, category, issue) by the requirements of each case's process."""
    table = cfg.requirement_table(cases.sparkSession)
    wanted = cases.select("case_id", "country", "process_type").join(table, ["country", "process_type"])
    wanted = wanted.drop("country", "process_type")
    waived = waived_by_anchors(anchor_records(cases, docs, cfg), cfg)
    return _issues(wanted.join(waived, ["case_id", "category"], "left_anti"), docs)


def _issues(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    fits = (F.col("_category") == F.col("category")) & F.array_contains("doc_types", F.col("_type"))
    per_type = F.filter(
        F.collect_list(F.when(F.coalesce(fits, F.lit(False)), F.struct("_type", "_n"))), lambda c: c.isNotNull()
    )
    # Accepted types come from configuration, so the list of their counts is short.
    found = (
        wanted.join(_counts(docs), "case_id", "left")
        .groupBy("case_id", "pos", "category", "doc_types", "min_required", "max_accepted", F.map_entries("temporal_constraints").alias("limits"))
        .agg(per_type.alias("_types"))
        .withColumn("found", F.aggregate("_types", F.lit(0).cast("bigint"), lambda a, c: a + c["_n"]))
    )
    types = F.concat(F.lit("['"), F.array_join("doc_types", "', '"), F.lit("']"))
    none = F.lit(0).cast("bigint")

    def typed(limit):
        held = F.aggregate(
            F.filter("_types", lambda c: c["_type"] == limit["key"]), none, lambda a, c: a + c["_n"]
        )
        text = F.format_string(fv.MSG_REQUIREMENT_TYPE, F.col("category"), limit["key"], limit["value"], held)
        return F.when(held < limit["value"], text)

    issues = F.concat(
        F.array(
            F.when(
                F.col("found") < F.col("min_required"),
                F.format_string(fv.MSG_REQUIREMENT_MIN, "category", "min_required", types, "found"),
            ),
            F.when(
                F.col("found") > F.col("max_accepted"),
                F.format_string(fv.MSG_REQUIREMENT_MAX, "category", "max_accepted", "found"),
            ),
        ),
        F.transform(F.coalesce("limits", F.array().cast("array<struct<key:string,value:int>>")), typed),
    )
    return found.select("case_id", "pos", "category", F.posexplode(issues).alias("issue_seq", "issue")).where(
        F.col("issue").isNotNull()
    )


def extraction_quality(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document with gaps, per case). Notes (fields starting with ``_``) are no gaps but do count as fields."""
    data = F.coalesce("extracted_data", empty_record())
    gaps = F.map_keys(F.map_filter(data, lambda k, v: (v["kind"] == "null") & ~k.startswith("_")))
    done, failed = F.col("status") == fv.DOC_EXTRACTED, F.col("status") == fv.DOC_FAILED
    per_doc = (
        docs.where(done | failed)
        .select(
            "case_id",
            "doc_id",
            "doc_type",
            F.when(done, F.array_sort(gaps)).alias("null_fields"),
            F.when(failed, "extraction_failed").alias("issue"),
            F.size(data).alias("_fields"),
        )
        .where(F.col("issue").isNotNull() | (F.size("null_fields") > 0))
        .select(
            "case_id",
            "doc_id",
            "doc_type",
            "null_fields",
            "issue",
            F.when(F.col("issue").isNotNull(), 0.0)
            .otherwise(F.round(1 - F.size("null_fields") / F.greatest("_fields", F.lit(1)), 2))
            .alias("extraction_completeness"),
        )
    )
    per_case = (
        docs.groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("total_documents"),
            F.count(F.when(done, 1)).alias("extracted"),
            F.count(F.when(failed, 1)).alias("failed"),
        )
        .withColumn("overall_quality", F.round(F.col("extracted") / F.greatest("total_documents", F.lit(1)), 2))
    )
    return per_doc, per_case
