"""Condition checks on documents: by rule, and by a model over several documents.

Result rows have the columns of RESULT_COLUMNS. ``condition_seq, type_pos, doc_seq`` give their order
within a case.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.dates import months_before, parse_date
from casequarry.functions.jsonobj import parse_object
from casequarry.functions.text import strip
from casequarry.functions.values import field_of, record_json, text_to_float, to_float, truthy
from casequarry.operators.guards import input_verdict, output_verdict
from casequarry.operators.prompts import condition_prompts
from casequarry.scale import bounded_text, config_table, cut_lineage, settle
from casequarry.sources.config import CONDITION_SCHEMA, DOC_MARK, FIELD_MARK, FORMAT_MARKS, ReviewConfig, format_mark

RESULT_COLUMNS = [
    "case_id", "condition_seq", "type_pos", "doc_seq", "doc_id", "condition_name", "status", "severity",
    "analyst_message", "check_type", "sources_used", "details",
]
DETERMINISTIC, WITH_MODEL = "deterministic", "llm_assisted"
DOCUMENT_ATTRIBUTES = [
    "doc_id", "doc_type", "category", "file_name", "text_content", "upload_timestamp", "document_date", "document_period",
]
ANY_TYPE = "*"


def condition_targets(docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Documents paired with the rule conditions that apply to them.

    An equi join with the broadcast conditions on country, process and type. Conditions without types
    apply to every document: only if there are such does a document also look under the any-type key.
    """
    rows = [c for c in cfg.conditions if c["check_type"] == DETERMINISTIC]
    open_to_all = any(not c["applies_to"] for c in rows)
    # A repeated type in applies_to checks its documents again, as the list says.
    targets = [
        {**c, "_key": t, "type_pos": i} for c in rows for i, t in enumerate(c["applies_to"] or [ANY_TYPE])
    ]
    table = config_table(docs.sparkSession, targets, CONDITION_SCHEMA + ", _key string, type_pos int")
    keys = F.explode(F.array("doc_type", F.lit(ANY_TYPE))) if open_to_all else F.col("doc_type")
    return docs.withColumn("_key", keys).join(table, ["country", "process_type", "_key"]).drop("_key")


def _python_quoted(text: Column) -> Column:
    plain = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(plain)


DATE_OPERATORS, NUMBER_OPERATORS = ["within_months", "after_today"], ["greater_than", "less_than"]


def evaluate_operator(
    operator: Column, text: Column, day: Column, left: Column, right: Column, expected: Column, months: Column, as_of: Column
) -> tuple[Column, Column]:
    """(passed, reason) of ``text operator expected``; ``day, left, right`` are the sides as date or numbers.

    Dates are compared with ``as_of``; a value that is no date or no number does not pass. An unknown
    operator does not pass.
    """
    date_operator, number_operator = operator.isin(DATE_OPERATORS), operator.isin(NUMBER_OPERATORS)
    cutoff = months_before(as_of, months)
    no_date = F.concat(F.lit("Cannot parse date: Cannot parse date: "), _python_quoted(strip(text)))
    comparable = left.isNotNull() & right.isNotNull()
    ordered = ~F.isnan(left) & ~F.isnan(right)
    passed = (
        F.when(operator == "within_months", day >= cutoff)
        .when(operator == "after_today", day >= as_of)
        .when(operator == "equals", text == expected)
        .when(operator == "not_equals", text != expected)
        .when(operator == "greater_than", ordered & (left > right))
        .when(operator == "less_than", ordered & (left < right))
    )
    sign = (
        F.when(operator == "equals", " == ")
        .when(operator == "not_equals", " != ")
        .when(operator == "greater_than", " > ")
        .otherwise(" < ")
    )
    compared = F.concat(text, sign, expected)
    reason = (
        F.when(date_operator & day.isNull(), no_date)
        .when(
            operator == "within_months",
            F.concat(
                F.lit("Date "), day.cast("string"), F.lit(" is "), F.datediff(as_of, day).cast("string"),
                F.lit(" days old (cutoff: "), cutoff.cast("string"), F.lit(")"),
            ),
        )
        .when(
            operator == "after_today",
            F.concat(F.lit("Expiry "), day.cast("string"), F.when(day >= as_of, " is valid").otherwise(" has passed")),
        )
        .when(number_operator & ~comparable, F.concat(F.lit("Cannot compare "), compared))
        .when(operator.isin("equals", "not_equals") | number_operator, compared)
        .otherwise(F.concat(F.lit("Unknown operator: "), operator))
    )
    return F.coalesce(passed, F.lit(False)), reason


def looked_up(targets: DataFrame, cfg: ReviewConfig) -> Column:
    """The condition's field: the extracted value unless it is falsy, else the document's own attribute.

    A net salary of zero therefore reads as missing. Null when there is neither.
    """
    extracted = field_of(F.col("extracted_data"), F.col("field"))
    named = {c["field"] for c in cfg.conditions if c["check_type"] == DETERMINISTIC}
    own = F.lit(None).cast("string")
    for name in DOCUMENT_ATTRIBUTES:  # attributes that no condition names are not read
        if name in named and name in targets.columns:
            own = F.when(F.col("field") == name, F.col(name).cast("string")).otherwise(own)
    attribute = F.when(own.isNotNull(), F.struct(own.alias("text"), F.lit("string").alias("kind")))
    return F.when(truthy(extracted), extracted).otherwise(attribute)


def _formats(message: str | None) -> list[str]:
    """Number formats that a message asks for."""
    return re.findall(f"{FORMAT_MARKS[0]}(.*?){FORMAT_MARKS[1]}", message or "")


def _formatted(spec: str, v: Column) -> Column:
    """A number in a message's format; null for a value that is no number, or no whole one where one is asked for."""
    if spec.endswith("d"):
        return F.when(v["kind"].isin("int", "bool"), F.format_string(f"%{spec}", to_float(v).cast("bigint")))
    return F.when(v["kind"].isin("int", "float", "bool"), F.format_string(f"%{spec}", to_float(v)))


def check_deterministic(targets: DataFrame, cfg: ReviewConfig, as_of: dt.date) -> DataFrame:
    """One result row per document and condition; ``_months_error`` marks conditions that cannot be run."""
    day = F.lit(as_of)
    found = settle(targets, _v=looked_up(targets, cfg))
    text, operator = F.col("_v.text"), F.col("operator")
    found = settle(
        found,
        _day=F.when(operator.isin(DATE_OPERATORS), parse_date(text)),
        _left=F.when(operator.isin(NUMBER_OPERATORS), to_float(F.col("_v"))),
        _right=F.when(operator.isin(NUMBER_OPERATORS), text_to_float(F.col("value"))),
    )
    passed, reason = evaluate_operator(
        operator, text, F.col("_day"), F.col("_left"), F.col("_right"), F.col("value"), F.col("months"), day
    )
    missing = F.col("_v").isNull()
    absent_text = F.coalesce(
        F.replace("missing_message", F.lit(DOC_MARK), F.col("doc_id")),
        F.concat(F.lit("Field '"), "field", F.lit("' not found in "), "doc_id"),
    )
    own = F.replace("value_message", F.lit(FIELD_MARK), F.col("_v.text"))
    for spec in sorted({m for c in cfg.conditions for m in _formats(c["value_message"])}):
        marked = F.contains(own, F.lit(format_mark(spec)))
        own = F.when(marked, F.replace(own, F.lit(format_mark(spec)), _formatted(spec, F.col("_v")))).otherwise(own)
    filled = F.coalesce(
        own,
        F.when(F.col("analyst_message") != "", F.col("analyst_message")),
        reason,
    )
    on_fail = F.when(F.col("on_fail") == "fail", "fail").otherwise("needs_review")
    details = F.when(
        missing, F.create_map(F.lit("field"), F.col("field"), F.lit("value"), F.lit(None).cast("string"), F.lit("reason"), F.lit("field_missing"))
    ).otherwise(
        F.create_map(
            F.lit("field"), F.col("field"), F.lit("value"), F.col("_v.text"), F.lit("operator"), F.col("operator"),
            F.lit("expected"), F.col("value"), F.lit("reason"), reason, F.lit("doc_id"), F.col("doc_id"),
        )
    )
    return found.select(
        "case_id",
        "condition_seq",
        "type_pos",
        "doc_seq",
        "doc_id",
        "condition_name",
        F.when(missing, "needs_review").when(passed, "pass").otherwise(on_fail).alias("status"),
        F.when(~missing & passed, "info").otherwise(F.col("severity")).alias("severity"),
        F.when(missing, absent_text).when(passed, fv.MSG_CHECK_PASSED).otherwise(filled).alias("analyst_message"),
        F.lit(DETERMINISTIC).alias("check_type"),
        F.array("doc_id").alias("sources_used"),
        details.alias("details"),
        F.when(~missing, F.col("months_error")).alias("_months_error"),
        F.col("severity").alias("_severity"),
    )


def deterministic_results(docs: DataFrame, cfg: ReviewConfig, as_of: dt.date) -> DataFrame:
    """All rule results. A condition that cannot be run gives one row per case instead of its documents'.

    Conditions that can be run are one pass over the documents. The rows of the others are written, for they are read
    twice: to find cases that reach the comparison, and to keep the rows of those that do not.
    """
    checked = lambda conditions: check_deterministic(condition_targets(docs, own := replace(cfg, conditions=conditions)), own, as_of)
    broken = [c for c in cfg.conditions if c["months_error"]]
    whole = checked([c for c in cfg.conditions if not c["months_error"]]).select(*RESULT_COLUMNS)
    if not broken:
        return whole
    partial = cut_lineage(checked(broken), "broken")
    raised = (
        partial.where(F.col("_months_error").isNotNull())
        .groupBy("case_id", "condition_seq", "condition_name")
        .agg(F.max("_months_error").alias("_err"), F.max("_severity").alias("severity"))
    )
    # Cases where every document lacks the field never reach the comparison and keep their rows.
    kept = partial.join(raised.select("case_id", "condition_name"), ["case_id", "condition_name"], "left_anti")
    error_rows = raised.select(
        "case_id",
        "condition_seq",
        F.lit(0).alias("type_pos"),
        F.lit(None).cast("bigint").alias("doc_seq"),
        F.lit(None).cast("string").alias("doc_id"),
        "condition_name",
        F.lit("needs_review").alias("status"),
        "severity",
        F.concat(F.lit("Condition check error: "), "_err").alias("analyst_message"),
        F.lit(DETERMINISTIC).alias("check_type"),
        F.array().cast("array<string>").alias("sources_used"),
        F.create_map(F.lit("error"), F.col("_err")).alias("details"),
    )
    return whole.unionByName(kept.select(*RESULT_COLUMNS)).unionByName(error_rows)


def gather_sources(docs: DataFrame, cfg: ReviewConfig, max_chars: int) -> DataFrame:
    """Source documents of each model condition: case, condition, ``sources_used``, ``source_blocks``, ``source_chars``.

    Types without documents are left out. The documents of a case that would not fit a prompt are
    counted, not collected: blocks are then null and ``source_chars`` is still exact.
    """
    rows = [
        {"country": c["country"], "process_type": c["process_type"], "condition_name": c["condition_name"], "source_pos": i, "doc_type": t}
        for c in cfg.conditions
        if c["check_type"] == WITH_MODEL
        for i, t in enumerate(dict.fromkeys(c["sources"] or []))
    ]
    table = config_table(
        docs.sparkSession,
        rows,
        "country string, process_type string, condition_name string, source_pos int, doc_type string",
    )
    lines = docs.join(table, ["country", "process_type", "doc_type"]).select(
        "case_id",
        "condition_name",
        "source_pos",
        "doc_type",
        "doc_seq",
        record_json(F.col("extracted_data"), ("doc_id", F.col("doc_id"))).alias("line"),
    )
    per_type = bounded_text(
        lines, ["case_id", "condition_name", "source_pos", "doc_type"], ["doc_seq"], "line", max_chars
    )
    title = F.concat(F.lit("### "), "doc_type", F.lit("\n"))
    per_type = per_type.withColumn("_block", F.concat(title, "text")).withColumn(
        "_chars", F.length(title) + F.col("chars")
    )
    # At most one block per source type of the condition.
    cells = F.array_sort(F.collect_list(F.struct("source_pos", "doc_type", "_block")))
    return (
        per_type.groupBy("case_id", "condition_name")
        .agg(
            cells.alias("_cells"),
            F.sum("line_count").alias("source_docs"),
            (F.sum("_chars") + F.count(F.lit(1)) - 1).alias("source_chars"),
        )
        .select(
            "case_id",
            "condition_name",
            "source_docs",
            F.transform("_cells", lambda c: c["doc_type"]).alias("sources_used"),
            F.when(
                F.forall("_cells", lambda c: c["_block"].isNotNull()), F.transform("_cells", lambda c: c["_block"])
            ).alias("source_blocks"),
            "source_chars",
        )
    )


def model_condition_prompts(cases: DataFrame, docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Every case with every model condition of its process; ``prompt`` is null without source documents."""
    limit = cfg.guards["input_guards"].get("max_prompt_length", 32000)
    rows = [c for c in cfg.conditions if c["check_type"] == WITH_MODEL]
    table = config_table(cases.sparkSession, rows, CONDITION_SCHEMA)
    known = cases.select("case_id", "country", "process_type").join(cfg.country_table(cases.sparkSession), "country", "left")
    due = known.join(table, ["country", "process_type"])
    gathered = gather_sources(docs, cfg, limit)
    return condition_prompts(due.join(gathered, ["case_id", "condition_name"], "left"), limit)


def _model_result(df: DataFrame, status: Column, severity: Column, message: Column, details: Column) -> DataFrame:
    return df.select(
        "case_id",
        "condition_seq",
        F.lit(0).alias("type_pos"),
        F.lit(None).cast("bigint").alias("doc_seq"),
        F.lit(None).cast("string").alias("doc_id"),
        "condition_name",
        status.alias("status"),
        severity.alias("severity"),
        message.alias("analyst_message"),
        F.lit(WITH_MODEL).alias("check_type"),
        F.coalesce("sources_used", F.array().cast("array<string>")).alias("sources_used"),
        details.cast("map<string,string>").alias("details"),
    )


def parse_condition_reply(replies: DataFrame, strict: bool = False) -> DataFrame:
    """Result rows from ``reply_text``. An unknown status means review; an unreadable reply too.

    Rows whose prompt was never answered say so in ``_never`` (message) and ``_why`` (details).
    """
    if "_never" not in replies.columns:
        replies = replies.withColumn("_never", F.lit(None).cast("string"))
        replies = replies.withColumn("_why", F.lit(None).cast("map<string,string>"))
    read = settle(replies, _p=F.when(F.col("_never").isNull(), parse_object(F.col("reply_text"), strict)))
    record, bad = F.col("_p.record"), F.col("_p.record").isNull()
    said = field_of(record, "status")["text"]
    known = F.coalesce(said.isin("pass", "fail", "needs_review"), F.lit(False))
    status = F.when(~bad & known, said).otherwise("needs_review")
    own = field_of(record, "analyst_message")
    message = (
        F.when(F.col("_never").isNotNull(), F.col("_never"))
        .when(bad, F.concat(F.lit(fv.MSG_REPLY_UNREADABLE), F.col("_p.error")))
        .when(own.isNotNull(), own["text"])
        .otherwise(F.col("analyst_message"))
    )
    given = field_of(record, "details")
    details = F.when(F.col("_why").isNotNull(), F.col("_why")).when(bad, F.create_map(F.lit("raw"), F.substring("reply_text", 1, fv.CONDITION_RAW_CHARS))).otherwise(
        F.coalesce(
            F.from_json(F.when(given["kind"] == "object", given["text"]), "map<string,string>"),
            F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"),
        )
    )
    return _model_result(read, status, F.when(status == "pass", "info").otherwise(F.col("severity")), message, details)


def check_with_model(
    cases: DataFrame, docs: DataFrame, cfg: ReviewConfig, ask: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """One result row per case and model condition; ``ask`` adds ``raw_response, error`` to prompts."""
    prompts = model_condition_prompts(cases, docs, cfg)
    screened = input_verdict(prompts, "prompt", cfg, prompt_length=F.col("prompt_chars"))
    columns = ["case_id", "country_code", "condition_seq", "condition_name", "severity", "analyst_message", "sources_used"]
    made = ask(screened.select(*columns, "prompt", "in_passed", "in_reason"))
    never = (
        F.when(F.col("sources_used").isNull(), fv.MSG_NO_SOURCES)
        .when(~F.col("in_passed"), F.concat(F.lit(fv.MSG_PROMPT_BLOCKED), "in_reason"))
        .when(F.col("error").isNotNull(), F.concat(F.lit(fv.MSG_MODEL_ERROR), "error"))
    )
    why = (
        F.when(F.col("sources_used").isNull(), F.create_map(F.lit("reason"), F.lit("missing_sources")))
        .when(~F.col("in_passed"), F.create_map(F.lit("blocked"), F.lit("True")))
        .when(F.col("error").isNotNull(), F.create_map(F.lit("error"), F.col("error")))
    )
    answered = output_verdict(made.withColumn("_never", never).withColumn("_why", why), "raw_response", cfg)
    return parse_condition_reply(answered)


def check_all(
    cases: DataFrame, docs: DataFrame, cfg: ReviewConfig, ask: Callable[[DataFrame], DataFrame], as_of: dt.date
) -> DataFrame:
    """Results of all conditions, by rule and by model; conditions of another check type give no rows."""
    return deterministic_results(docs, cfg, as_of).unionByName(check_with_model(cases, docs, cfg, ask))
