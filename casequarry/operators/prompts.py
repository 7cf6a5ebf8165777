"""Prompts as column expressions.

The wording is ours; the data in a prompt, its order and its limits follow the review rules. Blocks that
depend on configuration only are written once on the driver and joined as a broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.values import empty_record, field_of, json_cell, record_json
from casequarry.scale import bounded_text, config_table, paired_parts, settle, text_parts
from casequarry.sources.config import ReviewConfig

FENCE = "\n```\n"

CLASSIFY_HEAD = "Identify the type of this financial document.\nCountry: "
CLASSIFY_TYPES = "\n\nRegistered types:\n"
CLASSIFY_TEXT = "\n\nStart of the document:" + FENCE
CLASSIFY_TAIL = (
    FENCE + "\nAnswer with one JSON object: detected_type (a registered type, or "
    f"{fv.NEEDS_MANUAL} below a confidence of {fv.CONFIDENCE_THRESHOLD}), confidence (0 to 1), "
    "alternative_types (list of type and confidence), reasoning (short)."
)
EXTRACT_TAIL = FENCE + "\nAnswer with one JSON object keyed by field name; use null for a required field that is missing."
CONDITION_TAIL = (
    '\n\nAnswer with one JSON object: status ("pass", "fail" or "needs_review"), analyst_message (text), '
    "details (object)."
)
SUMMARY_TAIL = (
    "\n\nWrite three to five plain paragraphs for the analyst: documents received, completeness and freshness, "
    "main findings, overall recommendation. Recommend and suggest only; do not decide on credit."
)
REFLECT_TAIL = "\n\nCorrect the answer. Reply with valid JSON of the expected form only."
VALIDATE_TAIL = (
    "\n\nCheck every rule. Answer with one JSON object: validations (list of rule_name, passed, details, severity)."
)
SEMANTIC_TAIL = (
    "\n\nAnswer with one JSON object: is_consistent (true or false), canonical_value, variations_explained, "
    "confidence (0 to 1)."
)
CONTRADICTION_TAIL = (
    "\n\nLook for conflicting income, employment, dates, addresses, debts and other facts. Answer with one JSON "
    "object: contradictions_found (true or false), contradictions (list of type, severity, description, "
    "documents_involved, fields_involved, fraud_signal), overall_risk_assessment, recommendation."
)
ENTITY_TAIL = (
    "\n\nAllow for spelling, transliteration, abbreviations and formats of dates and addresses. Answer with one "
    "JSON object: is_same_entity (true or false), confidence (0 to 1), matching_fields, mismatching_fields, reasoning."
)


def type_blocks(cfg: ReviewConfig) -> dict[str, str]:
    """Registered types of each country as prompt lines."""
    blocks: dict[str, list[str]] = {}
    for t in sorted(cfg.doc_types, key=lambda t: (t["country"], t["pos"])):
        words = ", ".join(t["key_indicators"])
        blocks.setdefault(t["country"], []).append(f"- {t['name']}: {t['description']} [indicators: {words}]")
    return {country: "\n".join(lines) for country, lines in blocks.items()}


def schema_blocks(cfg: ReviewConfig) -> dict[tuple[str, str], str]:
    """Fields and rules of each schema as the opening of an extraction prompt."""
    blocks = {}
    for s in cfg.schemas:
        key = (s["country"], s["doc_type"])
        mine = [f for f in sorted(cfg.fields, key=lambda f: f["pos"]) if (f["country"], f["doc_type"]) == key]
        rules = [r for r in sorted(cfg.rules, key=lambda r: r["pos"]) if (r["country"], r["doc_type"]) == key]
        lines = [f"Extract data from a {s['schema_country']} {s['doc_type']} document.", "", "Fields:"]
        for f in mine:
            if not f["reasoning"]:
                marks = [f["type"], *(["required"] if f["required"] else [])]
                if f["alias"]:
                    marks.append("aliases: " + "/".join(f["alias"]))
                lines.append(f"- {f['name']} ({', '.join(marks)})")
        thought = [f"- {f['name']}: {f['reasoning']}" for f in mine if f["reasoning"]]
        if thought:
            lines += ["", "Fields that need reasoning:", *thought]
        if rules:
            lines += ["", "Rules:", *[f"- {r['condition']}: {r['action']} (severity: {r['severity']})" for r in rules]]
        blocks[key] = "\n".join(lines)
    return blocks


def classification_prompts(docs: DataFrame, cfg: ReviewConfig, text_chars: int = fv.CLASSIFIER_TEXT_CHARS) -> DataFrame:
    """Adds ``prompt``: country, registered types, first characters of the text. Null without registered types."""
    rows = [{"country": c, "_types": b} for c, b in type_blocks(cfg).items()]
    types = config_table(docs.sparkSession, rows, "country string, _types string")
    prompt = F.concat(
        F.lit(CLASSIFY_HEAD),
        F.col("country"),
        F.lit(CLASSIFY_TYPES),
        F.col("_types"),
        F.lit(CLASSIFY_TEXT),
        F.substring("text_content", 1, text_chars),
        F.lit(CLASSIFY_TAIL),
    )
    return docs.join(types, "country", "left").select(*docs.columns, prompt.alias("prompt"))


def with_schema(docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Adds ``schema_key`` (the country whose schema applies, or ``_defaults``) and ``schema_country,
    business_unit``; null when neither has a schema for the document type."""
    spark = docs.sparkSession
    own = cfg.schema_table(spark).select(
        "country", "doc_type", F.struct(F.col("country").alias("key"), "schema_country", "business_unit").alias("_own")
    )
    fallback = F.broadcast(
        cfg.schema_table(spark)
        .where(F.col("country") == "_defaults")
        .select("doc_type", F.struct(F.col("country").alias("key"), "schema_country", "business_unit").alias("_std"))
    )
    found = F.coalesce("_own", "_std")
    return (
        docs.join(F.broadcast(own), ["country", "doc_type"], "left")
        .join(fallback, "doc_type", "left")
        .select(
            *docs.columns,
            found["key"].alias("schema_key"),
            found["schema_country"].alias("schema_country"),
            found["business_unit"].alias("business_unit"),
        )
    )


def context_lines(record: Column) -> Column:
    """A record of earlier results as prompt lines."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_keys(record)), lambda k: F.concat(F.lit("- "), k, F.lit(": "), json_cell(field_of(record, k)))
        ),
        "\n",
    )


def extraction_prompts(docs: DataFrame, cfg: ReviewConfig, previous_col: str | None = None) -> DataFrame:
    """Adds ``prompt``: fields, rules, earlier results, whole text. Null when no schema applies."""
    rows = [{"schema_key": c, "doc_type": t, "_block": b} for (c, t), b in schema_blocks(cfg).items()]
    blocks = config_table(docs.sparkSession, rows, "schema_key string, doc_type string, _block string")
    base = docs if "schema_key" in docs.columns else with_schema(docs, cfg)
    earlier = F.lit("")
    if previous_col:
        has = F.size(F.coalesce(F.col(previous_col), empty_record())) > 0
        earlier = F.when(has, F.concat(F.lit("\n\nEarlier results:\n"), context_lines(F.col(previous_col)))).otherwise("")
    prompt = F.concat(
        F.col("_block"),
        earlier,
        F.lit("\n\nDocument:" + FENCE),
        F.coalesce(F.col("text_content"), F.lit("")),
        F.lit(EXTRACT_TAIL),
    )
    return base.join(blocks, ["schema_key", "doc_type"], "left").select(*base.columns, prompt.alias("prompt"))


def reflection_prompt(step: Column, prompt: Column, reply: Column, error: Column, context: Column | None = None) -> Column:
    """Ask again, with the failed answer and its errors."""
    return F.concat(
        F.lit("A step failed and has to be corrected.\nStep: "),
        step,
        F.lit("\n\nOriginal prompt:\n"),
        prompt,
        F.lit("\n\nFailed answer:\n"),
        F.coalesce(reply, F.lit("")),
        F.lit("\n\nErrors:\n- "),
        error,
        F.lit("\n\nContext:\n"),
        context if context is not None else F.lit(""),
        F.lit(REFLECT_TAIL),
    )


def condition_prompts(gathered: DataFrame, max_chars: int) -> DataFrame:
    """One prompt per case and condition from the gathered source blocks.

    ``gathered`` has ``case_id, condition_name, description, sources, llm_logic, source_blocks`` (ordered
    text per source type, null when a block is too long) and ``source_chars``. Adds ``prompt`` (null when
    it would be longer than ``max_chars``) and ``prompt_chars``, its exact length.
    """
    has_sources = F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0
    head = F.concat(
        F.when(has_sources, "Check that documents agree with each other.").otherwise("Check a condition on documents."),
        F.lit("\nName: "),
        F.col("condition_name"),
        F.lit("\nDescription: "),
        F.col("description"),
        F.when(has_sources, F.concat(F.lit("\nSources: "), F.array_join("sources", ", "))).otherwise(""),
        F.when(F.coalesce("llm_logic", F.lit("")) != "", F.concat(F.lit("\nLogic: "), "llm_logic")).otherwise(""),
        F.lit("\n\nData:\n"),
    )
    chars = F.length(head) + F.col("source_chars") + len(CONDITION_TAIL)
    text = F.concat(head, F.array_join("source_blocks", "\n"), F.lit(CONDITION_TAIL))
    return gathered.withColumn("prompt_chars", chars).withColumn(
        "prompt", F.when(F.col("prompt_chars") <= max_chars, text)
    )


def summary_prompts(cases: DataFrame, inventory: DataFrame, results: DataFrame, max_chars: int) -> DataFrame:
    """Case facts, inventory lines and condition lines; (case_id, prompt, prompt_chars).

    Lines are only put together for cases whose prompt stays within ``max_chars``; for the others the
    exact length is enough to block them.
    """
    confidence = F.coalesce(F.col("classification_confidence").cast("string"), F.lit("None"))
    doc_lines = inventory.select(
        "case_id",
        F.col("doc_seq").alias("seq"),
        F.concat(
            F.lit("- "), "file_name", F.lit(" -> "), "classified_as", F.lit(" (confidence: "), confidence, F.lit(")")
        ).alias("line"),
    )
    result_lines = results.select(
        "case_id",
        "condition_seq",
        "type_pos",
        F.coalesce("doc_seq", F.lit(0)).alias("seq"),
        F.concat(
            F.lit("- ["), F.upper("status"), F.lit("] "), "condition_name", F.lit(": "), "analyst_message"
        ).alias("line"),
    )
    docs = bounded_text(doc_lines, ["case_id"], ["seq"], "line", max_chars)
    checks = bounded_text(result_lines, ["case_id"], ["condition_seq", "type_pos", "seq"], "line", max_chars)
    docs = docs.select("case_id", F.col("line_count").alias("_dn"), F.col("chars").alias("_dc"), F.col("text").alias("_dt"))
    checks = checks.select("case_id", F.col("line_count").alias("_cn"), F.col("chars").alias("_cc"), F.col("text").alias("_ct"))
    head = F.concat(
        F.lit("Write a summary of this case for an analyst.\nCase: "),
        F.col("case_id"),
        F.lit("\nCountry: "),
        F.col("country"),
        F.lit("\nProcess: "),
        F.col("process_type"),
        F.lit("\n\nDocuments ("),
        F.coalesce("_dn", F.lit(0)).cast("string"),
        F.lit("):\n"),
    )
    middle = "\n\nChecks:\n"
    chars = (
        F.length(head) + F.coalesce("_dc", F.lit(0)) + len(middle) + F.coalesce("_cc", F.lit(0)) + len(SUMMARY_TAIL)
    )
    text = F.concat(
        head,
        F.when(F.col("_dn").isNull(), "").otherwise(F.col("_dt")),
        F.lit(middle),
        F.when(F.col("_cn").isNull(), "").otherwise(F.col("_ct")),
        F.lit(SUMMARY_TAIL),
    )
    return (
        cases.join(docs, "case_id", "left")
        .join(checks, "case_id", "left")
        .withColumn("prompt_chars", chars)
        .select("case_id", "prompt_chars", F.when(F.col("prompt_chars") <= max_chars, text).alias("prompt"))
    )


def document_lines(docs: DataFrame) -> DataFrame:
    """One line per extracted document: ``type.doc_id: {data}``."""
    extracted = docs.where(F.col("status") == fv.DOC_EXTRACTED).select("case_id", "doc_seq", "doc_type", "doc_id", "extracted_data")
    # Settled, for a filter on the record's size would make the record again.
    held = settle(extracted, _data=F.col("extracted_data"))
    return held.where(F.size("_data") > 0).select(
        "case_id",
        "doc_seq",
        F.concat("doc_type", F.lit("."), "doc_id", F.lit(": "), record_json(F.col("_data"))).alias("line"),
    )


def _rule_lines(rules: list[dict]) -> str:
    return "\n".join(
        f"- {r['name']}: {r['description']} [fields: {', '.join(r['fields'])}; severity: {r['severity']}]"
        for r in sorted(rules, key=lambda r: r.get("pos", 0))
    )


def cross_validation_prompts(cases: DataFrame, docs: DataFrame, rules: list[dict], max_chars: int) -> DataFrame:
    """Documents of a case and the rules to check on them; (case_id, part, prompt).

    Rules with ``country`` and ``process_type`` are those of the cases of that process; a case without any is not asked
    about. Here and for contradictions, documents of more than ``max_chars`` are asked about in several prompts, such
    that any two documents are together in one.
    """
    if any("process_type" in r for r in rules):
        groups: dict[tuple[str, str], list[dict]] = {}
        for r in rules:
            groups.setdefault((r["country"], r["process_type"]), []).append(r)
        rows = [{"country": c, "process_type": p, "_rules": _rule_lines(g)} for (c, p), g in groups.items()]
        table = config_table(cases.sparkSession, rows, "country string, process_type string, _rules string")
        ruled = cases.join(table, ["country", "process_type"])
    else:
        ruled = cases.withColumn("_rules", F.lit(_rule_lines(rules)))
    lines = paired_parts(document_lines(docs), ["case_id"], ["doc_seq"], "line", max_chars)
    head = F.concat(F.lit("Validate the documents of a "), F.col("country"), F.lit(" case.\n\nDocuments:\n"))
    prompt = F.concat(head, "text", F.lit("\n\nRules:\n"), "_rules", F.lit(VALIDATE_TAIL))
    return ruled.join(lines, "case_id", "inner").select("case_id", "part", prompt.alias("prompt"))


def semantic_prompts(values: DataFrame, max_chars: int) -> DataFrame:
    """Values of one field across the documents of a case; (case_id, field, part, prompt).

    ``values``: case_id, field, doc_seq, source, value (text). Values of more than ``max_chars`` are asked about in several
    prompts, each value in one: the replies' canonical values are compared afterwards.
    """
    line = F.concat(F.lit("- "), "source", F.lit(": "), "value")
    lines = values.where(F.col("value").isNotNull()).withColumn("line", line)
    joined = text_parts(lines, ["case_id", "field"], ["doc_seq", "source"], "line", max_chars)
    head = F.concat(F.lit("Do these values of the field "), "field", F.lit(" mean the same?\n"))
    return joined.select("case_id", "field", "part", F.concat(head, "text", F.lit(SEMANTIC_TAIL)).alias("prompt"))


def contradiction_prompts(docs: DataFrame, max_chars: int, focus: list[str] | None = None) -> DataFrame:
    """All extracted data of a case; (case_id, part, prompt)."""
    lines = paired_parts(document_lines(docs), ["case_id"], ["doc_seq"], "line", max_chars)
    head = "Find contradictions between the documents of a credit case.\n\nDocuments:\n"
    tail = (f"\n\nFocus on: {', '.join(focus)}" if focus else "") + CONTRADICTION_TAIL
    return lines.select("case_id", "part", F.concat(F.lit(head), "text", F.lit(tail)).alias("prompt"))


def entity_prompts(pairs: DataFrame) -> DataFrame:
    """Adds ``prompt`` for each given pair of records ``entity_a, entity_b`` of an ``entity_type``."""
    prompt = F.concat(
        F.lit("Are these two "),
        F.col("entity_type"),
        F.lit(" records the same entity?\n\nA: "),
        record_json(F.col("entity_a")),
        F.lit("\nB: "),
        record_json(F.col("entity_b")),
        F.lit(ENTITY_TAIL),
    )
    return pairs.withColumn("prompt", prompt)
