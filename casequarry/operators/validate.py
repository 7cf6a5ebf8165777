"""Extracted fields against their declared types, and business rules over them."""

from __future__ import annotations

import datetime as dt
import logging
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry.functions.dates import parse_date
from casequarry.functions.text import unicode_space
from casequarry.functions.values import field_of, truthy
from casequarry.operators.prompts import with_schema
from casequarry.scale import config_table, lenient, mixes_types
from casequarry.sources.config import ReviewConfig

log = logging.getLogger(__name__)

_TYPE_WORDS = {"string": "str", "object": "dict"}


def _word(kind: Column) -> Column:
    out = kind
    for name, word in _TYPE_WORDS.items():
        out = F.when(kind == name, word).otherwise(out)
    return out


def validate_fields(docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Adds ``errors``: per declared field, missing, wrong type, or not matching its pattern."""
    specs: dict[tuple[str, str], list[dict]] = {}
    for f in sorted(cfg.fields, key=lambda f: f["pos"]):
        specs.setdefault((f["country"], f["doc_type"]), []).append(
            {k: f[k] for k in ("name", "type", "required", "pattern")}
        )
    rows = [{"schema_key": c, "doc_type": t, "_specs": s} for (c, t), s in specs.items()]
    table = config_table(
        docs.sparkSession,
        rows,
        "schema_key string, doc_type string, "
        "_specs array<struct<name:string,type:string,required:boolean,pattern:string>>",
    )
    patterns = sorted({f["pattern"] for f in cfg.fields if f["pattern"]})

    def check(spec: Column) -> Column:
        v = field_of(F.col("extracted_data"), spec["name"])
        text, kind = v["text"], v["kind"]
        absent = v.isNull() | (kind == "null")
        matches = F.lit(True)
        for p in patterns:  # literal patterns are compiled once, not per row
            matches = F.when(spec["pattern"] == p, text.rlike(rf"\A(?:{unicode_space(p)})")).otherwise(matches)

        def wrong(wanted: str) -> Column:
            return F.concat(spec["name"], F.lit(f": expected {wanted}, got "), _word(kind))

        found = F.array(
            F.when((spec["type"] == "float") & ~kind.isin("int", "float", "bool"), wrong("number")),
            F.when((spec["type"] == "boolean") & (kind != "bool"), wrong("boolean")),
            F.when((spec["type"] == "string") & (kind != "string"), wrong("string")),
            F.when(
                spec["pattern"].isNotNull() & (kind == "string") & ~matches,
                F.concat(spec["name"], F.lit(": '"), text, F.lit("' doesn't match pattern "), spec["pattern"]),
            ),
        )
        missing = F.when(spec["required"], F.concat(F.lit("Missing required field: "), spec["name"]))
        return F.when(absent, F.array(missing)).otherwise(found)

    base = docs if "schema_key" in docs.columns else with_schema(docs, cfg)
    errors = F.filter(F.flatten(F.transform("_specs", check)), lambda e: e.isNotNull())
    return base.join(table, ["schema_key", "doc_type"], "left").select(
        *docs.columns, F.coalesce(errors, F.array().cast("array<string>")).alias("errors")
    )


def rule_column(v: Column, kind: str, as_date: bool = False) -> Column:
    """A field's value as a rule sees it; a value of another type makes the rule fail to evaluate, that is null."""
    if kind == "boolean":
        return F.when(v.isNotNull(), truthy(v))
    if kind in ("float", "integer"):
        number = F.when(v["kind"].isin("int", "float"), v["text"].try_cast("double"))
        return number.when(v["kind"] == "bool", (v["text"] == "True").cast("double"))
    text = F.when(v["kind"] == "string", v["text"])
    return parse_date(text) if as_date else text


def triggered_rules(docs: DataFrame, cfg: ReviewConfig, as_of: dt.date | None = None) -> DataFrame:
    """Adds ``triggered``: ``action (severity: s)`` of each rule that holds, in order.

    Rules are SQL boolean expressions over the document's declared fields. A rule that names an absent
    field or cannot be evaluated is skipped; so is one that names ``today``, unless ``as_of`` is given.
    """
    base = docs if "schema_key" in docs.columns else with_schema(docs, cfg)
    work, cells = base, []
    for i, rule in enumerate(sorted(cfg.rules, key=lambda r: (r["country"], r["doc_type"], r["pos"]))):
        mine = (F.col("schema_key") == rule["country"]) & (F.col("doc_type") == rule["doc_type"])
        kinds = {
            f["name"]: f["type"]
            for f in cfg.fields
            if (f["country"], f["doc_type"]) == (rule["country"], rule["doc_type"]) and not f["name"].startswith("_")
        }
        used = [n for n in kinds if re.search(rf"\b{re.escape(n)}\b", rule["condition"])]
        sql, with_today = rule["condition"], re.search(r"\btoday\b", rule["condition"]) and as_of
        columns = {f"_r{i}_{n}": rule_column(field_of(F.col("extracted_data"), n), kinds[n], bool(with_today)) for n in used}
        for n in used:
            sql = re.sub(rf"\b{re.escape(n)}\b", f"`_r{i}_{n}`", sql)
        if with_today:
            sql = re.sub(r"\btoday\b", f"DATE '{as_of.isoformat()}'", sql)
        try:
            # Only the rule's own fields are in sight: a name from elsewhere must not resolve.
            mixed = mixes_types(base.select(*[c.alias(n) for n, c in columns.items()]), sql)
        except (AnalysisException, ParseException) as exc:
            log.warning("rule %r cannot be evaluated, skipped: %s", rule["condition"], str(exc).splitlines()[0])
            continue
        if mixed:
            log.warning("rule %r compares a text with another type, skipped", rule["condition"])
            continue
        present = mine
        for n in used:
            present = present & field_of(F.col("extracted_data"), n).isNotNull()
        work = work.withColumns(columns)
        with lenient(work.sparkSession):  # a division by zero skips the rule for its document
            work = work.withColumn(f"_holds{i}", F.coalesce(F.expr(sql).cast("boolean"), F.lit(False)))
        text = f"{rule['action']} (severity: {rule['severity']})"
        cells.append(F.when(present & F.col(f"_holds{i}"), text))
    triggered = F.filter(F.array(*cells).cast("array<string>"), lambda c: c.isNotNull())
    return work.select(*docs.columns, triggered.alias("triggered"))
