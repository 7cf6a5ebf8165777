"""Review configuration: read from a YAML folder or taken from the default country.

The folder holds ``countries/<country>/{classification.yaml, doc_types/, conditions/, process/}``,
``guardrails/{global,pii_patterns}.yaml`` and ``pipelines/``. Configuration is small and written by hand,
so it lives on the driver; jobs see it as broadcast tables or as literals in column expressions.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from string import Formatter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.scale import config_table

log = logging.getLogger(__name__)

DEFAULT_PIPELINE = "single_doc_extraction"

CONDITION_SCHEMA = (
    "country string, process_type string, condition_seq int, condition_name string, description string, "
    "applies_to array<string>, check_type string, field string, operator string, value string, "
    "sources array<string>, llm_logic string, on_fail string, severity string, analyst_message string, "
    "months int, months_error string, value_message string, missing_message string"
)
CATEGORY_SCHEMA = (
    "country string, process_type string, pos int, category string, doc_types array<string>, min_required int, "
    "max_accepted int, description string"
)
REQUIREMENT_SCHEMA = (
    "pos int, category string, doc_types array<string>, min_required int, max_accepted int, role string, "
    "condition string, temporal_constraints map<string,int>"
)
REQUIREMENT_TABLE = f"country string, process_type string, {REQUIREMENT_SCHEMA}"

# Stand-ins for the two values a message may name; a number that is to be formatted has its format in between.
FIELD_MARK, DOC_MARK, FORMAT_MARKS = "\ue000", "\ue001", ("\ue002", "\ue003")
NUMBER_FORMAT = re.compile(r"(,?)\.(\d+)f|(,?)d")


def format_mark(spec: str) -> str:
    return spec.join(FORMAT_MARKS)


def _message(template: str, marks: dict[str, str]) -> str | None:
    """The message with its placeholders marked; null when it names anything else and cannot be filled in."""
    out = []
    try:
        for text, name, spec, conversion in Formatter().parse(template):
            out.append(text)
            if name is None:
                continue
            mark = marks[name]
            if mark == FIELD_MARK and spec and not conversion:
                if not NUMBER_FORMAT.fullmatch(spec):
                    return None
                mark = format_mark(spec)
            elif spec:
                mark = format(mark, spec)
            out.append(mark)
    except (KeyError, ValueError):
        return None
    return "".join(out)


def condition_row(value: Any = None, **row: Any) -> dict:
    """A condition row; what depends on the configuration alone is settled here, once."""
    months, problem = None, None
    if row["operator"] == "within_months":
        try:
            months = int(value)
        except (TypeError, ValueError) as exc:
            problem = str(exc)
    name = row["field"] or ""
    return dict(
        row,
        value=None if row["check_type"] != "deterministic" else str(value),
        months=months,
        months_error=problem,
        value_message=_message(row["analyst_message"], {name: FIELD_MARK}),
        missing_message=_message(row["analyst_message"], {name: "MISSING", "doc_id": DOC_MARK}),
    )


@dataclass
class ReviewConfig:
    countries: dict[str, str] = field(default_factory=dict)  # folder name -> country code
    doc_types: list[dict] = field(default_factory=list)
    schemas: list[dict] = field(default_factory=list)  # country, doc_type, schema_country, business_unit
    fields: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    conditions: list[dict] = field(default_factory=list)
    categories: list[dict] = field(default_factory=list)
    requirements: list[dict] = field(default_factory=list)  # of the processes, with country and process_type
    validations: list[dict] = field(default_factory=list)  # cross-validation rules of the processes
    steps: list[dict] = field(default_factory=list)
    processes: list[dict] = field(default_factory=list)  # country, process_type, pipeline, business_unit
    country_conditions: dict[str, list[dict]] = field(default_factory=dict)  # all condition files, for processes without a file
    guards: dict = field(default_factory=dict)
    pii: list[dict] = field(default_factory=list)

    # Broadcast tables -----------------------------------------------------------------------------
    def country_table(self, spark: SparkSession) -> DataFrame:
        rows = [{"country": c, "country_code": code} for c, code in self.countries.items()]
        return config_table(spark, rows, "country string, country_code string")

    def schema_table(self, spark: SparkSession) -> DataFrame:
        return config_table(
            spark, self.schemas, "country string, doc_type string, schema_country string, business_unit string"
        )

    def condition_table(self, spark: SparkSession) -> DataFrame:
        return config_table(spark, self.conditions, CONDITION_SCHEMA)

    def category_table(self, spark: SparkSession) -> DataFrame:
        return config_table(spark, self.categories, CATEGORY_SCHEMA)

    def requirement_table(self, spark: SparkSession) -> DataFrame:
        return config_table(spark, self.requirements, REQUIREMENT_TABLE)

    # Plan-time access -----------------------------------------------------------------------------
    def pii_patterns(self) -> list[dict]:
        """Global patterns first, then those of each country, in the order they are applied."""
        return sorted(self.pii, key=lambda p: (p["scope"] != "global", p["scope"], p["pos"]))

    def covering(self, cases: DataFrame) -> ReviewConfig:
        """The configuration with the conditions of the cases' processes that have no file: all of their country's.

        What is collected are the names of processes, which are as few as an institution has.
        """
        known = {(p["country"], p["process_type"]) for p in self.processes}
        known |= {(c["country"], c["process_type"]) for c in self.conditions}
        pairs = cases.select("country", "process_type").distinct().where(F.col("country").isin(list(self.country_conditions)))
        more = [
            dict(c, process_type=r.process_type)
            for r in sorted(pairs.collect(), key=str)
            if r.process_type is not None and (r.country, r.process_type) not in known
            for c in self.country_conditions[r.country]
        ]
        return replace(self, conditions=[*self.conditions, *more]) if more else self

    def default_process(self) -> tuple[str, str] | None:
        """Country and process of a case that names none: of the only process file, else the package's own, if it is there."""
        known = [(p["country"], p["process_type"]) for p in self.processes]
        own = (fv.COUNTRY, fv.PROCESS)
        return known[0] if len(known) == 1 else own if not known or own in known else None

    def filled(self, cases: DataFrame, process: tuple[str, str] | None = None) -> DataFrame:
        """Cases with the country and the process type of ``process`` (else the default one) where they have none."""
        given = process or self.default_process()
        if given is None:
            return cases
        named = dict(zip(("country", "process_type"), given, strict=True))
        return cases.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", v).otherwise(F.col(c)) for c, v in named.items()})

    def pipelines(self) -> list[str]:
        """Names of the extraction pipelines that processes use; the default comes first."""
        return list(dict.fromkeys([DEFAULT_PIPELINE, *(p["pipeline"] for p in self.processes)]))

    def pipeline_of(self, country: Column, process_type: Column) -> Column:
        """The pipeline a process file names, else the default one."""
        out = F.lit(DEFAULT_PIPELINE)
        for p in self.processes:
            out = F.when((country == p["country"]) & (process_type == p["process_type"]), p["pipeline"]).otherwise(out)
        return out

    def steps_of(self, pipeline: str) -> list[dict]:
        return sorted((s for s in self.steps if s["pipeline"] == pipeline), key=lambda s: s["pos"])


def default_config() -> ReviewConfig:
    """The default country, built from the fixed values."""
    c = ReviewConfig(countries={fv.COUNTRY: fv.COUNTRY_CODE}, guards=fv.GUARDS)
    for pos, t in enumerate(fv.DOC_TYPES):
        c.doc_types.append(dict(t, country=fv.COUNTRY, pos=pos))
        c.schemas.append(
            dict(country=fv.COUNTRY, doc_type=t["name"], schema_country=fv.COUNTRY_CODE, business_unit=fv.BUSINESS_UNIT)
        )
    every = [(doc_type, f) for doc_type, fields in fv.FIELDS.items() for f in fields]
    for pos, (doc_type, (name, kind, required, alias)) in enumerate(every):
        c.fields.append(
            dict(
                country=fv.COUNTRY, doc_type=doc_type, pos=pos, name=name, type=kind, required=required, pattern=None,
                alias=alias, reasoning=None,
            )
        )
    for pos, rule in enumerate(fv.RULES):
        c.rules.append(dict(rule, country=fv.COUNTRY, pos=pos))
    where = dict(country=fv.COUNTRY, process_type=fv.PROCESS)
    by_rule = dict(check_type="deterministic", sources=None, llm_logic=None)
    by_model = dict(check_type="llm_assisted", applies_to=[], field=None, operator=None)
    for given, rest in [*((g, by_rule) for g in fv.DATE_CONDITIONS), *((g, by_model) for g in fv.MODEL_CONDITIONS)]:
        row = {k: v for k, v in given.items() if k != "name"}
        c.conditions.append(condition_row(**where, **rest, **row, condition_seq=len(c.conditions), condition_name=given["name"]))
    for pos, category in enumerate(fv.REQUIRED_CATEGORIES):
        c.categories.append(dict(where, **category, pos=pos))
    for pos, step in enumerate(fv.EXTRACTION_STEPS):
        c.steps.append(dict(step, pipeline=DEFAULT_PIPELINE, backend_key="default", pos=pos, output_schema=None))
    for scope, patterns in [("global", fv.PII_GLOBAL), *fv.PII_BY_COUNTRY_CODE.items()]:
        for pos, (name, pattern, replacement, sensitivity) in enumerate(patterns):
            c.pii.append(
                dict(scope=scope, pos=pos, name=name, pattern=pattern, replacement=replacement, sensitivity=sensitivity)
            )
    return c


def _read_yaml(path: Path) -> dict:
    """A missing file reads as an empty record."""
    if not path.exists():
        return {}
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise RuntimeError("reading a configuration folder needs PyYAML") from exc
    with path.open(encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def load_requirements(path: str | Path) -> list[dict]:
    """Document requirements of one process file."""
    return _requirements(_read_yaml(Path(path)))


def _requirements(process: dict) -> list[dict]:
    rows = []
    for pos, (category, r) in enumerate((process.get("document_requirements") or {}).items()):
        limits = {t: (c or {}).get("min_count", 1) for t, c in (r.get("temporal_constraints") or {}).items()}
        rows.append(
            dict(
                pos=pos, category=category, doc_types=r["doc_types"], min_required=r["min_required"],
                max_accepted=r["max_accepted"], role=r.get("role"), condition=r.get("condition"),
                temporal_constraints=limits,
            )
        )
    return rows


def _validations(process: dict) -> list[dict]:
    """Cross-validation rules of a process; what a rule does when it fails is its severity."""
    return [
        dict(
            pos=pos, name=r["name"], description=r.get("description", ""), fields=r.get("fields") or r.get("sources") or [],
            severity=r.get("on_fail", "flag_for_review"),
        )
        for pos, r in enumerate(process.get("cross_validation_rules") or [])
    ]


def load_steps(path: str | Path) -> list[dict]:
    """Steps of one extraction file, in order, with defaults filled in."""
    raw = _read_yaml(Path(path))
    return [
        dict(
            pipeline=raw["name"], backend_key=raw.get("backend_key", "default"), pos=pos, name=s["name"],
            retry_on_failure=s.get("retry_on_failure", True), max_retries=s.get("max_retries", fv.STEP_MAX_RETRIES),
            use_reflection=s.get("use_reflection", True), output_schema=s.get("output_schema"),
            temperature=float(s.get("temperature", 0.0)),
            inject_previous_results=s.get("inject_previous_results", True),
        )
        for pos, s in enumerate(raw.get("steps", []))
    ]


def _conditions_of(folder: Path, country: str, process_type: str, files: list[str]) -> list[dict]:
    rows: list[dict] = []
    for name in files:
        path = folder / "conditions" / f"{name}.yaml"
        if not path.exists():
            log.warning("condition file %s not found, skipped", path)
            continue
        for item in _read_yaml(path).get("conditions", []):
            logic = item.get("logic")
            rows.append(
                condition_row(
                    country=country, process_type=process_type, condition_seq=len(rows), condition_name=item["name"],
                    description=item["description"], applies_to=item.get("applies_to") or [],
                    check_type=item.get("check_type", "deterministic"), field=(logic or {}).get("field", ""),
                    operator=(logic or {}).get("operator", ""), value=(logic or {}).get("value"),
                    sources=item.get("sources"), llm_logic=item.get("llm_logic"),
                    on_fail=item.get("on_fail", "needs_review"), severity=item.get("severity", "warning"),
                    analyst_message=item.get("analyst_message", ""),
                )
            )
    return rows


def load_config(folder: str | Path, extra_processes: dict[str, list[str]] | None = None) -> ReviewConfig:
    """Read a configuration folder.

    Process types without a process file use every condition file of the country and require no category; a review
    finds them in its cases (``ReviewConfig.covering``). ``extra_processes`` names some per country beforehand.
    """
    root = Path(folder)
    guards = _read_yaml(root / "guardrails" / "global.yaml")
    c = ReviewConfig(guards=guards or fv.GUARDS)
    pii = _read_yaml(root / "guardrails" / "pii_patterns.yaml")
    for scope, patterns in [("global", pii.get("global", [])), *pii.get("country_specific", {}).items()]:
        for pos, p in enumerate(patterns):
            c.pii.append(
                dict(
                    scope=scope, pos=pos, name=p["name"], pattern=p["pattern"], replacement=p["replacement"],
                    sensitivity=p.get("sensitivity", "medium"),
                )
            )
    names = {}  # of pipelines, by file
    for path in sorted((root / "pipelines").glob("*.yaml")):
        steps = load_steps(path)
        c.steps.extend(steps)
        names[path.stem] = steps[0]["pipeline"] if steps else path.stem
    for land in sorted(p for p in (root / "countries").glob("*") if p.is_dir()):
        country = land.name
        raw = _read_yaml(land / "classification.yaml")
        c.countries[country] = raw.get("country", country)
        for pos, t in enumerate(raw.get("document_types", [])):
            c.doc_types.append(
                dict(
                    country=country, pos=pos, name=t["name"], description=t.get("description"),
                    key_indicators=t.get("key_indicators", []),
                )
            )
        for path in sorted((land / "doc_types").glob("*.yaml")):
            raw = _read_yaml(path)
            doc_type = path.stem
            c.schemas.append(
                dict(
                    country=country, doc_type=doc_type, schema_country=raw.get("country", country),
                    business_unit=raw.get("business_unit", "general"),
                )
            )
            for pos, f in enumerate(raw.get("fields", [])):
                c.fields.append(
                    dict(
                        country=country, doc_type=doc_type, pos=pos, name=f["name"], type=f["type"],
                        required=f.get("required", False), pattern=f.get("pattern"), alias=f.get("alias") or [],
                        reasoning=f.get("reasoning"),
                    )
                )
            for pos, r in enumerate(raw.get("rules") or []):
                c.rules.append(
                    dict(
                        country=country, doc_type=doc_type, pos=pos, condition=r.get("condition", ""),
                        action=r.get("action", "unknown"), severity=r.get("severity", "info"),
                    )
                )
        for path in sorted((land / "process").glob("*.yaml")):
            raw = _read_yaml(path)
            process_type = path.stem
            file = Path(raw.get("pipeline_config", DEFAULT_PIPELINE)).stem
            unit = raw.get("business_unit", "general")
            c.processes.append(dict(country=country, process_type=process_type, pipeline=names.get(file, file), business_unit=unit))
            where = dict(country=country, process_type=process_type)
            c.requirements.extend(where | r for r in _requirements(raw))
            c.validations.extend(where | r for r in _validations(raw))
            c.conditions.extend(_conditions_of(land, country, process_type, raw.get("condition_files", [])))
            for pos, r in enumerate(raw.get("required_categories", [])):
                category = r.get("category", "")
                c.categories.append(
                    dict(
                        country=country, process_type=process_type, pos=pos, category=category,
                        doc_types=r.get("doc_types", []),
                        min_required=r.get("min_required", fv.DEFAULT_MIN_REQUIRED),
                        max_accepted=r.get("max_accepted", fv.DEFAULT_MAX_ACCEPTED),
                        description=r.get("description", category),
                    )
                )
        files = sorted(p.stem for p in (land / "conditions").glob("*.yaml"))
        c.country_conditions[country] = _conditions_of(land, country, "", files)
        for process_type in (extra_processes or {}).get(country, []):
            if not (land / "process" / f"{process_type}.yaml").exists():
                c.conditions.extend(dict(row, process_type=process_type) for row in c.country_conditions[country])
    return c
