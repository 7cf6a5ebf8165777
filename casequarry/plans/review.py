"""A whole review: classify, check completeness, extract, check conditions, report.

Phases meet in joins on document or case keys, over all cases at once. Tables that hold model replies
are written to the shared folder before they are used again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry.operators.classify import apply_classification, apply_overrides, classify
from casequarry.operators.completeness import category_issues, process_requirement_issues
from casequarry.operators.conditions import check_all
from casequarry.operators.model import run_steps
from casequarry.operators.narrative import narratives
from casequarry.operators.report import ReportTables, inventory, report_tables
from casequarry.operators.stepdata import extraction_eligibility, extraction_status
from casequarry.scale import cut_lineage
from casequarry.sources.config import DEFAULT_PIPELINE, ReviewConfig
from casequarry.sources.intake import attach_case

Ask = Callable[[DataFrame], DataFrame]


@dataclass
class ModelSteps:
    """Who answers which prompts; each adds ``raw_response, error`` to its rows."""

    classify: Ask
    extract: Ask
    conditions: Ask
    narrative: Ask


@dataclass
class Review:
    documents: DataFrame
    classifications: DataFrame
    completeness_issues: DataFrame
    requirement_issues: DataFrame
    step_results: DataFrame
    traces: DataFrame
    condition_results: DataFrame
    tables: ReportTables


def _extract(ready: DataFrame, cfg: ReviewConfig, ask: Ask, pipeline: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the steps of each pipeline over its documents; there are as many runs as pipelines."""
    if pipeline is not None or len(cfg.pipelines()) == 1:
        return run_steps(ready, cfg.steps_of(pipeline or DEFAULT_PIPELINE), ask, cfg)
    own = cfg.pipeline_of(F.col("country"), F.col("process_type"))
    done = [run_steps(ready.where(own == name), cfg.steps_of(name), ask, cfg) for name in cfg.pipelines()]
    return tuple(reduce(DataFrame.unionByName, tables) for tables in zip(*done, strict=True))


def review_cases(
    cases: DataFrame,
    docs: DataFrame,
    cfg: ReviewConfig,
    model: ModelSteps,
    as_of: dt.date,
    overrides: DataFrame | None = None,
    pipeline: str | None = None,
    generated_at: dt.datetime | None = None,
    respect_overrides: bool = True,
    started_at: dt.datetime | None = None,
    process: tuple[str, str] | None = None,
) -> Review:
    """Review all cases. Each is extracted by the pipeline that its process names, unless ``pipeline`` names one for all.

    ``started_at`` is when the run begins: overrides made later do not count in it. Cases without a country or a process
    type take those of ``process`` (country, process type), else of the configuration's only or default process.
    """
    cases = cfg.filled(cases, process)
    cfg = cfg.covering(cases)
    base = attach_case(docs, cases, cfg)
    classifications = cut_lineage(classify(base, cfg, model.classify), "classifications")
    typed = apply_classification(base, classifications)
    if overrides is not None:
        typed, classifications = apply_overrides(typed, classifications, overrides, respect_overrides, started_at)
        typed = typed.drop("old_type")
    missing = category_issues(cases, typed, cfg)
    eligible = extraction_eligibility(typed, cfg)
    ready = eligible.where("skip_reason IS NULL")
    extracted, step_results, traces = _extract(ready, cfg, model.extract, pipeline)
    done = cut_lineage(extraction_status(eligible, extracted).drop("text_content"), "documents")
    results = cut_lineage(check_all(cases, done, cfg, model.conditions, as_of), "conditions")
    words = cut_lineage(narratives(cases, inventory(done, classifications), results, cfg, model.narrative), "narratives")
    tables = report_tables(cases, done, classifications, results, words, generated_at)
    required = process_requirement_issues(cases, done, cfg)
    return Review(done, classifications, missing, required, step_results, traces, results, tables)
