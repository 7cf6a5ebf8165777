"""The narrative of a report: written by the model, or the counted sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.text import strip
from casequarry.operators.guards import input_verdict, output_verdict
from casequarry.operators.prompts import summary_prompts
from casequarry.operators.report import fallback_narrative
from casequarry.sources.config import ReviewConfig


def narratives(
    cases: DataFrame,
    inventory: DataFrame,
    results: DataFrame,
    cfg: ReviewConfig,
    ask: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(case_id, narrative_summary). A blocked prompt or a model error falls back to the counted sentence."""
    limit = cfg.guards["input_guards"].get("max_prompt_length", 32000)
    prompts = summary_prompts(cases, inventory, results, limit)
    codes = cases.select("case_id", "country").join(cfg.country_table(cases.sparkSession), "country", "left")
    prompts = prompts.join(codes.select("case_id", "country_code"), "case_id")
    screened = input_verdict(prompts, "prompt", cfg, prompt_length=F.col("prompt_chars"))
    warm = F.lit(fv.NARRATIVE_TEMPERATURE).alias("temperature")
    made = ask(screened.select("case_id", "country_code", "prompt", "in_passed", warm))
    read = output_verdict(made, "raw_response", cfg)
    written = read.select("case_id", strip(F.col("reply_text")).alias("_written"))
    spare = fallback_narrative(cases, results)
    return spare.join(written, "case_id", "left").select(
        "case_id", F.coalesce("_written", "narrative_summary").alias("narrative_summary")
    )
