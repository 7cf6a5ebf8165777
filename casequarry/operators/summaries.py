"""Summaries of traces that can be added up: counts, and sketches of durations and of different problems.

A run summarises its own traces; summaries of runs, days or halves of a table merge to that of the whole, without reading a
trace again. Quantiles come from KLL sketches, numbers of different values from HLL sketches, both of the engine: a group
of any size is a few kilobytes, built in every task and merged by the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequarry import fixed_values as fv

#: Size of a quantile sketch; the rank of a quantile is off by about 1.3 % at 200, less for larger sketches.
SKETCH_SIZE = 400
#: 2 to the power of this many registers; a number of different values is off by about 1.6 % at 12.
REGISTERS_LOG2 = 12
BY = ("step_name", "doc_type", "day")
QUANTILES = (0.5, 0.95, 0.99)
_COUNTS = ("attempts", "successes", "terminal", "blocked", "timed")


def summarise_traces(traces: DataFrame, by: Sequence[str] = BY, key: str = "doc_id") -> DataFrame:
    """One row per group of traces (``trace_status, blocked, problem, duration_ms`` and the columns ``by``).

    A trace without a duration, as of a recorded reply, counts as an attempt and is in no quantile.
    """
    status = F.col("trace_status")
    return traces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(status == fv.TRACE_SUCCESS, 1)).alias("successes"),
        F.count(F.when(status == fv.TRACE_TERMINAL, 1)).alias("terminal"),
        F.count(F.when(F.col("blocked"), 1)).alias("blocked"),
        F.count("duration_ms").alias("timed"),
        F.kll_sketch_agg_double("duration_ms", SKETCH_SIZE).alias("durations"),
        F.hll_sketch_agg(F.when(status != fv.TRACE_SUCCESS, F.col("problem")), REGISTERS_LOG2).alias("problems"),
        F.hll_sketch_agg(F.col(key).cast("string"), REGISTERS_LOG2).alias("documents"),
    )


def merge_summaries(*summaries: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The summary of all that the given ones are of."""
    rows = reduce(DataFrame.unionByName, summaries)
    return rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.kll_merge_agg_double("durations", SKETCH_SIZE).alias("durations"),
        *[F.hll_union_agg(c).alias(c) for c in ("problems", "documents")],
    )


def _quantile(at: float) -> Column:
    return F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("durations", F.lit(at)))


def read_summary(summary: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Figures of each group: exact counts, estimated quantiles (``p50_ms`` ...) and numbers of different values."""
    return summary.select(
        *by,
        *_COUNTS,
        *[_quantile(q).alias(f"p{q * 100:.0f}_ms") for q in QUANTILES],
        F.hll_sketch_estimate("problems").alias("different_problems"),
        F.hll_sketch_estimate("documents").alias("documents"),
    )
