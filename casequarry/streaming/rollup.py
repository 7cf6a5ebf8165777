"""Running figures per case: documents, required categories, results, attention.

One grouping keeps the counts as state. Every batch puts the changed cases in their place in a keyed table
(``streaming/keyed.py``): it rewrites the buckets of these cases only, and a reader never sees half a batch.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casequarry.operators.conditions import check_deterministic, condition_targets
from casequarry.operators.report import final_status
from casequarry.sources.config import ReviewConfig
from casequarry.streaming import keyed


def _category_columns(cfg: ReviewConfig) -> dict[str, Column]:
    """Counts by category, over the processes that require it."""
    fits: dict[str, Column] = {}
    for c in cfg.categories:
        own = (F.col("country") == c["country"]) & (F.col("process_type") == c["process_type"])
        fit = own & (F.col("doc_type").isin(c["doc_types"]) | (F.col("category") == c["category"]))
        fits[c["category"]] = fits[c["category"]] | fit if c["category"] in fits else fit
    return {f"n_{name}": F.count(F.when((F.col("_kind") == "doc") & fit, 1)) for name, fit in fits.items()}


def case_rollup(docs: DataFrame, cfg: ReviewConfig, as_of: dt.date) -> DataFrame:
    """Figures per case from documents of all countries and processes; the same plan for tables and streams.

    A condition that cannot be run counts as one result to review in place of its documents' results, as soon as one of
    them reaches it.
    """
    none = F.lit(None).cast("string")
    facts = docs.select(
        "case_id", "country", "process_type", F.lit("doc").alias("_kind"), "doc_type", "category", none.alias("status"),
        none.alias("severity"), none.alias("_broken"), none.alias("_error"),
    )
    broken = [c["condition_name"] for c in cfg.conditions if c["months_error"]]
    checks = check_deterministic(condition_targets(docs, cfg), cfg, as_of).select(
        "case_id", none.alias("country"), none.alias("process_type"), F.lit("check").alias("_kind"), none.alias("doc_type"),
        none.alias("category"), "status", "severity", F.when(F.col("condition_name").isin(broken), F.col("condition_name")).alias("_broken"),
        F.col("_months_error").alias("_error"),
    )
    rows = reduce(DataFrame.unionByName, [facts, checks])
    figures = {
        "passed": F.col("status") == "pass",
        "blocking": (F.col("status") == "fail") & (F.col("severity") == "error"),
        "in_review": F.col("status") == "needs_review",
    }
    sound = F.col("_broken").isNull()
    kept = {f"_{n}_{k}": F.count(F.when((F.col("_broken") == name) & test, 1)) for k, name in enumerate(broken) for n, test in figures.items()}
    raised = {f"_raised_{k}": F.count(F.when(F.col("_broken") == name, F.col("_error"))) for k, name in enumerate(broken)}
    counted = rows.groupBy("case_id").agg(
        F.count(F.when(F.col("_kind") == "doc", 1)).alias("documents"),
        *[c.alias(n) for n, c in _category_columns(cfg).items()],
        *[F.count(F.when(sound & test, 1)).alias(n) for n, test in figures.items()],
        *[c.alias(n) for n, c in {**kept, **raised}.items()],
    )
    names = [c for c in counted.columns if not c.startswith("_")]
    totals = {n: F.col(n) for n in names}
    for k in range(len(broken)):
        for n in figures:
            own = F.when(F.col(f"_raised_{k}") > 0, int(n == "in_review")).otherwise(F.col(f"_{n}_{k}"))
            totals[n] = totals[n] + own
    return counted.select(*[c.cast("bigint").alias(n) if n in figures else c.alias(n) for n, c in totals.items()])


def with_status(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("case_status", final_status((F.col("blocking") > 0) | (F.col("in_review") > 0)))


def write_rollup(rollup: DataFrame, path: str, checkpoint: str, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    def put(batch: DataFrame, batch_id: int) -> None:
        keyed.upsert(batch, path, ["case_id"], batch_id, buckets)

    return (
        rollup.writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Newest figures of each case."""
    return with_status(keyed.current(spark, path))
