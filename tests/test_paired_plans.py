"""Tables with a row for many cases or prompts don't go through the driver's memory."""

from pyspark.sql import functions as F

from casequarry import scale
from casequarry.operators import crossdoc as cd


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_cases_are_not_broadcast(spark, monkeypatch):
    lines = spark.createDataFrame([(str(c), k, "x" * (10 + k)) for c in range(9) for k in range(c)], "case_id string, doc_seq long, line string")
    written, cut = [], scale.cut_lineage
    monkeypatch.setattr(scale, "cut_lineage", lambda df, label="table": cut(written.append(df) or df, label))
    texts = scale.paired_parts(lines, ["case_id"], ["doc_seq"], "line", 40)
    assert texts.count() == sum(1 if c < 4 else c * (c - 1) // 2 for c in range(1, 9))
    plans = [plan(df) for df in [*written, texts]]
    joins = [p for p in plans if "LeftAnti" in p or "LeftSemi" in p]
    assert len(joins) >= 2 and not any("BroadcastExchange" in p for p in plans)


def test_reports_of_prompts_are_not_broadcast(spark):
    items = spark.range(40).select(
        (F.col("id") % 3).cast("string").alias("case_id"), (F.col("id") % 10).alias("part"), F.lit(0).alias("pos"),
        F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, "b").otherwise("c")).alias("documents_involved"), F.array(F.lit("f")).alias("fields_involved"),
    )
    once = cd._listed_once(items)
    assert "LeftAnti" in plan(once) and "Broadcast" not in plan(once)
    want = {}
    for r in items.collect():
        at = (r.case_id, tuple(sorted(r.documents_involved)))
        want.setdefault(at, []).append(r.part)
    assert sorted(r.part for r in once.collect()) == sorted(p for ps in want.values() for p in ps if p == min(ps))
