"""What was known at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casequarry import scale
from casequarry.operators.classify import apply_overrides, types_as_of_runs


def brute(rows, facts):
    out = []
    for key, n, at in rows:
        known = [(t, tie, v) for k, t, tie, v in facts if k == key and k is not None and t is not None and at is not None and t <= at]
        best = max(known, default=None)
        out.append((key, n, at, best and best[1], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 8])
def test_hot_key_over_many_partitions(spark, partitions):
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
    rows = [(key(), n, rng.choice([None, *range(300)])) for n in range(1500)]
    facts = [(key(), rng.choice([None, *range(0, 300, 3)]), rng.randrange(3), f"v{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "key string, n long, at long").repartition(partitions)
    known = spark.createDataFrame(facts, "key string, since long, tie int, value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scale.as_of_join(df, known, ["key"], "at", "since", ["tie"])
        assert got.columns == ["key", "n", "at", "tie", "value"]
        got = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got, key=str) == brute(rows, facts)


def test_no_facts_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1)], "key string, at long")
    known = spark.createDataFrame([], "key string, since long, value string")
    assert [tuple(r) for r in scale.as_of_join(df, known, ["key"], "at", "since").collect()] == [("a", 1, None)]
    assert scale.as_of_join(df.limit(0), known, ["key"], "at", "since").collect() == []


def test_two_runs_with_an_override_between_them(spark):
    at = lambda day: dt.datetime(2024, 5, day)
    docs = spark.createDataFrame([("c", "d", 1, "old"), ("c", "e", 2, "kept")], "case_id string, doc_id string, doc_seq long, doc_type string")
    runs = spark.createDataFrame([("c", "r1", at(1)), ("c", "r2", at(3)), ("other", "r3", at(3))], "case_id string, run_id string, started_at timestamp")
    made = spark.createDataFrame([("c", "d", "new", "ann", at(2)), ("c", "d", "newer", "bob", at(3))], "case_id string, doc_id string, doc_type string, analyst_id string, ts timestamp")
    got = {(r.run_id, r.doc_id): (r.doc_type, r.override_by) for r in types_as_of_runs(docs, runs, made).collect()}
    assert got == {("r1", "d"): ("old", None), ("r1", "e"): ("kept", None), ("r2", "d"): ("newer", "bob"), ("r2", "e"): ("kept", None)}
    classes = spark.createDataFrame([("c", "d", 1, "old", 0.4, None, "r", False, None)], "case_id string, doc_id string, doc_seq long, detected_type string, confidence double, alternative_types array<struct<type:string,confidence:double>>, reasoning string, manually_overridden boolean, override_by string")
    for until, want in ((at(1), "old"), (at(2), "new"), (None, "newer")):
        typed, merged = apply_overrides(docs, classes, made, until=until)
        assert typed.where("doc_id = 'd'").first().doc_type == want
        assert merged.where(F.col("doc_id") == "d").first().detected_type == want
