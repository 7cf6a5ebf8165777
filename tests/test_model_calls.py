"""Who is asked what, how often and in which order."""

import random
import time
import uuid
from collections import Counter
from functools import partial

from pyspark.sql import functions as F

from casequarry import scale
from casequarry.operators import model as mo


def counting(folder, delay=0.0):
    """A single call that leaves a file for every time it was asked."""

    def one(prompt, temperature, backend):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{prompt}|{temperature}|{backend}")
        time.sleep(random.random() * delay)
        if prompt == "bad":
            raise ValueError("bad prompt")
        return f"re {prompt} {temperature} {backend}"

    return one


def asked(folder):
    return Counter(f.read_text() for f in folder.iterdir())


def test_each_different_prompt_is_asked_once(spark, tmp_path):
    rows = [(k, "hot" if k % 3 == 0 else f"p{k % 50}", None, None, True) for k in range(3000)]
    rows += [(3000, "hot", 0.5, None, True), (3001, "hot", 0.5, "other", True), (3002, None, None, None, True), (3003, "never", None, None, False), (3004, "bad", None, None, True), (3005, "bad", None, None, True)]
    df = spark.createDataFrame(rows, "id long, prompt string, temperature double, backend_key string, in_passed boolean").repartition(9)
    ask = partial(mo.call_in_flight, ask_one=counting(tmp_path, 0.002), keys=["prompt_hash"])
    got = {r.id: r for r in mo.ask_each_once(df, ask).collect()}
    assert len(got) == len(rows)
    for k, prompt, heat, backend, passed in rows:
        r = got[k]
        if prompt is None or not passed:
            assert (r.raw_response, r.error) == (None, None)
        elif prompt == "bad":
            assert (r.raw_response, r.error) == (None, "bad prompt")
        else:
            assert r.raw_response == f"re {prompt} {heat or 0.0} {backend or 'default'}"
    seen = asked(tmp_path)
    assert set(seen.values()) == {1} and len(seen) == 50 + 1 + 2 + 1
    # A model that sees frames of prompts does as well, and no rows are no calls.
    by_frame = partial(mo.call_model, model_fn=lambda b: [p.upper() for p in b["prompt"]], keys=["prompt_hash"])
    assert {r.raw_response for r in mo.ask_each_once(df.where("id < 9").select("id", "prompt"), by_frame).collect()} == {"HOT", "P1", "P2", "P4", "P5", "P7", "P8"}
    assert mo.ask_each_once(df.limit(0), by_frame).collect() == []


def test_order_holds_under_random_delays(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 100, 1, 2).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("p"), "id")).alias("prompt"))
        start = time.monotonic()
        got = mo.call_in_flight(df, counting(tmp_path, 0.2), ["id"], in_flight=8).collect()
        spent = time.monotonic() - start
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert [r.id for r in got] == list(range(100))
    assert all(r.raw_response == (None if r.id % 10 == 3 else f"re p{r.id} 0.0 default") for r in got)
    assert sum(r.duration_ms for r in got) / 1000 > 1.5 * spent  # calls were open at the same time
    assert max(asked(tmp_path).values()) == 1


def test_lookup_of_wide_rows_with_a_hot_key(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("key"), F.col("id").alias("doc_id"))
    table = spark.createDataFrame([("hot", "x" * 10_000, 1), *((f"k{k}", str(k), k) for k in range(0, 900, 2))], "key string, wide string, n int")
    want = {(r.doc_id, r.n) for r in rows.join(table, "key", "left").collect()}
    left = scale.lookup(rows, table, ["key"])
    assert left.columns == ["key", "doc_id", "wide", "n"]
    assert {(r.doc_id, r.n) for r in left.collect()} == want
    inner = scale.lookup(rows, table, ["key"], "inner")
    assert {(r.doc_id, r.n) for r in inner.collect()} == {w for w in want if w[1] is not None}
    # The hot key's rows lie in many partitions, and no wide column is broadcast.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = scale.lookup(rows, table, ["key"])
        plan = again._jdf.queryExecution().executedPlan().toString()
        spread = again.where("key = 'hot'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spread > 4
    assert not any("BroadcastExchange" in line and "wide" in line for line in plan.splitlines())
