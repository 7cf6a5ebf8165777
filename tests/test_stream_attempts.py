"""Retries over a stream that is stopped and started again and again."""

import time

from pyspark.sql import functions as F

from casequarry.functions.values import record_json
from casequarry.operators.model import judge_attempts, resolve_attempts
from casequarry.sources.config import default_config
from casequarry.streaming import attempts as sa
from casequarry.streaming import intake as si

CFG = default_config()
REPLIES = "doc_id string, attempt int, raw_response string, error string"
GOOD, LACKS, BAD = '{"v": 1}', '{"w": 1}', "no json"
# What each document's attempts get, up to three.
SCRIPT = {
    "first": [GOOD], "second": [BAD, GOOD], "third": [LACKS, BAD, GOOD], "soft": [BAD, BAD, LACKS], "never": [BAD, LACKS, BAD],
    "error": [None, GOOD], "errors": [None, None, None],
}


def run(spark, at, timeout_ms=None):
    """The stream from its checkpoint to the end of its input: each call is a new start."""
    replies = si.read_stream(spark, f"{at}/in", spark.createDataFrame([], REPLIES).schema, "*.parquet", files_per_batch=1)
    stream = sa.stream_attempts(replies, CFG, ["v"], 3, ["doc_id"], timeout_ms)
    query = sa.write_attempts(stream, f"{at}/out", f"{at}/log")
    assert query.awaitTermination(100)
    return spark.read.parquet(f"{at}/out")


def send(spark, at, rows):
    df = spark.createDataFrame([(d, a, r, None if r is not None else "timeout") for d, a, r in rows], REPLIES)
    df.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return df


def test_restarts_give_what_the_table_gives(spark, tmp_path):
    sent = send(spark, tmp_path, [(d, 1, replies[0]) for d, replies in SCRIPT.items()])
    answered = {(d, 1) for d in SCRIPT}
    for _ in range(4):
        out = run(spark, tmp_path)
        due = {(r.doc_id, r.attempt) for r in out.where("kind = 'ask'").collect()} - answered
        if not due:
            break
        # Repeats of earlier replies come along and change nothing.
        again = send(spark, tmp_path, [(d, a, SCRIPT[d][a - 1]) for d, a in due] + [("second", 1, GOOD), ("first", 1, BAD)])
        sent = sent.unionByName(again.where("NOT (doc_id IN ('first', 'second') AND attempt = 1)"))
        answered |= due
    assert answered == {(d, k + 1) for d, replies in SCRIPT.items() for k in range(len(replies))}
    results = out.where("kind = 'result'").select("doc_id", "outcome", "attempt", "record", "problem")
    got = sorted(map(tuple, results.collect()))
    table = resolve_attempts(judge_attempts(sent, CFG, ["v"], 3), ["doc_id"])
    record = F.when(F.col("record").isNotNull(), record_json(F.col("record")))
    assert got == sorted(map(tuple, table.select("doc_id", "outcome", "attempts", record, "problem").collect()))
    assert len(got) == len(SCRIPT)
    asked = {(r.doc_id, r.attempt): r.problem for r in out.where("kind = 'ask'").collect()}
    assert asked["second", 2].startswith("JSON parse error") and asked["error", 2] == "timeout"


def test_replies_out_of_order_wait_for_their_turn(spark, tmp_path):
    send(spark, tmp_path, [("d", 3, GOOD), ("d", 2, BAD), ("e", 2, GOOD)])
    assert run(spark, tmp_path).collect() == []
    send(spark, tmp_path, [("d", 1, BAD), ("e", 1, GOOD)])
    got = sorted((r.doc_id, r.kind, r.attempt, r.outcome) for r in run(spark, tmp_path).collect())
    assert got == [("d", "ask", 2, None), ("d", "ask", 3, None), ("d", "result", 3, "success"), ("e", "result", 1, "success")]


def test_a_reply_that_does_not_come_is_a_failed_attempt(spark, tmp_path):
    send(spark, tmp_path, [("d", 1, BAD), ("done", 1, GOOD)])
    first = run(spark, tmp_path, timeout_ms=500)
    assert sorted((r.doc_id, r.kind, r.attempt) for r in first.collect()) == [("d", "ask", 2), ("done", "result", 1)]
    time.sleep(1)
    send(spark, tmp_path, [("other", 1, GOOD)])
    out = run(spark, tmp_path, timeout_ms=500).where("doc_id = 'd'").orderBy("attempt").collect()
    assert [(r.kind, r.attempt, r.problem) for r in out][1:] == [("ask", 3, "timeout")]
    send(spark, tmp_path, [("d", 2, GOOD), ("d", 3, GOOD)])  # the second comes too late
    got = run(spark, tmp_path, timeout_ms=60_000).where("doc_id = 'd' AND kind = 'result'").collect()
    assert [(r.attempt, r.outcome) for r in got] == [(3, "success")]
