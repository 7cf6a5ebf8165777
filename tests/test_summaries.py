"""Summaries that are added up."""

import random

from casequarry import fixed_values as fv
from casequarry.operators import summaries as sm

TRACES = "doc_id string, step_name string, doc_type string, day string, trace_status string, blocked boolean, problem string, duration_ms double"


def rows(n):
    rng = random.Random(7)
    for k in range(n):
        status = rng.choice([fv.TRACE_SUCCESS, fv.TRACE_SUCCESS, fv.TRACE_RETRYING, fv.TRACE_TERMINAL])
        yield (f"d{k // 2}", "extract", rng.choice("ab"), rng.choice(["1", "2"]), status, k % 11 == 0, f"p{k % 700}", None if k % 10 == 0 else rng.expovariate(0.01))


def test_halves_merge_to_the_whole(spark):
    data = list(rows(20_000))
    halves = [sm.summarise_traces(spark.createDataFrame(data[h::2], TRACES).repartition(4)) for h in (0, 1)]
    got = {(r.doc_type, r.day): r for r in sm.read_summary(sm.merge_summaries(*halves)).collect()}
    whole = {(r.doc_type, r.day): r for r in sm.read_summary(sm.summarise_traces(spark.createDataFrame(data, TRACES))).collect()}
    assert set(got) == set(whole) and len(got) == 4
    for (kind, day), r in got.items():
        own = [x for x in data if x[2:4] == (kind, day)]
        times = sorted(x[7] for x in own if x[7] is not None)
        for name in ("attempts", "successes", "terminal", "blocked", "timed"):
            assert r[name] == whole[kind, day][name]
        assert (r.attempts, r.timed, r.blocked) == (len(own), len(times), sum(x[5] for x in own))
        for q in sm.QUANTILES:
            for figures in (r, whole[kind, day]):
                rank = sum(t <= figures[f"p{q * 100:.0f}_ms"] for t in times) / len(times)
                assert abs(rank - q) < 0.02
        assert abs(r.documents - len({x[0] for x in own})) < 0.06 * len(own)
        wrong = {x[6] for x in own if x[4] != fv.TRACE_SUCCESS}
        assert abs(r.different_problems - len(wrong)) < 0.06 * len(wrong)


def test_nothing_timed_and_nothing_at_all(spark):
    data = [("d", "extract", "a", "1", fv.TRACE_TERMINAL, False, "p", None)]
    df = spark.createDataFrame(data, TRACES)
    once = sm.summarise_traces(df)
    (r,) = sm.read_summary(sm.merge_summaries(once, sm.summarise_traces(df.limit(0)))).collect()
    assert (r.attempts, r.timed, r.p50_ms, r.documents, r.different_problems) == (1, 0, None, 1, 1)
    assert sm.read_summary(sm.summarise_traces(df.limit(0))).collect() == []
