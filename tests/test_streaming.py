"""Streams of several files and batches give the figures of the whole table."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.operators.conditions import deterministic_results
from casequarry.plans import inputs
from casequarry.sources.config import condition_row, default_config
from casequarry.streaming import intake as si
from casequarry.streaming import keyed
from casequarry.streaming import rollup as sr

CFG = default_config()
SF_DIR = "/root/testdata/sf0.001"


def _config(broken):
    """Two processes; one of the conditions may have a limit that is no number."""
    other = [dict(c, process_type="other") for c in CFG.categories[:1]]
    conditions = list(CFG.conditions)
    if broken:
        first = conditions[0]
        row = {k: first[k] for k in first if k not in ("value", "months", "months_error", "value_message", "missing_message")}
        conditions[0] = condition_row(**dict(row, operator="within_months"), value="many")
    return dataclasses.replace(CFG, categories=[*CFG.categories, *other], conditions=conditions)


@pytest.mark.parametrize("broken", [False, True])
def test_batches_and_repeats(spark, tmp_path, broken):
    cfg = _config(broken)
    orders = inputs.table(spark, SF_DIR, "orders")
    orders.repartition(7).write.parquet(f"{tmp_path}/in")
    shaped = lambda df: inputs.document_columns(df).withColumns(
        {"country": F.lit(fv.COUNTRY), "process_type": F.when(F.col("case_id").cast("int") % 5 == 0, "other").otherwise(fv.PROCESS)}
    )
    stream = shaped(si.read_stream(spark, f"{tmp_path}/in", orders.schema, "*.parquet", files_per_batch=1))
    sr.write_rollup(sr.case_rollup(stream, cfg, inputs.AS_OF), f"{tmp_path}/out", f"{tmp_path}/log", buckets=8).awaitTermination()
    got = {tuple(r) for r in sr.current_rollup(spark, f"{tmp_path}/out").collect()}
    whole = shaped(orders)
    want = {tuple(r) for r in sr.with_status(sr.case_rollup(whole, cfg, inputs.AS_OF)).collect()}
    assert got == want and len(got) == whole.select("case_id").distinct().count()
    manifest = keyed.newest(spark, f"{tmp_path}/out")
    assert manifest.batch == 6 and set(manifest.folders) == {str(k) for k in range(8)}
    # The same figures as the rows of the batch operator.
    counts = deterministic_results(whole, cfg, inputs.AS_OF).groupBy("case_id").agg(F.count(F.when(F.col("status") == "needs_review", 1)).alias("n"))
    by_case = {r.case_id: r.n for r in counts.collect()}
    names = sr.current_rollup(spark, f"{tmp_path}/out").columns
    at = names.index("in_review")
    assert all(r[at] == by_case.get(r[0], 0) for r in got) and any(r[at] for r in got)
    # A repeated run finds nothing new and changes nothing.
    sr.write_rollup(sr.case_rollup(stream, cfg, inputs.AS_OF), f"{tmp_path}/out", f"{tmp_path}/log", buckets=8).awaitTermination()
    assert {tuple(r) for r in sr.current_rollup(spark, f"{tmp_path}/out").collect()} == want


def _table(spark, rows):
    return spark.createDataFrame(rows, "k string, n long")


def _now(spark, path):
    return {r.k: r.n for r in keyed.current(spark, path).collect()}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    keyed.upsert(_table(spark, [(f"k{i}", i) for i in range(400)]), path, ["k"], 0, buckets=32)
    before = keyed.newest(spark, path).folders
    keyed.upsert(_table(spark, [("k7", -1), ("new", 5), (None, 9)]), path, ["k"], 1)
    after = keyed.newest(spark, path).folders
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 3 and len(after) == 32
    files = [f for f in tmp_path.glob("t/data/1/bucket=*/*.parquet")]
    assert len(files) == len(changed)
    assert _now(spark, path) == {f"k{i}": i for i in range(400)} | {"k7": -1, "new": 5, None: 9}
    keyed.upsert(_table(spark, [(None, 10)]), path, ["k"], 2)
    assert _now(spark, path)[None] == 10 and keyed.current(spark, path).count() == 402
    # The last two manifests and what they name stay.
    assert sorted(f.name for f in tmp_path.glob("t/manifests/*.json")) == ["1.json", "2.json"]
    assert {f"data/{f.parent.name}/{f.name}" for f in tmp_path.glob("t/data/*/bucket=*")} == set(after.values()) | set(keyed.newest(spark, path).folders.values())


def test_a_batch_that_is_cut_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    keyed.upsert(_table(spark, [("a", 1), ("b", 2)]), path, ["k"], 0, buckets=4)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            keyed.upsert(_table(spark, [("a", 5), ("c", 6)]), path, ["k"], 1)
    assert _now(spark, path) == {"a": 1, "b": 2}
    keyed.upsert(_table(spark, [("a", 5), ("c", 6)]), path, ["k"], 1)
    assert _now(spark, path) == {"a": 5, "b": 2, "c": 6}
    # Batches that the table has, and empty ones, change nothing; other columns are refused.
    keyed.upsert(_table(spark, [("a", 0)]), path, ["k"], 1)
    keyed.upsert(_table(spark, []), path, ["k"], 2)
    assert _now(spark, path) == {"a": 5, "b": 2, "c": 6} and keyed.newest(spark, path).batch == 2
    with pytest.raises(ValueError, match="has keys"):
        keyed.upsert(spark.createDataFrame([("a", "x")], "k string, n string"), path, ["k"], 3)
    assert keyed.current(spark, f"{tmp_path}/none") is None
