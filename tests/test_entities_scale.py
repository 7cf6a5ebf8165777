"""Entities without joins that move records again, and closures that are gathered or go in rounds."""

import random

import pytest
from pyspark.sql import functions as F

from casequarry import scale
from casequarry.functions.values import RECORD
from casequarry.operators import crossdoc as cd


@pytest.mark.parametrize("limit", [0, 20, 1000])
def test_gathered_links_give_what_rounds_give(spark, monkeypatch, limit):
    monkeypatch.setattr(scale, "GATHERED_LINKS", limit)
    rng = random.Random(3)
    links = [(k, rng.randrange(60), rng.randrange(60)) for k, n in (("a", 8), ("b", 18), ("c", 45)) for _ in range(n)]
    got = {(r.k, r.node): r.root for r in scale.components(spark.createDataFrame(links, "k string, a long, b long"), ["k"]).collect()}
    want = {(k, n): n for k, a, b in links for n in (a, b)}
    for _ in range(60):
        for k, a, b in links:
            want[k, a] = want[k, b] = min(want[k, a], want[k, b])
    assert got == want


def test_closing_small_cases_takes_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(scale, "cut_lineage", lambda df, label="table", cut=scale.cut_lineage: written.append(label) or cut(df, label))
    links = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    assert scale.components(links, ["k"]).where("root > 2").count() == 0
    assert len(written) <= 2


def test_pairs_cross_blocks_and_carry_their_records(spark, monkeypatch):
    monkeypatch.setattr(cd, "PLACES", 5)
    rows = [("x" if k % 4 else "y", f"d{k}", k, f"n {k:03}", {"f": (str(k), "int")}) for k in range(70)]
    docs = spark.createDataFrame(rows, f"case_id string, doc_id string, doc_seq long, name string, extracted_data {RECORD}")
    pairs = cd.neighbouring_pairs(docs, "name")
    # Records are joined once to their places, not twice more to each pair.
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
    got = {(r.doc_a, r.doc_b): (r.seq_a, r.seq_b, r.entity_a["f"]["text"], r.entity_b["f"]["text"]) for r in pairs.collect()}
    want = {}
    for c in "xy":
        own = [r for r in rows if r[0] == c]
        want |= {(a[1], b[1]): (a[2], b[2], str(a[2]), str(b[2])) for k, a in enumerate(own) for b in own[k + 1 : k + 4]}
    assert got == want
