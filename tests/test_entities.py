"""Entities of a case: pairs by sorted names, and the closure of what was accepted."""

import random

import pytest
from pyspark.sql import functions as F

from casequarry import scale
from casequarry.functions.values import RECORD
from casequarry.operators import crossdoc as cd

DOCS = f"case_id string, doc_id string, doc_seq long, name string, extracted_data {RECORD}"


def brute(nodes, links):
    root = {n: n for n in nodes}
    while True:
        new = {n: min([root[n], *(root[b] for a, b in links if a == n), *(root[a] for a, b in links if b == n)]) for n in nodes}
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("window_rows", [20, 1_000_000])
def test_each_document_meets_its_next_neighbours(spark, monkeypatch, window_rows):
    monkeypatch.setattr(scale, "WINDOW_ROWS", window_rows)
    rng = random.Random(4)
    rows = [("hot" if k % 3 else f"c{k % 7}", f"d{k}", k, rng.choice(["Ann Lee", "lee, ANN", "Änn  Lée", "Bob", "bob!", None, ""]), {}) for k in range(240)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    pairs = [tuple(r) for r in cd.neighbouring_pairs(docs, "name").select("case_id", "doc_a", "doc_b").collect()]
    key = {"Bob": "bob", "bob!": "bob"}
    want = set()
    for c in {r[0] for r in rows}:
        lined = sorted((r for r in rows if r[0] == c and r[3]), key=lambda r: (key.get(r[3], "ann lee"), r[2]))
        want |= {(c, a[1], b[1]) for k, a in enumerate(lined) for b in lined[k + 1 : k + 4]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert len(pairs) <= cd.NEIGHBOURS * len(rows)


def test_what_is_accepted_is_closed_over(spark):
    rng = random.Random(8)
    rows = [(c, f"{c}{k}", k, "n", {}) for c in ("a", "b") for k in range(60)]
    links = [(c, f"{c}{k}", f"{c}{k + 1}", rng.random() < 0.7 or None, rng.choice([0.2, 0.75, 0.9])) for c in ("a", "b") for k in range(59)]
    links += [("a", "a5", "a50", True, 0.9), ("b", "b3", "b40", False, 1.0)]
    docs = spark.createDataFrame(rows, DOCS)
    resolved = spark.createDataFrame(links, "case_id string, doc_a string, doc_b string, is_same_entity boolean, confidence double")
    got = {r.doc_id: r.entity for r in cd.case_entities(docs, resolved).collect()}
    for c in ("a", "b"):
        own = [(int(x[1:]), int(y[1:])) for k, x, y, same, sure in links if k == c and same and sure >= 0.75]
        want = brute(range(60), own)
        assert {k: got[f"{c}{k}"] for k in range(60)} == want
    alone = cd.case_entities(docs, resolved.where(F.lit(False)))
    assert alone.where("entity <> doc_seq").count() == 0 and alone.count() == 120


def test_a_long_chain(spark):
    links = spark.range(500).select(F.lit("k").alias("k"), (500 - F.col("id")).alias("a"), (499 - F.col("id")).alias("b"))
    got = scale.components(links, ["k"])
    assert got.count() == 501 and got.where("root <> 0").count() == 0
