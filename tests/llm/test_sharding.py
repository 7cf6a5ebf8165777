import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casequarry.llm import sharding as s
from tests.check import compare, oracle_connection


def brute_capacity(sizes, shards):
    """The smallest possible largest shard, by trying cuts of the line from the front (dynamic programming)."""
    stops = [0]
    for x in sizes:
        stops.append(stops[-1] + x)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], stops[i] - stops[j]) for j in range(i + 1)) for i in range(len(stops))]
    return best[-1]


class Known(s.Line):
    """A line that counts a list instead of a table."""

    rounds = 0

    def _count(self, stretches):
        self.rounds += 1
        assert len(stretches) <= 4 * 40
        cells = {}
        for after, stop, width in stretches:
            for e in self.ends:
                if after < e <= stop:
                    cells.setdefault((after, (e - after - 1) // width, width), []).append(e)
        return sorted((k[2], min(v), max(v), len(v)) for k, v in cells.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(16, 40), st.integers(16, 5000)), min_size=1, max_size=40), st.integers(1, 9), st.integers(2, 30))
def test_capacity_is_the_smallest_and_cuts_keep_it(sizes, shards, cells):
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    line = Known(ends, ends[-1], cells)
    capacity = s.smallest_capacity(line, shards)
    assert capacity == brute_capacity(sizes, shards)
    large = s.large_groups(sorted(zip(sizes, ends, strict=True), reverse=True), ends[-1], shards)
    found = s.cuts(line, shards, capacity, large)
    assert found == sorted(found) and len(found) == shards - 1 and set(found) <= {0, *ends}
    assert max(b - a for a, b in zip([0, *found], [*found, ends[-1]], strict=True)) == capacity


def test_few_rounds_for_many_groups():
    rng = random.Random(5)
    ends, at = [], 0
    for _ in range(20_000):
        at += rng.randrange(16, 3000) if rng.random() < 0.999 else 200_000
        ends.append(at)
    exact = Known(ends, at, 1 << 30)
    coarse = Known(ends, at, 256)
    wanted = s.smallest_capacity(exact, 40)
    assert s.smallest_capacity(coarse, 40) == wanted
    assert s.cuts(coarse, 40, wanted, []) == s.cuts(exact, 40, wanted, [])
    assert coarse.rounds < 25 and exact.rounds == 1


def test_a_large_group_leaves_the_others_equal():
    sizes = [100] * 60 + [9000] + [100] * 120
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    line = Known(ends, ends[-1], 16)
    capacity = s.smallest_capacity(line, 10)
    large = s.large_groups(sorted(zip(sizes, ends, strict=True), reverse=True), ends[-1], 10)
    found = s.cuts(line, 10, capacity, large)
    loads = sorted(b - a for a, b in zip([0, *found], [*found, ends[-1]], strict=True))
    assert loads[-1] == capacity == 9000 and loads[:-1] == [2000] * 9


def check_law(rows, source, shards=40):
    """rows: (doc_id, size, crc, shard, slot); source: [(doc_id, text)]."""
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in rows) == sorted(
        (i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in source
    )
    groups = {}
    for i, t in source:
        groups.setdefault(t or "", []).append(i)
    by_crc = {zlib.crc32(t.encode()): t for t in groups}
    where = {}
    for r in rows:
        where.setdefault(by_crc[r[2]], set()).add(r[3])
        assert 0 <= r[3] < shards
    assert all(len(x) == 1 for x in where.values())
    slots = {}
    for r in rows:
        slots.setdefault(r[3], []).append(r[4])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    first = lambda t: min((i for i in groups[t] if i is not None), default=-1)
    lined = sorted(groups, key=first)
    assert [min(where[t]) for t in lined] == sorted(min(where[t]) for t in lined)
    load = Counter()
    for r in rows:
        load[r[3]] += r[1]
    assert max(load.values()) == brute_capacity([size(t) * len(groups[t]) for t in lined], shards)


ROWS = [
    *((i, f"text {i % 90} " + "x" * (i * 37 % 500)) for i in range(200)), *((i, "hot copy") for i in range(1000, 1150)),
    (300, None), (301, ""), (302, "ü" * 50_000), (None, "null id"), (303, "null id"), (None, "no id at all"), (304, "twice"), (304, "twice"),
]


@pytest.mark.parametrize(("shards", "cells"), [(40, s.CELLS), (7, 8), (1, 8)])
def test_equals_brute_force(spark, shards, cells):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    docs = docs.withColumns({n: F.lit("x") for n in ("size", "digest", "row", "shard", "slot", "part", "end", "n", "before")})
    got = s.place(docs, shards, cells=cells).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    check_law([tuple(r) for r in got], ROWS, shards)


def test_fewer_groups_than_shards_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = s.place(docs).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    check_law([tuple(r) for r in got], [(1, "a"), (2, "b"), (3, "a")])
    assert s.place(docs.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("_row", F.lit(1))
    s.write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r.shard for r in back.select("shard").collect()} == set(range(5))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    with pytest.raises(ValueError, match="slot"):
        s.write_shards(docs.withColumn("slot", F.lit(1)), f"{tmp_path}/no")


def test_given_documents(spark):
    at = "/root/testdata/sf0.001"
    source = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{at}/documents.parquet").to_pylist()]
    got = s.op13_sharding(spark, at)
    assert {(r.law, r.grown_shard) for r in got.collect()} == {("bytes", None)}
    check_law([tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()], source)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    outcome = compare(spark, oracle_connection(at), "op13", s.op13_sharding, s.ORACLE, at)
    assert outcome.startswith("ok") and "types differ" not in outcome, outcome
