import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casequarry.llm import prefix_trie as p
from tests.check import compare, oracle_connection

TURNS = "conv_id long, turn long, role string, text string"


def trie_of(paths):
    """Nodes by definition; paths: {conv_id: [(turn, code points), ...]}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    saved = {n: (len(m) - 1) * n[-1][1] if n else 0 for n, m in members.items()}
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}
    out = []
    for n, m in members.items():
        under = [x for x in members if x[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))
        out.append((
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in under),
            sum(saved[x] for x in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def brute(rows):
    turns = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, k, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            turns.setdefault(c, []).append(((k is not None, k or 0, digest(r, t)), (r, t)))
    turns = {c: [x for _, x in sorted(v, key=lambda v: v[0])] for c, v in turns.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = [((r, t), len(t)) for r, t in turns.get(base, [])[:h] + turns[c][h:]]
    return trie_of(paths)


def rows_of(df):
    order = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)


def by_shards(paths, cuts):
    """The shards' nodes and shares put together without Spark."""
    token = lambda turn: hashlib.sha256(repr(turn).encode()).digest()[: p.WIDTH]
    lined = sorted((b"".join(map(token, path)), c, [s for _, s in path]) for c, path in paths.items())
    edges = sorted({0, len(lined), *(k % (len(lined) + 1) for k in cuts)})
    parts = [lined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    trie, previous = [], -1
    for k, part in enumerate(parts):
        depth = p._common(part[0][0], parts[k - 1][-1][0]) if k else -1
        along = p._common(part[0][0], parts[k - 1][0][0]) if k else -1
        trie.append((k, depth, min(depth, previous, along)))
        previous = depth
    found = []
    for k, part in enumerate(parts):
        left = p.owners(trie, k) if k else np.zeros(0, int)
        right = p.owners(trie, k + 1) if k + 1 < len(parts) else np.zeros(0, int)
        ids, sizes = np.array([c for _, c, _ in part]), [np.array(s, np.int64) for _, _, s in part]
        found += [r for b in p.shard_nodes(k, [x for x, _, _ in part], ids, sizes, left, right) for r in b.to_pylist()]
    shares = {}
    for r in found:
        if r["kind"] == p.SHARE:
            key = (r["splitter"], r["depth"])
            old = shares.setdefault(key, dict(r, n_convs=0, n_children=0, n_leaves=0, saved_tokens=0, ids=[]))
            assert old["parent_splitter"] == r["parent_splitter"]
            old["conv_id"] = min(old["conv_id"], r["conv_id"])
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                old[c] += r[c]
    for r in sorted((r for r in found if r["kind"] == p.PIECE), key=lambda r: (r["shard"], r["seq"])):
        shares[r["splitter"], r["depth"]]["ids"].append(r["ids"])
    out = []
    for r in [*shares.values(), *(r for r in found if r["kind"] == p.NODE)]:
        up = r["parent_conv_id"]
        if up is None and r["depth"]:
            up = shares[r["parent_splitter"], r["depth"] - 1]["conv_id"]
        ends = r["ends_sha256"] or hashlib.sha256(",".join(r["ids"]).encode()).hexdigest()
        out.append((r["conv_id"], r["depth"], up, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], ends))
    return sorted(out, key=str)


TURN = st.tuples(st.integers(0, 2), st.integers(0, 3))
PATHS = st.dictionaries(st.integers(-5, 300), st.lists(TURN, max_size=5), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(PATHS, st.lists(st.integers(0, 20), max_size=6))
def test_any_shards_give_the_trie(paths, cuts):
    assert by_shards(paths, cuts) == trie_of(paths)


def test_pieces_of_a_crowd(monkeypatch):
    monkeypatch.setattr(p, "PIECE_CHARS", 63)
    paths = {c: [("hot", 4)] for c in range(95, 160)} | {3: [("hot", 4), ("x", 1)], 500: []}
    for cuts in ([], [20, 40], list(range(60))):
        assert by_shards(paths, cuts) == trie_of(paths)


ROWS = [
    *((c, k, "user" if k % 2 else "system", f"text {k} {c // 3}") for c in range(190, 215) for k in range(c % 8)),
    *((c, k, "user", "the same") for c in range(300, 360) for k in range(7)),
    (400, None, "user", "no number"), (400, 0, None, "no role"), (400, 1, "user", None), (400, 1, "", ""), (400, 1, "", ""),
    (401, 0, "user", "long " * 200_000), (402, 0, "u", "ser text"), (403, 0, "us", "er text"), (-7, 0, "user", "negative"), (-7, 1, "a", "b"),
    (None, 0, "user", "no id"), (777, 0, "user", "no head"), (777, 1, "user", "no head"), (12345678901, 0, "x", "😀é"),
]


@pytest.mark.parametrize("shard_turns", [10, 200_000])
def test_equals_brute_force(spark, shard_turns):
    turns = spark.createDataFrame(ROWS, TURNS).repartition(5)
    turns = turns.withColumns({n: F.lit("x") for n in ("path", "sizes", "shard", "base", "taken", "depth", "kind")})
    assert rows_of(p.prefix_trie(turns, shard_turns)) == brute(ROWS)


def test_more_skeleton_nodes_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(p, "BROADCAST_NODES", 0)
    assert rows_of(p.prefix_trie(spark.createDataFrame(ROWS, TURNS), 10)) == brute(ROWS)


def test_empty_table(spark):
    got = p.prefix_trie(spark.createDataFrame([], TURNS))
    assert got.collect() == [] and got.schema["saved_tokens"].dataType.simpleString() == "bigint"


def test_one_conversation_with_most_rows(spark):
    rows = [(100, k, "user", f"turn {k}") for k in range(20_000)] + [(c, k, "user", f"turn {k}") for c in (101, 102) for k in range(300)]
    got = {(r.conv_id, r.depth): r for r in p.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert len(got) == 20_001 and got[100, 300].n_convs == 3 and got[100, 301].n_convs == 1
    assert got[100, 0].n_leaves == 1 and got[100, 0].saved_tokens == sum(2 * len(f"turn {k}") for k in range(300))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    outcome = compare(spark, oracle_connection(at), "op12", p.op12_prefix_trie, p.ORACLE, at)
    assert outcome.startswith("ok") and "types differ" not in outcome, outcome


def test_schema_of_found_rows():
    assert p._batch(0, kind=p.NODE).schema == p._FOUND and isinstance(p._FOUND, pa.Schema)
