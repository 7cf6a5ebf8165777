import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from casequarry.llm import suffix_dedup as s
from casequarry.llm.suffixes import common_prefixes, suffix_order
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(rows, length=50):
    least, out = {}, []
    raw = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, float("inf")), rank(i))
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < rank(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + gone[:-1], gone, strict=True)) if b else 0
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r)[:5] for r in s.find_repeats(docs).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 255]), min_size=1, max_size=150), st.sampled_from([8, 20, 50]))
def test_suffix_order_and_common_prefixes(values, depth):
    text = np.array(values, np.uint8)
    raw = text.tobytes()
    order = suffix_order(text, depth).tolist()
    assert sorted(order) == list(range(len(raw)))
    cut = [raw[k : k + depth].ljust(depth, b"\0") for k in order]
    assert cut == sorted(cut)
    for k, n in list(enumerate(common_prefixes(text, np.array(order), depth)))[1:]:
        a, b = raw[order[k] :][:depth], raw[order[k - 1] :][:depth]
        same = [x == y for x, y in zip(a, b, strict=False)]
        assert n == (same + [False]).index(False)


def test_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = sorted((tuple(r) for r in s.op2_suffix_dedup(spark, SF).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_random_overlaps_hot_keys_and_long_texts(documents, monkeypatch):
    monkeypatch.setattr(s, "HOT", 30)
    monkeypatch.setattr(s, "SORTED_BYTES", 3000)
    monkeypatch.setattr(s, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(s, "_STEP", 700)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    common = " ".join(word() for _ in range(40))
    rows = []
    for k in range(120):
        a, z = sorted((rng.randrange(len(common)), rng.randrange(len(common))))
        rows.append((k, " ".join([word() for _ in range(10)] + [common[a:z]] + [word() for _ in range(5)])))
    rows += [(k, "x" * n) for k, n in ((200, 49), (201, 50), (202, 51), (203, 4000))]
    rng.shuffle(rows)
    assert run(documents(*rows)) == brute(rows)


def test_copies_null_ids_repeated_rows_and_empty_table(documents):
    t = "a passage that is longer than fifty bytes, written more than once"
    rows = [(5, t), (3, t), (None, t), (3, t), (9, "x" + t), (7, None), (8, ""), (None, "only here " * 9), (None, "only here " * 9), (1, "short")]
    docs = documents(*rows).withColumns({n: F.lit(1) for n in ("block", "cell", "kind", "bucket")})
    assert run(docs) == brute(rows)
    assert s.find_repeats(docs.limit(0)).count() == 0
    spans = {r.doc_id: r.spans for r in s.find_repeats(docs).collect()}
    assert spans[9] == [1, 1 + len(t)] and spans[5] == [0, len(t)] and spans[3] == []


def test_windows_are_hashed_once_and_then_found_by_their_places(monkeypatch):
    """Hashes of windows are made where keys and passages are sent; the result reads the places that were sent."""
    rng = random.Random(7)
    common = "".join(rng.choice("abcde ") for _ in range(300))
    rows = [(3, "first " + common), (5, None), (1, common[20:200] + " last"), (9, "short"), (7, common[100:260] + common[90:180])]
    cell = s.cells.columns(id=s.pa.array([r[0] for r in rows]), first=list(range(len(rows))), text=s.pa.array([r[1] for r in rows]))
    data, at = s.text_bytes(s.pa.array([r[1] for r in rows]))
    who, begin, n, keys = s.runs_of(data, at, 50, 24)
    monkeypatch.setattr(s, "_STEP", 70)
    assert {(w, p + k, key) for w, p, m, key in zip(who, begin, n, keys, strict=True) for k in range(m)} == {
        (w, p + k, key) for w, p, m, key in zip(*s.runs_of(data, at, 50, 24), strict=True) for k in range(m)
    }
    shared = s.cells.columns(key=np.unique(keys), hot=np.zeros(len(np.unique(keys)), bool))
    sent = lambda kind, cell: s.cells.rows(s._SENT, {"bucket": 0, "block": 6, "kind": kind, "cell": cell})
    found = list(s._passages(50, 24, 4)(iter([sent(s.TEXTS, cell), sent(s.KEYS, shared)])))
    verdicts = list(s._compare(50)(iter(found)))
    monkeypatch.setattr(s, "window_keys", None)
    got = [r for b in s._result(50)(iter([sent(s.TEXTS, cell), *verdicts])) for r in b.to_pylist()]
    assert sorted((tuple(r.values())[:5] for r in got), key=str) == brute(rows) and sum(r["n_removed"] for r in got) > 200
