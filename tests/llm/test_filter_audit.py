import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casequarry.llm import filter_audit as f
from tests.check import compare, oracle_connection

LABELS = "doc_id long, quality int, toxic int"
MASKS = st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 3), st.integers(0, 3)))


def steps_of(letters, counts):
    """All steps by definition, without the shares over all orders."""
    bit = {x: 1 << k for k, x in enumerate(letters)}
    for order in permutations(letters):
        for k, x in enumerate(order):
            before = sum(bit[y] for y in order[:k])
            total = lambda keep, j=0: sum(v[j] for m, v in counts.items() if keep(m))  # noqa: E731, B023
            here = lambda m: not m & before and m & bit[x]  # noqa: E731, B023
            yield (
                "".join(order), k + 1, total(lambda m: not m & (before | bit[x])), total(here), total(lambda m: m & before and m & bit[x]),
                total(lambda m: m == bit[x]), total(here, 1), total(here, 2),
            )


def brute(rows, labels):
    """rows: (doc_id, text, lang)."""
    marks, parts, first = {}, {}, {}
    for i, q, t in labels:
        g, x = marks.get(i, (0, 0))
        marks[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > first[t],
        ]
        mask = sum(1 << k for k, x in enumerate(fails) if x)
        good, toxic = marks.get(i, (0, 0)) if i is not None else (0, 0)
        counts = parts.setdefault(lang or "", {})
        counts[mask] = tuple(a + b for a, b in zip(counts.get(mask, (0, 0, 0)), (1, good, toxic), strict=True))
    out = []
    for part, counts in parts.items():
        found = list(steps_of("ABCDE", counts))
        for r in found:
            share = sum(o[3] for o in found if o[0][o[1] - 1] == r[0][r[1] - 1])
            out.append((part, *r, share))
    return sorted(out)


@settings(max_examples=30, deadline=None)
@given(MASKS)
def test_diagram_equals_definition(counts):
    rows = f.audit_part("p", "ABCDE", counts)
    assert sorted(r[1:-1] for r in rows) == sorted(steps_of("ABCDE", counts))


def test_other_numbers_of_filters():
    for letters in ("A", "AB", "ABC", "ABCDEF"):
        counts = {m: (random.Random(m).randrange(9), 0, 0) for m in range(1 << len(letters))}
        assert sorted(r[1:-1] for r in f.audit_part("p", letters, counts)) == sorted(steps_of(letters, counts))


def test_every_swap_is_of_neighbours():
    order, seen = list("ABCDE"), {"ABCDE"}
    for k in f.adjacent_swaps(5):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add("".join(order))
    assert len(seen) == 120 and len(list(f.adjacent_swaps(5))) == 119
    assert list(f.adjacent_swaps(1)) == []


def test_equal_subdiagrams_are_shared():
    diagram = f.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)})
    assert [len(level) for level in diagram.levels] == [1] * 5 and diagram.weight(0, 0) == (32, 0, 0)


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (0, LONG, "en"), (1, LONG, "en"), (1, LONG, "de"), (2, None, None), (3, "", "en"), (4, "A#", ""), (5, "word " * 30_000, "de"),
    (5, "word " * 30_000, "de"), (6, "\x0b\tÄ É\xa0x", "fr"), (None, LONG, "en"), (None, "null id", "en"), (7, LONG + " A|", "en"),
    (8, "ABC " * 80, "en"), (9, "w " * 198 + "a b", "en"), (10, "w" * 97 + "ABC", "en"), (11, "w" * 96 + "ABCD", "en"), (12, "😀" * 99 + "AAA", "x"),
]
MARKS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (5, 1, 1), (77, 1, 1), (None, 1, 1), (8, None, None)]


def test_equals_brute_force(spark, tables):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    # Names that the operator uses itself.
    docs = docs.withColumns({n: F.lit("x") for n in ("part", "mask", "digest", "words", "n", "first_id")})
    path = tables(documents=docs, labels=spark.createDataFrame(MARKS, LABELS))
    got = f.op11_filter_audit(spark, path)
    assert sorted(map(tuple, got.collect())) == brute(ROWS, MARKS)


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    path = tables(documents=docs, labels=spark.createDataFrame([], LABELS))
    assert f.op11_filter_audit(spark, path).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    outcome = compare(spark, oracle_connection(at), "op11", f.op11_filter_audit, f.ORACLE, at)
    assert outcome.startswith("ok") and "types differ" not in outcome, outcome
