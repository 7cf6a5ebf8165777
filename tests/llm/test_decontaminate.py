import itertools
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from casequarry.llm import decontaminate as d
from tests.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"


def items(spark, *texts):
    return spark.createDataFrame([(100 + k, t, 1) for k, t in enumerate(texts)], "item_id long, text string, own int")


def places(document, item):
    """Every way to lay the item over the document that counts as a match."""
    w, b = (re.findall(r"[^\W_]+", t.lower()) for t in (document or "", item))
    n = min(len(b), d.WINDOW)
    need = len(b) if len(b) < d.SHORT_WORDS else -(-n * 4 // 5)
    found = []
    for at in range(-len(b), len(w) + 1):
        equal = [0 <= at + k < len(w) and w[at + k] == b[k] for k in range(len(b))]
        if max(sum(equal[s : s + n]) for s in range(len(b) - n + 1)) >= need:
            found.append(at)
    return found


def test_sql_and_brute_force_on_the_table(spark):
    assert compare(spark, oracle_connection(SF), "op4", d.op4_decontaminate, d.ORACLES["op4_decontaminate"], SF).startswith("ok")
    got = {(r.doc_id, r.item_id): r.places for r in d.op4_decontaminate(spark, SF).collect()}
    documents, benchmark = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    words = {b["item_id"]: set(re.findall(r"[^\W_]+", b["text"].lower())) for b in benchmark}
    want = {}
    for r in documents:
        own = set(re.findall(r"[^\W_]+", r["text"].lower()))
        for b in benchmark:
            if len(own & words[b["item_id"]]) >= 0.3 * len(words[b["item_id"]]) and (at := places(r["text"], b["text"])):
                want[r["doc_id"], b["item_id"]] = len(at)
    assert got == want and got


def test_replaced_words_cut_items_and_odd_rows(spark, documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    swapped = [w if k % 6 else word() for k, w in enumerate(item)]
    half = [word() for _ in range(10)] + item[:20] + [word() for _ in range(10)]
    docs = documents(
        None, "", "clean " * 30_000, " ".join(swapped).upper() + "!!", " | ".join(half), " ".join(item[:12]), " ".join(item + item),
        "six small words are an item", "six small words are no item", "the end", (3, "other text"), (None, " ".join(item)),
    )
    bench = items(spark, " ".join(item), " ".join(item), "Six small words are an item!", "the end", None, "")
    found = d.find_passages(docs.withColumn("own", F.lit(1)), bench)
    got = sorted(((r.doc_id, r.item_id, r.places) for r in found.collect()), key=str)
    twice = [(doc, item, n) for doc, n in ((3, 1), (4, 1), (6, 2), (None, 1)) for item in (100, 101)]
    assert got == sorted([*twice, (7, 102, 1)], key=str)
    kept = d.drop_matches(docs, bench)
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", F.substring("text", 1, 3).alias("text")).collect() if r.doc_id in (3, 5, 8)) == [
        (3, "oth"), (5, " ".join(item)[:3]), (8, "six"),
    ]
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5


def test_any_words_that_a_match_may_lack(spark, documents):
    """Every choice of replaced words that leaves an item of 5 to 20 words a match, each as a document."""
    bench, texts = [], []
    for n in range(d.LEAST_WORDS, d.WINDOW + 1):
        item = [f"w{n}x{k}" for k in range(n)]
        bench.append(" ".join(item))
        lack = 0 if n < d.SHORT_WORDS else n - -(-n * 4 // 5)
        for gone in itertools.combinations(range(n), lack):
            texts.append((n, " ".join("other" if k in gone else w for k, w in enumerate(item))))
    found = d.find_passages(documents(*((k, t) for k, (_, t) in enumerate(texts))), items(spark, *bench)).collect()
    assert {(r.doc_id, r.item_words) for r in found} == {(k, n) for k, (n, _) in enumerate(texts)} and len(texts) > 8000


def test_empty_tables_and_wide_benchmark(spark, documents, monkeypatch):
    docs, bench = documents("a b c d e f g h i j"), items(spark, "a b c d e f g h i j")
    assert d.find_passages(docs.limit(0), bench).count() == 0
    assert d.find_passages(docs, bench.limit(0)).count() == 0 and d.drop_matches(docs, bench.limit(0)).count() == 1
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    assert d.find_passages(docs, bench).count() == 1
