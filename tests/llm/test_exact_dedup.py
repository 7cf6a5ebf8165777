import hashlib
import re

from pyspark.sql import functions as F

from casequarry.llm import exact_dedup as e


def brute(rows):
    groups = {}
    norm = {i: re.sub(r"[ \t-\r]+", " ", t or "") for i, t in rows}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return sorted(
        (i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for i, t in norm.items()
    )


TEXTS = ["a b", "a\n\tb", None, "", " ", "a  b ", "ä" * 5000, "ä" * 5000, "x", "a b", "\x0ba b", "\xa0a b"]


def test_equals_brute_force(documents, tables, spark):
    got = e.op7_exact_dedup(spark, tables(documents=documents(*TEXTS))).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(TEXTS)))


def test_buckets_split_and_keep_the_result(documents):
    texts = [f"t{i % 300}" for i in range(700)]
    found = e.find_copies(documents(*texts), bucket_rows=8)
    got = found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))
    sizes = found.where("kept").groupBy("bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 8 and sizes.count() > 300 / 8


def test_repeated_rows_null_ids_and_empty_table(documents):
    docs = documents((3, "x"), (3, "x"), (None, "x"), (None, "y"), (None, "y"))
    kept = e.drop_copies(docs)
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == [(3, "x")]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["y"]
    assert kept.columns == docs.columns
    assert e.find_copies(docs.limit(0)).count() == 0 and e.drop_copies(docs.limit(0)).count() == 0


def test_chain_of_one_fingerprint(documents, monkeypatch):
    """All texts collide: bytes still tell them apart."""
    monkeypatch.setattr(e.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    found = e.find_copies(documents("a", "b", "a", None), bucket_rows=1)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.link > 0) for r in found.collect()) == [
        (0, 0, 2, True), (1, 1, 1, True), (2, 0, 2, True), (3, 3, 1, True),
    ]


def test_clashing_column_names(documents):
    docs = documents("a", "a").withColumns({n: F.lit(1) for n in ("h", "row", "norm", "bucket", "first", "entry", "kept", "_row")})
    assert e.drop_copies(docs).columns == docs.columns
    assert e.drop_copies(docs).count() == 1
