import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_exact_dedup import brute as equal_texts
from tests.llm.test_decontaminate import places
from tests.llm.test_jaccard_join import brute as similar_texts
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 !"), (9002, None), (9003, "")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    columns, out = docs.columns, []
    for _, stage in p.STAGES:
        docs = p.store.written(stage(spark, docs, SF), "stage")
        out.append(docs)
    assert all(d.columns == columns for d in out[:-1])
    kept = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in out[:-1]]
    source = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert kept[0] == {k: t for k, t in source.items() if any(c.isalpha() for c in t)}
    assert sorted(kept[1]) == sorted(r[0] for r in equal_texts(list(kept[0].items())) if r[3])
    assert sorted(kept[2]) == sorted(k for k, (_, c) in similar_texts(kept[1]).items() if k == c)
    items = [b["text"] for b in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    near = lambda t, b: len(set(b.lower().split()) & set(t.lower().replace("!!", "").split())) > len(b.split()) // 4
    assert sorted(kept[3]) == sorted(k for k, t in kept[2].items() if not any(near(t, b) and places(t, b) for b in items))
    assert [len(k) for k in kept] == sorted((len(k) for k in kept), reverse=True) and len(kept[3]) < len(kept[0])
    check_packing(out[-1].collect(), kept[3], 1024)
    whole = p.run(spark, SF)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, out[-1].select(*key).collect()))


def test_odd_rows_in_every_stage(spark, documents):
    t = "the words of a document that is like another one of this table"
    docs = documents((1, t), (1, t), (2, None), (None, t), (3, ""), (4, t + " more"), (5, "word " * 30_000))
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "hash", "own", "first", "kept")}).withColumn("lang", F.lit(None).cast("string"))
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {r.doc_id for r in got.collect()} >= {1, 5}, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
