import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from casequarry.llm import jaccard_join as j
from casequarry.llm.components import components

SF = "/root/testdata/sf0.001"


def roots_of(nodes, links):
    root = {k: k for k in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


def brute(texts):
    sets, holders, links = {}, defaultdict(list), []
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        common = Counter(o for s in sets[k] for o in holders[s])
        links += [(k, o) for o, n in common.items() if 100 * n >= 80 * (len(sets[k]) + len(sets[o]) - n)]
        for s in sets[k]:
            holders[s].append(k)
    found = roots_of(texts, links)
    return {k: (len(sets[k]), found[k]) for k in texts}


def run(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in j.find_similar(docs).collect()}


def test_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.op3_jaccard_join(spark, SF).collect()}
    assert got == brute(texts) and any(k != c for k, (_, c) in got.items())


def test_a_crowd_of_near_copies_and_odd_texts(documents, monkeypatch):
    """Similarities around the limit, so that stars miss links and blocks have to find them."""
    monkeypatch.setattr(j, "BLOCK_SETS", 8)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = [None, "", " \t", "one", "One", "a b c", "A b c", "x " * 50_000, "X " * 40_000, "one two three four five"]
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
            own[at] = f"v{rng.randrange(4)}"
        texts.append(" ".join(own) + " tail" * (k % 3))
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(5, 45)]
    assert run(documents(*texts)) == brute(dict(enumerate(texts)))


def test_repeated_rows_null_ids_and_empty_table(documents):
    docs = documents((5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, ""), (9, None))
    got = j.find_similar(docs.withColumn("hash", F.lit(1)).withColumn("row", F.lit(2))).collect()
    assert sorted(((r.doc_id, r.component_id, r.first) for r in got), key=str) == [
        (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True), (None, 3, False), (None, None, True),
    ]
    assert j.find_similar(docs.limit(0)).count() == 0


def test_no_filter_drops_a_pair():
    rng = random.Random(5)
    for _ in range(400):
        a = sorted(rng.sample(range(60), rng.randrange(1, 50)))
        b = sorted(set(a) - set(rng.sample(a, len(a) // 8)) | set(rng.sample(range(60), 3)))
        common = len(set(a) & set(b))
        assert (100 * common >= 80 * (len(a) + len(b) - common)) == (common >= j.least_common(len(a), len(b)))
        assert j.suffix_allows(j.np.array(a), j.np.array(b), common)
        assert not j.suffix_allows(j.np.array(a), j.np.array(b), min(len(a), len(b)) + 1)


def test_short_texts_are_one_shingle_and_words_are_bytes():
    sets = j.sets_of(pa.array(["a b", "A  B", "a b c d e", "é\xa0x y", None, "b a"]), 5)
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 1]
    assert sets[0] == sets[1] and sets[0] != sets[5]


def test_components_of_a_chain_and_of_nothing(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7), (50, 60), (60, 55)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots_of(got, links) and len(got) == 41 + 2 + 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lone_sets_with_frequent_words_share_blocks(documents, monkeypatch):
    rng = random.Random(5)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line = some(64)
    texts = {k: " ".join(line + some(10)) for k in range(1, 61)}  # 60 of 80 shingles in common: no two are similar
    texts[70] = texts[7] + " " + " ".join(some(3))
    met, real = [], j.store.write
    monkeypatch.setattr(j.store, "write", lambda df, label, *a: (met.append(df.count()) if label == "meetings" else None, real(df, label, *a))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.find_similar(documents(*texts.items())).collect()}
    assert got == brute(texts) and got[70][1] == 7
    assert len(met) == 1 and met[0] < 60


def test_texts_without_a_repeated_shingle(documents):
    texts = dict(enumerate(["a b c d e f g h", "i j k l m n", None, "o"]))
    got = j.find_similar(documents(*texts.items())).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)
