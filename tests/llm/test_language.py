import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from casequarry.llm import language as l

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples():
    return [(r["lang"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def field(samples):
    return l.fit([(lang, " ".join(t.split()[:80])) for lang, t in samples[:300]])


def plain(words, moves):
    """Forward-backward word by word."""
    n, kinds = words.shape
    forward, a = np.zeros((n, kinds)), np.full(kinds, 1 / kinds)
    for t in range(n):
        a = (a @ moves) * words[t]
        forward[t] = a = a / a.sum()
    out, b = np.zeros((n, kinds)), np.ones(kinds)
    for t in range(n - 1, -1, -1):
        out[t] = forward[t] * b / (forward[t] * b).sum()
        b = moves @ (words[t] * b)
        b /= b.sum()
    return out, forward


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunks_give_what_one_pass_gives(chunk):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 3, 7, 64, 65, 130])
    words, moves = rng.random((lengths.sum(), 3)) + 1e-3, rng.random((3, 3)) + 0.01
    got = l.posteriors(words, moves, lengths, chunk)
    at = np.cumsum(lengths) - lengths
    for k in range(2):
        want = np.concatenate([plain(words[a : a + n], moves)[k] for a, n in zip(at, lengths, strict=True)])
        assert np.allclose(got[k], want)


def test_words_of_a_text_that_switches(field, samples):
    a = next(l.words_of(t) for lang, t in samples if lang == "en" and len(t) > 2000)[:40]
    b = next(l.words_of(t) for lang, t in samples if lang == "de" and len(t) > 2000)[:40]
    post, _ = l.posteriors(field.scores(a + b), field.moves, np.array([80]))
    found = [field.langs[k] for k in post.argmax(axis=1)]
    assert np.mean([x == "en" for x in found[:40]]) > 0.9 and np.mean([x == "de" for x in found[40:]]) > 0.9
    assert (np.diag(field.moves) > 1).all() and (field.moves - np.diag(np.diag(field.moves)) < 1).all()


def test_held_out_documents(spark, samples):
    got = {r.doc_id: r for r in l.op8_language(spark, SF).collect()}
    assert len(got) == len(samples)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [(got[k].lang_pred, lang) for k, (lang, _) in enumerate(samples) if got[k].held_out]
    assert len(own) > 200 and np.mean([p == lang for p, lang in own]) > 0.98


def test_odd_rows(spark, documents, field):
    docs = documents(None, "", "12 ² !", "the and of", "word " * 50_000, (3, "the and of"), (None, "la de los"))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.shares) for r in l.label(docs, field).collect()]
    assert [g[2] for g in got[:3]] == ["und"] * 3 and got[3][2] == "en" and got[5][2] == "en"
    assert got[6][:2] == (None, False) and abs(sum(got[4][3].values()) - 1) < 1e-6
    assert l.learn(docs.limit(0)) is None and l.learn(docs.withColumn("lang", l.F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in l.label(docs, None).collect()} == {("und", 0.0)}
    assert l.label(docs.limit(0), field).count() == 0
    assert l.fit([("xx", "only one language")]).langs == ["xx"]
