import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casequarry.llm import packing, token_counts, tokens

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)
ODD = [None, "", " ", "a", "<|endoftext|>x <|endoftext|>", "\n\n \t x", "漢字 it's 12½ ²", "word " * 30_000, "é ١\x1c \x85 z"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "'s", "é", "ab", "1", "!", "²", "漢", "̀", "\x1d"]), max_size=12).map("".join))
def test_pre_tokens_give_the_ids_of_the_library(text):
    assert tokens.pieces_of(tokens.DEFAULT_TOKENIZER).ids(text) == np.array(ids(text), "<u4").tobytes()


def test_counts_of_the_table(spark, documents, monkeypatch):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in token_counts.op9_token_counts(spark, SF).collect()}
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == {
        r["doc_id"]: (len(r["text"].encode()), n := len(ids(r["text"])), n > 512) for r in rows
    }
    odd = documents(*ODD, (3, "again"), (3, "again"), (None, "no id"))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd).collect()), key=str)
    assert got == sorted([(i, len(ids(t))) for i, t in enumerate(ODD)] + [(3, len(ids("again")))] * 2 + [(None, len(ids("no id")))], key=str)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def check_packing(rows, texts, size):
    """Every id once, sequences gapless and within their size."""
    own, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(own) == set(texts)
    for doc_id, text in texts.items():
        whole, at = [*ids(text), 0], 0
        for r in sorted(own[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    used = sum(n for spans in by_sequence.values() for _, n in spans)
    return used, len(by_sequence)


def test_packing_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    used, sequences = check_packing(packing.op1_packing(spark, SF).collect(), texts, 1024)
    assert sequences <= used // 1024 + 3


def test_packing_of_odd_rows(documents):
    docs = documents(*ODD)
    check_packing(packing.pack(docs, size=16).collect(), dict(enumerate(ODD)), 16)
    twice = packing.pack(documents((1, "a"), (1, "a"), (None, None))).collect()
    assert sorted((r.offset, r.length) for r in twice) == [(0, 2), (2, 2), (4, 1)]
    assert packing.pack(docs.limit(0)).count() == 0
    got = packing.pack(documents("a b c"), with_ids=True).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == [*ids("a b c"), 0]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_rank_once(histogram):
    fill = defaultdict(int)
    for length, a, b, first, offset in packing.shortest_pack_first(histogram, 64):
        for k in range(b - a):
            assert fill[first + k] == offset
            fill[first + k] += length
    assert all(v <= 64 for v in fill.values())
    assert sum(fill.values()) == sum(k * n for k, n in histogram.items())
