"""Token counts from pre-token frequencies.

1. Each task splits its texts into pre-tokens and counts them per document, for blocks of about ``BLOCK_PIECES``.
2. Pre-tokens that are in at least one of ``COMMON`` documents of a block are counted and summed where they are. They
   are few (a document's share of different pre-tokens times ``COMMON`` at most), so no frequent word meets in a task.
3. All others go, with their frequencies, to the partition of their hash. There each different pre-token is tokenised
   once, joined to the frequencies and summed to one partial sum per document.
4. Partial sums of a block are added up: one number a document and partition. No list of ids is made anywhere.

Cases: null text is empty and has no tokens; documents without an id, repeated rows and repeated ids each keep their
own row; strings of special tokens inside a text are what the library makes of them by default; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store
from casequarry.llm.tokens import DEFAULT_TOKENIZER, pieces_of

BLOCK_PIECES = 2_000_000
COMMON = 64
#: Pre-tokens whose counts a task of step 3 remembers.
REMEMBERED = 1_000_000
LIMIT = 512

_FREQUENCIES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("payload", pa.binary())])
_SUMS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_DDL = {
    "frequencies": "bucket int, block long, doc_ids array<long>, n_bytes array<long>, sums array<long>, payload binary",
    "sums": "block long, doc_ids array<long>, n_bytes array<long>, sums array<long>",
    "counts": "doc_id long, n_bytes long, n_tokens long",
}


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of 32-bit numbers (texts as bytes) in one compressed cell."""
    raw = [p if isinstance(p, bytes) else p.astype("<u4").tobytes() for p in parts]
    body = np.array([len(parts), *map(len, raw)], dtype="<u4").tobytes() + b"".join(raw)
    return np.uint32(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(cell: bytes) -> list[bytes]:
    body = pa.decompress(cell[4:], int.from_bytes(cell[:4], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(body[:4], "little")
    at = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u4", n, 4).astype(np.int64))])
    return [body[at[k] : at[k + 1]] for k in range(n)]


class _Block:
    """Documents of a task whose pre-tokens are counted together."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.n_bytes: list[int] = []
        self.pieces = 0

    def add(self, doc_id: int | None, text: str, pieces) -> None:
        words = self.words
        codes = np.fromiter((words.setdefault(p, len(words)) for p in pieces), dtype=np.int64)
        self.codes.append(codes)
        self.doc_ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.pieces += len(codes)

    def rows(self, block: int, buckets: int, tokenizer) -> Iterator[dict]:
        words, docs = list(self.words), len(self.doc_ids)
        who = np.repeat(np.arange(docs), [len(c) for c in self.codes])
        what = np.concatenate(self.codes)
        pairs, n = np.unique(what * docs + who, return_counts=True)
        what, who = pairs // docs, pairs % docs
        spread = np.bincount(what, minlength=len(words))
        common = spread * COMMON >= docs
        here = np.zeros(len(words), np.int64)
        at = np.flatnonzero(common)
        here[at] = [tokenizer.count(words[k]) for k in at]
        sums = np.bincount(who, here[what] * n, minlength=docs).astype(np.int64)
        yield {"bucket": -1, "block": block, "doc_ids": self.doc_ids, "n_bytes": self.n_bytes, "sums": sums.tolist(), "payload": None}
        rest = np.flatnonzero(~common)
        home = np.array([zlib.crc32(words[k].encode()) % buckets for k in rest], dtype=np.int64)
        first = np.searchsorted(what, np.arange(len(words) + 1))
        for bucket in np.unique(home):
            own = rest[home == bucket]
            texts = [words[k].encode() for k in own]
            cells = np.concatenate([np.arange(first[k], first[k + 1]) for k in own])
            payload = pack(np.array([len(t) for t in texts]), b"".join(texts), spread[own], who[cells], n[cells], np.array([docs]))
            yield {"bucket": int(bucket), "block": block, "doc_ids": None, "n_bytes": None, "sums": None, "payload": payload}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _frequencies(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, k, block = pieces_of(path), TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                text = text or ""
                block.add(doc_id, text, tokenizer.split(text))
                if block.pieces >= BLOCK_PIECES:
                    for row in block.rows((part << 24) + k, buckets, tokenizer):
                        yield _batch([row], _FREQUENCIES)
                    k, block = k + 1, _Block()
        if block.doc_ids:
            for row in block.rows((part << 24) + k, buckets, tokenizer):
                yield _batch([row], _FREQUENCIES)

    return run


def _partial_sums(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pieces_of(path)
        known: dict[str, int] = {}
        for b in batches:
            for row in b.to_pylist():
                if row["payload"] is not None:
                    sizes, text, spread, who, n, docs = unpack(row["payload"])
                    at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))])
                    words = [text[i:j].decode() for i, j in zip(at[:-1], at[1:], strict=True)]
                    if new := [w for w in words if w not in known]:
                        if len(known) + len(new) > REMEMBERED:
                            known.clear()
                            new = words
                        known.update((w, tokenizer.count(w)) for w in new)
                    each = np.repeat([known[w] for w in words], np.frombuffer(spread, "<u4"))
                    docs = int.from_bytes(docs, "little")
                    sums = np.bincount(np.frombuffer(who, "<u4"), each * np.frombuffer(n, "<u4"), minlength=docs)
                    row["sums"] = sums.astype(np.int64).tolist()
                yield _batch([{k: row[k] for k in _SUMS.names}], _SUMS)

    return run


def _added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = doc_ids = n_bytes = None
    for b in group:
        for row in b.to_pylist():
            if row["doc_ids"] is not None:
                doc_ids, n_bytes = row["doc_ids"], row["n_bytes"]
            total = np.array(row["sums"], np.int64) + (0 if total is None else total)
    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(total, pa.int64())], schema=_COUNTS)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    spark = docs.sparkSession
    store.small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_frequencies(tokenizer, buckets), _DDL["frequencies"])
    # Base rows (no payload) only pass through: they go where their block's hash says.
    at_home = found.repartition(F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket").cast("long")))
    sums = at_home.mapInArrow(_partial_sums(tokenizer), _DDL["sums"])
    return sums.groupBy("block").applyInArrow(_added, _DDL["counts"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(store.table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
