"""Repeated byte strings over all documents, found by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

1. Tasks read their texts in blocks; of equal texts in a block one goes on. Every window of ``LENGTH`` bytes has a key:
   the smallest hash of the ``GRAM`` byte strings in it. Neighbours mostly share it, so a text is a line of runs of
   windows with one key, about one run for 14 bytes. Keys go to the partition of their bucket; those of several texts
   go back. Equal windows have equal keys, so windows of other runs occur in one text only and are done.
2. What a run covers is a passage: its windows and the rest of the last one. Different passages of a block go to the
   partition of their key with the smallest id that holds them.
3. There the passages are put in a row and their suffixes sorted in two stages (``suffixes``). Neighbours with
   ``LENGTH`` common bytes hold one string; the smallest id of the string goes back to each passage that holds it.
   Passages are handled by ranges of keys of about ``SORTED_BYTES``. A key that more than ``HOT`` runs have is not kept
   together: its passages are cut into single windows, which go by their own hash.
4. Each block marks the bytes that go, by the places of its passages that the second step has sent on.

No step holds more than a block, or a partition's passages. All strings are compared by their bytes.

Cases: null text is empty; strings never cross documents; rows with one id don't remove from each other; a null
``doc_id`` comes after all ids; texts shorter than ``LENGTH`` stay; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import cells, store
from casequarry.llm.suffixes import common_prefixes, suffix_order, words8
from casequarry.llm.words import U, mixed, text_bytes

LENGTH = 50
#: Bytes of a key's strings: 16 to 24, fewer than ``LENGTH``.
GRAM = 24
BLOCK_BYTES = 8_000_000
SORTED_BYTES = 2_000_000
HOT = 20_000
#: Bytes that are hashed at once.
_STEP = 500_000
_LAST = np.iinfo(np.int64).max  # stands for a null id

_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("cell", pa.binary())])
_DDL = "bucket int, block long, kind int, cell binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
TEXTS, KEYS, PASSAGES, VERDICTS, RUNS = range(5)


def window_keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of each window of ``length`` bytes, the smallest hash of its byte strings of ``gram``."""
    key = words8(data)
    n = len(data) - gram + 1
    h = mixed(key[:n] * U(0x9E3779B97F4A7C15) + mixed(key[8 : n + 8] + U(1)) * U(0xC2B2AE3D27D4EB4F) + key[gram - 8 : n + gram - 8])
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def runs_of(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, key) of each run; ``at`` says where the texts begin in ``data``."""
    found = []
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for begin in range(0, max(0, len(data) - length + 1), _STEP):
        end = min(len(data), begin + _STEP + length - 1)
        keys = window_keys(data[begin:end], length, gram)
        who = own[begin : end - length + 1]
        place = np.flatnonzero(who == own[begin + length - 1 : end])  # windows that end in the text they begin in
        who, keys = who[place], keys[place]
        if len(keys):
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])]))
            found.append((who[new], place[new] + begin, np.diff(np.concatenate([new, [len(keys)]])), keys[new]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


def _by_bucket(home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(home):
        return
    narrow = 0 <= home.min() and home.max() < 1 << 16  # sorted in two passes
    order = np.argsort(home.astype(np.uint16) if narrow else home, kind="stable")
    own = home[order]
    at = np.flatnonzero(own[1:] != own[:-1]) + 1
    yield from zip(own[np.concatenate([[0], at])].tolist(), np.split(order, at), strict=True)


def _send_keys(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 16
        ids: list[int | None] = []
        texts: list[str] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            # Of equal texts the one with the smallest id goes on; the others know it.
            least: dict[bytes, int] = {}
            digest = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            for k, d in enumerate(digest):
                if d not in least or (_LAST if ids[k] is None else ids[k]) < (_LAST if ids[least[d]] is None else ids[least[d]]):
                    least[d] = k
            first = [least[d] for d in digest]
            own = [t if first[k] == k else None for k, t in enumerate(texts)]
            yield cells.rows(_SENT, {"bucket": block % buckets, "block": block, "kind": TEXTS, "cell": cells.columns(id=pa.array(ids, pa.int64()), first=first, text=pa.array(own, pa.string()))})
            data, at = text_bytes(pa.array(own, pa.string()))
            who, _, _, keys = runs_of(data, at, length, gram)
            for k, part in _by_bucket((keys % U(buckets)).astype(np.int64)):
                yield cells.rows(_SENT, {"bucket": k, "block": block, "kind": KEYS, "cell": cells.columns(who=who[part].astype(np.int32), key=keys[part])})

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_BYTES // 80:
                    yield from out()
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield from out()

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that several texts have go back to their blocks, with a mark on hot ones."""
    who, keys = [], []
    for b in batches:
        for row in b.to_pylist():
            if row["kind"] == TEXTS:
                yield cells.rows(_SENT, row)
            else:
                own = cells.opened(row["cell"])
                who.append(row["block"] << 24 | cells.numbers(own, "who").astype(np.int64))
                keys.append(cells.numbers(own, "key"))
    if not keys:
        return
    who, keys = np.concatenate(who), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    who, keys = who[order], keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.concatenate([begin, [len(keys)]]))
    shared = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
    on = np.repeat(shared, n)
    who, keys, hot = who[on], keys[on], np.repeat(n > HOT, n)[on]
    for block, part in _by_bucket(who >> 24):
        own = keys[part]
        once = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        cell = cells.columns(key=own[once], hot=hot[part][once])
        yield cells.rows(_SENT, {"bucket": 0, "block": block, "kind": KEYS, "cell": cell})


class _Texts:
    """Texts of a block, in their order."""

    def __init__(self, cell: bytes):
        texts = cells.opened(cell)
        self.ids = texts["id"].to_pylist()
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.first = cells.numbers(texts, "first")
        self.data, self.at = text_bytes(texts["text"])


def _passages(length: int, gram: int, buckets: int):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different passages of a block's shared keys, and the runs that hold them, for ``_result``."""
        keys, hot = [np.zeros(0, U)], [np.zeros(0, bool)]
        for b in group:
            for row in b.to_pylist():
                block = row["block"]
                if row["kind"] == TEXTS:
                    texts = _Texts(row["cell"])
                else:
                    own = cells.opened(row["cell"])
                    keys.append(cells.numbers(own, "key"))
                    hot.append(cells.numbers(own, "hot"))
        keys, hot = np.concatenate(keys), np.concatenate(hot)
        if not len(keys):
            return
        rank = np.argsort(keys)
        keys, hot = keys[rank], hot[rank]
        who, begin, n, key = runs_of(texts.data, texts.at, length, gram)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        on = np.flatnonzero(keys[place] == key)
        who, begin, n, key, is_hot = who[on], begin[on], n[on], key[on], hot[place[on]]
        # Hot runs become single windows with the window's hash as their key.
        each = np.where(is_hot, n, 1)
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        who, begin = np.repeat(who, each), np.repeat(begin, each) + within
        single = np.repeat(is_hot, each)
        n, key = np.where(single, 1, np.repeat(n, each)), np.repeat(key, each)
        raw = texts.data.tobytes()
        spans = [raw[a : a + k + length - 1] for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
        for k in np.flatnonzero(single):
            key[k] = xxhash.xxh3_64_intdigest(spans[k])
        # Different passages, by their bytes.
        known: dict[bytes, int] = {}
        passage = np.fromiter((known.setdefault(s, len(known)) for s in spans), np.int64, len(spans))
        spans = list(known)
        least, its_key = np.full(len(spans), _LAST), np.zeros(len(spans), U)
        np.minimum.at(least, passage, texts.order[who])
        its_key[passage] = key
        cell = cells.columns(step=np.diff(begin, prepend=0).astype(np.int32), n=n.astype(np.int32), passage=passage.astype(np.int32))
        yield cells.rows(_SENT, {"bucket": (block + (block >> 16)) % buckets, "block": block, "kind": RUNS, "cell": cell})
        for k, part in _by_bucket((its_key % U(buckets)).astype(np.int64)):
            cell = cells.columns(place=part.astype(np.int32), least=least[part], key=its_key[part], span=pa.array([spans[p] for p in part], pa.binary()))
            yield cells.rows(_SENT, {"bucket": k, "block": block, "kind": PASSAGES, "cell": cell})

    return run


def _result(length: int):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes of each text of a block."""
        verdicts = []
        begin = size = passage = np.zeros(0, np.int64)
        for b in group:
            for row in b.to_pylist():
                if row["kind"] == TEXTS:
                    texts = _Texts(row["cell"])
                elif row["kind"] == RUNS:
                    own = cells.opened(row["cell"])
                    begin = np.cumsum(cells.numbers(own, "step").astype(np.int64))
                    size, passage = (cells.numbers(own, c).astype(np.int64) for c in ("n", "passage"))
                else:
                    verdicts.append(row["cell"])
        order = texts.order[np.searchsorted(texts.at, begin, "right") - 1]
        n = int(passage.max()) + 1 if len(passage) else 0
        least, mask = np.full(n, _LAST), [b""] * n
        for cell in verdicts:
            own = cells.opened(cell)
            place = cells.numbers(own, "place")
            least[place] = cells.numbers(own, "least")
            for p, m in zip(place.tolist(), own["mask"].to_pylist(), strict=True):
                if m:
                    mask[p] = m
        # A passage that a smaller id holds goes whole; else its windows that smaller ids hold elsewhere.
        whole = least[passage] < order
        edge = np.zeros(len(texts.data) + 1, np.int32)
        np.add.at(edge, begin[whole], 1)
        np.add.at(edge, begin[whole] + size[whole] + length - 1, -1)
        partly = np.flatnonzero(~whole & np.array([bool(m) for m in mask], bool)[passage])
        for k in partly:
            on = np.flatnonzero(np.unpackbits(np.frombuffer(mask[passage[k]], np.uint8))[: size[k]]) + begin[k]
            np.add.at(edge, on, 1)
            np.add.at(edge, on + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for k, doc_id in enumerate(texts.ids):
            f = texts.first[k]
            a, z = texts.at[f], texts.at[f + 1]
            if texts.order[k] > texts.order[f] and z - a >= length:  # a copy of a smaller id
                out.append((doc_id, z - a, z - a, 1, hashlib.sha256(b"").hexdigest(), [0, z - a]))
                continue
            own, drop = texts.data[a:z], gone[a:z]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
            kept = own[~drop] if len(turn) else own
            out.append((doc_id, z - a, int(drop.sum()), len(turn) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), turn.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return run


def _smaller_elsewhere(spans: list[bytes], least: np.ndarray, length: int) -> dict[int, bytes]:
    """Of each passage its windows, as bits, whose bytes an id smaller than its own holds: neighbours in the suffix array.

    Passages without such a window are left out.
    """
    size = np.array([len(s) for s in spans])
    text = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(spans)), size)
    starts = np.arange(len(text)) - begin[own] <= size[own] - length
    order = suffix_order(text, length)
    order = order[starts[order]]
    new = common_prefixes(text, order, length) < length
    new[0] = True
    at = np.flatnonzero(new)
    ids = least[own[order]]
    smaller = np.zeros(len(text), bool)
    smaller[order] = np.repeat(np.minimum.reduceat(ids, at), np.diff(np.concatenate([at, [len(order)]]))) < ids
    some = np.flatnonzero(np.logical_or.reduceat(smaller, begin))
    return {k: np.packbits(smaller[begin[k] : begin[k] + size[k] - length + 1]).tobytes() for k in some.tolist()}


def _compare(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, place, least, key, span = [], [], [], [], []
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] != PASSAGES:
                    yield cells.rows(_SENT, row)
                    continue
                own = cells.opened(row["cell"])
                blocks.append(np.full(len(own), row["block"]))
                place.append(cells.numbers(own, "place"))
                least.append(cells.numbers(own, "least"))
                key.append(cells.numbers(own, "key"))
                span += own["span"].to_pylist()
        if not span:
            return
        blocks, place, least, key = (np.concatenate(x) for x in (blocks, place, least, key))
        known: dict[bytes, int] = {}
        who = np.fromiter((known.setdefault(s, len(known)) for s in span), np.int64, len(span))
        spans = list(known)
        del span, known
        smallest, own_key = np.full(len(spans), _LAST), np.zeros(len(spans), U)
        np.minimum.at(smallest, who, least)
        own_key[who] = key
        order = np.argsort(own_key, kind="stable")
        sorted_keys = own_key[order]
        sizes = np.cumsum([len(spans[k]) for k in order])
        masks: list[bytes | None] = [None] * len(spans)
        at = 0
        while at < len(order):  # ranges of keys; a key is never cut
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SORTED_BYTES, "right"))
            end = max(at + 1, end)
            if end < len(order):
                end = max(end, int(np.searchsorted(sorted_keys, sorted_keys[end - 1], "right")))
            part = order[at:end]
            for k, mask in _smaller_elsewhere([spans[k] for k in part], smallest[part], length).items():
                masks[part[k]] = mask
            at = end
        for block, part in _by_bucket(blocks):
            cell = cells.columns(place=place[part], least=smallest[who[part]], mask=pa.array([masks[k] for k in who[part]], pa.binary()))
            yield cells.rows(_SENT, {"bucket": 0, "block": int(block), "kind": VERDICTS, "cell": cell})

    return run


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end, begin, end ...)."""
    spark = docs.sparkSession
    store.small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(_send_keys(length, gram, buckets), _DDL).repartitionById(buckets, F.col("bucket"))
    blocks = store.written(sent.mapInArrow(_shared_keys, _DDL), "blocks")
    found = blocks.groupBy("block").applyInArrow(_passages(length, gram, buckets), _DDL).repartitionById(buckets, F.col("bucket"))
    verdicts = store.written(found.mapInArrow(_compare(length), _DDL), "verdicts")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    return blocks.where(F.col("kind") == TEXTS).unionByName(verdicts).groupBy("block").applyInArrow(_result(length), out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(store.table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
