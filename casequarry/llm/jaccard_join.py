"""Near duplicates by the Jaccard similarity of word shingles: an exact join with prefix filtering.

1. Tasks hash the shingles of their texts, one set per different set and block, and send each hash to the partition of
   its bucket. There its frequency is known, and hashes that occur more than once go back to their block.
2. A set's tokens are ordered rarest first. Of a set of n, two sets of the wanted similarity must share one of the
   first ``n - ceil(0.8 n) + 1`` tokens. A token that occurs once is shared with nothing, so a set with that many of
   them has no partner and leaves: that is most sets. The prefixes of the others are joined on their tokens.
3. Partners of one token are first joined to the most shared set among them (and to that of their size), never each to
   each: linear in the group. Length and positional filters drop pairs, a suffix filter and the count of common tokens
   decide. This links groups of near copies as stars.
4. Sets that share a prefix token and are not linked yet are compared as well, each pair once, in blocks of sets:
   blocks meet if they share a token, and a task compares two blocks in memory. So no pair of a group becomes a row,
   and pairs within one component are not compared. Of tokens that lie in the same blocks only one makes them meet.
   Sets without near ones would be blocks of one each: those that share a frequent token lie in blocks of that token.
5. Links become components. Sets of equal content count as one throughout, so copies cost nothing.

Hashes have 64 bits and equal sets are recognised by 128 bits. No filter drops a qualifying pair, there are no caps.

Cases: null or empty text, or one without words, has no shingles and is a component of its own; a text shorter than a
shingle is one shingle; repeated rows and ids are documents of equal content; a null ``doc_id`` never names a component
that has another; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store
from casequarry.llm.components import components
from casequarry.llm.words import BASE, U, shingle_hashes, word_hashes

WIDTH = 5
#: Similarity of a link, in hundredths.
SIMILAR = 80
#: Hashes of a block of step 1; sets and tokens of a block of step 4.
BLOCK_HASHES = 2_000_000
BLOCK_SETS, BLOCK_TOKENS = 256, 500_000
#: Sets of so many orbits that share a token go to the token's own blocks.
SPREAD_ORBITS = 8

_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("who", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("who", pa.binary()), ("hashes", pa.binary()), ("n", pa.binary()), ("docs", pa.binary())])
_SETS = pa.schema([("e", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("set_key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("row", pa.int64())])
_DDL = {
    "sent": "bucket int, block long, who binary, hashes binary, docs binary",
    "back": "block long, who binary, hashes binary, n binary, docs binary",
    "sets": "e long, n long, own long, set_key binary, prefix array<long>, tokens array<long>",
    "docs": "doc_id long, n_shingles long, set_key binary, row long",
}


def least_common(n: np.ndarray | int, m: np.ndarray | int, similar: int = SIMILAR):
    """Common tokens that sets of n and m need at least: 100 * common >= similar * (n + m - common)."""
    return -(-similar * (n + m) // (100 + similar))


def prefix_size(n: np.ndarray | int, similar: int = SIMILAR):
    """Of the rarest tokens of a set of n, a partner shares one of so many."""
    return n + (-similar * n // 100) + 1


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    words, at = word_hashes(column)
    hashes = shingle_hashes(words, width)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(hashes[a : b - width + 1]))
        else:
            out.append(shingle_hashes(words[a:b], int(b - a)) * U(BASE) + U(b - a) if b > a else np.zeros(0, U))
    return out


def _compressed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + pa.compress(x.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _opened(cell: bytes) -> np.ndarray:
    n = int.from_bytes(cell[:4], "little")
    return np.frombuffer(pa.decompress(cell[4:], 4 * n, codec="zstd", asbytes=True), "<u4")


def _ipc(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _docs_of(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(cell).read_all()


def _send(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 16
        ids, numbers, sizes, keys, place, sets, seen, held = [], [], [], [], [], [], {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            docs = pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in ((ids, pa.int64()), (sizes, pa.int64()), (keys, pa.binary()), (numbers, pa.int64()), (place, pa.int64()))],
                names=["doc_id", "n", "set_key", "row", "place"],
            )
            yield pa.RecordBatch.from_pylist([{"bucket": block % buckets, "block": block, "docs": _ipc(docs)}], schema=_SENT)
            hashes = np.concatenate([*sets, np.zeros(0, U)])
            who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            home = (hashes % U(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            at = np.searchsorted(home[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(at)):
                own = order[at[k] : at[k + 1]]
                row = {"bucket": int(k), "block": block, "who": _compressed(who[own]), "hashes": hashes[own].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_SENT)

        for b in batches:
            for doc_id, row, own in zip(b["doc_id"].to_pylist(), b["row"].to_pylist(), sets_of(b["text"], width), strict=True):
                key = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                if key is not None and key not in seen:
                    seen[key] = len(sets)
                    sets.append(own)
                    held += len(own)
                ids.append(doc_id)
                numbers.append((block << 24) + len(numbers) if row is None else row)
                sizes.append(len(own))
                keys.append(key)
                place.append(seen.get(key))
            if held >= BLOCK_HASHES or len(ids) >= BLOCK_HASHES // 20:
                yield from rows()
                block += 1
                ids, numbers, sizes, keys, place, sets, seen, held = [], [], [], [], [], [], {}, 0
        if ids:
            yield from rows()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the hashes of this partition, those that occur more than once go back with their frequency."""
    blocks, who, hashes = [], [], []
    for b in batches:
        for row in b.to_pylist():
            if row["docs"] is not None:
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "docs": row["docs"]}], schema=_BACK)
            else:
                who.append(_opened(row["who"]))
                hashes.append(np.frombuffer(row["hashes"], U))
                blocks.append(np.full(len(who[-1]), row["block"], np.int64))
    if not hashes:
        return
    hashes, who, blocks = np.concatenate(hashes), np.concatenate(who), np.concatenate(blocks)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    n = np.diff(np.concatenate([begin, [len(ranked)]]))
    often = np.repeat(n > 1, n)
    if not often.any():
        return
    order, n = order[often], np.repeat(n, n)[often]
    by_block = np.argsort(blocks[order], kind="stable")
    order, n = order[by_block], n[by_block]
    own = blocks[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    for a, z in zip(at, [*at[1:], len(own)], strict=True):
        part = order[a:z]
        row = {"block": int(own[a]), "who": _compressed(who[part]), "hashes": hashes[part].tobytes(), "n": _compressed(n[a:z])}
        yield pa.RecordBatch.from_pylist([row], schema=_BACK)


def _candidates(similar: int):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of a block that can have a partner: too few of their rarest tokens are theirs alone."""
        docs, block, who, hashes, n = None, None, [], [], []
        for b in group:
            for row in b.to_pylist():
                block = row["block"]
                if row["docs"] is not None:
                    docs = _docs_of(row["docs"])
                else:
                    who.append(_opened(row["who"]).astype(np.int64))
                    hashes.append(np.frombuffer(row["hashes"], U))
                    n.append(_opened(row["n"]))
        if not who:
            return
        who, hashes, n = np.concatenate(who), np.concatenate(hashes), np.concatenate(n)
        order = np.lexsort((hashes, n, who))
        who, hashes = who[order], hashes[order].view(np.int64)
        place, size, keys = (docs[c].to_pylist() for c in ("place", "n", "set_key"))
        first = {p: k for k, p in reversed(list(enumerate(place))) if p is not None}
        at = np.searchsorted(who, np.arange(len(first) + 1))
        rows = []
        for p, k in first.items():
            own = hashes[at[p] : at[p + 1]]
            alone = size[k] - len(own)
            take = prefix_size(size[k], similar) - alone
            if take > 0 and len(own):
                rows.append({"e": (block << 24) + p, "n": size[k], "own": alone, "set_key": keys[k], "prefix": own[:take], "tokens": np.sort(own)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SETS)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for cell in b["docs"].to_pylist():
            docs = _docs_of(cell)
            yield pa.RecordBatch.from_arrays([docs[c].combine_chunks() for c in ("doc_id", "n", "set_key", "row")], schema=_DOCS)


def suffix_allows(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """False if halves of the sorted sets, split at one token, can't share ``need`` tokens between them."""
    if min(len(a), len(b)) < need:
        return False
    if depth == 0 or need <= 0 or len(a) < 8:
        return True
    k = len(a) // 2
    j = int(np.searchsorted(b, a[k]))
    both = min(k, j) + min(len(a) - k, len(b) - j)
    if both < need:
        return False
    left = need - min(len(a) - k, len(b) - j)
    right = need - min(k, j)
    return suffix_allows(a[:k], b[:j], left, depth - 1) and suffix_allows(a[k:], b[j:], right, depth - 1)


def _verify_pairs(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for a, z, n, m, left, right in zip(*(b[c] for c in ("a", "b", "n", "m", "left", "right")), strict=True):
                need = int(least_common(n.as_py(), m.as_py(), similar))
                x, y = left.values.to_numpy(), right.values.to_numpy()
                if suffix_allows(x, y, need) and len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    found.append((a.as_py(), z.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of common tokens of every set of x with every set of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    flat, own = np.concatenate(y), np.repeat(np.arange(len(y)), [len(s) for s in y])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    for k, s in enumerate(x):
        a, z = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        hit = np.flatnonzero(z > a)
        n = z[hit] - a[hit]
        at = np.repeat(a[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[k] = np.bincount(own[at], minlength=len(y))
    return out


def _verify_blocks(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(["left", "right", "same"]).to_pylist():
                sides = []
                for side in ("left", "right"):
                    own = row[side]
                    sides.append(([np.array(s["tokens"], np.int64) for s in own], *(np.array([s[c] for s in own]) for c in ("e", "n", "root"))))
                (x, e, n, root), (y, f, m, other) = sides
                wanted = (5 * 20 * np.minimum.outer(n, m) >= similar * np.maximum.outer(n, m)) & (root[:, None] != other[None, :])
                if row["same"]:
                    wanted &= e[:, None] < f[None, :]
                rows = np.flatnonzero(wanted.any(axis=1))
                if len(rows):
                    need = least_common(n[rows][:, None], m[None, :], similar)
                    hit = (_common([x[k] for k in rows], y) >= need) & wanted[rows]
                    at, to = np.nonzero(hit)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(e[rows[at]]), pa.array(f[to])], names=["a", "b"])

    return run


def _links(sets: DataFrame, similar: int) -> DataFrame:
    """Roots (node, root) of the sets (e, n, own, prefix, tokens) that have a link."""
    spark = sets.sparkSession
    flat = sets.select("e", "n", (F.col("own") / F.col("n")).alias("alone"), "own", F.posexplode("prefix").alias("k", "hash"))
    size = F.floor(F.log("n") / F.log(F.lit(100.0 / similar))).cast("int")
    postings = store.written(flat.select("e", "n", "alone", (F.col("own") + F.col("k")).alias("pos"), size.alias("size"), "hash"), "postings")

    # Stars: everyone meets the most shared set of the token, and that of its size.
    pivot = F.min(F.struct("alone", "e", "n", "pos")).alias("pivot")
    stars = None
    for by in (["hash"], ["hash", "size"]):
        met = postings.join(postings.groupBy(*by).agg(pivot, F.count(F.lit(1)).alias("many")).where("many > 1"), by)
        met = met.where((F.col("e") != F.col("pivot.e")) & (100 * F.least("n", "pivot.n") >= similar * F.greatest("n", "pivot.n")))
        met = met.select(F.col("pivot.e").alias("a"), F.col("e").alias("b"), F.col("pivot.n").alias("n"), F.col("n").alias("m"), F.col("pivot.pos").alias("p"), F.col("pos").alias("q"))
        stars = met if stars is None else stars.unionByName(met)
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    swap = F.col("a") > F.col("b")
    stars = stars.select(low, high, F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m"), F.when(swap, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("q"))
    pairs = stars.groupBy("a", "b", "n", "m").agg(F.min("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("shared"))
    # Positional filter: what the sets can still share from their first common token on.
    need = F.ceil(F.lit(similar) * (F.col("n") + F.col("m")) / F.lit(100.0 + similar) - 1e-9)
    pairs = store.written(pairs.where(F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= need), "pairs")
    tokens = sets.select("e", "tokens")
    both = pairs.join(tokens.withColumnsRenamed({"e": "a", "tokens": "left"}), "a").join(tokens.withColumnsRenamed({"e": "b", "tokens": "right"}), "b")
    linked = store.written(both.select("a", "b", "n", "m", "left", "right").mapInArrow(_verify_pairs(similar), "a long, b long"), "stars")
    roots = components(linked)

    # What is left: sets of different components that share a prefix token, block by block.
    star_of = pairs.select(F.col("a").alias("e"), F.col("b").alias("o"), "shared").unionByName(pairs.select(F.col("b").alias("e"), F.col("a").alias("o"), "shared"))
    # The orbit of a set is the component of its closest partner, so a crowd's outsiders share their blocks.
    orbit = star_of.groupBy("e").agg(F.max(F.struct("shared", (-F.col("o")).alias("less"))).alias("most"))
    orbit = orbit.select("e", (-F.col("most.less")).alias("o"))
    other = roots.select(F.col("node").alias("o"), F.col("root").alias("near"))
    orbit = orbit.join(other, "o", "left").select("e", F.coalesce("near", "o").alias("orbit"))
    alone = sets.select("e", F.size("tokens").alias("weight"))
    known = alone.join(roots.withColumnRenamed("node", "e"), "e", "left").join(orbit, "e", "left")
    known = known.select("e", "weight", F.coalesce("root", "e").alias("root"), F.coalesce("orbit", "root", "e").alias("orbit"))
    crowd = known.groupBy("root").agg(F.count(F.lit(1)).alias("crowd"))
    known = known.join(crowd, "root").withColumn("kind", F.when(F.col("crowd") >= BLOCK_SETS // 4, F.col("root")).otherwise(-1))
    known = known.withColumn("orbit", F.when(F.col("kind") >= 0, F.col("root")).otherwise(F.col("orbit")))
    # Lone sets with a frequent token in common would be a block each: they share the blocks of their most spread token.
    known = store.written(known, "known")
    lone = postings.select("e", "hash").join(known.where("kind = -1").select("e", "orbit"), "e")
    spread = lone.select("hash", "orbit").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("orbits")).where(F.col("orbits") >= SPREAD_ORBITS)
    most = lone.join(spread, "hash").groupBy("e").agg(F.max(F.struct("orbits", "hash")).alias("most")).select("e", F.col("most.hash").alias("token"))
    known = known.join(most, "e", "left").select(
        "e", "weight", "root", F.coalesce("token", "orbit").alias("orbit"), F.when(F.col("token").isNotNull(), -2).otherwise(F.col("kind")).alias("kind")
    )
    parts = known.groupBy("orbit", "kind").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("weight") / BLOCK_TOKENS)).alias("parts"))
    group = F.xxhash64("orbit", "kind", F.pmod(F.xxhash64("e"), F.col("parts")))
    member = store.written(known.join(parts, ["orbit", "kind"]).select("e", "root", group.alias("g")), "members")
    met = postings.join(member, "e").groupBy("hash", "g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    met = store.written(met, "met")
    # Tokens of a crowd lie in the same blocks; one of them stands for all with its signature (128 bits and their number).
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "g", "low", "high")).alias(f"mark{k}") for k in range(2)]
    several = met.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("held"), *marks)
    several = several.where("low <> high").groupBy("held", "mark0", "mark1").agg(F.min("hash").alias("hash"))
    open_ = met.join(several.select("hash"), "hash", "left_semi")
    one, two = open_.select("hash", F.col("g").alias("a"), "low", "high"), open_.select("hash", F.col("g").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = one.join(two, "hash").where((F.col("a") <= F.col("b")) & ((F.col("low") != F.col("high2")) | (F.col("high") != F.col("low2"))))
    meet = store.written(meet.select("a", "b").distinct(), "meetings")
    cells = sets.join(member, "e").select("g", F.struct("e", "n", "root", "tokens").alias("cell"))
    blocks = store.written(cells.groupBy("g").agg(F.collect_list("cell").alias("cells")), "blocks")
    # Blocks go to their meetings, dealt by block: a broadcast of the few meetings would leave all work where blocks lie.
    left, right = (blocks.withColumnsRenamed({"g": g, "cells": side}).hint("merge") for g, side in (("a", "left"), ("b", "right")))
    both = meet.join(left, "a").join(right, "b")
    both = both.select((F.col("a") == F.col("b")).alias("same"), "left", "right")
    more = store.written(both.mapInArrow(_verify_blocks(similar), "a long, b long"), "links")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def find_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    width: int = WIDTH,
    similar: int = SIMILAR,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, first (the row stands for its component), row.

    ``row_col`` names a column with a number of each row, if there is one.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(row_col) if row_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), number.cast("long").alias("row"))
    sent = rows.mapInArrow(_send(width, buckets), _DDL["sent"])
    counted = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_count, _DDL["back"])
    back = store.reread(counted, counted_at := store.write(counted, "frequencies"))
    every = store.written(back.where(F.col("docs").isNotNull()).select("docs").mapInArrow(_documents, _DDL["docs"]), "documents")
    found = back.groupBy("block").applyInArrow(_candidates(similar), _DDL["sets"])
    found = store.reread(found, found_at := store.write(found, "sets"))
    once = found.groupBy("set_key").agg(F.min("e").alias("e"))
    sets = store.written(found.join(once.select("e"), "e", "left_semi"), "candidates")
    store.discard(spark, counted_at, found_at)

    with store.recorded() as linking:
        roots = store.write(_links(sets, similar), "roots")
    store.discard(spark, *linking[:-1])
    roots = spark.read.parquet(roots)
    keys = sets.select("e", "set_key")
    cluster = roots.join(keys.withColumnRenamed("e", "node"), "node").join(keys.withColumnsRenamed({"e": "root", "set_key": "cluster"}), "root")
    placed = every.join(cluster.select("set_key", "cluster"), "set_key", "left").select(
        "doc_id", "n_shingles", "row", F.coalesce("cluster", "set_key", F.col("row").cast("string").cast("binary")).alias("cluster")
    )
    placed = store.written(placed, "clusters")
    least = placed.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    return placed.join(least, "cluster").select(
        "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("first"), "row"
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of the smallest id, with all its columns."""
    rows, row = store.numbered(docs)
    gone = find_similar(rows, id_col, text_col, row).where(~F.col("first"))
    return rows.join(gone.select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_similar(store.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES: dict[str, str] = {}
