"""The prefix trie of conversations: a skeleton over the splitters of sorted shards, all else finished inside the shards.

1. A turn becomes a digest of role and text and the length of its text; a conversation's path is its digests in order.
   Texts go no further than this. Paths are rebuilt: a conversation begins with turns of the first one of its hundred.
2. Conversations are ranged by (path, id) into shards and sorted there, so members of a node are neighbours. Equal
   paths are told apart by id, and a path that a third of all conversations share lies in many shards.
3. A node spans two shards only if it is on the path that the last conversation of one and the first of the next have in
   common. These paths of the splitters form the skeleton trie. It is broadcast in its shortest form, two numbers a
   splitter: how deep its path goes, and how much of it the splitter before has too.
4. Each shard finishes its own nodes, and adds up its share of the skeleton nodes on its first and last path: a node is
   opened in the first shard that holds it (where it counts as its parent's child) and closed in the last (where it shows
   whether it is a leaf). Such shares are sums, so one reduction by skeleton node gives whole nodes, descendants included.
5. Ids that end at a skeleton node are sent as pieces of text in order, and digested in that order as a stream.

A shard's digests and numbers (about 30 bytes a turn) lie in one task; ``SHARD_TURNS`` gives the number of shards. The
one thing that cannot be split is one conversation's own path: its digests must fit a task (its texts need not).

Cases: null role or text is empty; turns are ordered by number, null first, and those with one number by their digest;
rows with a null ``conv_id`` name no conversation and are left out; repeated rows are turns of their own; an empty table
gives no rows; other columns are not read. Ids are truncated towards zero when the first one of a hundred is sought.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casequarry.llm import store
from casequarry.scale import lookup

#: Conversations of a hundred share turns of the first of them, up to HEADS - 1.
FAMILY = 100
HEADS = 6
#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of a shard, about.
SHARD_TURNS = 200_000
#: Characters of ids in one piece.
PIECE_CHARS = 65_536
#: Skeleton nodes up to this number are broadcast to their children; more are joined by a shuffle.
BROADCAST_NODES = 100_000

NODE, SHARE, PIECE = 0, 1, 2
_FOUND = pa.schema([
    ("kind", pa.int8()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("splitter", pa.int64()), ("parent_splitter", pa.int64()), ("shard", pa.int64()), ("seq", pa.int64()), ("ids", pa.string()),
])
_DDL = (
    "kind byte, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, splitter long, parent_splitter long, shard long, seq long, ids string"
)
NOTHING = hashlib.sha256(b"").hexdigest()


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): digests of the turns in one binary, and the code points of each text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps (role, text) apart from other pairs with the same letters.
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    cell = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("digest"), F.length(text).alias("size"))
    cells = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), cell.alias("cell"))
    gathered = cells.groupBy("conv_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return gathered.select(
        "conv_id", F.unhex(F.array_join("cells.digest", "")).alias("path"), F.col("cells.size").alias("sizes")
    )


def rebuilt(paths: DataFrame) -> DataFrame:
    """Paths whose first turns are those of the first conversation of their hundred."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = paths.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"),
        F.substring("path", 1, WIDTH * (HEADS - 1)).alias("head"),
        F.slice("sizes", 1, HEADS - 1).alias("head_sizes"),
    )
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    both = paths.withColumns({"base": base, "taken": taken.cast("int")}).join(heads, "base", "left")
    own = F.expr(f"substring(path, {WIDTH} * taken + 1)")
    none = F.lit("").cast("binary")
    return both.select(
        "conv_id",
        F.concat(F.coalesce(F.expr(f"substring(head, 1, {WIDTH} * taken)"), none), F.coalesce(own, none)).alias("path"),
        F.concat(
            F.coalesce(F.slice("head_sizes", F.lit(1), F.col("taken")), F.expr("array()").cast("array<int>")),
            F.slice("sizes", F.col("taken") + 1, F.size("sizes")),
        ).alias("sizes"),
    )


def _common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two paths have in common."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0] if len(differ) else n) // WIDTH


def skeleton(shards: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, depth, shared) of each shard, in order.

    ``depth``: of the splitter in front of the shard, the path that it shares with the shard before (-1 for the first).
    ``shared``: how much of that is also the path of the splitter before. Three numbers a shard come to the driver.
    """
    ends = shards.groupBy("shard").agg(
        F.min(F.struct("path", "conv_id"))["path"].alias("first"), F.max(F.struct("path", "conv_id"))["path"].alias("last")
    )
    # One row a shard, so this window is small.
    before = Window.orderBy("shard")
    lined = ends.select("shard", "first", F.lag("last").over(before).alias("last"), F.lag("first").over(before).alias("first_before"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["shard"], _common(r["first"], r["last"]), _common(r["first"], r["first_before"])) for r in b.to_pylist()]
            names = ["shard", "depth", "along"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3, names)

    found = sorted(tuple(r) for r in lined.mapInArrow(compare, "shard long, depth long, along long").collect())
    out, previous = [], -1
    for shard, depth, along in found:
        out.append((shard, depth, min(depth, previous, along)))
        previous = depth
    return out


def owners(trie: list[tuple[int, int, int]], at: int) -> np.ndarray:
    """For each depth of the splitter ``at``, the first splitter that has the same node there: the node's name."""
    names = np.zeros(0, np.int64)
    for k in range(at + 1):
        _, depth, shared = trie[k]
        names = np.concatenate([names[: shared + 1], np.full(depth - shared, k, np.int64)])
    return names


def _ids(values: np.ndarray) -> str:
    return ",".join(map(str, values.tolist()))


def shard_nodes(
    shard: int, paths: list[bytes], ids: np.ndarray, sizes: list[np.ndarray], left: np.ndarray, right: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Nodes of one sorted shard. ``left`` and ``right`` name the skeleton nodes on its first and on its last path."""
    n = len(paths)
    lens = np.array([len(p) // WIDTH for p in paths], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    words = np.frombuffer(b"".join(paths), np.dtype([("a", "<u8"), ("b", "<u8")]))
    row_of = np.repeat(np.arange(n), lens)
    place = np.arange(len(row_of)) - starts[row_of]
    # A turn is shared with the row before if all turns up to it are equal; the first that is not ends it.
    earlier = starts[np.maximum(row_of - 1, 0)] + place
    comparable = (row_of > 0) & (place < lens[np.maximum(row_of - 1, 0)])
    same = np.zeros(len(row_of), bool)
    same[comparable] = words[comparable.nonzero()[0]] == words[earlier[comparable]]
    shared = lens.copy()
    np.minimum.at(shared, row_of[~same], place[~same])
    # From here on every row also has the root, at depth 0.
    row = np.repeat(np.arange(n), lens + 1)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    depth = np.arange(len(row)) - begin[row]
    size = np.zeros(len(row), np.int64)
    size[depth > 0] = np.concatenate(sizes) if len(row_of) else 0
    fresh = (depth > shared[row]) | (row == 0)
    # Members of a node are neighbours among the rows of its depth.
    order = np.lexsort((row, depth))
    head = fresh[order].nonzero()[0]
    node = np.empty(len(row), np.int64)
    node[order] = np.cumsum(fresh[order]) - 1
    level, length, first_row = depth[order][head], size[order][head], row[order][head]
    total = np.add.reduceat(np.ones(len(row), np.int64), head)
    last_row = first_row + total - 1
    smallest = np.minimum.reduceat(ids[row[order]], head)
    # On the shard's first path a node may have been opened before, on its last path it may go on.
    opened = ~((first_row == 0) & (level < len(left)))
    closed = ~((last_row == n - 1) & (level < len(right)))
    name = np.full(len(level), -1, np.int64)
    name[~closed] = right[level[~closed]]
    name[~opened] = left[level[~opened]]
    # Weights of nodes, on the row and place where the shard has them first, added up below each node.
    at = begin[first_row] + level
    leaf, saved, child = (np.zeros(len(row), np.int64) for _ in range(3))
    leaf[at] = closed & (lens[last_row] == level)
    saved[at] = (total - opened) * length
    child[at] = opened
    below = lambda x: np.cumsum(x[::-1])[::-1]
    after = begin[row + 1]
    rest = [np.concatenate([below(x), [0]]) for x in (leaf, saved)]
    leaves, kept = (np.add.reduceat((x[:-1] - x[after])[order], head) for x in rest)
    next_child = np.where(depth < lens[row], np.concatenate([child[1:], [0]]), 0)
    children = np.add.reduceat(next_child[order], head)
    # Members that end at a node are its first ones, in order of id.
    ends = np.add.reduceat((lens[row] == depth)[order].astype(np.int64), head)
    parent = np.where(level > 0, node[at - 1], -1)
    parent_name = np.where(level > 0, name[parent], -1)
    local = (opened & closed).nonzero()[0]
    digests = [hashlib.sha256(_ids(ids[a : a + k]).encode()).hexdigest() if k else NOTHING for a, k in zip(first_row[local], ends[local], strict=True)]
    yield _batch(
        len(local), kind=NODE, conv_id=smallest[local], depth=level[local],
        parent_conv_id=pa.array(smallest[parent[local]], mask=(parent[local] < 0) | (parent_name[local] >= 0)), n_convs=total[local], n_children=children[local],
        n_leaves=leaves[local], saved_tokens=kept[local], ends_sha256=digests, parent_splitter=parent_name[local],
    )
    part = (~(opened & closed)).nonzero()[0]
    yield _batch(
        len(part), kind=SHARE, conv_id=smallest[part], depth=level[part], n_convs=total[part], n_children=children[part],
        n_leaves=leaves[part], saved_tokens=kept[part], splitter=name[part], parent_splitter=parent_name[part],
    )
    step = PIECE_CHARS // 21  # no id is longer than 20 characters
    for k in part[ends[part] > 0]:
        for seq, a in enumerate(range(0, ends[k], step)):
            members = ids[first_row[k] + a : first_row[k] + min(a + step, ends[k])]
            yield _batch(1, kind=PIECE, depth=level[[k]], splitter=name[[k]], shard=[shard], seq=[seq], ids=[_ids(members)])


def _batch(n: int, kind: int, **columns) -> pa.RecordBatch:
    cells = [pa.array(np.full(n, kind), pa.int8()) if f.name == "kind" else columns.get(f.name) for f in _FOUND]
    cells = [pa.nulls(n, f.type) if c is None else pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(cells, _FOUND, strict=True)]
    return pa.RecordBatch.from_arrays(cells, schema=_FOUND)


def _local(shards: DataFrame, trie: list[tuple[int, int, int]]) -> DataFrame:
    places = {shard: k for k, (shard, _, _) in enumerate(trie)}
    nowhere = np.zeros(0, np.int64)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, k = pa.Table.from_batches(held), places[shard]
            left = owners(trie, k) if k else nowhere
            right = owners(trie, k + 1) if k + 1 < len(trie) else nowhere
            sizes = [np.asarray(s, np.int64) for s in t["sizes"].to_pylist()]
            yield from shard_nodes(shard, t["path"].to_pylist(), t["conv_id"].to_numpy(), sizes, left, right)

        now, held = None, []
        for b in batches:
            numbers = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if numbers[a] != now and held:
                    yield from whole(now, held)
                    held = []
                now = int(numbers[a])
                held.append(b.slice(a, z - a))
        if held:
            yield from whole(now, held)

    dealt = shards.repartition(max(1, len(trie)), "shard").sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(finish, _DDL)


def _digests(pieces: DataFrame) -> DataFrame:
    """(splitter, depth, ends_sha256): pieces digested in order, one after the other."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for r in b.to_pylist():
                key = (r["splitter"], r["depth"])
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(r["ids"].encode())
                else:
                    state.update(b"," + r["ids"].encode())
        if now is not None:
            done.append((*now, state.hexdigest()))
        columns = list(zip(*done)) or [[], [], []]
        types = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["splitter", "depth", "ends_sha256"])

    lined = pieces.select("splitter", "depth", "shard", "seq", "ids").repartition("splitter", "depth")
    lined = lined.sortWithinPartitions("splitter", "depth", "shard", "seq")
    return lined.mapInArrow(digest, "splitter long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    store.small_batches(spark)
    paths = store.written(conversation_paths(turns), "paths")
    whole = store.written(rebuilt(paths), "rebuilt")
    n_turns = whole.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // shard_turns))
    ranged = whole.repartitionByRange(n, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    shards = store.written(ranged, "shards")
    found = store.written(_local(shards, skeleton(shards)), "nodes")
    keys = ["splitter", "depth"]
    shares = found.where(F.col("kind") == SHARE).groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"),
        F.max("parent_splitter").alias("parent_splitter"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    digests = _digests(found.where(F.col("kind") == PIECE))
    shares = store.written(shares.join(digests, keys, "left").fillna({"ends_sha256": NOTHING}), "skeleton")
    out: list[str | Column] = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = found.where(F.col("kind") == NODE)
    inner = nodes.where("parent_splitter < 0").select(*out)
    hanging = nodes.where("parent_splitter >= 0").select("parent_splitter", *out).unionByName(shares.select("parent_splitter", *out[:2], F.lit(None).cast("long").alias("parent_conv_id"), *out[3:]))
    hanging = hanging.drop("parent_conv_id").withColumn("parent_depth", F.col("depth") - 1)
    parents = shares.select(F.col("splitter").alias("parent_splitter"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("parent_conv_id"))
    if shares.count() <= BROADCAST_NODES:
        met = hanging.join(F.broadcast(parents), ["parent_splitter", "parent_depth"], "left")
    else:
        met = lookup(hanging, parents, ["parent_splitter", "parent_depth"])
    return inner.unionByName(met.select(*out))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(store.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)
  ) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id FROM turns),
crc_table AS (
  SELECT i AS byte, i AS value, 0 AS round FROM range(256) AS r(i)
  UNION ALL
  SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, round + 1 FROM crc_table WHERE round < 8
), crc AS (
  SELECT conv_id, 4294967295::bigint AS value, conv_id::varchar AS rest FROM ids
  UNION ALL
  SELECT conv_id, xor(t.value, crc.value // 256), rest[2:] FROM crc
  JOIN crc_table t ON t.round = 8 AND t.byte = xor(crc.value % 256, ascii(rest[1])::bigint)
  WHERE rest <> ''
), heads AS (
  SELECT conv_id, xor(value, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc WHERE rest = ''
), mixed AS (
  SELECT h.conv_id, 0 AS own, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.place <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM mixed
), chained AS (
  SELECT conv_id, 0::bigint AS depth, 'root' AS node, 0::bigint AS chars FROM ids
  UNION ALL
  SELECT r.conv_id, r.depth, sha256(c.node || length(r.role) || ':' || r.role || r.text), length(r.text)
  FROM chained c JOIN rebuilt r ON r.conv_id = c.conv_id AND r.depth = c.depth + 1
), longest AS (SELECT conv_id, max(depth) AS depth FROM chained GROUP BY conv_id),
nodes AS (
  SELECT node, any_value(c.depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    string_agg(CASE WHEN c.depth = l.depth THEN conv_id::varchar END, ',' ORDER BY conv_id) AS ends
  FROM chained c JOIN longest l USING (conv_id) GROUP BY node
), links AS (
  SELECT DISTINCT a.node, b.node AS below FROM chained a JOIN chained b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1
), inside AS (
  SELECT DISTINCT a.node, b.node AS below FROM chained a JOIN chained b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), children AS (SELECT node, count(*) AS n_children FROM links GROUP BY node),
sums AS (
  SELECT i.node, sum((n.n_convs - 1) * n.chars)::bigint AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
  FROM inside i JOIN nodes n ON n.node = i.below LEFT JOIN children c ON c.node = i.below GROUP BY i.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
  s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node)
LEFT JOIN links l ON l.below = n.node LEFT JOIN nodes p ON p.node = l.node
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": ORACLE}
