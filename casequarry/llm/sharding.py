"""Shards of nearly equal size: a minimax contiguous partition of groups that stay together.

1. Rows with equal text form a group, which is never cut. Groups are lined up by their smallest id; a range shuffle and
   the sums of its parts give every group the bytes up to its end (``end``), so a shard is a stretch of these numbers.
2. The smallest capacity that the wanted number of shards can do with is found by binary search. A capacity is checked
   greedily: each shard takes as many groups as fit. The driver does not see the groups: it knows the first and last end
   in each of ``CELLS`` cells of the line, which mostly decides a step; where it does not, both answers are tried. If they
   differ in the outcome, the cells in doubt are counted again in finer cells, by one job a round. So the result is exact,
   while the driver holds ``CELLS`` triples whatever the corpus.
3. With that capacity as the limit, each cut goes where its shard comes nearest to an equal part of what is left, no
   further than greedy filling from the front and no less than greedy filling from the back allow. Groups that are more
   than an equal part (fewer than there are shards) get a shard of their own and are left out of the parts.
4. A row takes the shard of its group (a skew-safe join of narrow rows) and its slot from its rank in the shard, again by
   ranges and the counts of their parts.

Cases: null text is empty and counts ``OVERHEAD`` bytes; rows with a null id come first in their group, and a group of
such rows before all others; repeated rows each have a slot; with fewer groups than shards some shards stay empty; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casequarry.llm import store
from casequarry.scale import lookup

SHARDS = 40
#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Cells whose first and last ends the driver knows.
CELLS = 65_536


def documents_to_place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, digest, row): all that is needed of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
    )


def _part(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Rows ranged and sorted by ``order`` and written, with the number of their range in ``part``."""
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id())
    return store.written(ranged, label)


def _running(parts: DataFrame, order: list[str], value: str, name: str, by: list[str]) -> DataFrame:
    """Adds the sum of ``value`` over the rows before in the same part and ``by``: streamed through sorted parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ["part", *by]])
            values = b.column(value).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            sums = np.cumsum(values) - values
            base = sums[starts].copy()
            if tuple(keys[:, 0]) == now:
                base[0] -= total
            lens = np.diff([*starts, len(values)])
            before = sums - np.repeat(base, lens)
            now, total = tuple(keys[:, -1]), int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], [*b.schema.names, name])

    lined = parts.repartition("part").sortWithinPartitions("part", *by, *[F.col(c).asc_nulls_first() for c in order])
    return lined.mapInArrow(add, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema), f"{name} long"]))


def lined_up(placed: DataFrame) -> DataFrame:
    """(digest, n, bytes, end): groups in their order with the bytes up to the end of each."""
    groups = placed.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")
    )
    parts = _part(groups, ["first_id", "digest"], "groups")
    # One row a part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.sum("bytes").alias("in_part"))
    offsets = offsets.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    summed = _running(parts, ["first_id", "digest"], "bytes", "before", [])
    whole = summed.join(F.broadcast(offsets), "part")
    ended = whole.select("digest", "n", "bytes", (F.col("offset") + F.col("before") + F.col("bytes")).alias("end"))
    return store.written(ended, "ends")


class Line:
    """What the driver knows of the ends of the groups: first and last of each cell, cells in order."""

    def __init__(self, ends: DataFrame, total: int, cells: int):
        self.ends, self.total, self.cells = ends, total, cells
        self.width = -(-total // cells)
        self.found = self._count([(0, total, self.width)])
        self._index()

    def _count(self, stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(width of the cell, first, last, number) of the ends in cells of each stretch (after, up to, width)."""
        afters, stops, widths = (np.array(c, np.int64) for c in zip(*stretches, strict=True))

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                end = b.column("end").to_numpy()
                k = np.searchsorted(stops, end)
                k = np.minimum(k, len(stops) - 1)
                inside = (end > afters[k]) & (end <= stops[k])
                end, k = end[inside], k[inside]
                cell = (end - afters[k] - 1) // widths[k]
                arrays = [pa.array(x, pa.int64()) for x in (k, cell, end)]
                yield pa.RecordBatch.from_arrays(arrays, ["stretch", "cell", "end"])

        near = self.ends.select("end").where(F.col("end").between(int(afters[0]) + 1, int(stops[-1])))
        counted = near.mapInArrow(cells, "stretch long, cell long, end long").groupBy("stretch", "cell")
        counted = counted.agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))
        return sorted((int(widths[r.stretch]), r.first, r.last, r.n) for r in counted.collect())

    def _index(self) -> None:
        self.found.sort(key=lambda c: c[1])
        self.firsts = [c[1] for c in self.found]

    def at_most(self, y: int) -> tuple[int, int, int | None]:
        """Bounds for the greatest end that is at most y (0 if there is none), and the cell in doubt."""
        k = bisect_right(self.firsts, y) - 1
        if k < 0:
            return 0, 0, None
        _, first, last, n = self.found[k]
        if y >= last:
            return last, last, None
        return (first, first, None) if n <= 2 else (first, y, k)

    def at_least(self, y: int) -> tuple[int, int, int | None]:
        """The same for the smallest end that is at least y (the total if there is none)."""
        k = bisect_left(self.firsts, y)
        after = self.firsts[k] if k < len(self.found) else self.total
        if k == 0:
            return after, after, None
        _, _, last, n = self.found[k - 1]
        if y > last:
            return after, after, None
        return (last, last, None) if n <= 2 else (y, last, k - 1)

    def refine(self, doubtful: set[int]) -> None:
        """Count the cells in doubt in finer cells."""
        finer = max(2, self.cells // len(doubtful))
        stretches = []
        for k in sorted(doubtful):
            _, first, last, _ = self.found[k]
            stretches.append((first - 1, last, max(1, -(-(last - first + 1) // finer))))
        kept = [c for k, c in enumerate(self.found) if k not in doubtful]
        self.found = kept + self._count(stretches)
        self._index()


def fits(line: Line, shards: int, capacity: int) -> tuple[bool | None, set[int]]:
    """Does greedy filling with this capacity need no more shards? None if the cells in doubt (the second) decide it."""
    low = high = 0
    doubtful = set()
    for _ in range(shards):
        low, _, a = line.at_most(low + capacity)
        _, high, b = line.at_most(high + capacity)
        doubtful |= {k for k in (a, b) if k is not None}
    if low >= line.total:
        return True, set()
    return (False, set()) if high < line.total else (None, doubtful)


def smallest_capacity(line: Line, shards: int) -> int:
    """Binary search; cells are refined where an answer hangs on them."""
    low, high = -(-line.total // shards) - 1, line.total  # the first is too small, the second is enough
    while high - low > 1:
        middle = (low + high) // 2
        answer, doubtful = fits(line, shards, middle)
        if answer is None:
            line.refine(doubtful)
        elif answer:
            high = middle
        else:
            low = middle
    return high


def large_groups(top: list[tuple[int, int]], total: int, shards: int) -> list[tuple[int, int]]:
    """Of the largest groups (bytes, end), largest first, those that exceed an equal part of all that is not in them."""
    rest = total
    for m, (size, _) in enumerate(top[: shards - 1]):
        if size * (shards - m) <= rest:
            return top[:m]
        rest -= size
    return top[: shards - 1]


def cuts(line: Line, shards: int, capacity: int, large: list[tuple[int, int]]) -> list[int]:
    """Ends of the shards but the last: each as near to its equal part as the capacity allows."""
    while True:
        doubtful: set[int] = set()

        def exact(found: tuple[int, int, int | None]) -> int:
            if found[2] is not None:
                doubtful.add(found[2])  # noqa: B023
            return found[0]

        # Where each shard must have begun, seen from the back.
        least = [line.total]
        for _ in range(shards - 1):
            behind = least[-1] - capacity
            least.append(exact(line.at_least(behind)) if behind > 0 else 0)
        least.reverse()  # least[k]: the least end of the k-th shard
        out, last = [], 0
        for k in range(shards - 1):
            ahead = [size for size, end in large if end > last]
            wanted = last + (line.total - last - sum(ahead)) // max(1, shards - k - len(ahead))
            most = exact(line.at_most(last + capacity))
            below, above = exact(line.at_most(wanted)), exact(line.at_least(wanted + 1))
            near = below if below > last and wanted - below <= above - wanted else above
            last = min(max(near, least[k], last), max(most, last))
            out.append(last)
        if not doubtful:
            return out
        line.refine(doubtful)


def shard_ends(ends: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> tuple[list[int], int]:
    """Where the shards of the lined-up groups end (the last one's end left out), and the smallest capacity."""
    total = ends.agg(F.max("end")).first()[0]
    if not total:
        return [], 0
    line = Line(ends, total, cells)
    capacity = smallest_capacity(line, shards)
    top = ends.orderBy(F.desc("bytes"), "end").limit(shards).select("bytes", "end").collect()
    return cuts(line, shards, capacity, large_groups([tuple(r) for r in top], total, shards)), capacity


def place(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, row) of every row of ``docs``."""
    placed = store.written(documents_to_place(docs, id_col, text_col, row_col), "sizes")
    ends = lined_up(placed)
    bounds, _ = shard_ends(ends, shards, cells)
    shard = sum(((F.col("end") > b).cast("int") for b in bounds), F.lit(0))
    groups = ends.select("digest", "end", shard.alias("shard"))
    met = lookup(placed, groups, ["digest"], counts=ends.select("digest", "n"))
    # Shards follow the order of the groups, so ranges of ends are ranges of shards.
    order = ["end", "doc_id", "row"]
    parts = _part(met.select("doc_id", "size", "text_crc32", "shard", "end", "row", F.lit(1).cast("long").alias("one")), order, "ranked")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    # A row for each part, and one more for each shard that begins inside one.
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = _running(parts, order, "one", "before", ["shard"])
    return ranked.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("before")).alias("slot"), "row"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all rows with all columns to a folder a shard under ``path``, files of a shard in order of ``slot``."""
    rows, row = store.numbered(docs)
    at = place(rows, shards, id_col, text_col, row).select(F.col("row").alias(row), "shard", "slot")
    taken = {"shard", "slot"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the shards' own")
    met = rows.join(at, row).drop(row)
    met.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = place(store.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = r"""
WITH RECURSIVE crc_steps AS (
  SELECT i AS byte, i AS value, 0 AS round FROM range(256) AS r(i)
  UNION ALL
  SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, round + 1 FROM crc_steps WHERE round < 8
), crc_table AS (SELECT list(value ORDER BY byte) AS entries FROM crc_steps WHERE round = 8),
texts AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents
), groups AS (
  SELECT text, sha256(text) AS digest, min(doc_id) AS first_id, sum(size)::bigint AS bytes FROM texts GROUP BY text
), line AS (
  SELECT text, bytes, (sum(bytes) OVER (ORDER BY first_id NULLS FIRST, digest))::bigint AS stop FROM groups
), whole AS (SELECT max(stop) AS total FROM line),
-- One row a greedy step: at step 40 of a capacity the search goes on with the next capacity.
search AS (
  SELECT (total + 39) // 40 - 1 AS low, total AS high, ((total + 39) // 40 - 1 + total) // 2 AS capacity, 0 AS step, 0::bigint AS pos
  FROM whole
  UNION ALL
  SELECT low2, high2, CASE WHEN step < 40 THEN capacity ELSE (low2 + high2) // 2 END, CASE WHEN step < 40 THEN step + 1 ELSE 0 END,
    CASE WHEN step < 40 THEN (SELECT coalesce(max(stop), 0) FROM line WHERE stop <= pos + capacity) ELSE 0 END
  FROM (
    SELECT *, CASE WHEN step = 40 AND pos < (SELECT total FROM whole) THEN capacity ELSE low END AS low2,
      CASE WHEN step = 40 AND pos >= (SELECT total FROM whole) THEN capacity ELSE high END AS high2
    FROM search WHERE high - low > 1
  )
), best AS (SELECT min(high) AS capacity FROM search),
ranked AS (
  SELECT stop, bytes, row_number() OVER w - 1 AS m, (sum(bytes) OVER w)::bigint - bytes AS larger
  FROM line WINDOW w AS (ORDER BY bytes DESC, stop)
), large AS (
  SELECT stop, bytes FROM ranked WHERE m < least(39, coalesce((
    SELECT min(m) FROM ranked, whole WHERE m < 39 AND bytes * (40 - m) <= total - larger), 39))
), backward AS (
  SELECT 40 AS k, total AS least FROM whole
  UNION ALL
  SELECT k - 1, CASE WHEN least <= capacity THEN 0 ELSE (SELECT min(stop) FROM line WHERE stop >= least - capacity) END
  FROM backward, best WHERE k > 1
), forward AS (
  SELECT 0 AS k, 0::bigint AS stop
  UNION ALL
  SELECT k + 1, least(greatest(CASE WHEN below > was AND wanted - below <= above - wanted THEN below ELSE above END, bound, was),
    greatest(most, was))
  FROM (
    SELECT *, (SELECT coalesce(max(stop), 0) FROM line WHERE stop <= was + capacity) AS most,
      (SELECT coalesce(max(stop), 0) FROM line WHERE stop <= wanted) AS below,
      coalesce((SELECT min(stop) FROM line WHERE stop > wanted), total) AS above
    FROM (
      SELECT f.k, f.stop AS was, b.least AS bound, total, capacity,
        f.stop + (total - f.stop - (SELECT coalesce(sum(bytes), 0)::bigint FROM large WHERE large.stop > f.stop))
          // greatest(1, 40 - f.k - (SELECT count(*) FROM large WHERE large.stop > f.stop)) AS wanted
      FROM forward f JOIN backward b ON b.k = f.k + 1, best, whole WHERE f.k < 39
    )
  )
), placed AS (
  SELECT text, stop, (SELECT count(*) FROM forward WHERE k > 0 AND forward.stop < line.stop)::int AS shard FROM line
)
SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY stop, doc_id NULLS FIRST) - 1 AS slot, NULL::int AS grown_shard
FROM texts JOIN placed USING (text), crc_table
"""

QUERIES = {"op13_sharding": op13_sharding}
ORACLES = {"op13_sharding": ORACLE}
