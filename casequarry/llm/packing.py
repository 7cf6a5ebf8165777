"""Packing documents into sequences: shortest pack first, over the histogram of lengths.

1. Each text becomes its ids and the end id, cut into pieces of ``length`` ids and one shorter rest. Pieces are written
   with their rank among the pieces of one length that the same task made.
2. The histogram of lengths (``length`` rows at most) is packed on the driver: longest first, each into the open packs
   that hold least so far; where it doesn't fit there it fits nowhere, and a new pack is opened. Packs with one history
   are a pattern, kept as a range of sequence numbers with a count and a fill; placing some of them splits the range.
   The plan is a list of (length, ranks, sequences, offset), bounded by the lengths, whatever the number of documents.
3. Ranks over all tasks come from counts by (length, task). Pieces find their sequence by length and rank.

Cases: null text is empty and has the end id alone; documents without an id, repeated rows and repeated ids are packed
each for itself; a text of any length is cut, never shortened; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casequarry.llm import store
from casequarry.llm.tokens import DEFAULT_TOKENIZER, pieces_of

LENGTH = 1024
END_ID = 0

_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place")])


def _cut(path: str, size: int, end_id: int, with_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = pieces_of(path), TaskContext.get().partitionId()
        end, seen = end_id.to_bytes(4, "little"), Counter()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = memoryview(tokenizer.ids(text or "") + end)
                n = len(ids) // 4
                for start in range(0, n, size):
                    own = ids[4 * start : 4 * min(n, start + size)]
                    k = len(own) // 4
                    rows.append((doc_id, start, k, zlib.crc32(own), n, part, seen[k], bytes(own) if with_ids else None))
                    seen[k] += 1
            if rows:
                columns = list(zip(*rows, strict=True))[: len(schema)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def shortest_pack_first(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): where the pieces of a length go."""
    places, packs, sequences = [], [], 0  # packs: (fill, first sequence, count)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                fill, first, count = heapq.heappop(packs)
                n = min(count, left)
                if count > n:
                    heapq.heappush(packs, (fill, first + n, count - n))
                each = 1
            else:  # new packs, each filled with this length before the next is opened; the last may hold fewer
                fill, first, each = 0, sequences, min(size // length, left)
                n = left // each
                sequences += n
            for k in range(each):
                places.append((length, rank + k * n, rank + (k + 1) * n, first, fill + k * length))
            if fill + each * length < size:
                heapq.heappush(packs, (fill + each * length, first, n))
            rank, left = rank + each * n, left - each * n
    return places


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = LENGTH,
    tokenizer: str = DEFAULT_TOKENIZER,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids)."""
    spark = docs.sparkSession
    store.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = ", ".join(f"{n} long" for n in _PIECES.names) + (", ids binary" if with_ids else "")
    pieces = store.written(rows.mapInArrow(_cut(tokenizer, size, end_id, with_ids), ddl), "pieces")

    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        shortest_pack_first(histogram, size), "length long, from_rank long, to_rank long, first_sequence long, offset long"
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    found = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "own")), (F.col("length") == F.col("own")) & found)
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("from_rank"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(store.table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
