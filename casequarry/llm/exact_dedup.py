"""Exact duplicates through an extendible-hash index whose buckets lie on shared files.

1. Every row gets a 64-bit fingerprint and a SHA-256 of its normalised text; these narrow entries are written.
2. The directory of the index starts with one entry for each ``bucket_rows`` fingerprints and doubles until no
   bucket holds more: an overfull bucket splits by one more bit, the others keep their depth. Fingerprints are
   counted once each, so copies never make a bucket overfull.
3. Texts meet by (fingerprint, text): the engine compares the bytes of texts with one fingerprint, after each task
   has folded its own copies. What is left is one record for each different text. Records with one fingerprint form
   a chain, numbered in ``link``.
4. Records are written by bucket, so one owner task reads and writes each key range, and entries look up theirs.

DataFrame functions only. A lost executor repeats tasks over written tables.

Cases: a null text counts as empty; a null ``doc_id`` comes after all others when the row that stays is chosen; of
rows with equal text and id the first read stays; an empty table gives an empty result; other columns are not read,
so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casequarry.llm import store

#: Different fingerprints that a bucket holds before it splits.
BUCKET_ROWS = 65_536
#: A directory of more entries is joined by a shuffle instead of a broadcast.
BROADCAST_ENTRIES = 1_000_000

ORACLE = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(norm) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY norm)
"""


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def top_bits(fingerprint: Column, depth: int) -> Column:
    """The first ``depth`` bits: the place in a directory of that depth."""
    return F.shiftrightunsigned(fingerprint, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(prints: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """Directory rows (entry, bucket, depth) over different fingerprints ``h``, and the directory's depth.

    ``entry`` is the place in the full directory; a bucket of smaller depth holds several entries.
    """
    spark = prints.sparkSession
    total = prints.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / bucket_rows)))
    buckets = prints.groupBy(top_bits(F.col("h"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.withColumn("depth", F.lit(depth))
    settled = None
    while True:
        path = store.write(buckets, "directory")
        buckets = store.reread(buckets, path)
        full = buckets.where(F.col("n") > bucket_rows)
        done = buckets.where(F.col("n") <= bucket_rows)
        settled = done if settled is None else settled.unionByName(done)
        if depth == 63 or full.isEmpty():
            settled = settled if depth < 63 else settled.unionByName(full)
            break
        # The directory doubles; only overfull buckets are counted anew, one bit deeper.
        parents = full.select("prefix")
        depth += 1
        buckets = (
            prints.withColumn("prefix", top_bits(F.col("h"), depth - 1))
            .join(parents, "prefix", "left_semi")
            .groupBy(top_bits(F.col("h"), depth).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("depth", F.lit(depth))
        )
    # A prefix of all local depths names its bucket; spread over the entries of the full directory.
    span = F.pow(F.lit(2.0), F.lit(depth) - F.col("depth")).cast("long")
    entries = settled.select(
        F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1)).alias("entry"),
        (F.col("prefix") * span).alias("bucket"),
        "depth",
    )
    return store.written(entries, "entries"), depth


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, link, row.

    ``row_col`` names a column with a number of each row, if there is one.
    """
    norm = normalised(F.col(text_col))
    entries = store.written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(norm).alias("h"),
            F.sha2(norm, 256).alias("text_sha256"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        ),
        "prints",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    prints = store.written(
        entries.groupBy("h", "text_sha256").agg(first.alias("first")).groupBy("h").agg(F.count(F.lit(1)).alias("n")),
        "keys",
    )
    directory, depth = build_directory(prints, bucket_rows)
    if directory.count() <= BROADCAST_ENTRIES:
        directory = F.broadcast(directory)

    # Compare bytes: one record per different text, folded in each task before the shuffle.
    texts = docs.select(norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    records = texts.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    records = records.select("h", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    records = records.withColumn("entry", top_bits(F.col("h"), depth)).join(directory, "entry", "left")
    chain = Window.partitionBy("bucket", "h").orderBy("text_sha256")
    index = records.withColumn("link", F.row_number().over(chain)).select("bucket", "h", "link", "text_sha256", "group_size")
    index = store.written(index.repartition("bucket").sortWithinPartitions("bucket", "h"), "index", by="bucket")

    keep = entries.groupBy("h", "text_sha256").agg(first.alias("first"))
    index = index.join(keep, ["h", "text_sha256"])
    return entries.join(index, ["h", "text_sha256"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        "bucket",
        "link",
        "row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, row = store.numbered(docs)
    gone = find_copies(rows, id_col, text_col, row).where(~F.col("kept"))
    return rows.join(gone.select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_copies(store.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": ORACLE}
