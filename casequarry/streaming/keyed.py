"""A table with one row per key that streams can update: copy on write, by hash buckets.

Keys lie in a fixed number of buckets, each a folder of files. A batch merges its rows into the buckets it touches and
writes those anew; the others stay as they are. What belongs to the table is written in a manifest, which is renamed into
place at the end: a reader sees all of a batch or nothing of it, and a batch that was cut off leaves the old table. A
repeated batch that is in the manifest already is not written again.

Folders that the last two manifests do not name are deleted, so a reader may take as long as one batch.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFESTS_KEPT = 2


@dataclass
class Manifest:
    """Which folder holds which bucket after a batch, and how the table is laid out."""

    batch: int = -1
    buckets: int = BUCKETS
    keys: list[str] = field(default_factory=list)
    schema: str = ""
    folders: dict[str, str] = field(default_factory=dict)  # bucket -> folder below the table


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _entries(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [e.getPath().getName() for e in fs.listStatus(at)] if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Batches that have a manifest, oldest first."""
    return sorted(int(n.removesuffix(".json")) for n in _entries(spark, f"{path}/manifests") if n.removesuffix(".json").isdigit())


def _read(spark: SparkSession, path: str, number: int) -> Manifest:
    lines = spark.read.option("wholetext", True).text(f"{path}/manifests/{number}.json").collect()
    return Manifest(**json.loads(lines[0][0]))


def newest(spark: SparkSession, path: str) -> Manifest | None:
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[-1]) if numbers else None


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """The step that makes a batch visible: a file under another name, renamed when it is whole."""
    fs, draft = _fs(spark, f"{path}/manifests/{manifest.batch}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/manifests/{manifest.batch}.json")
    if not fs.rename(draft, final):
        raise OSError(f"cannot publish batch {manifest.batch} of {path}")


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete manifests beyond the last ones, and folders that none of those names."""
    numbers = _numbers(spark, path)
    named = {f for n in numbers[-MANIFESTS_KEPT:] for f in _read(spark, path, n).folders.values()}
    for n in numbers[:-MANIFESTS_KEPT]:
        fs, at = _fs(spark, f"{path}/manifests/{n}.json")
        fs.delete(at, False)
    for batch in _entries(spark, f"{path}/data"):
        below = f"{path}/data/{batch}"
        held = [b for b in _entries(spark, below) if b.startswith("bucket=")]
        gone = [b for b in held if f"data/{batch}/{b}" not in named]
        for b in [below] if len(gone) == len(held) else [f"{below}/{b}" for b in gone]:
            fs, at = _fs(spark, b)
            fs.delete(at, True)


def _rows(spark: SparkSession, path: str, manifest: Manifest, buckets: list[str]) -> DataFrame:
    places = [f"{path}/{manifest.folders[b]}" for b in buckets if b in manifest.folders]
    return spark.read.schema(manifest.schema).parquet(*places) if places else spark.createDataFrame([], manifest.schema)


def upsert(batch: DataFrame, path: str, keys: list[str], batch_id: int, buckets: int = BUCKETS) -> None:
    """Put the rows of a batch (at most one per key) in the place of those with their keys."""
    spark = batch.sparkSession
    old = newest(spark, path) or Manifest(buckets=buckets, keys=keys, schema=_ddl(batch))
    if batch_id <= old.batch:
        return
    if (old.keys, old.schema) != (keys, _ddl(batch)):
        raise ValueError(f"the table in {path} has keys {old.keys} and columns {old.schema}")
    # A batch of a stream is computed once: written, then read for its buckets and its rows.
    bucket = F.pmod(F.xxhash64(*keys), F.lit(old.buckets)).cast("int").alias("bucket")
    batch.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/incoming")
    rows = spark.read.schema(f"{old.schema}, bucket int").parquet(f"{path}/incoming")
    touched = sorted(n.removeprefix("bucket=") for n in _entries(spark, f"{path}/incoming") if n.startswith("bucket="))
    if touched:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
        new_keys = rows.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
        kept = _rows(spark, path, old, touched).join(new_keys, same, "left_anti").select("*", bucket)
        # One file a bucket: that is what the number of buckets is chosen by.
        merged = kept.unionByName(rows).repartition(len(touched), "bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{batch_id}")
    folders = old.folders | {b: f"data/{batch_id}/bucket={b}" for b in touched}
    _publish(spark, path, Manifest(batch_id, old.buckets, keys, old.schema, folders))
    _sweep(spark, path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table after its newest batch; None before the first."""
    manifest = newest(spark, path)
    return None if manifest is None else _rows(spark, path, manifest, list(manifest.folders))
