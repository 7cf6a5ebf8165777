"""Tables that an operator writes on its way, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists that are being kept of the tables written, the innermost last.
_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are written inside, for ``discard``."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset, a folder in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write the rows and go on from the written table: a lost executor costs no more than its running tasks."""
    return reread(df, write(df, label, by))


def write(df: DataFrame, label: str, by: str | None = None) -> str:
    """Write the rows (in folders by the column ``by``) and return the path."""
    spark = df.sparkSession
    # What a write has shuffled is of no use once the table is there.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return path


def reread(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written with a number each, and the name of its column, which none of theirs has."""
    name = "_row"
    while name in df.columns:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Bound the Arrow batches that go to Python workers, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
