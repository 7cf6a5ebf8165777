"""Documents screened as they arrive: a stateless projection, so it scales with its input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from casequarry.operators.guards import input_verdict, redact
from casequarry.sources.config import ReviewConfig


def read_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def stream_intake(docs: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Screen and redact the text of arriving documents (``text_content``, ``country_code``)."""
    screened = input_verdict(docs, "text_content", cfg)
    return redact(screened, "text_content", cfg.pii_patterns(), "country_code").drop("in_text", "in_pii_count")


def write_intake(screened: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table; the sink's log makes a repeated batch harmless."""
    return (
        screened.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
