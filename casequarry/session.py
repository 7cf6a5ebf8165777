"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # JSON objects may repeat a key; the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Bounds the memory of one Arrow batch when long texts go to Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Streaming state of many cases stays off the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else started."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, name: str = "casequarry", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.ui.enabled", "false")
        # Call-site capture doubles the driver's round trips while a plan is put together.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # the driver does the executors' work
            builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())
