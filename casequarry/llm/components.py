"""Connected components of links, each labelled by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry.llm import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b).

    Each round gives a node the smallest root around it and then the root of that root, so chains shorten by half.
    Every round is written, which keeps the plan short and lets a lost executor start from the round's table.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges_at = store.write(both.where("a <> b").distinct(), "edges")
    edges = store.reread(both, edges_at)
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    at = store.write(roots.withColumn("changed", F.lit(True)), "roots")
    while True:
        now = spark.read.parquet(at)
        if now.where("changed").isEmpty():
            break
        known = now.select("node", "root")
        around = (
            edges.join(known.select(F.col("node").alias("b"), F.col("root").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        nearer = known.join(around, "node").select("node", "root", F.least("root", "near").alias("near"))
        jump = known.select(F.col("node").alias("near"), F.col("root").alias("further"))
        stepped = nearer.join(jump, "near").select(
            "node", F.least("near", "further").alias("root"), (F.least("near", "further") < F.col("root")).alias("changed")
        )
        new = store.write(stepped, "roots")
        store.discard(spark, at)
        at = new
    store.discard(spark, edges_at)
    return spark.read.parquet(at).select("node", "root")
