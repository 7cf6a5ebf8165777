"""From raw documents to packed training sequences: STAGES in order, each over all that the one before kept.

Language identification drops texts without words of a known language; exact and near deduplication keep the document
with the smallest id of each group; decontamination drops documents with a benchmark passage; packing cuts what is left
into sequences. Every stage but the last returns the columns of its input. A stage's result is written before the next
one is called: what the stage before wrote on its way is deleted then.

Cases are those of the operators: null and empty texts go in the first stage, repeated rows in the second; a null
``doc_id`` is kept like any other; where nothing is labelled the first stage keeps every row; an empty table gives no
rows; columns beside ``doc_id``, ``text`` and ``lang`` are passed on unread.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from casequarry.llm import decontaminate, exact_dedup, jaccard_join, language, packing, store


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of the last stage that was called, by application.
_LEFT: dict[str, list[str]] = {}


def after_the_last(stage: Stage) -> Stage:
    """The stage, which first deletes the working tables of the stage before it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.discard(spark, *_LEFT.pop(spark.sparkContext.applicationId, []))
        with store.recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = paths
        return out

    return run


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.learn(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_matches(docs, store.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language identification", after_the_last(known_language)),
    ("exact dedup", after_the_last(without_copies)),
    ("n-gram Jaccard join", after_the_last(without_near_copies)),
    ("benchmark decontamination", after_the_last(without_benchmark)),
    ("packing", after_the_last(packed)),
]

#: Language identification is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, previous = store.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = store.write(found := stage(spark, docs, sf_dir), "stage")
        docs = store.reread(found, path)
        if previous:
            store.discard(spark, previous)
        previous = path
    return STAGES[-1][1](spark, docs, sf_dir)
