"""Cases and documents as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.scale import lookup, with_places
from casequarry.sources.config import ReviewConfig


# Hex digits of an id. Ids are made from hashes, so they have to be long enough not to collide in a large table.
ID_CHARS = 32


def create_cases(requests: DataFrame, id_chars: int = ID_CHARS) -> DataFrame:
    """New cases from ``request_key, country, process_type, created_at``; ids come from the key's hash."""
    return requests.select(
        F.substring(F.sha2(F.col("request_key").cast("string"), 256), 1, id_chars).alias("case_id"),
        "country",
        "process_type",
        F.lit(fv.CASE_INTAKE).alias("status"),
        "created_at",
    )


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files under ``<folder>/<case_id>/<file>``.

    ``doc_seq`` is a file's place in its case, from 1 on, by upload time and, at equal times, by path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    case = F.element_at(F.split("path", "/"), -2).alias("case_id")
    places = with_places(files.select("path", "modificationTime", case), ["case_id"], ["modificationTime", "path"], "doc_seq")
    return files.select("path", "content").join(places, "path").select(
        "case_id",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "doc_seq",
        F.col("modificationTime").alias("upload_timestamp"),
        "content",
    )


def intake(uploads: DataFrame) -> DataFrame:
    """Documents from ``case_id, file_name, doc_seq, upload_timestamp, content``.

    Bytes become text, broken ones the replacement character; a missing name is ``unknown``. Document
    ids are unique over all cases. ``original_input_hash`` is the digest of the text as it came in; guards that ask for it
    compare it in every prompt of the document.
    """
    name = F.when(F.coalesce("file_name", F.lit("")) == "", "unknown").otherwise(F.col("file_name"))
    key = F.concat_ws("/", "case_id", F.col("doc_seq").cast("string"), name)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return uploads.select(
        "case_id",
        F.substring(F.sha2(key, 256), 1, ID_CHARS).alias("doc_id"),
        "doc_seq",
        name.alias("file_name"),
        text.alias("text_content"),
        F.sha2(text.cast("binary"), 256).alias("original_input_hash"),
        F.lit("").alias("doc_type"),
        F.lit("").alias("category"),
        F.lit(fv.DOC_PENDING).alias("status"),
        "upload_timestamp",
    )


def new_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents of an intake whose text their case does not hold yet: neither in ``known`` nor earlier in the intake.

    Only (case, digest) is compared; the engine drops most rows by a Bloom filter where the sides are large. The first
    of equal uploads stays, by ``doc_seq`` and then by id.
    """
    keys = ["case_id", "original_input_hash"]
    first = docs.groupBy(*keys).agg(F.min(F.struct("doc_seq", "doc_id"))["doc_id"].alias("doc_id"))
    fresh = first.join(known.select(*keys), keys, "left_anti")
    return docs.join(fresh.select("case_id", "doc_id"), ["case_id", "doc_id"], "left_semi")


def attach_case(docs: DataFrame, cases: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Adds country, country_code and process_type of the case. Safe for cases with very many documents.

    Documents that came in with their country and process are not joined again: the join moves them,
    texts and all, so a large intake should stamp them on arrival.
    """
    if not {"country", "process_type"} <= set(docs.columns):
        docs = lookup(docs, cases.select("case_id", "country", "process_type"), ["case_id"])
    if "country_code" not in docs.columns:
        docs = docs.join(cfg.country_table(docs.sparkSession), "country", "left")
    return docs
