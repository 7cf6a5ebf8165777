"""Benchmark passages in training documents, found by spaced seeds.

Texts are runs of letters and digits in lower case. A mask takes some of the words from a place on and ignores the
others, so a seed still fits where an ignored word was replaced; whichever words of an item are replaced, as long as it
is a match by the count below, one mask fits somewhere (the tests go through all cases). Seeds of all documents are
joined to those of the benchmark; a hit names a document, an item and how they lie to each other. Around each hit the
item is laid over the document and equal words are counted: it is a match if some ``WINDOW`` words of the item in a row
(all, of a shorter item) have at least ``LEAST_EQUAL`` equal ones. Items under 8 words must be equal throughout; items
under 5 words can't be told from chance and match nothing.

DataFrame functions only. Seeds of the benchmark are broadcast up to ``BROADCAST_SEEDS`` rows; beyond that the join
shuffles. A document's words are never copied to its seeds: hits are narrow rows, and only their distinct
(document, item, place) meet the words again.

Cases: null or empty text has no words; documents with one id and different texts are searched each, repeated rows give
one row together; items with equal words are all reported; a null ``doc_id`` or ``item_id`` is reported as null; an empty
table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store

#: Places of the words that a mask takes, and the fewest words of an item that it serves.
MASKS = ((0, 1, 3, 5, 6), (0, 2, 3, 6, 7))
SHORT_MASK = (0, 1, 2, 3, 4)
#: The most words of an item that the short mask serves: up to here the others alone miss some of its matches.
SHORT_MASK_WORDS = 16
LEAST_WORDS = 5
SHORT_WORDS = 8
WINDOW = 20
LEAST_EQUAL = 0.8
BROADCAST_SEEDS = 1_000_000

_WORDS = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORDS), F.lit(0))


def hashes(own: Column) -> Column:
    return F.transform(own, lambda w: F.xxhash64(w))


def seeds(own: Column, mask: tuple[int, ...]) -> Column:
    """Hash of the masked words from each place on."""
    last = F.size(own) - 1 - mask[-1]
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    return F.transform(places, lambda k: F.xxhash64(*[F.get(own, k + o) for o in mask]))


def _needed(size: Column) -> Column:
    """Equal words that a window needs."""
    window = F.least(size, F.lit(WINDOW))
    return F.when(size < SHORT_WORDS, size).otherwise(F.ceil(window * LEAST_EQUAL - 1e-9)).cast("int")


def _most_equal(document: Column, item: Column, place: Column) -> Column:
    """The most equal words of a window when the item lies at ``place`` of the document."""
    equal = F.transform(
        F.sequence(F.lit(0), F.size(item) - 1),
        lambda k: F.coalesce((F.get(document, place + k) == F.get(item, k)).cast("int"), F.lit(0)),
    )
    window = F.least(F.size(item), F.lit(WINDOW))
    sums = lambda flags: F.transform(
        F.sequence(F.lit(1), F.size(item) - window + 1),
        lambda k: F.aggregate(F.slice(flags, k, window), F.lit(0), lambda a, x: a + x),
    )
    return F.array_max(F.flatten(F.transform(F.array(equal), sums)))


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, places, first_word, most_equal, item_words of every document and item that match."""
    items = benchmark.select("item_id", hashes(words(F.col("text"))).alias("own")).where(F.size("own") >= LEAST_WORDS)
    items = store.written(items, "items")
    kinds = items.groupBy("own").agg(F.min(F.struct(F.col("item_id").isNull(), "item_id")).alias("least"))
    kinds = store.written(kinds.select(F.xxhash64("own").alias("kind"), "own"), "kinds")

    serves = [(mask, F.size("own") >= SHORT_WORDS) for mask in MASKS] + [(SHORT_MASK, F.size("own") <= SHORT_MASK_WORDS)]
    parts = [
        kinds.where(fits).select("kind", F.lit(k).alias("mask"), F.posexplode(seeds(F.col("own"), mask)).alias("at", "seed"))
        for k, (mask, fits) in enumerate(serves)
    ]
    wanted = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wanted = store.written(wanted.select("mask", "seed", "kind", "at"), "seeds")
    used = {r.mask for r in wanted.select("mask").distinct().collect()}  # three at most

    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), hashes(words(text)).alias("own"))
    masked = F.array(*[F.struct(F.lit(k).alias("mask"), seeds(F.col("own"), mask).alias("seeds")) for k, (mask, _) in enumerate(serves) if k in used])
    if not used:
        masked = F.expr("cast(array() as array<struct<mask: int, seeds: array<bigint>>>)")
    flat = own.select("doc_id", "text_hash", F.inline(masked)).select("doc_id", "text_hash", "mask", F.posexplode("seeds").alias("pos", "seed"))
    if wanted.count() <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    hits = flat.join(wanted, ["mask", "seed"]).select("doc_id", "text_hash", "kind", (F.col("pos") - F.col("at")).alias("place")).distinct()
    hits = store.written(hits, "hits")

    there = hits["text_hash"] == own["text_hash"]
    laid = own.join(hits, hits["doc_id"].eqNullSafe(own["doc_id"]) & there).select(own["doc_id"], own["text_hash"], "kind", "place", own["own"].alias("document"))
    laid = laid.join(kinds, "kind").withColumn("most_equal", _most_equal(F.col("document"), F.col("own"), F.col("place")))
    laid = laid.withColumn("item_words", F.size("own").cast("long")).where(F.col("most_equal") >= _needed(F.col("item_words")))
    found = laid.groupBy("doc_id", "text_hash", "kind", "item_words").agg(
        F.count_distinct("place").alias("places"),
        F.min("place").cast("long").alias("first_word"),
        F.max("most_equal").cast("long").alias("most_equal"),
    )
    named = items.select("item_id", F.xxhash64("own").alias("kind"))
    return found.join(named, "kind").select("doc_id", "text_hash", "item_id", "places", "first_word", "most_equal", "item_words")


def drop_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    found = find_passages(docs, benchmark, id_col, text_col).select("doc_id", "text_hash").distinct()
    found = store.written(found.withColumnsRenamed({"doc_id": "_hit_id", "text_hash": "_hit"}), "matches")
    same = docs[id_col].eqNullSafe(found["_hit_id"]) & (F.xxhash64(docs[text_col]) == found["_hit"])
    return docs.join(found, same, "left_anti")


def _oracle() -> str:
    split = lambda: rf"regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}')"

    def rows(name: str, key: str, where: str) -> str:
        masks = [(m, f"len(w) >= {SHORT_WORDS}" if where else "true") for m in MASKS] + [(SHORT_MASK, f"len(w) < {SHORT_WORDS}" if where else "true")]
        each = [
            f"SELECT {key}, {k} AS mask, p, [{', '.join(f'w[p + {o + 1}]' for o in m)}] AS seed "
            f"FROM (SELECT {key}, w, unnest(range(len(w) - {m[-1]})) AS p FROM {name} WHERE {fits})"
            for k, (m, fits) in enumerate(masks)
        ]
        return " UNION ALL ".join(each)

    return f"""
WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, text, {split()} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {split()} AS w FROM benchmark WHERE len({split()}) >= {LEAST_WORDS}),
hits AS (
  SELECT DISTINCT x.doc_id, y.item_id, x.p - y.p AS place
  FROM ({rows('d', 'doc_id', '')}) x JOIN ({rows('b', 'item_id', 'y')}) y ON x.mask = y.mask AND x.seed = y.seed
), laid AS (
  SELECT h.*, len(b.w) AS n, least(len(b.w), {WINDOW}) AS win,
    list_transform(range(len(b.w)), lambda k: CASE WHEN h.place + k >= 0 AND d.w[h.place + k + 1] = b.w[k + 1] THEN 1 ELSE 0 END) AS eq
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)
), best AS (
  SELECT *, list_max(list_transform(range(n - win + 1), lambda s: list_sum(eq[s + 1 : s + win]))) AS most FROM laid
)
SELECT doc_id, item_id, count(DISTINCT place) AS places, min(place)::BIGINT AS first_word, max(most)::BIGINT AS most_equal,
  n::BIGINT AS item_words
FROM best WHERE most >= CASE WHEN n < {SHORT_WORDS} THEN n ELSE ceil(win * {LEAST_EQUAL} - 1e-9) END
GROUP BY doc_id, item_id, n
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": _oracle()}
