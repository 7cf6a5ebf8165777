"""How a chain of filters acts in every order: decision diagrams of failure masks, reordered by adjacent level swaps.

1. Every document gets a failure mask, one bit a filter, in one pass over its text. The copy filter needs the smallest
   id of each text: a partial aggregation by digest, joined back skew-safely on the narrow rows.
2. Masks are counted per part (documents, good ones, toxic ones): at most 2^filters rows a part, whatever the corpus.
3. Per part, one task builds the diagram of these counts, a level a filter and equal sub-diagrams shared. Swapping two
   adjacent levels leads from one order of the filters to the next, so all orders are met by as many swaps. In each
   order the path of documents that pass everything shows what every step keeps and removes.

Cases: null text is empty; a null part is the empty string; a null id is no greater than any other, so such a document
is no copy, and it has no labels; rows with one id are documents of their own, and those with the smallest id of a text
are not copies of each other; several labels of an id count as good or toxic if one of them does; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store
from casequarry.scale import lookup, settle

LEAST_WORDS = 200
#: Out of a hundred words, so many must be different; out of a hundred characters, so many may be capitals.
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = "#$%&*|"
WORD = r"[^\x20\x09-\x0D]+"
#: Filter that removes later copies; the others look at one text.
COPY = "E"
#: What is counted: all documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")

_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_filters(text: str, words: str) -> dict[str, Column]:
    """True where a text (column) with these words (array column) fails the filter of that letter."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(F.col(text), "[A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": F.col(text).rlike(f"[{SYMBOLS}]"),
    }


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row; bit k of the mask is the k-th letter of ``text_filters``, then ``COPY``."""
    whole = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    split = settle(whole, words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    filters = text_filters("text", "words")
    mask = sum((failed.cast("int") * (1 << k) for k, failed in enumerate(filters.values())), F.lit(0))
    facts = store.written(split.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "facts")
    # Only texts that occur more than once can make a copy.
    groups = facts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = store.written(groups, "repeated")
    found = lookup(facts, groups.select("digest", "first_id"), ["digest"], counts=groups.select("digest", "n"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * (1 << len(filters))
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and those with labels quality=1 and toxic=1."""
    marks = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    # Rows that repeat an id are folded before they meet its labels.
    folded = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    met = folded.join(marks, "doc_id", "left")
    return met.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]]
    )


class Diagram:
    """A decision diagram of counts over failure masks.

    A node is a pair (child that passes, child that fails) of its level's filter; a node below the last level is a tuple
    of counts. Equal nodes of a level are one node. ``weight`` is the sum of the counts below a node.
    """

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]]):
        self.order, n = order, len(order)
        self.levels: list[list[tuple[int, int]]] = [[] for _ in order]
        self.weights: list[list[tuple[int, ...]]] = [[] for _ in order]
        leaves: dict[tuple[int, ...], int] = {}
        # The path to the i-th leaf has the bits of i, the first filter's at the top; a mask has the first filter's lowest.
        row = [int(f"{i:0{n}b}"[::-1], 2) for i in range(1 << n)]
        row = [leaves.setdefault(counts.get(mask, (0,) * len(COUNTS)), len(leaves)) for mask in row]
        self.leaves = list(leaves)
        for level in reversed(range(n)):
            known: dict[tuple[int, int], int] = {}
            row = [known.setdefault(pair, len(known)) for pair in zip(row[::2], row[1::2], strict=True)]
            self._fill(level, known)

    def _fill(self, level: int, nodes: dict[tuple[int, int], int]) -> None:
        self.levels[level] = list(nodes)
        below = level + 1
        self.weights[level] = [tuple(map(sum, zip(self.weight(below, a), self.weight(below, b), strict=True))) for a, b in nodes]

    def weight(self, level: int, node: int) -> tuple[int, ...]:
        return self.weights[level][node] if level < len(self.order) else self.leaves[node]

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Nodes above keep their children, nodes below are not touched."""
        known: dict[tuple[int, int], int] = {}
        upper = []
        for passes, fails in self.levels[level]:
            (a, b), (c, d) = self.levels[level + 1][passes], self.levels[level + 1][fails]
            upper.append((known.setdefault((a, c), len(known)), known.setdefault((b, d), len(known))))
        self.levels[level] = upper
        self._fill(level + 1, known)
        order = list(self.order)
        order[level], order[level + 1] = order[level + 1], order[level]
        self.order = "".join(order)

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) of each step along the path of documents that pass."""
        node, out = 0, []
        for level in range(len(self.order)):
            passes, fails = self.levels[level][node]
            out.append((self.weight(level + 1, passes), self.weight(level + 1, fails)))
            node = passes
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the swaps that lead through all orders of n things, each order once."""
    if n < 2:
        return
    # The last thing walks through the others; when it has reached an end, they take their own next step.
    inner, leftward = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if leftward else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + leftward
        leftward = not leftward


def audit_part(part: str, letters: str, counts: dict[int, tuple[int, ...]]) -> list[tuple]:
    """All steps of all orders of one part."""
    diagram = Diagram(letters, counts)
    orders = {diagram.order: diagram.steps()}
    for place in adjacent_swaps(len(letters)):
        diagram.swap(place)
        orders[diagram.order] = diagram.steps()
    if len(orders) != math.factorial(len(letters)):
        raise AssertionError("an order is missing")
    # First in an order a filter removes all that fail it, last in an order only what fails nothing else.
    total = {order[0]: steps[0][1][0] for order, steps in orders.items()}
    unique = {order[-1]: steps[-1][1][0] for order, steps in orders.items()}
    shapley = dict.fromkeys(letters, 0)
    for order, steps in orders.items():
        for letter, (_, removed) in zip(order, steps, strict=True):
            shapley[letter] += removed[0]
    return [
        (part, order, k, kept[0], out[0], total[f] - out[0], unique[f], out[1], out[2], shapley[f])
        for order, steps in orders.items()
        for k, (f, (kept, out)) in enumerate(zip(order, steps, strict=True), start=1)
    ]


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the letters and step, from ``mask_counts``."""

    def steps(table: pd.DataFrame) -> pd.DataFrame:
        found = {int(r.mask): tuple(int(getattr(r, c)) for c in COUNTS) for r in table.itertuples()}
        rows = audit_part(table["part"].iloc[0], letters, found)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _STEPS.split(", ")])

    # At most 2^filters rows a part.
    return counts.groupBy("part").applyInPandas(steps, _STEPS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(store.table(spark, sf_dir, "documents"))
    letters = "".join(text_filters("text", "text")) + COPY
    return audit(mask_counts(masks, store.table(spark, sf_dir, "labels")), letters)


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(words) < 200 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
      CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
      CASE WHEN doc_id > first_id THEN 'E' END) AS failed
  FROM texts LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT letter AS filter_order FROM letters
  UNION ALL
  SELECT filter_order || letter FROM orders, letters WHERE NOT contains(filter_order, letter)
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before
  FROM (SELECT DISTINCT part FROM counted), (SELECT * FROM orders WHERE length(filter_order) = 5), range(1, 6) AS r(step)
), judged AS (
  SELECT part, filter_order, step, letter, c.n, c.good, c.toxic, contains(failed, letter) AS fails,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS gone, failed = letter AS alone
  FROM steps JOIN counted c USING (part)
), summed AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::bigint AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::bigint AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::bigint AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::bigint AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::bigint AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley
FROM summed
"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {"op11_filter_audit": ORACLE}
