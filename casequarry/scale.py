"""Helpers that keep joins and lists bounded when one key holds much of the data."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
# Hot rows are spread over this many join partitions.
SALTS = 64
# Paths written by each running application, for drop_work.
_WRITTEN: dict[str, list[str]] = {}
# A key of up to so many rows is numbered by one task.
WINDOW_ROWS = 1_000_000
# The links of a key are gathered to one row if there are up to so many.
GATHERED_LINKS = 1000
# A key's pairs of blocks are made in one row if their texts have up to so many characters.
PAIRED_ROW_CHARS = 4_000_000
# Configuration tables up to this size are broadcast; larger ones are joined by a shuffle.
MAX_CONFIG_ROWS = 100_000


def config_table(spark: SparkSession, rows: list[dict], schema: str | T.StructType) -> DataFrame:
    """A driver-side table, marked for broadcast if it is small."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(struct))
    df = spark.createDataFrame(table, schema=struct)
    return F.broadcast(df) if len(rows) <= MAX_CONFIG_ROWS else df


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions that are analysed inside give null where they cannot be evaluated, instead of ending the job."""
    strict = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", strict)


def mixes_types(df: DataFrame, sql: str) -> bool:
    """True if a text column would be read as another type to evaluate the expression."""
    plan = df.select(F.expr(sql).cast("boolean").alias("_e"))._jdf.queryExecution().analyzed().toString()
    texts = "|".join(re.escape(c) for c, t in df.dtypes if t == "string")
    return bool(texts and re.search(rf"cast\((?:{texts})#\d+ as (?!string|boolean\) AS _e)", plan))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add new columns that are computed once per row, before any filter on them.

    A filter on an ordinary computed column is pushed down with the whole computation repeated inside it.
    Columns that come out of a generator stay where they are.
    """
    cells = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(cells)))


def hot_keys(rows: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Keys holding more than 1/HOT_SHARE of the rows: at most HOT_SHARE of them, whatever the data.

    ``counts`` (keys, n) may be given when the caller has grouped the rows already.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.where(F.col("n") * HOT_SHARE > total.scalar()).select(*keys).dropna()


_ROW_KEYS = ("doc_id", "doc_seq", "field")


def _spread_columns(rows: DataFrame, keys: Sequence[str]) -> list[str]:
    """Short columns that tell the rows of one key apart; long texts are not read just to be hashed."""
    own = [c for c in _ROW_KEYS if c in rows.columns and c not in keys]
    short = [c for c, t in rows.dtypes if c not in keys and t.startswith(("int", "bigint", "double", "date", "timestamp"))]
    hashable = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    return own or short or hashable


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``table`` (one row per key) to ``rows`` without sending a hot key to one task.

    Rows of a hot key, and rows without a key, are dealt over SALTS partitions by a hash of their own columns, and the
    key's row of ``table`` goes to each of these. Only the keys themselves are broadcast, HOT_SHARE at most; the columns
    of ``table`` may be as wide as they like.
    """
    keys = list(keys)
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    values = [c for c in table.columns if c not in keys]
    hot = F.broadcast(hot_keys(rows, keys, counts).withColumn("_is_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in _spread_columns(rows, keys)]), F.lit(SALTS)).cast("int")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    marked = rows.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_is_hot").isNotNull() | no_key, spread).otherwise(0)
    )
    salts = F.when(F.col("_is_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(hot, keys, "left").select(*keys, F.struct(*values).alias("_got"), F.explode(salts).alias("_salt"))
    joined = marked.join(copies, [*keys, "_salt"], how)
    return joined.select(*rows.columns, *[F.col(f"_got.{v}").alias(v) for v in values])


def _aside(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with its keys under other names, for a join with a table it was made from."""
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def _met(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that has a row for many keys: its size follows the data, so it never goes through the driver.

    Compressed rows of a few megabytes would be broadcast, and take many times that in the driver's memory.
    """
    return df.hint("merge")


def _plain(keys: Sequence[str], order: Sequence[str]) -> list[str]:
    """Columns of keys and order, each once."""
    return list(dict.fromkeys([*keys, *order]))


def bounded_text(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, max_chars: int, separator: str = "\n"
) -> DataFrame:
    """Join the lines of each key in order, for keys whose joined text has at most ``max_chars``.

    Returns keys, ``line_count``, ``chars`` (exact for every key) and ``text``, which is null when the text would be
    longer: the length alone then decides what happens to it. Lengths come from a partial aggregation; only the lines
    of keys that fit are gathered, so ``max_chars`` bounds every group. Lines are made once: written, then read for both.
    """
    keys = list(keys)
    lines = cut_lineage(lines.select(*_plain(keys, order), line), "lines")
    length = F.sum(F.length(line)) + (F.count(F.lit(1)) - 1) * len(separator)
    totals = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_count"), length.alias("chars"))
    longer = totals.where(F.col("chars") > max_chars).select(*keys)
    cells = F.struct(*[F.col(c) for c in order], F.col(line).alias("_line"))
    texts = (
        lines.join(_aside(longer, keys), _met(keys), "left_anti")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(cells)).alias("_cells"))
        .select(*keys, F.array_join("_cells._line", separator).alias("text"))
    )
    return totals.join(_aside(texts, keys), _met(keys), "left").select(*keys, "line_count", "chars", "text")


def with_running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the total of ``value`` over the row and those before it in its key, however many rows a key has.

    Rows are written first: what they come from is computed once. Keys of up to WINDOW_ROWS rows are summed by one shuffle
    and a window. Rows of larger keys are ranged by key and order, so such a key lies in several partitions; a row's total
    is that in its partition and the key's totals in the partitions before. Ties of key and order take any order.
    """
    keys = list(keys)
    out = [*rows.columns, name]
    given = cut_lineage(rows.withColumn("_value", value.cast("bigint")), "rows")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = _aside(sizes.where(F.col("_n") > WINDOW_ROWS).select(*keys), keys)
    if large.isEmpty():
        return given.withColumn(name, F.sum("_value").over(within)).select(*out)
    # At most one key for each WINDOW_ROWS rows: few, but how few the data decide, so this is a plain join.
    small = given.join(large, _met(keys), "left_anti").withColumn(name, F.sum("_value").over(within)).select(*out)
    ranged = given.join(large, _met(keys), "left_semi").repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_value").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    in_part = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("_within", F.sum("_value").over(in_part))
    both = running.join(_aside(before, [*keys, "_part"]), _met([*keys, "_part"]), "left")
    return small.unionByName(both.select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name)))


def with_places(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds each row's place among the rows of its key, from 1 on."""
    return with_running_total(rows, keys, order, F.lit(1), name)


def as_of_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, since: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rows with the other columns of their key's newest row of ``facts`` whose ``since`` is not after ``at``; null if none.

    Both sides are ranged together by key and time, so a key with very many rows lies in several partitions. In each, the
    newest fact so far is carried forward; what a partition ends with is carried to the key's next ones. Facts of one time
    are ordered by ``ties`` and then by their values. Rows without a time, and facts without one, meet nothing.
    """
    keys, ties = list(keys), list(ties)
    values = [c for c in facts.columns if c not in (*keys, since)]
    fact = F.struct(*[F.col(c) for c in [*ties, *[v for v in values if v not in ties]]])
    own = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    known = facts.where(F.col(since).isNotNull()).dropna(subset=keys).select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_kind"), fact.alias("_fact"))
    asked = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), own.alias("_row"))
    lined = known.unionByName(asked, allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("_at", "_kind")] + [F.col("_fact").asc_nulls_first()]
    ranged = lined.repartitionByRange(*keys, "_at", "_kind").withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "as-of")
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("_here", F.last("_fact", ignorenulls=True).over(within)).where("_kind = 1")
    ends = ranged.where("_kind = 0").groupBy(*keys, "_part").agg(F.max_by("_fact", F.struct("_at", "_fact")).alias("_end"))
    # One row per key and partition it lies in.
    parts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).join(_aside(ends, [*keys, "_part"]), _met([*keys, "_part"]), "left")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_before")).where("_before IS NOT NULL")
    both = here.join(_aside(carried, [*keys, "_part"]), _met([*keys, "_part"]), "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_before"))
    both = both.select(*keys, "_row", found.alias("_fact"))
    return both.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns], *[F.col(f"_fact.{v}").alias(v) for v in values])


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root): every node of the links (keys, a, b) with the smallest node it is connected to.

    Keys of up to GATHERED_LINKS links are gathered, a row each, and closed there: one shuffle. Larger keys go on in rounds
    (``_components_in_rounds``); links are written first, as they are read for their number and for both.
    """
    keys = list(keys)
    given = cut_lineage(links.select(*keys, "a", "b"), "given")
    counts = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(_aside(counts.where(F.col("_n") > GATHERED_LINKS).select(*keys), keys), "large")
    few = given if (none := large.isEmpty()) else given.join(large, _met(keys), "left_anti")
    gathered = few.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("_links"))
    schema = T.StructType([*given.select(*keys).schema, *[T.StructField(n, given.schema["a"].dataType) for n in ("node", "root")]])
    closed = gathered.mapInArrow(_closed(keys, to_arrow_schema(schema)), schema)
    return closed if none else closed.unionByName(_components_in_rounds(given.join(large, _met(keys), "left_semi"), keys))


def _closed(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes, roots = [], [], []
            for k, links in enumerate(batch.column("_links")):
                root: dict = {}

                def top(n, root=root):
                    while root[n] != n:
                        root[n] = n = root[root[n]]
                    return n

                for link in links.as_py():
                    low, high = (top(root.setdefault(n, n)) for n in (link["a"], link["b"]))
                    root[max(low, high)] = min(low, high)
                rows += [k] * len(root)
                nodes += root
                roots += [top(n) for n in root]
            own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            cells = [pa.array(c, schema.field(n).type) for n, c in (("node", nodes), ("root", roots))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, *cells], schema, strict=True)], schema=schema)

    return run


def _components_in_rounds(links: DataFrame, keys: list[str]) -> DataFrame:
    """``components`` of keys of any size.

    Each round gives a node the smallest root of its neighbours and then that root's own, so chains shorten by half. Every
    round is written; nothing is gathered, so a component of any size is many rows of many tasks.
    """
    ends = links.select(*keys, "a", "b")
    both = cut_lineage(ends.unionByName(ends.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    known = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    known = cut_lineage(known, "roots")
    while True:
        around = both.join(known.select(*keys, F.col("node").alias("b"), "root"), [*keys, "b"])
        around = around.groupBy(*keys, F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        nearer = known.join(around, [*keys, "node"]).withColumn("_near", F.least("root", "_near"))
        jump = known.select(*keys, F.col("node").alias("_near"), F.col("root").alias("_further"))
        stepped = nearer.join(jump, [*keys, "_near"]).select(
            *keys, "node", F.least("_near", "_further").alias("root"), (F.least("_near", "_further") < F.col("root")).alias("_changed")
        )
        stepped = cut_lineage(stepped, "roots")
        known = stepped.drop("_changed")
        if stepped.where("_changed").isEmpty():
            return known


def _cut_lines(
    lines: DataFrame, keys: list[str], order: Sequence[str], line: str, max_chars: int, step: int, gap: int
) -> tuple[DataFrame, DataFrame]:
    """(lines of keys that fit ``max_chars``, lines of the others with the ``part`` of them they are in).

    A line is in the step of ``step`` characters that it begins in, so the lines of a part take less than two steps; a
    line longer than a step is a part of its own. Parts are numbered in order, with gaps. Lines are made once: written,
    then read for their lengths and for both tables.
    """
    lines = cut_lineage(lines.select(*_plain(keys, order), line), "lines")
    length = F.length(line) + gap
    sized = lines.groupBy(*keys).agg((F.sum(length) - gap).alias("_chars")).where(F.col("_chars") > max_chars)
    large = shuffled(_aside(sized.select(*keys), keys))
    plain = lines.join(large, _met(keys), "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    cut = with_running_total(lines.join(large, _met(keys), "left_semi"), keys, order, length, "_end")
    begin = F.col("_end") - length
    # What follows a longer line begins in a later step.
    part = 2 * F.floor(begin / step) + (length > step).cast("int")
    return plain, cut.withColumn("part", part.cast("bigint")).drop("_end")


def _joined_lines(lines: DataFrame, keys: list[str], order: Sequence[str], line: str, separator: str) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return lines.groupBy(*keys, "part").agg(cells.alias("_cells")).select(*keys, "part", F.array_join("_cells._line", separator).alias("text"))


def text_parts(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, max_chars: int, separator: str = "\n"
) -> DataFrame:
    """Join the lines of each key in order, in as many texts as it takes; (keys, part, text).

    A key whose lines fit ``max_chars`` has the one part 0. Others are cut before the line that would be too much: each
    line is in one part, and a part has at most ``max_chars``, or is a single line that alone is longer.
    """
    keys = list(keys)
    # Two steps of half the size: a part's lines fit.
    plain, cut = _cut_lines(lines, keys, order, line, max_chars, max(1, max_chars // 2), len(separator))
    return _joined_lines(plain.unionByName(cut), keys, order, line, separator)


def paired_parts(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, max_chars: int, separator: str = "\n"
) -> DataFrame:
    """Join the lines of each key in order, in texts in which any two of its lines meet; (keys, part, text).

    A key whose lines fit ``max_chars`` has the one part 0. Others are cut into blocks of half the size, and there is a
    text for every two blocks: with n blocks n * (n - 1) / 2 texts of at most ``max_chars`` (more only where a line alone
    has over half of that). Two lines of different blocks meet once, those of one block in n - 1 texts. Every text is
    a question that somebody has to ask, so this is meant for keys of not much more than one text.
    """
    keys = list(keys)
    plain, cut = _cut_lines(lines, keys, order, line, max_chars, max(1, max_chars // 4), len(separator))
    blocks = cut_lineage(_joined_lines(cut, keys, order, line, separator), "blocks")
    counts = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("_chars"))
    large = cut_lineage(counts.where(F.col("n") * F.col("_chars") > PAIRED_ROW_CHARS).select(*keys, "n"), "large")
    one = _joined_lines(plain, keys, order, line, separator)
    if large.isEmpty():
        return one.unionByName(_pairs_in_rows(blocks, keys, separator))
    met = shuffled(_aside(large.select(*keys), keys))
    few = blocks.join(met, _met(keys), "left_anti")
    many = _pairs_of_many(blocks.join(met, _met(keys), "left_semi"), large, keys, separator)
    return one.unionByName(_pairs_in_rows(few, keys, separator)).unionByName(many)


def _pairs_in_rows(blocks: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """The pairs of keys whose blocks, and the texts made of them, fit one row: a text for every two blocks."""
    gathered = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("_cells"))
    texts = gathered.select(*keys, F.col("_cells.text").alias("_texts"))
    low = lambda high: F.transform(
        F.sequence(F.lit(0), high - 1), lambda k: F.concat(F.get("_texts", k), F.lit(separator), F.get("_texts", high))
    )
    # Later block by later block, and in each by the earlier one: the place is the text's number.
    paired = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_texts") - 1), low))
    rows = texts.select(*keys, F.posexplode(F.when(F.size("_texts") == 1, F.col("_texts")).otherwise(paired)).alias("part", "text"))
    return rows.select(*keys, F.col("part").cast("bigint").alias("part"), "text")


def _pairs_of_many(blocks: DataFrame, counts: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """The pairs of keys with more than a row should hold: each block is dealt to its pairs by a shuffle."""
    placed = with_places(blocks.select(*keys, "part"), keys, ["part"], "_place")
    numbered = blocks.join(_aside(placed, [*keys, "part"]), _met([*keys, "part"])).select(*keys, "text", (F.col("_place") - 1).alias("_place"))
    numbered = lookup(numbered, counts.withColumnRenamed("n", "_blocks"), keys, counts=counts)
    others = F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)
    others = F.filter(others, lambda k: (k != F.col("_place")) | (F.col("_blocks") == 1))
    dealt = numbered.select("*", F.explode(others).alias("_other"))
    low, high = F.least("_place", "_other"), F.greatest("_place", "_other")
    # Texts are numbered by their later block, then by the earlier one; a lone block is text 0.
    part = F.when(F.col("_blocks") == 1, 0).otherwise((high * (high - 1) / 2).cast("bigint") + low)
    return _joined_lines(dealt.withColumn("part", part.cast("bigint")), keys, ["_place"], "text", separator)


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; unset, on one machine, a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_work")


def drop_work(spark: SparkSession) -> int:
    """Delete the tables that this session's jobs have written on their way; returns how many there were.

    Call it when the results that read them have been stored.
    """
    jvm, paths = spark.sparkContext._jvm, _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def new_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(work_folder(spark), f"casequarry-{label}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Used after model calls: a lost executor then re-reads replies, it does not ask the model again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
