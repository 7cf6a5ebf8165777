"""Lines that prompts are put together from are made once, however often they are read."""

import pytest
from pyspark.sql import functions as F

from casequarry import scale
from casequarry.operators import prompts as pr
from casequarry.plans import inputs

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("helper", ["bounded_text", "text_parts", "paired_parts"])
def test_lines_are_made_once(spark, helper):
    made = spark.sparkContext.accumulator(0)

    def line(seq):
        made.add(1)
        return f"line {seq}"

    rows = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    lines = rows.withColumn("line", F.udf(line)("seq"))
    out = getattr(scale, helper)(lines, ["k"], ["seq"], "line", 50)
    assert out.count() >= 3
    assert made.value == 60


def test_a_record_is_made_once_for_its_line(spark):
    lines = pr.document_lines(inputs.home_documents(spark, SF_DIR))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1


def _pairs(spark, sizes):
    rows = [(k, i, f"{k}-{i}-" + "x" * (i * 7 % 20)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, seq int, line string")
    return {(r.k, r.part): r.text for r in scale.paired_parts(df, ["k"], ["seq"], "line", 80).collect()}


def test_pairs_in_rows_are_those_of_the_shuffle(spark, monkeypatch):
    sizes = {"a": 1, "b": 3, "c": 9, "d": 40}
    in_rows = _pairs(spark, sizes)
    monkeypatch.setattr(scale, "PAIRED_ROW_CHARS", 0)
    shuffled = _pairs(spark, sizes)
    monkeypatch.setattr(scale, "PAIRED_ROW_CHARS", 4000)  # one key above, others below
    assert in_rows == shuffled == _pairs(spark, sizes) and len(in_rows) > 100
