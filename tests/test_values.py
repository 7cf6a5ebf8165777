"""Value, text, date and JSON functions against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from casequarry.functions import dates, jsonobj, text, values
from casequarry.functions.values import RECORD


def one_column(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.repartition(4).withColumn("y", expression).orderBy("i").select("y").collect()]


def python_strip_fences(s):
    """Own plain statement of the rule: drop the first line and cut at the last lone fence."""
    s = s.strip()
    if not s.startswith("```"):
        return s
    lines = s.splitlines()
    closing = [i for i, line in enumerate(lines) if i and line.strip() == "```"]
    return "\n".join(lines[1 : closing[-1] if closing else len(lines)])


FENCED = [
    "```json\n{\"a\":1}\n```", "  ```\r\n{}\r\n```  ", "```", "```\n", "no fence", " x ```\ny\n``` ", "```\na\n```\nb\n ``` \nc",
    "```json {} ```", " ```\nz", "", "``\nq",
]


def test_strip_fences(spark):
    assert one_column(spark, FENCED, "string", text.strip_fences(F.col("x"))) == [python_strip_fences(s) for s in FENCED]


JSONS = [
    '{"a":1}', '{"a":1} x', "[1,2]", '"s"', "", "null", "3", "2.5", "true", '{"a":1},{"b":2}', '{"a":1}], x', "1], [2", '{"a":[1]}, {"b":[2]}', "[1]]", '{"a":1}} x', '{"a":[{"b":1}]}',
    '{"a":1,"a":2}', '{"a":null,"b":true,"c":"true","d":1.50,"e":1.0,"f":{"x":[1, 2]},"g":[],"h":"","i":12345678901234567890}',
    "{'a':1}", '{"a":"x\ny"}', '{"a"', "{}", '```json\n{"k": "v"}\n```', '{"é": "\\u00e9\\n\\"q\\""}',
]


def python_object(s):
    try:
        data = json.loads(python_strip_fences(s))
    except json.JSONDecodeError:
        return None, jsonobj.INVALID
    if not isinstance(data, dict):
        return None, f"Expected JSON object, got {type(data).__name__}"
    kinds = {"NoneType": "null", "str": "string", "dict": "object"}
    return {
        k: (
            None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) if isinstance(v, dict | list) else str(v),
            kinds.get(type(v).__name__, type(v).__name__),
        )
        for k, v in data.items()
    }, ""


@pytest.mark.parametrize("strict", [False, True])
def test_parse_object(spark, strict):
    for s, got in zip(JSONS, one_column(spark, JSONS, "string", jsonobj.parse_object(F.col("x"), strict)), strict=True):
        record, error = python_object(s)
        seen = got["error"]
        if strict and error == jsonobj.INVALID:
            assert seen and not seen.startswith("Expected JSON object"), s
        else:
            assert seen == error, s
        read = None if got["record"] is None else {k: (v["text"], v["kind"]) for k, v in got["record"].items()}
        assert read == record, s


def test_strict_takes_nan(spark):
    (got,) = one_column(spark, ['{"a": NaN}'], "string", jsonobj.parse_object(F.col("x"), strict=True))
    assert got["record"]["a"]["kind"] == "float"


def test_float_text(spark):
    rng = random.Random(5)
    numbers = [0.0, -0.0, 1.0, 1.5, 1e7, 12345678.9, 1e15, 0.001, 0.00012, 1e-4, 1.25e-5, 1e-10, float("inf"), -float("inf")]
    numbers += [round(rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12), 4) for _ in range(500)]
    assert one_column(spark, numbers, "double", values.float_text(F.col("x"))) == [repr(n) for n in numbers]


def python_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def test_text_to_float(spark):
    texts = ["1", " 1.5 ", "1_000", "1__0", "_1", "12d", "1e5", "-.5", "5.", "inf", "-Infinity", "1.234,56", "", "abc", "+7", "1f", "0x10"]
    assert one_column(spark, texts, "string", values.text_to_float(F.col("x"))) == [python_float(t) for t in texts]


def test_falsy_values(spark):
    df = spark.sql(
        f"""SELECT from_json('{{"a":{{"text":"0.0","kind":"float"}},"b":{{"text":"0.0","kind":"string"}},"c":{{"kind":"null"}},
        "d":{{"text":"False","kind":"bool"}},"e":{{"text":"","kind":"string"}},"f":{{"text":"[]","kind":"list"}},
        "g":{{"text":"2","kind":"int"}}}}', '{RECORD}') AS r"""
    )
    names = "abcdefgz"
    row = df.select(*[values.truthy(values.field_of(F.col("r"), n)).alias(n) for n in names]).first()
    assert [row[n] for n in names] == [False, True, False, False, False, False, True, False]


# A date text and the date it is read as, worked by hand: one of each format, then the edges.
DATES = [
    ("1998-06-30", "1998-06-30"), ("1.2.2001", "2001-02-01"), ("01/02/2001", "2001-02-01"), ("6/1998", "1998-06-01"), ("1998-6", "1998-06-01"),
    ("31.02.2001", None), ("29.02.2000", "2000-02-29"), (" 1998-06-01\n", "1998-06-01"), ("98-01-01", None), ("x", None), ("", None),
    ("1998-13", None), ("0000-01-01", None), ("1998-06-30x", None), ("13/13/2001", None),
]


def test_parse_date(spark):
    got = one_column(spark, [t for t, _ in DATES], "string", dates.parse_date(F.col("x")).cast("string"))
    assert got == [day for _, day in DATES]


def test_months_before_clamps(spark):
    row = spark.sql("SELECT DATE '2024-03-31' AS d").select(dates.months_before(F.col("d"), F.lit(1)).cast("string").alias("a"), dates.months_before(F.col("d"), F.lit(13)).cast("string").alias("b")).first()
    assert (row.a, row.b) == ("2024-02-29", "2023-02-28")


# A text, the bits per character of its noisiest window, and its number of windows, worked by hand: n letters that are
# equally frequent have log2(n) bits; windows have 100 characters and begin every 50, as long as 100 are left.
ENTROPIES = [
    ("", None, 0), ("a", 0.0, 1), ("ab", 1.0, 1), ("aabb", 1.0, 1), ("abcd", 2.0, 1), ("abcdefgh", 3.0, 1), ("ü€😀x" * 25, 2.0, 1),
    ("a" * 99, 0.0, 1), ("a" * 100, 0.0, 1), ("a" * 101, 0.0, 1), ("a" * 150, 0.0, 1), ("a" * 151, 0.0, 2), ("a" * 201, 0.0, 3),
    ("a" * 50 + "b" * 50, 1.0, 1), ("a" * 100 + "b" * 100, 1.0, 2),
    ("a" * 75 + "b" * 25, 2 - 0.75 * math.log2(3), 1),
]


def test_entropy(spark):
    texts = [t for t, _, _ in ENTROPIES]
    got = one_column(spark, texts, "string", text.max_window_entropy("x"))
    assert one_column(spark, texts, "string", text.entropy_window_count(F.col("x"))) == [n for _, _, n in ENTROPIES]
    for (s, bits, _), seen in zip(ENTROPIES, got, strict=True):
        assert seen == bits or abs(seen - bits) < 1e-9, s[:9]


def test_safe_key_and_json_text(spark):
    keys = ["abc_1", "a-b", "", "a b", "ä", "abc\n"]
    assert one_column(spark, keys, "string", text.is_safe_key(F.col("x"))) == [True, False, False, False, False, True]
    texts = ['a"b', "back\\slash", "tab\t", "plain", "é", ""]
    assert [json.loads(t) for t in one_column(spark, texts, "string", values.json_quoted(F.col("x")))] == texts
