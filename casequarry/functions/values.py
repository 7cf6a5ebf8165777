"""Extracted values.

An extracted record is a MAP from field name to (text, kind). ``text`` is the value as text (null for a
JSON null), ``kind`` one of string, int, float, bool, null, list, object. A field that is present with
null differs from an absent field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<text:string,kind:string>"
RECORD = f"map<string,{VALUE}>"

_NUMBER = r"\A[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\z"
_WORD = r"(?i)\A[+-]?(inf|infinity|nan)\z"


def field_of(record: Column, name: str | Column) -> Column:
    """A field of a record; null when it is absent."""
    return F.try_element_at(record, F.lit(name) if isinstance(name, str) else name)


def empty_record() -> Column:
    return F.map_from_arrays(F.array(), F.array()).cast(RECORD)


def value(text: Column, kind: str) -> Column:
    """A value of a given kind; a null text makes a JSON null."""
    return F.struct(
        text.cast("string").alias("text"),
        F.when(text.isNull(), "null").otherwise(kind).alias("kind"),
    )


def float_text(d: Column) -> Column:
    """A double as the shortest text that reads back, with an exponent only below 1e-4 and from 1e16 on."""
    java = d.cast("string")
    size = F.abs(d)
    sign = F.when(java.startswith("-"), "-").otherwise("")
    lead = F.regexp_extract(java, r"(\d)\.(\d+)E(-?\d+)", 1)
    rest = F.regexp_replace(F.regexp_extract(java, r"(\d)\.(\d+)E(-?\d+)", 2), r"0+\z", "")
    power = F.coalesce(F.regexp_extract(java, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))
    digits = F.length(rest)
    plain_large = F.concat(
        sign,
        lead,
        F.rpad(F.substring(rest, F.lit(1), power), power, F.lit("0")),
        F.lit("."),
        F.when(digits > power, F.substring(rest, power + 1, digits)).otherwise("0"),
    )
    plain_small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), lead, rest)
    steps = F.abs(power).cast("string")
    exponent = F.concat(
        F.when(power < 0, "-").otherwise("+"), F.lpad(steps, F.greatest(F.lit(2), F.length(steps)), F.lit("0"))
    )
    scientific = F.concat(sign, lead, F.when(digits > 0, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), exponent)
    return (
        F.when(F.isnan(d), "nan")
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(~java.contains("E"), java)
        .when((size >= 1e7) & (size < 1e16), plain_large)
        .when((size >= 1e-4) & (size < 1e-3), plain_small)
        .otherwise(scientific)
    )


def truthy(v: Column) -> Column:
    """False for null, false, zero, empty text, empty list and empty object."""
    text, kind = v["text"], v["kind"]
    return F.coalesce(
        F.when(kind == "bool", text == "True")
        .when(kind.isin("int", "float"), text.try_cast("double") != 0)
        .when(kind == "string", text != "")
        .when(kind.isin("list", "object"), ~text.isin("[]", "{}"))
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def text_to_float(text: Column) -> Column:
    """Text as a double, null when it is not a number. Digits may be grouped by single underscores."""
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), F.regexp_replace(t, "_", "").try_cast("double")).when(
        t.rlike(_WORD), t.try_cast("double")
    )


def to_float(v: Column) -> Column:
    """A value as a double, null when it cannot be one."""
    text, kind = v["text"], v["kind"]
    return (
        F.when(kind == "bool", F.when(text == "True", 1.0).otherwise(0.0))
        .when(kind.isin("int", "float"), text.try_cast("double"))
        .when(kind == "string", text_to_float(text))
    )


def json_quoted(text: Column) -> Column:
    """Text as a JSON string; only text with characters to escape goes through the JSON writer."""
    escaped = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)\A\{"t":(.*)\}\z', 1)
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(plain)


def json_cell(v: Column) -> Column:
    """A value as JSON text."""
    text, kind = v["text"], v["kind"]
    return (
        F.when(kind == "string", json_quoted(text))
        .when(kind == "bool", F.lower(text))
        .when(kind == "null", "null")
        .otherwise(text)
    )


def record_json(record: Column, *leading: tuple[str, Column]) -> Column:
    """A record as one JSON object with its keys sorted, after the given leading text members."""
    head = [
        F.concat(F.lit(f'"{name}": '), F.when(c.isNull(), "null").otherwise(json_quoted(c))) for name, c in leading
    ]
    members = F.sort_array(F.map_entries(record))
    cells = F.transform(members, lambda m: F.concat(json_quoted(m["key"]), F.lit(": "), json_cell(m["value"])))
    return F.concat(
        F.lit("{"), F.array_join(F.concat(F.array(*head).cast("array<string>"), cells), ", "), F.lit("}")
    )
