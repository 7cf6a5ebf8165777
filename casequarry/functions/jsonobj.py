"""Reading JSON objects out of model replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casequarry.functions.text import fenced_block, let, strip_fences
from casequarry.functions.values import RECORD, float_text

INVALID = "invalid JSON"
NOT_OBJECT = "Expected JSON object, got "
_PYTHON_KINDS = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in ("keys", "texts", "kinds")]
    + [T.StructField("error", T.StringType())]
)


def _array_of_one(text: Column) -> Column:
    """``[text]`` as a variant: this way text after the first JSON value is an error, not ignored."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _is_one_value(text: Column, wrapped: Column) -> Column:
    # A stray "]" could close the wrapper early; a second wrapper, which "]" cannot close, rules that out.
    closes_early = text.contains("]")
    also_member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return (
        F.try_variant_get(wrapped, "$[0]", "variant").isNotNull()
        & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
        & (~closes_early | also_member)
    )


def _kind(schema: Column, text: Column) -> Column:
    number = F.when(text.rlike("[.eE]"), "float").otherwise("int")
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "VOID", "null")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "list")
        .otherwise(number)
    )


def _member(text: Column, schema: Column) -> Column:
    return let(
        _kind(schema, text),
        lambda kind: F.struct(
            F.when(kind == "float", float_text(text.try_cast("double")))
            .when(kind == "bool", F.initcap(text))
            .otherwise(text)
            .alias("text"),
            kind.alias("kind"),
        ),
    )


def _type_word(schema: Column, text: Column) -> Column:
    kind = _kind(schema, text)
    return (
        F.when(kind == "string", "str").when(kind == "null", "NoneType").otherwise(kind)
    )


def parse_object_text(text: Column) -> Column:
    """Parse text that holds exactly one JSON object; (record, error), error empty when it does."""

    def read(wrapped: Column) -> Column:
        schema = F.schema_of_variant(F.try_variant_get(wrapped, "$[0]", "variant"))
        error = (
            F.when(~_is_one_value(text, wrapped), INVALID)
            .when(schema.startswith("OBJECT"), "")
            .otherwise(F.concat(F.lit(NOT_OBJECT), _type_word(schema, F.trim(text))))
        )
        texts = F.map_from_entries(F.map_entries(F.from_json(text, "map<string,string>")))
        schemas = F.transform_values(
            F.try_variant_get(wrapped, "$[0]", "map<string,variant>"), lambda _, v: F.schema_of_variant(v)
        )
        return let(
            F.coalesce(error, F.lit(INVALID)),
            lambda e: F.struct(
                F.when(e == "", F.map_zip_with(texts, schemas, lambda _, t, s: _member(t, s))).alias("record"),
                e.alias("error"),
            ),
        )

    return let(_array_of_one(text), read)


def parse_object(c: Column, strict: bool = False) -> Column:
    """Parse a reply after dropping its fence lines.

    ``strict`` uses Python's own JSON reader (a vectorised helper), which also accepts NaN and words its
    errors in detail; the default stays in the JVM.
    """
    text = strip_fences(c)
    if not strict:
        return let(text, parse_object_text)
    parsed = _python_object(text)
    cells = F.arrays_zip(parsed["texts"].alias("text"), parsed["kinds"].alias("kind"))
    record = F.map_from_arrays(parsed["keys"], F.transform(cells, lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"))))
    return F.struct(F.when(parsed["error"] == "", record).cast(RECORD).alias("record"), parsed["error"].alias("error"))


def _python_member(value: object) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return str(value), "bool"
    if isinstance(value, (int, float)):
        return str(value), type(value).__name__
    if isinstance(value, str):
        return value, "string"
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False), (
        "list" if isinstance(value, list) else "object"
    )


def _python_row(text: str | None) -> tuple:
    try:
        data = json.loads(text or "")
    except json.JSONDecodeError as exc:
        return None, None, None, str(exc)
    if not isinstance(data, dict):
        return None, None, None, f"{NOT_OBJECT}{type(data).__name__}"
    members = [_python_member(v) for v in data.values()]
    return list(data), [m[0] for m in members], [m[1] for m in members], ""


@F.pandas_udf(_PYTHON_KINDS)
def _python_object(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_python_row(t) for t in texts], columns=["keys", "texts", "kinds", "error"])


def is_json(text: Column) -> Column:
    """True when the text is exactly one JSON value."""
    return F.coalesce(let(_array_of_one(text), lambda w: _is_one_value(text, w)), F.lit(False))


def missing_keys(record: Column, required: list[str]) -> Column:
    """Required keys that the object lacks, in the given order; a key holding null is present."""
    wanted = F.array(*[F.lit(k) for k in required]).cast("array<string>")
    return F.filter(wanted, lambda k: ~F.array_contains(F.map_keys(record), k))


def unexpected_keys(reply: Column, expected: Column) -> Column:
    """Keys of the reply's object, sorted, that are neither expected nor notes (``_x``, ``x_reasoning``)."""
    record = let(fenced_block(reply), parse_object_text)["record"]
    named = F.filter(F.map_keys(record), lambda k: ~k.startswith("_") & ~k.endswith("_reasoning"))
    return F.coalesce(F.array_sort(F.array_except(named, expected)), F.array().cast("array<string>"))
