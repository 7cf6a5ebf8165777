"""Compare registered queries with their SQL: ``python tests/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "quantize"):
        return f"{float(v):.9g}"
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows only: {len(got)}"
    rel = con.sql(sql)
    want, columns = rel.fetchall(), rel.columns
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {c: str(t) for c, t in zip(columns, rel.types, strict=True)}
    names = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE"}
    odd = [(c, t, duck_types[c]) for c, t in spark_types.items() if names.get(t) != duck_types[c]]
    a, b = _rows(df.columns, got), _rows(columns, want)
    note = f" types differ: {odd}" if odd else ""
    if a == b:
        return f"ok {len(a)} rows{note}"
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"DIFFERENT {len(a)} vs {len(b)}{note}\n   spark {only_a}\n   sql   {only_b}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from casequarry.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:] or list(queries())
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle_connection(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            out = compare(spark, con, name, queries()[name], oracle_sql().get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            out = f"ERROR {str(exc)[:1500]}"
        bad += not out.startswith(("ok", "rows only"))
        print(f"{name}: {out} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} of {len(wanted)} not equal")


if __name__ == "__main__":
    main()
