"""Streams over tables that are folders of files."""

import os

from casequarry.plans import inputs, queries_stream

SF_DIR = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_a_table_may_be_a_folder(spark, tmp_path):
    for name in ("documents", "orders", "events"):
        inputs.table(spark, SF_DIR, name).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        assert len([f for f in os.listdir(f"{tmp_path}/{name}.parquet") if f.endswith(".parquet")]) == 3
    for query in (queries_stream.streamed_intake, queries_stream.streamed_case_rollup, queries_stream.streamed_attempts):
        whole, parts = _rows(query(spark, SF_DIR)), _rows(query(spark, str(tmp_path)))
        assert parts == whole and len(parts) > 100, query.__name__
