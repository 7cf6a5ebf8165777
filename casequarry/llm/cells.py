"""Compressed cells: what tasks send to each other about many rows at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa



def packed(table: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def columns(**arrays: np.ndarray | list | pa.Array) -> bytes:
    """Arrays of one length in a cell."""
    return packed(pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in arrays.items()}))


def opened(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(cell).read_all()


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def rows(schema: pa.Schema, *found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(found), schema=schema)
