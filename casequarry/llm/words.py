"""Words and their 64-bit hashes of whole Arrow batches, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: One random value per byte, and the odd base of the rolling hash with its inverse modulo 2**64.
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=U)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return own[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and where each text's words begin."""
    data, at = text_bytes(column)
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    letter = ~_SPACE[data]
    first = np.zeros(n, dtype=bool)
    first[at[:-1][at[:-1] < n]] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | first[1:]
    ends = np.flatnonzero(ends) + 1
    del letter, first, begins
    total = np.zeros(n + 1, dtype=U)
    values = BYTE_VALUES[_LOWER[data]]
    values *= powers(BASE, n)
    np.cumsum(values, out=total[1:])
    del values
    hashes = total[ends] - total[starts]
    del total
    hashes *= powers(BASE_INVERSE, n)[starts]
    return mixed(hashes + (ends - starts).astype(U)), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; the last ``width - 1`` places have none."""
    if len(words) < width:
        return np.zeros(0, U)
    out, held = words, 1
    for bit in f"{width:b}"[1:]:  # twice the width, and one more for a bit that is set
        n = len(words) - 2 * held + 1
        out, held = out[:n] * U(pow(BASE, held, 2**64)) + out[held : held + n], 2 * held
        if bit == "1":
            out, held = out[: n - 1] * U(BASE) + words[held : held + n - 1], held + 1
    return mixed(out)
