"""Column functions over text: trimming, fences, patterns, entropy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from re import _constants, _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from casequarry import fixed_values as fv

SPACE = r"[\s\x1c-\x1f]"  # with (?U): every Unicode white space character
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Trim all Unicode white space on both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def unicode_space(pattern: str) -> str:
    r"""Make ``\s``, ``\w``, ``\d`` and ``\b`` in a pattern cover Unicode, as the patterns are written for."""
    return f"(?U){pattern}" if re.search(r"\\[sSwWdDbB]", pattern) else pattern


def is_safe_key(c: Column) -> Column:
    # The pattern's end anchor also accepts one final line break.
    return F.coalesce(c.rlike(fv.SAFE_KEY.replace("$", r"\n?\z")), F.lit(False))


def too_long(c: Column, max_len: int) -> Column:
    return F.length(c) > max_len


def hash_tampered(text: Column, stored_hash: Column) -> Column:
    """True when a stored hash is given and the text no longer has it."""
    stored = F.coalesce(stored_hash, F.lit(""))
    return (stored != "") & (F.sha2(text.cast("binary"), 256) != stored)


def required_literals(pattern: str) -> tuple[list[str], bool]:
    """(texts of which one is in every match, is it the lower-cased text that holds them); no texts if none is known.

    What is returned is the longest piece that no match can do without, or a piece for each alternative. A pattern that
    folds the case of more than ASCII, or that cannot be read here, has none.
    """
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return [], False
    fold = bool(tree.state.flags & re.IGNORECASE)
    found = _pieces_of(tree, fold)
    if not found or (fold and not all(x.isascii() for x in found)):
        return [], False
    return sorted({x.lower() for x in found} if fold else set(found)), fold


def _pieces_of(items, fold: bool) -> list[str]:
    """The best list of pieces of a sequence: the one whose shortest piece is the longest."""
    lists: list[list[str]] = []
    run = ""
    for kind, value in items:
        if kind is _constants.LITERAL:
            run += chr(value)
            continue
        lists.append([run])
        run = ""
        if kind is _constants.SUBPATTERN:
            _, add, remove, inner = value
            if not add and not remove:  # groups with flags of their own are passed over
                lists.append(_pieces_of(inner, fold))
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            lists.append(_pieces_of(value[2], fold))
        elif kind is _constants.BRANCH:
            each = [_pieces_of(b, fold) for b in value[1]]
            if all(each):
                lists.append([x for b in each for x in b])
    lists.append([run])
    known = [x for x in lists if x and all(x)]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=[])


def may_match(c: Column, pattern: str) -> Column:
    """False where the text lacks what every match of the pattern holds: a search for bytes instead of a regular expression."""
    literals, fold = required_literals(pattern)
    held = F.lit(not literals)
    for x in literals:
        held = held | F.contains(F.lower(c) if fold else c, F.lit(x))
    return held


def first_match(c: Column, patterns: Sequence[str]) -> Column:
    """The first pattern, in list order, that is found in the text; null when none is."""
    hit = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        hit = F.when(may_match(c, pattern) & c.rlike(unicode_space(pattern)), F.lit(pattern)).otherwise(hit)
    return hit


def role_structure(c: Column) -> Column:
    """True when the text holds markers that look like a change of speaker."""
    found = F.lit(False)
    for pattern in fv.ROLE_MARKERS:
        found = found | c.rlike(f"(?iuU){pattern}")
    return found


def fenced_block(c: Column) -> Column:
    """Inner text of the first fenced block anywhere, else the whole text."""
    pattern = f"(?sU){fv.FENCED_BLOCK}"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def strip_fences(c: Column) -> Column:
    """Drop the fence lines of a text that starts with a fence."""

    def inner(lines: Column) -> Column:
        closing = F.transform(lines, lambda x, i: F.when((i >= 1) & (strip(x) == "```"), i))
        end = F.coalesce(F.array_max(closing), F.size(lines))
        return F.array_join(F.slice(lines, F.lit(2), end - 1), "\n")

    cleaned = strip(c)
    return F.when(cleaned.startswith("```"), let(F.split(cleaned, LINE_BREAK), inner)).otherwise(cleaned)


_COUNT_WEIGHT = np.zeros(fv.ENTROPY_WINDOW + 1)
_COUNT_WEIGHT[1:] = np.arange(1, fv.ENTROPY_WINDOW + 1) * np.log2(np.arange(1, fv.ENTROPY_WINDOW + 1))
_WINDOWS_AT_ONCE = 20_000


def _window_bits(windows: np.ndarray) -> np.ndarray:
    """Entropy in bits per character of each row, from the lengths of equal runs in the sorted row."""
    rows, width = windows.shape
    chars = np.sort(windows, axis=1)
    start = np.ones(chars.shape, dtype=bool)
    start[:, 1:] = chars[:, 1:] != chars[:, :-1]
    first = np.flatnonzero(start.ravel())
    run = np.diff(np.append(first, rows * width))
    weights = np.bincount(first // width, weights=_COUNT_WEIGHT[run], minlength=rows)
    return np.log2(width) - weights / width


def _max_bits(text: str | None) -> float | None:
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size, step = fv.ENTROPY_WINDOW, fv.ENTROPY_WINDOW // 2
    if len(codes) <= size:
        return float(_window_bits(codes[None, :])[0])
    count = -(-(len(codes) - size) // step)
    windows = np.lib.stride_tricks.sliding_window_view(codes, size)[::step][:count]
    return max(
        float(_window_bits(windows[i : i + _WINDOWS_AT_ONCE]).max()) for i in range(0, count, _WINDOWS_AT_ONCE)
    )


@F.pandas_udf(DoubleType())
def max_window_entropy(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Highest entropy of the 100-character windows starting every 50 characters; null for empty text.

    Windows start at 0, 50, ... below ``length - 100``, so the tail of a text is not looked at.
    """
    for batch in texts:
        yield pd.Series([_max_bits(t) for t in batch], dtype="float64")


def entropy_window_count(c: Column) -> Column:
    n = F.length(c)
    step = fv.ENTROPY_WINDOW // 2
    return F.when(n == 0, 0).when(n <= fv.ENTROPY_WINDOW, 1).otherwise(F.ceil((n - fv.ENTROPY_WINDOW) / step))


def high_entropy(c: Column, threshold: float = fv.ENTROPY_THRESHOLD) -> Column:
    return F.coalesce(max_window_entropy(c) > threshold, F.lit(False))
