"""Dates written as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from casequarry import fixed_values as fv
from casequarry.functions.text import SPACE, strip


_SHAPES = {"yyyy": "(?!0000)[0-9]{4}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", ".": r"\."}


def _shape(pattern: str) -> str:
    """Regular expression for the digits a date format asks for."""
    digits = re.sub(r"yyyy|M|d|\.", lambda m: _SHAPES[m.group()], pattern)
    return rf"(?U)\A{SPACE}*{digits}{SPACE}*\z"


def parse_date(c: Column) -> Column:
    """First of the accepted formats that fits; a month alone is its first day; null when none fits.

    The shape decides which format is read, so at most one is.
    """
    parsed = F.lit(None).cast("date")
    for pattern in reversed(fv.DATE_PATTERNS):
        parsed = F.when(c.rlike(_shape(pattern)), F.try_to_date(strip(c), pattern)).otherwise(parsed)
    return parsed


def months_before(ref: Column, months: Column) -> Column:
    """Calendar months back, the day clamped to the end of the month."""
    return F.add_months(ref, -months)
