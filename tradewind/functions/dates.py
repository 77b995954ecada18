"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(moment: Column) -> Column:
    return F.year(moment) * 12 + F.month(moment)


def month_boundaries(start: Column, end: Column) -> Column:
    """Month boundaries crossed between two moments (31 Jan to 1 Feb is 1)."""
    return month_number(end) - month_number(start)


def in_range(moment: Column, start: str | None, end: str | None) -> Column:
    """start <= moment < end. Bounds stay bare literals so the scan can prune on them."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (moment >= F.lit(start))
    if end is not None:
        condition = condition & (moment < F.lit(end))
    return condition
