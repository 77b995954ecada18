"""Exact means, shares and output types.

Money is summed as DECIMAL, so totals do not depend on the order of rows. Sums
are wider than a single price so that they do not overflow on large tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
MONEY_TOTAL = T.DecimalType(20, 2)
GROWTH = T.DecimalType(12, 1)
SHARE = T.DecimalType(10, 2)


def mean(total: Column, count: Column) -> Column:
    """total / count as DOUBLE, NULL for an empty group."""
    return total.cast("double") / F.nullif(count.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as DOUBLE, NULL when the whole is zero."""
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))

