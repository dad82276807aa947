"""Column functions on times given as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(seconds: Column) -> Column:
    """True if the time is a finite number of at least zero."""
    return F.coalesce(seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < F.lit(9e12)), F.lit(False))


def finite(seconds: Column) -> Column:
    """True if the time is neither null nor NaN nor infinite."""
    return F.coalesce(seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e12)), F.lit(False))


def millis(seconds: Column) -> Column:
    """Whole milliseconds; null where the time is not finite."""
    return F.when(finite(seconds), F.round(seconds * 1000).cast("bigint"))
