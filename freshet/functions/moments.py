"""Aggregates that stay null, instead of stopping the job, where a spread or sum is zero."""

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null for a constant series (the built-in divides by zero there)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def running_total(value: Column | str, so_far: WindowSpec) -> Column:
    """Sum so far that is null from the first null on, as an unfilled gap leaves it unknown.

    so_far is a window from the start of a series to the current row.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count_if(value.isNull()).over(so_far) == 0, F.sum(value).over(so_far))
