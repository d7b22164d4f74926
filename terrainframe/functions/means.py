"""Means that don't hang on the order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits after the point that values are taken at.
SCALE = 10**6


def exact_mean(value: Column | str, scale: int = SCALE) -> Column:
    """The mean of values taken at a whole multiple of 1 / ``scale``: whole numbers are summed and divided once. Null without values."""
    value = F.col(value) if isinstance(value, str) else value
    total = F.sum(F.round(value * float(scale)).cast("decimal(28,0)")).cast("double")
    return F.try_divide(total, F.count(value) * float(scale))


def exact_mean_sql(value: str, scale: int = SCALE) -> str:
    """The same in SQL."""
    return f"CAST(sum(CAST(round({value} * {float(scale)}) AS DECIMAL(28, 0))) AS DOUBLE) / ({float(scale)} * nullif(count({value}), 0))"
