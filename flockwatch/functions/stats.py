"""Share and z-score expressions (ops 18-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share_of_total(value, total) -> Column:
    """Op 18: value / total; 0 when the value is missing or the total unknown.

    A zero total gives IEEE infinity (NaN for 0/0) as JVM double division does,
    instead of Spark's ANSI division error.
    """
    v, t = _col(value), _col(total)
    return (F.when(v.isNull() | t.isNull(), F.lit(0.0))
             .when(t == 0, v.cast("double") * F.lit(float("inf")))
             .otherwise(v / t))


def guarded_z(n, total, mean, sd) -> Column:
    """Op 19: (n/total - mean) / sd when total > 0 and sd > 0, else 0."""
    n, total, mean, sd = _col(n), _col(total), _col(mean), _col(sd)
    return F.when((total > 0) & (sd > 0), (n / total - mean) / sd).otherwise(F.lit(0.0))
