"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column | str, digits: int) -> Column:
    """Round half away from zero on the binary value (``x * 10^d`` rounded,
    divided back), as most SQL engines do. Python's ``round`` goes to even on an
    exact tie (1/64 at 5 digits: 0.01562 there, 0.01563 here). Spark's ``round`` rounds the shortest decimal text instead, which differs
    on values such as 47.0595625 whose binary value lies just below the tie."""
    x = F.col(x) if isinstance(x, str) else x
    p = float(10 ** digits)
    y = x.cast("double") * F.lit(p)
    # signum keeps the sign of values that round to zero (-0.0, as Python does)
    r = F.signum(y) * F.floor(F.abs(y) + 0.5).cast("double")
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) > 4.5e15), x.cast("double")).otherwise(
        r / F.lit(p))
