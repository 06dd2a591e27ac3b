"""Exact order statistics of a distributed column.

``percentile`` keeps every distinct value of its group in one task. Here the
value is bracketed with ``percentile_approx`` (a fixed-size sketch per task), the
rows around the bracket are counted exactly, and the bracket narrows until few
rows are left. Each round is one aggregate; only a handful of numbers reach the
driver. Whatever the sketch returns, the counts decide, so the result is exact.

The input is read once per round: pass a stored or checkpointed table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that may be left for the final sort.
SMALL = 100_000
_ACCURACY = 10_000


def _stored_around(inside: DataFrame, low, high) -> tuple:
    """The nearest stored values at or outside the given bounds."""
    v = F.col("v")
    row = inside.agg(
        F.max(F.when(v <= F.lit(low), v)).alias("low"),
        F.min(F.when(v >= F.lit(high), v)).alias("high"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
    ).first()
    return (
        row["least"] if row["low"] is None else row["low"],
        row["greatest"] if row["high"] is None else row["high"],
    )


def kth_smallest(df: DataFrame, column: str, k: int, small: int = SMALL):
    """The k-th smallest non-null value (from 1)."""
    inside = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    v = F.col("v")
    n = inside.count()
    # The sketch works in doubles: only these types come back as they are stored.
    exact_sketch = isinstance(
        inside.schema["v"].dataType, (T.DoubleType, T.FloatType, T.IntegerType)
    )
    if not 1 <= k <= n:
        raise ValueError(f"rank {k} outside 1..{n}")
    while n > small:
        at, slack = k / n, 2.0 / _ACCURACY
        cuts = [max(0.0, at - slack), min(1.0, at + slack)]
        low, high = inside.agg(F.percentile_approx("v", cuts, _ACCURACY)).first()[0]
        if not exact_sketch:
            low, high = _stored_around(inside, low, high)
        low_, high_ = F.lit(low), F.lit(high)
        seen = inside.agg(
            F.count_if(v < low_).alias("under"),
            F.count_if(v == low_).alias("at_low"),
            F.count_if((v > low_) & (v < high_)).alias("between"),
            F.count_if((v == high_) & (high_ > low_)).alias("at_high"),
        ).first()
        under, upto_low = seen["under"], seen["under"] + seen["at_low"]
        upto_between = upto_low + seen["between"]
        upto_high = upto_between + seen["at_high"]
        if k <= under:
            inside, n = inside.where(v < low_), under
        elif k <= upto_low:
            return low
        elif k <= upto_between:
            inside, n, k = inside.where((v > low_) & (v < high_)), seen["between"], k - upto_low
        elif k <= upto_high:
            return high
        else:
            inside, n, k = inside.where(v > high_), n - upto_high, k - upto_high
    return inside.orderBy("v").offset(k - 1).limit(1).first()["v"]


def exact_quantile(
    df: DataFrame, column: str, q: float, small: int = SMALL
) -> float | None:
    """Quantile with linear interpolation between neighbouring ranks."""
    n = df.where(F.col(column).isNotNull()).count()
    if n == 0:
        return None
    position = q * (n - 1)
    k = math.floor(position) + 1
    fraction = position - math.floor(position)
    value = kth_smallest(df, column, k, small)
    if fraction == 0:
        return float(value)
    here = F.lit(value)
    step = df.agg(
        F.count_if(F.col(column) <= here).alias("upto"),
        F.min(F.when(F.col(column) > here, F.col(column))).alias("above"),
    ).first()
    following = value if step["upto"] > k else step["above"]
    return float(value) + (float(following) - float(value)) * fraction
