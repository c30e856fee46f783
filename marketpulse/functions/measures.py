"""Arithmetic on prices and changes. Missing or zero bases never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column (NaN > 0 is true in Spark)."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, floats) else F.col(f.name)
        for f in df.schema.fields
    ])


def pct_change(last, base) -> Column:
    """(last / base - 1) * 100, NULL where the base is missing or zero."""
    return (F.try_divide(_col(last), _col(base)) - 1) * 100


def body_pct(open_, last) -> Column:
    """move since the open; 0 when either price is missing or open is 0."""
    open_, last = _col(open_), _col(last)
    return F.coalesce(F.try_divide(last - open_, open_) * 100, F.lit(0.0))


def step_pct(prev, cur) -> Column:
    """Move between two neighbouring points; 0 unless prev > 0 and cur is known."""
    prev, cur = _col(prev), _col(cur)
    return F.when((prev > 0) & cur.isNotNull(), F.try_divide(cur - prev, prev) * 100).otherwise(0.0)


def speed(tail) -> Column:
    """move between the last two valid (known, positive) prices of a tail array."""
    valid = F.filter(_col(tail), lambda p: p.isNotNull() & (p > 0))
    prev, cur = F.try_element_at(valid, F.lit(-2)), F.try_element_at(valid, F.lit(-1))
    return F.coalesce(F.try_divide(cur - prev, prev) * 100, F.lit(0.0))


def acceleration(tail) -> Column:
    """last step minus the step before it, on at most three trailing prices.

    The first step of a series is 0, so with two points this equals the speed.
    """
    tail = _col(tail)
    n = F.size(tail)
    p1, p2, p3 = (F.try_element_at(tail, F.lit(-i)) for i in (1, 2, 3))
    before = F.when(n >= 3, step_pct(p3, p2)).otherwise(0.0)
    return F.when(n >= 2, step_pct(p2, p1) - before).otherwise(0.0)


def return_band(change) -> Column:
    """Magnitude band of a return."""
    change = F.coalesce(_col(change), F.lit(0.0))
    return (
        F.when(change >= 9.8, "limit")
        .when(change >= 5.0, "strong")
        .when(change > 0, "up")
        .when(change < 0, "down")
        .otherwise("flat")
    )


def direction(change) -> Column:
    """Sign class of a change used for display: up, down or empty."""
    change = _col(change)
    return F.when(change > 0, "up").when(change < 0, "down").otherwise("")


def acceleration_mark(value) -> Column:
    """Acceleration marker with a dead band of +-0.01."""
    value = _col(value)
    return F.when(value > 0.01, "rising").when(value < -0.01, "falling").otherwise("steady")


def score_shade(score, section) -> Column:
    """Intensity (2 strong .. 0 weak) of a group score in its section."""
    score = F.when(_col(section) == "top", _col(score)).otherwise(-_col(score))
    return F.when(score >= 2, 2).when(score >= 1, 1).otherwise(0)


def rounded(value, digits: int | None) -> Column:
    """Half-even rounding, or the value itself when no precision is asked for."""
    value = _col(value)
    return value if digits is None else F.bround(value, digits)
