"""Latest-snapshot and as-of selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scalar_max(df: DataFrame, column: str) -> Column:
    return df.select(F.max(column)).scalar()


def latest_by(df: DataFrame, keys: Sequence[str], order: str = "as_of") -> DataFrame:
    """Rows of the latest ``order`` value per key; no keys means globally.

    The newest date per key comes from a combining aggregate and joins back,
    which keeps every row of that date and never gathers one key's history.
    """
    if not keys:
        return df.filter(F.col(order) == _scalar_max(df, order))
    newest = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(newest, [*keys, order], "left_semi")


def snapshot(df: DataFrame, date, order: str = "as_of") -> DataFrame:
    """Rows of one explicit snapshot date."""
    return df.filter(F.col(order) == F.lit(date).cast("date"))


def as_of_date(bars: DataFrame, date=None) -> DataFrame:
    """One row ``trade_date``: the latest loaded date, not after ``date``."""
    if date is not None:
        bars = bars.filter(F.col("trade_date") <= F.lit(date).cast("date"))
    return bars.agg(F.max("trade_date").alias("trade_date"))


def previous_dates(bars: DataFrame) -> DataFrame:
    """Each loaded trading date with the strictly previous one.

    One row per calendar day, so the unpartitioned order below is bounded by
    the length of the calendar.
    """
    days = bars.select("trade_date").distinct()
    later = days.select(F.col("trade_date").alias("prev_date"), F.lit(1).alias("k"))
    w = Window.partitionBy("k").orderBy("prev_date")
    return (
        later.withColumn("trade_date", F.lead("prev_date").over(w))
        .filter(F.col("trade_date").isNotNull())
        .select("trade_date", "prev_date")
    )


def prev_volume(bars: DataFrame, date=None) -> DataFrame:
    """Positive volumes of the strictly previous trading date.

    With ``date`` only that day is answered: ``(code, prev_volume)``. Without
    it every trading date gets its own previous day:
    ``(trade_date, code, prev_volume)``.
    """
    positive = bars.filter(F.col("volume") > 0)
    if date is not None:
        before = bars.filter(F.col("trade_date") < F.lit(date).cast("date"))
        return positive.filter(F.col("trade_date") == _scalar_max(before, "trade_date")).select(
            "code", F.col("volume").alias("prev_volume")
        )
    return positive.select(
        F.col("trade_date").alias("prev_date"), "code", F.col("volume").alias("prev_volume")
    ).join(F.broadcast(previous_dates(bars)), "prev_date").select("trade_date", "code", "prev_volume")


def last_bar(bars: DataFrame, date=None) -> DataFrame:
    """Latest bar per code, not after ``date``, however old."""
    if date is not None:
        bars = bars.filter(F.col("trade_date") <= F.lit(date).cast("date"))
    rest = [c for c in bars.columns if c != "code"]
    return bars.groupBy("code").agg(F.max_by(F.struct(*rest), "trade_date").alias("bar")).select("code", "bar.*")


def time_axis(ticks: DataFrame) -> DataFrame:
    """Distinct tick minutes of each session, both phases."""
    return ticks.select("trade_date", "hhmm").distinct()


def axis_bounds(ticks: DataFrame) -> DataFrame:
    """First and latest tick minute of each session (one row per date)."""
    return ticks.groupBy("trade_date").agg(
        F.min("hhmm").alias("first_time"), F.max("hhmm").alias("latest_time")
    )


def resolve_snapshot(ticks: DataFrame, at: str | None = None) -> DataFrame:
    """Effective snapshot minute per session.

    No time, ``"latest"`` or a time before the session's first tick all mean
    the latest minute.
    """
    wanted = F.lit(None if at in (None, "", "latest") else at).cast("string")
    usable = wanted.isNotNull() & (wanted >= F.col("first_time"))
    return axis_bounds(ticks).withColumn(
        "snapshot_time", F.when(usable, wanted).otherwise(F.col("latest_time"))
    )


def names(members: DataFrame) -> DataFrame:
    """One display name per code from the globally latest snapshot.

    Several spellings of one code resolve to the one of its lowest group id.
    """
    return latest_by(members, []).groupBy("code").agg(F.min_by("name", "group_id").alias("name"))


def with_member_names(df: DataFrame, members: DataFrame, default: str | None = "") -> DataFrame:
    """Attach names; the fallback is a text or, with None, the code itself."""
    fallback = F.col("code") if default is None else F.lit(default)
    return df.join(names(members), "code", "left").withColumn("name", F.coalesce("name", fallback))


def available_dates(strength: DataFrame, column: str = "trade_date") -> DataFrame:
    """Stored result dates, newest first."""
    return strength.select(column).distinct().orderBy(F.col(column).desc())
