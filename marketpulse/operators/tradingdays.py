"""Trading-calendar queries over columns of dates.

Calendars hold one row per day. They are spread into a dense day table (days
times a century is under 40,000 rows), so every lookup is an equi-join on the
date and never a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_from_bars(bars: DataFrame) -> DataFrame:
    """Trading days are the dates that have bars."""
    return bars.select("trade_date").distinct()


def trading_days(calendar: DataFrame, start=None, end=None, year: int | None = None) -> DataFrame:
    """L1: trading days within bounds, or of one year."""
    if year:
        start, end = f"{year:04d}-01-01", f"{year:04d}-12-31"
    if start is not None:
        calendar = calendar.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        calendar = calendar.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return calendar.select("trade_date").distinct().orderBy("trade_date")


def _day_table(calendar: DataFrame) -> DataFrame:
    """Every calendar day in range with ``latest`` and ``next`` trading day."""
    days = calendar.select("trade_date").distinct()
    bounds = days.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    dense = bounds.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi")).alias("d"), F.lit(1).alias("k"))
    marked = dense.join(days.select(F.col("trade_date").alias("d"), F.col("trade_date").alias("t")), "d", "left")
    order = Window.partitionBy("k").orderBy("d")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    return marked.select(
        "d", F.col("t").isNotNull().alias("is_td"),
        F.last("t", ignorenulls=True).over(back).alias("latest"),
        F.first("t", ignorenulls=True).over(ahead).alias("next"),
    )


def _first_weekday(d):
    """First Monday-to-Friday on or after a date."""
    w = F.weekday(d)
    return F.date_add(d, F.when(w == 5, 2).when(w == 6, 1).otherwise(0))


def _look_up(dates: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    table = _day_table(calendar)
    low, high = table.select(F.min("d")).scalar(), table.select(F.max("d")).scalar()
    return dates.join(F.broadcast(table.withColumnRenamed("d", column)), column, "left").withColumn(
        "__lo", low).withColumn("__hi", high)


_WORK = ("is_td", "latest", "next", "__lo", "__hi")


def is_trading_day(dates: DataFrame, calendar: DataFrame, column: str = "d") -> DataFrame:
    """L2: in the calendar; inside its range other days are not trading days,
    outside it Monday to Friday are."""
    found = _look_up(dates, calendar, column)
    outside = F.weekday(F.col(column)) < 5
    return found.withColumn("is_trading_day", F.coalesce("is_td", outside)).drop(*_WORK)


def latest_trading_day(dates: DataFrame, calendar: DataFrame, column: str = "d") -> DataFrame:
    """L3: latest trading day on or before each date, NULL before the first."""
    found = _look_up(dates, calendar, column)
    beyond = F.when(F.col(column) > F.col("__hi"), F.col("__hi"))
    return found.withColumn("latest_trading_day", F.coalesce("latest", beyond)).drop(*_WORK)


def next_trading_day(dates: DataFrame, calendar: DataFrame, column: str = "d") -> DataFrame:
    """L4: next trading day on or after each date; past the calendar's end the
    first weekday (always found within the search limit)."""
    found = _look_up(dates, calendar, column)
    d = F.col(column)
    outside = (
        F.when(d < F.col("__lo"), F.col("__lo"))
        .otherwise(_first_weekday(d))
    )
    return found.withColumn("next_trading_day", F.coalesce("next", outside)).drop(*_WORK)


def missing_dates(calendar: DataFrame, bars: DataFrame, until) -> DataFrame:
    """C14: trading days after the latest loaded date, up to ``until``, without bars.

    Days past the calendar's end count when they are weekdays.
    """
    loaded = bars.select("trade_date").distinct()
    bounds = loaded.agg(F.date_add(F.max("trade_date"), 1).alias("lo")).withColumn("hi", F.lit(until).cast("date"))
    wanted = bounds.filter(F.col("lo") <= F.col("hi")).select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return missing_among(wanted, calendar, bars)


def missing_among(dates: DataFrame, calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """C14: the listed dates that are trading days and have no bars."""
    loaded = bars.select(F.col("trade_date").alias("d")).distinct()
    return (
        is_trading_day(dates, calendar).filter(F.col("is_trading_day")).select("d")
        .join(loaded, "d", "left_anti").withColumnRenamed("d", "trade_date")
    )
