"""Returns over several sessions, from daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions import measures as M
from marketpulse.operators.latest import as_of_date, last_bar
from marketpulse.operators.ranking import top_per_group


def _window_return(close, first_pre) -> Column:
    """Change of ``close`` over the first pre-close; a zero base counts as no move."""
    return F.when(first_pre == 0, F.lit(0.0)).otherwise(M.pct_change(close, first_pre))


def period_return(bars: DataFrame, end, n: int) -> DataFrame:
    """F8: return to a common end date, one row per code quoted on it.

    The end is the latest loaded date not after ``end``. The base is the first
    known pre-close within 2n calendar days before it. Only that range of date
    partitions is read, in one combining aggregate.
    """
    last_date = as_of_date(bars, end).scalar()
    in_range = bars.filter(
        (F.col("trade_date") <= last_date) & (F.col("trade_date") >= F.date_sub(last_date, 2 * n))
    )
    at_end = F.col("trade_date") == last_date
    return (
        in_range.groupBy("code")
        .agg(
            F.expr("min_by(pre_close, trade_date) FILTER (WHERE pre_close IS NOT NULL)").alias("base"),
            F.max(F.when(at_end, F.col("close"))).alias("close"),
            F.max(F.when(at_end, F.col("trade_date"))).alias("trade_date"),
        )
        .filter(F.col("trade_date").isNotNull())
        .select("code", "trade_date",
                _window_return(F.col("close"), F.col("base")).alias("change_ratio"), "close")
    )


def rolling_period_return(bars: DataFrame, n: int) -> DataFrame:
    """F8 for every date at once: each bar is the end of its own window.

    A code has one bar per session, so a window per code is bounded by the
    length of the calendar.
    """
    day = F.datediff("trade_date", F.lit("1970-01-01"))
    w = Window.partitionBy("code").orderBy(day).rangeBetween(-2 * n, 0)
    base = F.first_value("pre_close", ignoreNulls=F.lit(True)).over(w)
    return bars.select("code", "trade_date", "close", base.alias("base")).select(
        "code", "trade_date", _window_return(F.col("close"), F.col("base")).alias("change_ratio"), "close"
    )


def rolling_period_returns(bars: DataFrame, horizons: Sequence[int],
                           carry: Sequence[str] = ()) -> DataFrame:
    """F8 for every date and several horizons in one shuffle on code.

    Columns ``return_<n>d`` next to ``carry`` columns of the bars.
    """
    day = F.datediff("trade_date", F.lit("1970-01-01"))
    ordered = Window.partitionBy("code").orderBy(day)
    bases = [
        F.first_value("pre_close", ignoreNulls=F.lit(True)).over(ordered.rangeBetween(-2 * n, 0)).alias(f"__base_{n}")
        for n in horizons
    ]
    return bars.select("code", "trade_date", "close", *carry, *bases).select(
        "code", "trade_date", *carry,
        *[_window_return(F.col("close"), F.col(f"__base_{n}")).alias(f"return_{n}d") for n in horizons],
    )


def period_return_asof(bars: DataFrame, end, n: int) -> DataFrame:
    """like F8 but every code ends at its own latest bar in the window.

    The base is the pre-close of the first bar in the window; codes whose base
    is missing or zero, or whose last close is missing, drop out.
    """
    end = F.lit(end).cast("date")
    in_range = bars.filter((F.col("trade_date") <= end) & (F.col("trade_date") >= F.date_sub(end, 2 * n)))
    return (
        in_range.groupBy("code")
        .agg(
            F.min_by(F.struct("pre_close"), "trade_date").alias("a"),
            F.max_by(F.struct("close", "trade_date"), "trade_date").alias("z"),
        )
        .select("code", F.col("z.trade_date").alias("end_date"),
                M.pct_change("z.close", "a.pre_close").alias("change_ratio"))
        .filter(F.col("change_ratio").isNotNull())
    )


def horizon_stats(bars: DataFrame, date, horizons: Sequence[int]) -> DataFrame:
    """F9, F11, F12 and the first bar per code in one grouped pass over ``bars``.

    Columns: first_date (over all bars), the last bar's change_ratio and body as of
    ``date``, and ``return_<n>d`` for each horizon with the rules of ``period_return_asof``.
    """
    day, at = F.lit(date).cast("date"), F.col("trade_date")
    known = F.when(at <= day, at)
    aggs = [F.min(at).alias("first_date"), F.max_by(F.struct("change_ratio", "open", "close"), known).alias("last")]
    for n in horizons:
        inside = F.when((at <= day) & (at >= F.date_sub(day, 2 * n)), at)
        aggs += [F.min_by(F.struct("pre_close"), inside).alias(f"a{n}"), F.max_by(F.struct("close"), inside).alias(f"z{n}")]
    return bars.groupBy("code").agg(*aggs).select(
        "code", "first_date", F.col("last").isNotNull().alias("has_bar"), "last.change_ratio", M.pct_change("last.close", "last.open").alias("body"),
        *[M.pct_change(f"z{n}.close", f"a{n}.pre_close").alias(f"return_{n}d") for n in horizons])


def bar_return(bars: DataFrame, n: int, digits: int | None = 4, key: str = "code") -> DataFrame:
    """close of the last bar over the close n bars back, NULL when not enough."""
    tail = top_per_group(bars.select(key, "trade_date", "close"), [key], [F.col("trade_date").desc()], n + 1)
    value = M.pct_change(F.max(F.when(F.col("pos") == 1, F.col("close"))),
                         F.max(F.when(F.col("pos") == n + 1, F.col("close"))))
    return tail.groupBy(key).agg(M.rounded(value, digits).alias(f"return_{n}d"))


def daily_body(bars: DataFrame, date=None) -> DataFrame:
    """body of the latest bar per code; unknown opens or closes drop out."""
    return (
        last_bar(bars, date).select("code", M.pct_change("close", "open").alias("body"))
        .filter(F.col("body").isNotNull())
    )


def daily_change(bars: DataFrame, date=None) -> DataFrame:
    """change of the latest bar per code; unknown changes drop out."""
    return last_bar(bars, date).select("code", "change_ratio").filter(F.col("change_ratio").isNotNull())


def bar_summary(bars: DataFrame, n: int = 5) -> DataFrame:
    """F16: figures of the last n bars per code, with the last five as an array."""
    tail = top_per_group(bars.select("code", "trade_date", "close", "volume", "amount"),
                         ["code"], [F.col("trade_date").desc()], n)
    volume = F.coalesce("volume", F.lit(0.0))

    def at(pos, c):
        return F.max(F.when(F.col("pos") == pos, c))

    agg = tail.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.max_by("close", "pos").alias("first_close"),
        at(1, F.col("close")).alias("last_close"),
        at(2, F.col("close")).alias("prev_close"),
        at(1, volume).alias("last_volume"),
        F.avg(F.when(F.col("pos") > 1, volume)).alias("mean_volume"),
        F.max("close").alias("max_close"),
        F.min("close").alias("min_close"),
        at(1, F.col("amount")).alias("last_amount"),
        F.array_sort(F.collect_list(F.when(
            F.col("pos") <= 5, F.struct("trade_date", "close", "volume")))).alias("last_bars"),
    )
    base_volume = F.coalesce("mean_volume", "last_volume")
    return agg.select(
        "code", "n_bars",
        F.coalesce(M.pct_change("last_close", "first_close"), F.lit(0.0)).alias("total_change"),
        F.when(F.col("n_bars") >= 2, F.coalesce(M.pct_change("last_close", "prev_close"), F.lit(0.0)))
        .otherwise(0.0).alias("last_change"),
        F.coalesce(F.try_divide("last_volume", base_volume), F.lit(1.0)).alias("volume_ratio"),
        F.coalesce(M.pct_change("max_close", "min_close"), F.lit(0.0)).alias("amplitude"),
        "last_close", "last_amount", "last_bars",
    )
