"""Group candidate lists (M6, M7) and the rotation table (M8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators import returns as T
from marketpulse.operators import rotation as O
from marketpulse.operators import scopes as Z
from marketpulse.operators.latest import as_of_date
from marketpulse.operators.ranking import ordered_positions
from marketpulse.staging import stage


def _frame(groups: DataFrame, members: DataFrame, watched: DataFrame) -> DataFrame:
    """Observed groups of eligible size with name, level, size and selected state."""
    marked = watched.select("group_id").distinct().withColumn("watched", F.lit(True))
    return (
        Z.monitorable(members).withColumnRenamed("member_count", "size")
        .join(Z.observe_groups(groups).select("group_id", "group_name"), "group_id")
        .join(marked, "group_id", "left").na.fill(False, ["watched"])
        .withColumn("level", C.group_level())
    )


def candidates(bars: DataFrame, members: DataFrame, groups: DataFrame, watched: DataFrame,
               date=None, digits: int | None = 4) -> DataFrame:
    """M6: candidate groups with 1d/3d/5d returns and body from the bars, in order (``pos``).

    The bars are read once, by a grouped pass over all horizons; the few latest trading
    dates come from the date column alone. Recent listings (C8) do not count in the 3d and
    5d returns. Groups are ordered by change, unknown ones last.
    """
    if date is None:
        date = as_of_date(bars).first()[0]
    recent = [r[0] for r in bars.filter(F.col("trade_date") <= F.lit(date).cast("date")).select("trade_date").distinct()
              .orderBy(F.col("trade_date").desc()).limit(Z.LISTING_DAYS).collect()]
    old = F.col("first_date") <= F.lit(min(recent)) if len(recent) >= Z.LISTING_DAYS else F.lit(True)
    frame = stage(_frame(groups, members, watched), "candidates")
    scope = Z.keep_groups(Z.current_members(members), frame).select("group_id", "code")
    stats = T.horizon_stats(bars, date, (3, 5)).filter("has_bar")
    figures = (
        stats.join(scope, "code").groupBy("group_id")
        .agg(F.avg("change_ratio").alias("change_ratio"), F.count("change_ratio").alias("quoted"), F.avg("body").alias("body"),
             *[F.avg(F.when(old, F.col(f"return_{n}d"))).alias(f"return_{n}d") for n in (3, 5)])
    )
    quoted = F.col("quoted") > 0
    joined = frame.join(figures, "group_id", "left").select(
        "group_id", "group_name", "level", M.rounded("change_ratio", digits).alias("change_ratio"),
        M.rounded(F.when(quoted, F.col("body")), digits).alias("body"), M.rounded("return_3d", digits).alias("return_3d"),
        M.rounded("return_5d", digits).alias("return_5d"),
        F.coalesce(F.when(quoted, F.col("quoted")), "size").alias("member_count"), "watched",
    )
    return ordered_positions(joined, "change_ratio", tie=["group_id"])


def quoted_candidates(quotes: DataFrame, index_bars: DataFrame, members: DataFrame, groups: DataFrame,
                      watched: DataFrame, digits: int | None = 4) -> DataFrame:
    """M7: candidate groups from live index quotes (A5), with the index history
    (A12, code = group id) for 3d/5d returns and for missing live values.

    A group without a live change takes change, and if needed body, from its
    last history bar. Groups are ordered by change (``pos``), unknown ones last.
    """
    frame = _frame(groups, members, watched)
    index_bars = stage(index_bars.select("code", "trade_date", "open", "close", "change_ratio"), "index_bars")

    def q(name):
        return F.try_element_at("quote", F.lit(name))

    live = quotes.select(
        F.col("code").alias("group_id"), q("changeRatio").alias("live_change"),
        M.pct_change(q("latest"), q("open")).alias("live_body"),
        q("riseCount").cast("long").alias("rise_count"), q("fallCount").cast("long").alias("fall_count"),
        q("upLimitCount").cast("long").alias("limit_up_count"))
    last = T.last_bar(index_bars).select(
        F.col("code").alias("group_id"), F.col("change_ratio").alias("hist_change"),
        M.pct_change("close", "open").alias("hist_body"))
    joined = frame.join(live, "group_id", "left").join(last, "group_id", "left")
    for n in (3, 5):
        joined = joined.join(
            T.bar_return(index_bars, n, digits).withColumnRenamed("code", "group_id"), "group_id", "left")
    from_history = F.col("live_change").isNull()
    body = F.coalesce("live_body", F.when(from_history & F.col("hist_change").isNotNull(), F.col("hist_body")))
    shown = joined.select(
        "group_id", "group_name", "level",
        M.rounded(F.coalesce("live_change", "hist_change"), digits).alias("change_ratio"),
        M.rounded(body, digits).alias("body"), "rise_count", "fall_count", "limit_up_count",
        "return_3d", "return_5d", F.col("size").alias("member_count"), "watched",
    )
    return ordered_positions(shown, "change_ratio", tie=["group_id"])


@dataclass
class RotationTable:
    groups: DataFrame
    leaders: DataFrame
    bench: DataFrame


def rotation_table(bars: DataFrame, custom: DataFrame, index_bars: DataFrame, n: int = O.BARS) -> RotationTable:
    """M8: user groups over the last n bars against the benchmark, with leaders."""
    custom = stage(custom.select("group_id", "group_name", "code").distinct(), "scope")
    groups = custom.select("group_id", "group_name").distinct()
    valid = stage(O.valid_summaries(bars, n), "bar_summaries")
    bench = stage(O.benchmark(index_bars, n), "benchmark")
    return RotationTable(
        O.rotation_stats(valid, custom, groups, bench), O.rotation_leaders(valid, custom, groups), bench)
