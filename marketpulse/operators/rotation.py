"""Group rotation against a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.operators.ranking import top_per_group
from marketpulse.operators.returns import bar_summary
from marketpulse.operators.scopes import rotation_groups

# Bars looked at, tolerance band in points, leaders shown, labels.
BARS, BAND, LEADERS = 5, 1.0, 3
STRONGER, WEAKER, IN_LINE = "强于大盘", "弱于大盘", "同步"


def benchmark(index_bars: DataFrame, n: int = BARS) -> DataFrame:
    """Mean total and last change over the index series (one row)."""
    return bar_summary(index_bars, n).agg(
        F.coalesce(F.avg("total_change"), F.lit(0.0)).alias("bench_total"),
        F.coalesce(F.avg("last_change"), F.lit(0.0)).alias("bench_last"),
    )


def relative_label(change, bench, band: float = BAND) -> Column:
    """Stronger or weaker than the benchmark by more than the band, else in line."""
    change = F.col(change) if isinstance(change, str) else change
    bench = F.col(bench) if isinstance(bench, str) else bench
    return F.when(change > bench + band, STRONGER).when(change < bench - band, WEAKER).otherwise(IN_LINE)


def valid_summaries(bars: DataFrame, n: int = BARS) -> DataFrame:
    """Figures of the last n bars of every instrument with at least two."""
    return bar_summary(bars, n).filter(F.col("n_bars") >= 2).select(
        "code", "total_change", "last_change", "volume_ratio")


def rotation_stats(valid: DataFrame, members: DataFrame, groups: DataFrame, bench: DataFrame) -> DataFrame:
    """Group means over the last n bars of each member, versus the benchmark.

    ``valid`` are the ``valid_summaries`` and ``bench`` the ``benchmark``.
    Members with fewer than two bars are skipped; groups left without members
    are absent.
    """
    eligible = rotation_groups(members, groups)
    pairs = members.select("group_id", "code").distinct().join(eligible, "group_id")
    return (
        valid.join(pairs, "code").groupBy("group_id", "group_name", "member_count")
        .agg(
            F.count(F.lit(1)).alias("valid_count"),
            F.count_if(F.col("last_change") > 0).alias("up_count"),
            F.avg("total_change").alias("avg_total"),
            F.avg("last_change").alias("avg_last"),
            F.avg("volume_ratio").alias("volume_ratio"),
        )
        .withColumn("up_pct", F.col("up_count") / F.col("valid_count") * 100)
        .withColumn("vs_index", relative_label("avg_total", bench.select("bench_total").scalar()))
    )


def rotation_leaders(valid: DataFrame, members: DataFrame, groups: DataFrame,
                     leaders: int = LEADERS) -> DataFrame:
    """Members with the greatest last change in every rotation group."""
    eligible = rotation_groups(members, groups).select("group_id")
    pairs = members.select("group_id", "code").distinct().join(eligible, "group_id", "left_semi")
    return top_per_group(valid.select("code", "last_change").join(pairs, "code"), ["group_id"],
                         [F.col("last_change").desc(), F.col("code").asc()], leaders)
