"""Portfolio exposure to groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT_RANK = 10
LEADERS = 5


def portfolio_exposure(holdings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cost value and number of holdings per group.

    ``mapping`` is any (code, group_id) membership, so the caller decides
    between the instrument mapping and the group members.
    """
    pairs = mapping.select("code", "group_id").distinct()
    value = F.coalesce("shares", F.lit(0.0)) * F.coalesce("cost_price", F.lit(0.0))
    return (
        holdings.withColumn("__value", value).join(pairs, "code").groupBy("group_id")
        .agg(F.sum("__value").alias("exposure_weight"), F.count(F.lit(1)).alias("holding_count"))
    )


def exposed_holdings(holdings: DataFrame, mapping: DataFrame) -> DataFrame:
    """G17 detail: (group_id, code) of every mapped holding."""
    return holdings.select("code").distinct().join(mapping.select("code", "group_id").distinct(), "code").select(
        "group_id", "code")


def dominant_group(exposure: DataFrame) -> DataFrame:
    """K5: the group with the greatest exposure."""
    return exposure.orderBy(F.col("exposure_weight").desc(), "group_id").limit(1)


def alert_groups(exposure: DataFrame, ranked: DataFrame, max_rank: int = ALERT_RANK) -> DataFrame:
    """K6: leading groups (rank up to ``max_rank``) the portfolio is exposed to."""
    return ranked.filter(F.col("rank_1d") <= max_rank).join(exposure, "group_id")


def leading_groups(ranked: DataFrame, n: int = LEADERS) -> DataFrame:
    """K6/I8: the first ``n`` of the leading groups of each date."""
    return ranked.filter((F.col("rank_1d") <= ALERT_RANK) & (F.col("pos") <= n))
