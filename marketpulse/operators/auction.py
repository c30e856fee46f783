"""Opening-auction factors, scores and group aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators import ranking as R
from marketpulse.schemas import PRE_MARKET
from marketpulse.staging import stage

# Factor weights, thresholds, base minute of the trend, list sizes.
AUCTION_WEIGHTS = {"gap_pct": 0.35, "vol_ratio": 0.30, "order_imbalance": 0.20, "trend_score": 0.15}
GAP_MIN = 2.0
VOL_RATIO_MIN = 2.0
LIMIT_GAP = 9.8
TREND_BASE = "09:20"
TOP_STOCKS, TOP_GROUPS, TOP_MEMBERS = 30, 20, 10

BY_DATE = ("trade_date",)


def auction_factors(ticks: DataFrame, prev_volume: DataFrame, at: str | None = None,
                    trend_base: str = TREND_BASE) -> DataFrame:
    """F18a-e: gap, volume ratio, order imbalance and trend per instrument.

    Eligible: two or more auction points in the session, a usable pre-close
    (its first point) and at least one point up to ``at``. One combining
    aggregate over the auction points; ``prev_volume`` is ``(trade_date, code,
    prev_volume)``, unknown volumes give a ratio of 0.
    """
    when = F.struct("hhmm", "seq")
    usable = F.lit(True) if at is None else F.col("hhmm") <= at
    based = usable & (F.col("hhmm") <= trend_base)
    point = F.struct("price", "matched_vol", "unmatched_buy", "unmatched_sell")
    per_code = (
        ticks.filter(F.col("phase") == PRE_MARKET).groupBy("trade_date", "code")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min_by("price", "seq").alias("pre_close"),
            F.max_by(F.when(usable, point), F.when(usable, when)).alias("p"),
            F.max_by(F.when(based, F.col("price")), F.when(based, when)).alias("base"),
        )
        .filter((F.col("n_points") >= 2) & (F.col("pre_close") != 0) & F.col("p").isNotNull())
    )
    buy = F.coalesce("p.unmatched_buy", F.lit(0.0))
    sell = F.coalesce("p.unmatched_sell", F.lit(0.0))
    ratio = F.try_divide(F.coalesce("p.matched_vol", F.lit(0.0)), F.col("prev_volume"))
    return per_code.join(prev_volume, ["trade_date", "code"], "left").select(
        "trade_date", "code",
        M.pct_change("p.price", "pre_close").alias("gap_pct"),
        F.when(F.col("prev_volume") > 0, ratio).otherwise(0.0).alias("vol_ratio"),
        F.when(buy + sell > 0, F.try_divide(buy - sell, buy + sell)).otherwise(0.0).alias("order_imbalance"),
        F.when(F.col("base") > 0, M.pct_change("p.price", "base")).otherwise(0.0).alias("trend_score"),
    )


def auction_score(factors: DataFrame, weights: dict[str, float] | None = None,
                  by: Sequence[str] = BY_DATE) -> DataFrame:
    """H5: weighted z-scores over the whole pool of a session, which has no size bound."""
    weights = weights or AUCTION_WEIGHTS
    return R.standardise(factors, list(weights), by).withColumn("score", R.weighted(weights))


def auction_groups(scored: DataFrame, members: DataFrame, groups: DataFrame,
                   by: Sequence[str] = BY_DATE, gap_min: float = GAP_MIN) -> DataFrame:
    """Mean gap, exact median volume ratio, mean imbalance, share of strong
    gaps and mean score per group, with the ZT flag."""
    keys = [*by, "group_id"]
    joined = stage(scored.join(members.select("group_id", "code").distinct(), "code").select(
        *keys, "gap_pct", "vol_ratio", "order_imbalance", "score"), "auction_members")
    means = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("member_count"),
        F.avg("gap_pct").alias("sector_gap"),
        F.avg("order_imbalance").alias("sector_imbalance"),
        F.avg((F.col("gap_pct") >= gap_min).cast("int")).alias("coherency"),
        F.avg("score").alias("score"),
    )
    medians = R.exact_median(joined.select(*keys, "vol_ratio"), "vol_ratio", keys, out="sector_vol_ratio")
    return (
        means.join(medians, keys)
        .join(groups.select("group_id", "group_name"), "group_id", "left")
        .withColumn("group_name", F.coalesce("group_name", "group_id"))
        .withColumn("is_zt", C.is_zt())
    )


def auction_stats(factors: DataFrame, by: Sequence[str] = BY_DATE) -> DataFrame:
    """Counts of the auction pool per session."""
    gap = F.col("gap_pct")
    return factors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("stock_count"),
        F.avg(gap).alias("avg_gap"),
        F.count_if(gap > 0).alias("up_count"),
        F.count_if(gap < 0).alias("down_count"),
        F.count_if(gap >= GAP_MIN).alias("strong_gap_count"),
        F.count_if(gap >= LIMIT_GAP).alias("limit_up_count"),
        F.count_if(F.col("vol_ratio") >= VOL_RATIO_MIN).alias("explode_count"),
    )


def auction_top_stocks(scored: DataFrame, n: int = TOP_STOCKS, by: Sequence[str] = BY_DATE) -> DataFrame:
    """Strongest instruments of each session."""
    return R.top_per_group(scored, by, [R.steady("score").desc(), F.col("code").asc()], n)


def auction_group_lists(grouped: DataFrame, top: int = TOP_GROUPS, by: Sequence[str] = BY_DATE) -> DataFrame:
    """The strongest ``top`` ordinary groups and all ZT groups, as sections.

    Ordered by the score at four digits, so groups of the same members tie.
    """
    lane = R.Window.partitionBy(*by, "is_zt").orderBy(M.rounded("score", 4).desc(), F.col("group_id").asc())
    return (
        grouped.withColumn("pos", F.row_number().over(lane))
        .filter(F.col("is_zt") | (F.col("pos") <= top))
        .withColumn("section", F.when(F.col("is_zt"), "zt").otherwise("main"))
    )


def auction_group_members(scored: DataFrame, members: DataFrame, picked: DataFrame, n: int = TOP_MEMBERS,
                          by: Sequence[str] = BY_DATE) -> DataFrame:
    """Strongest instruments of every listed group."""
    keys = [*by, "group_id"]
    joined = scored.join(members.select("group_id", "code").distinct(), "code").join(
        picked.select(*keys), keys, "left_semi")
    return R.top_per_group(joined, keys, [R.steady("score").desc(), F.col("code").asc()], n)
