"""Group strength: membership joined with quotes, aggregated, standardised, ranked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators import ranking as R
from marketpulse.operators.returns import rolling_period_returns, period_return

# Weights of the score and of the horizons, quoted-member minimum.
SCORE_WEIGHTS = {"s1": 0.40, "s2": 0.30, "s4": 0.30}
PERIOD_WEIGHTS = {"1d": 0.50, "5d": 0.30, "20d": 0.20}
MIN_MEMBERS = 6

BY_DATE = ("trade_date",)


def latest_quotes(quotes: DataFrame, order: str, by: Sequence[str] = BY_DATE) -> DataFrame:
    """Keep the last quote per instrument and snapshot (combines map-side)."""
    keys = [*by, "code"]
    rest = [c for c in quotes.columns if c not in keys]
    return quotes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("q")).select(*keys, "q.*")


def quotes_by_group(quotes: DataFrame, members: DataFrame, unique: bool = False) -> DataFrame:
    """One row per (group, quoted member). Duplicate pairs count once (J1);
    ``unique`` says there are none and saves the shuffle that removes them."""
    pairs = members.select("group_id", "code")
    return quotes.join(pairs if unique else pairs.distinct(), "code")


def market_return(quotes: DataFrame, by: Sequence[str] = BY_DATE) -> DataFrame:
    """Mean change over all quotes of a snapshot, before any deduplication."""
    return quotes.groupBy(*by).agg(F.avg("change_ratio").alias("market_return"))


def score_groups(aggregated: DataFrame, by: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """H1, H3, H6 on one row per group and snapshot.

    Adds ``z_s1``, ``z_s2``, ``z_s4``, ``score`` and ``rank_1d``. A snapshot has
    one row per group, so its window is bounded by the number of groups.
    """
    columns = {"s1": "s1_return", "s2": "s2_breadth", "s4": "s4_relative"}
    z = aggregated.select("*", *[R.zscore(c, by).alias(f"z_{k}") for k, c in columns.items()])
    known = F.col("s1_return").isNotNull()
    scored = z.withColumn("score", F.when(known, R.weighted(weights)))
    return scored.withColumn("rank_1d", R.min_rank("score", by))


def aggregate_groups(joined: DataFrame, market: DataFrame, by: Sequence[str], min_members: int,
                     precision: int | None, watch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Means, breadth and relative strength per group; small groups drop out.

    ``member_count`` counts quoted members, also those whose change is unknown.
    ``watch`` sees the figures of all groups, before small ones drop out (G21).
    """
    body = F.avg("body") if "body" in joined.columns else F.lit(None).cast("double")
    figures = joined.groupBy(*by, "group_id").agg(
        F.avg("change_ratio").alias("s1"),
        F.count_if(F.col("change_ratio") > 0).alias("up"),
        F.count(F.lit(1)).alias("member_count"),
        body.alias("body_mean"),
    )
    return finish_figures(watch(figures) if watch else figures, market, by, min_members, precision)


def finish_figures(figures: DataFrame, market: DataFrame, by: Sequence[str], min_members: int,
                   precision: int | None) -> DataFrame:
    """Group figures from sums: minimum size, breadth, relative strength, rounding.

    ``market`` has one row per snapshot, dates or minutes of dates: no more than
    a calendar's worth times 1,440, and small against any quotes it came from.
    """
    return (
        figures.filter(F.col("member_count") >= min_members)
        .join(market, list(by))
        .select(
            *by, "group_id",
            M.rounded("s1", precision).alias("s1_return"),
            M.rounded(F.col("up") / F.col("member_count"), precision).alias("s2_breadth"),
            M.rounded(F.col("s1") - F.col("market_return"), precision).alias("s4_relative"),
            M.rounded("body_mean", precision).alias("s_body"),
            "member_count",
        )
    )


def group_strength(quotes: DataFrame, members: DataFrame, by: Sequence[str] = BY_DATE,
                   weights: dict[str, float] | None = None, min_members: int = MIN_MEMBERS,
                   precision: int | None = 4, order: str | None = None,
                   groups: DataFrame | None = None, unique: bool = False,
                   watch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Strength of every group in every snapshot, ranked inside the snapshot.

    ``quotes`` carry ``by``, ``code``, ``change_ratio`` and optionally ``body``;
    ``by`` names the snapshot (one row of market figures each: dates, or dates
    and minutes). ``order`` asks for deduplication of quotes, keeping the last.
    ``precision`` rounds before standardising; ``groups`` (G1) restricts the
    scope.
    """
    market = market_return(quotes, by)
    if order is not None:
        quotes = latest_quotes(quotes, order, by)
    if groups is not None:
        members = members.join(groups.select("group_id"), "group_id", "left_semi")
    joined = quotes_by_group(quotes, members, unique)
    return score_groups(
        aggregate_groups(joined, market, by, min_members, precision, watch), by, weights or SCORE_WEIGHTS
    )


def merge_periods(base: DataFrame, others: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Attach other horizons' scores to the base; missing groups score 0."""
    for column, other in others.items():
        base = base.join(other.select(*keys, F.col("score").alias(column)), list(keys), "left")
        base = base.withColumn(column, F.coalesce(column, F.lit(0.0)))
    return base


def _fuse(base: DataFrame, others: dict[str, DataFrame], period_weights: dict[str, float]) -> DataFrame:
    merged = merge_periods(base.withColumnRenamed("score", "score_1d"), others, ["group_id"])
    final = R.weighted(period_weights, prefix="score_")
    return merged.withColumn("score_final", final).withColumn("rank_1d", R.min_rank("score_final", BY_DATE))


def multi_period_strength_on(bars: DataFrame, members: DataFrame, date,
                             period_weights: dict[str, float] | None = None,
                             weights: dict[str, float] | None = None,
                             min_members: int = MIN_MEMBERS, precision: int | None = 4) -> DataFrame:
    """G5 for one date: 1d from that exact date, 5d/20d ending at or before it."""
    weights = weights or SCORE_WEIGHTS
    day = F.lit(date).cast("date")

    def strength(quotes):
        return group_strength(quotes.select("trade_date", "code", "change_ratio"), members, weights=weights,
                              min_members=min_members, precision=precision)

    base = strength(bars.filter(F.col("trade_date") == day))
    others = {f"score_{n}d": strength(period_return(bars, date, n)) for n in (5, 20)}
    return _fuse(base, others, period_weights or PERIOD_WEIGHTS)


def multi_period_strength(bars: DataFrame, members: DataFrame,
                          period_weights: dict[str, float] | None = None,
                          weights: dict[str, float] | None = None,
                          min_members: int = MIN_MEMBERS, precision: int | None = 4) -> DataFrame:
    """G5 for every date of ``bars`` in one pass.

    All horizons share one window over the bars, one membership join and one
    aggregate per (date, group); every date has a bar of its own, so no horizon
    falls back to an earlier date here and all three count the same members.
    """
    weights = weights or SCORE_WEIGHTS
    returns = rolling_period_returns(bars, (5, 20), carry=("change_ratio",))
    horizons = {"1d": "change_ratio", "5d": "return_5d", "20d": "return_20d"}
    figures = [
        f(c).alias(f"{n}_{k}")
        for k, c in horizons.items()
        for n, f in (("s1", F.avg), ("up", lambda c: F.count_if(F.col(c) > 0)))
    ]
    market = returns.groupBy("trade_date").agg(*[F.avg(c).alias(f"m_{k}") for k, c in horizons.items()])
    grouped = (
        quotes_by_group(returns, members).groupBy("trade_date", "group_id")
        .agg(F.count(F.lit(1)).alias("member_count"), *figures)
        .filter(F.col("member_count") >= min_members)
        .join(market, "trade_date")
    )

    def parts(k):
        return {
            "s1": M.rounded(f"s1_{k}", precision),
            "s2": M.rounded(F.col(f"up_{k}") / F.col("member_count"), precision),
            "s4": M.rounded(F.col(f"s1_{k}") - F.col(f"m_{k}"), precision),
        }

    wide = grouped.select(
        "trade_date", "group_id", "member_count",
        *[v.alias(f"{n}__{k}") for k in horizons for n, v in parts(k).items()],
    )
    z = wide.select("*", *[
        R.zscore(f"{n}__{k}", BY_DATE).alias(f"z__{n}__{k}") for k in horizons for n in weights
    ])

    def score(k):
        total = sum((F.lit(w) * F.col(f"z__{n}__{k}") for n, w in weights.items()), F.lit(0.0))
        return F.when(F.col(f"s1__{k}").isNotNull(), total)

    scored = z.select(
        "trade_date", "group_id",
        F.col("s1__1d").alias("s1_return"), F.col("s2__1d").alias("s2_breadth"),
        F.col("s4__1d").alias("s4_relative"), F.lit(None).cast("double").alias("s_body"), "member_count",
        *[F.col(f"z__{n}__1d").alias(f"z_{n}") for n in weights],
        score("1d").alias("score_1d"),
        *[F.coalesce(score(k), F.lit(0.0)).alias(f"score_{k}") for k in ("5d", "20d")],
    )
    final = R.weighted(period_weights or PERIOD_WEIGHTS, prefix="score_")
    return scored.withColumn("score_final", final).withColumn(
        "rank_1d", R.min_rank("score_final", BY_DATE))


def group_mean_return(returns: DataFrame, members: DataFrame, value: str = "change_ratio",
                      body: str | None = None, min_members: int = 1) -> DataFrame:
    """Mean of the known member values per group, with the mean body."""
    aggs = [F.avg(value).alias("group_return"), F.count(value).alias("member_count")]
    if body:
        aggs.append(F.avg(body).alias("body"))
    return (
        quotes_by_group(returns, members).groupBy("group_id").agg(*aggs)
        .filter(F.col("member_count") >= min_members)
    )


def group_return(quotes: DataFrame, members: DataFrame, by: Sequence[str] = BY_DATE) -> DataFrame:
    """Mean known member change per group; groups without one are absent."""
    return (
        quotes_by_group(quotes.select(*by, "code", "change_ratio"), members)
        .groupBy(*by, "group_id").agg(F.avg("change_ratio").alias("group_return"))
        .filter(F.col("group_return").isNotNull())
    )


def daily_group_rank(quotes: DataFrame, members: DataFrame, by: Sequence[str] = BY_DATE) -> DataFrame:
    """Ad-hoc ranking on the daily change; only known changes count."""
    return (
        quotes_by_group(quotes.filter(F.col("change_ratio").isNotNull()), members)
        .groupBy(*by, "group_id")
        .agg(
            F.avg("change_ratio").alias("s1_return"),
            (F.count_if(F.col("change_ratio") > 0) / F.count(F.lit(1))).alias("s2_breadth"),
            F.count(F.lit(1)).alias("member_count"),
        )
        .withColumn("score", F.col("s1_return"))
    )


def market_stats(quotes: DataFrame, scope: DataFrame | None = None,
                 by: Sequence[str] = BY_DATE, known_only: bool = False) -> DataFrame:
    """G8, and G9 with ``scope`` and ``known_only``: counts of the market per snapshot."""
    if scope is not None:
        quotes = quotes.join(scope.select("code").distinct(), "code", "left_semi")
    change = F.col("change_ratio")
    if known_only:
        quotes = quotes.filter(change.isNotNull())
    return quotes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("stock_count"),
        F.avg(change).alias("market_avg_change"),
        F.count_if(change > 0).alias("up_count"),
        F.count_if(change < 0).alias("down_count"),
        F.count_if(change == 0).alias("flat_count"),
        F.count_if(C.is_limit_up()).alias("limit_up_count"),
    )


def run_statistics(strength: DataFrame, name: str = "group_strength") -> tuple[DataFrame, object]:
    """Attach an observation counting saved and unscored rows of a run (``plans.runlog`` stores more)."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return strength.observe(
        watch,
        F.count(F.lit(1)).alias("rows_saved"),
        F.count_if(F.col("score").isNull()).alias("rows_unscored"),
    ), watch
