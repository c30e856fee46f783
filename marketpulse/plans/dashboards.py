"""Intraday, auction and end-of-day dashboards (M1-M5, M9).

Every dashboard answers all sessions of its input at once; restrict the ticks
or bars to one date for a single screen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.operators import auction as A
from marketpulse.operators import intraday as I
from marketpulse.operators import members as P
from marketpulse.operators import ranking as R
from marketpulse.operators import strength as S
from marketpulse.operators.attribution import rankings, with_names
from marketpulse.operators.latest import prev_volume, resolve_snapshot, with_member_names
from marketpulse.operators.scopes import current_eligible, keep_groups, keep_members
from marketpulse.staging import stage

BY_DATE = ["trade_date"]
GROUP_KEYS = ["trade_date", "group_id"]
TOP_MEMBERS = 10


@dataclass
class Dashboard:
    """Sections of a dashboard, each a frame keyed by ``trade_date``."""

    groups: DataFrame
    members: DataFrame
    stats: DataFrame
    snapshots: DataFrame | None = None
    holdings: DataFrame | None = None


def watched_members(members: DataFrame, watched: DataFrame) -> DataFrame:
    """Current members of the selected groups of eligible size."""
    return current_eligible(members, watched)


def scoped_ticks(ticks: DataFrame, members: DataFrame) -> DataFrame:
    """Ticks of the instruments in scope; the set of codes is small enough to
    broadcast in all but extreme scopes, and Spark decides by its size."""
    return keep_members(ticks, members.select("code").distinct())


def _scope(members: DataFrame, *columns: str) -> DataFrame:
    """Distinct memberships in scope, staged: every section joins them, and their
    real size lets Spark decide about broadcasting."""
    return stage(members.select("group_id", *columns, "code").distinct(), "scope")


def _member_lists(quotes: DataFrame, members: DataFrame, picked: DataFrame) -> DataFrame:
    """Ten best members of top and ZT groups, ten worst (worst first) of bottom ones.

    Only groups that are shown get their members scored.
    """
    shown = picked.select(*GROUP_KEYS).distinct()
    joined = S.quotes_by_group(quotes, members, unique=True).join(shown, GROUP_KEYS, "left_semi")
    lists = P.section_members(P.score_members(joined), picked, n=TOP_MEMBERS)
    return lists.withColumn("limit_up", F.col("limit_score").cast("int"))


def _quotes(ticks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Indicators as of each session's minute, staged: one scan feeds all sections."""
    return stage(I.indicators(ticks, snapshots), "indicators")


def intraday_dashboard(ticks: DataFrame, members: DataFrame, groups: DataFrame, names: DataFrame,
                       at: str | None = None, top_n: int = 10, min_members: int = S.MIN_MEMBERS,
                       precision: int | None = 4) -> Dashboard:
    """M1: strongest and weakest groups at a minute, with members and market figures.

    ``members``: (group_id, code) in scope; ``names``: dated members for names.
    """
    members = _scope(members)
    ticks = scoped_ticks(ticks, members)
    snapshots = resolve_snapshot(ticks, at)
    quotes = _quotes(ticks, snapshots)
    strength = S.group_strength(quotes, members, min_members=min_members, precision=precision, unique=True)
    picked = R.top_bottom(strength, "score", top_n, BY_DATE).join(
        groups.select("group_id", "group_name"), "group_id", "left"
    ).withColumn("group_name", F.coalesce("group_name", "group_id"))
    lists = with_member_names(_member_lists(quotes, members, picked), names)
    return Dashboard(picked, lists, S.market_stats(quotes), snapshots)


def custom_dashboard(ticks: DataFrame, custom: DataFrame, names: DataFrame, at: str | None = None,
                     top_n: int = 10, min_members: int = S.MIN_MEMBERS,
                     precision: int | None = 4) -> Dashboard:
    """M2: the dashboard over user groups ``(group_id, group_name, code)``.

    ZT groups leave the top and bottom lists. Those with too few quoted members
    are scored without a minimum, in a cross-section of their own
    (``cross_section`` says which one); the ZT section is ordered by mean change.
    """
    custom = _scope(custom, "group_name")
    groups = P.custom_group_names(custom)
    ticks = scoped_ticks(ticks, custom)
    snapshots = resolve_snapshot(ticks, at)
    quotes = _quotes(ticks, snapshots)
    joined = S.quotes_by_group(quotes, custom, unique=True)
    figures = stage(with_names(
        S.aggregate_groups(joined, S.market_return(quotes), BY_DATE, 0, precision), groups), "custom_figures")
    enough = F.col("member_count") >= min_members
    ranked = S.score_groups(figures.filter(enough), BY_DATE, S.SCORE_WEIGHTS)
    small = S.score_groups(figures.filter(~enough & C.is_zt()), BY_DATE, S.SCORE_WEIGHTS)
    lanes = ranked.withColumn("cross_section", F.lit("all")).unionByName(
        small.withColumn("cross_section", F.lit("zt"))).withColumn("zt", C.is_zt())
    lane = R.Window.partitionBy(*BY_DATE, "zt")
    figure = R.steady(F.when(F.col("zt"), F.col("s1_return")).otherwise(F.col("score")))
    placed = (
        lanes.withColumn("__top", F.row_number().over(lane.orderBy(figure.desc_nulls_last(), F.col("group_id").asc())))
        .withColumn("__bottom", F.row_number().over(lane.orderBy(figure.asc_nulls_first(), F.col("group_id").desc())))
    )
    picked = R.sections(placed, top_n, zt="zt").drop("zt")
    holding = P.holdings_in_groups(custom, P.holding_codes(custom, groups))
    held = holding.groupBy("group_id").agg(F.count(F.lit(1)).alias("holding_count"))
    picked = picked.join(held, "group_id", "left").na.fill(0, ["holding_count"])
    lists = with_member_names(_member_lists(quotes, custom, picked), names)
    return Dashboard(picked, lists, S.market_stats(quotes), snapshots, holding)


def member_drilldown(ticks: DataFrame, members: DataFrame, names: DataFrame, at: str | None = None,
                     key: str = "score", descending: bool = True, limit: int = 10) -> DataFrame:
    """M3: every group's members by a chosen figure, with the group's quoted count."""
    members = _scope(members)
    quotes = stage(I.indicators(scoped_ticks(ticks, members), at, resolve=False), "indicators")
    scored = stage(P.score_members(S.quotes_by_group(quotes, members, unique=True)), "member_scores")
    counts = scored.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("member_count"))
    picked = P.member_ranking(scored, key, descending, limit).join(counts, GROUP_KEYS)
    return with_member_names(picked, names)


@dataclass
class AuctionBoard:
    stocks: DataFrame
    groups: DataFrame
    group_members: DataFrame
    stats: DataFrame


def auction_dashboard(ticks: DataFrame, bars: DataFrame, custom: DataFrame, names: DataFrame,
                      at: str | None = None, top_stock: int = A.TOP_STOCKS,
                      top_group: int = A.TOP_GROUPS) -> AuctionBoard:
    """M4: strongest instruments and user groups of the opening auction."""
    custom = _scope(custom, "group_name")
    groups = P.custom_group_names(custom)
    pool = scoped_ticks(ticks, custom)
    factors = A.auction_factors(pool, prev_volume(bars), at)
    scored = stage(A.auction_score(factors), "auction_scores")
    holding = P.holding_codes(custom, groups).withColumn("holding", F.lit(True))

    def decorated(df):
        listed = P.groups_of_instrument(keep_members(custom, df.select("code").distinct()), groups)
        return (
            with_member_names(df, names).join(listed, "code", "left").join(holding, "code", "left")
            .na.fill(False, ["holding"])
        )

    grouped = stage(A.auction_groups(scored, custom, groups), "auction_groups")
    listed = A.auction_group_lists(grouped, top_group)
    return AuctionBoard(
        decorated(A.auction_top_stocks(scored, top_stock)), listed,
        decorated(A.auction_group_members(scored, custom, listed)), A.auction_stats(scored))


def history_dashboard(bars: DataFrame, members: DataFrame, groups: DataFrame, names: DataFrame,
                      strength: DataFrame | None = None, top_n: int = 10) -> Dashboard:
    """M5: end-of-day dashboard from stored results.

    With ``strength`` the groups in scope are ranked by their stored score
    (scope "sector"), else by the members' mean change (scope "custom", where
    ZT groups form a section of their own). ``members``: (group_id, code) of
    the scope.
    """
    members = _scope(members)
    quotes = bars.select("trade_date", "code", "change_ratio")
    if strength is not None:
        scope = members.select("group_id").distinct()
        ranked = rankings(keep_groups(strength, scope), groups).withColumn("score", F.col("score_final"))
        best = [F.col("rank_1d").asc_nulls_last(), F.col("group_id").asc()]
        worst = [F.col("rank_1d").desc_nulls_first(), F.col("group_id").desc()]
        zt = F.lit(False)
    else:
        ranked = with_names(S.daily_group_rank(quotes, members), groups)
        best = [R.steady("score").desc(), F.col("group_id").asc()]
        worst = [R.steady("score").asc(), F.col("group_id").desc()]
        zt = C.is_zt()
    lane = R.Window.partitionBy(*BY_DATE, "zt")
    placed = (
        ranked.withColumn("zt", zt)
        .withColumn("__top", F.row_number().over(lane.orderBy(*best)))
        .withColumn("__bottom", F.row_number().over(lane.orderBy(*worst)))
        .select("trade_date", "group_id", "group_name", "score", "s1_return", "s2_breadth", "zt", "__top", "__bottom")
    )
    picked = stage(R.sections(placed, top_n, zt="zt").drop("zt"), "history_groups")
    lists = with_member_names(P.history_members(quotes, members, picked, TOP_MEMBERS), names)
    return Dashboard(picked, lists, S.market_stats(quotes, members, known_only=True))


def replay(ticks: DataFrame, members: DataFrame, min_members: int = S.MIN_MEMBERS,
           precision: int | None = 4) -> DataFrame:
    """M9: strength and rank of every group at every minute of every session.

    An instrument changes a group's sums only in the minutes it ticks, so only
    those changes are joined with memberships and summed; running totals per
    group (at most 1,440 rows a session) give the sums at any minute. Changes
    are exact decimals, so totals do not drift and equal what
    ``intraday_dashboard`` aggregates at that minute.
    """
    by = ["trade_date", "hhmm"]
    members = _scope(members)
    ticks = scoped_ticks(ticks, members)
    steps = stage(I.replay_steps(ticks), "replay_steps")
    axes = I.session_axes(ticks)
    market = I.running_totals(steps, BY_DATE, axes).select(*by, (F.col("change") / F.col("n")).alias("market_return"))
    totals = I.running_totals(S.quotes_by_group(steps, members, unique=True), GROUP_KEYS, axes)
    figures = S.finish_figures(totals.select(
        *by, "group_id", (F.col("change") / F.col("n")).alias("s1"), "up", F.col("n").alias("member_count"),
        (F.col("body") / F.col("n")).alias("body_mean")), market, by, min_members, precision)
    return S.score_groups(figures, by, S.SCORE_WEIGHTS)
