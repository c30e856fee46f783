"""Filters and scopes: which groups and instruments a query looks at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators.latest import latest_by
from marketpulse.staging import stage

# Eligibility bounds.
MONITORED_MIN, MONITORED_MAX = 10, 500
ROTATION_MIN_MEMBERS = 6
LISTING_DAYS = 5


def keep_members(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Keep rows whose instrument is in ``codes``."""
    return df.join(codes.select("code"), "code", "left_semi")


def drop_members(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Drop rows whose instrument is in ``codes``."""
    return df.join(codes.select("code"), "code", "left_anti")


def keep_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    return df.join(groups.select("group_id"), "group_id", "left_semi")


def current_members(members: DataFrame) -> DataFrame:
    """Membership at each group's own latest snapshot (D1), one row per pair."""
    return latest_by(members, ["group_id"]).groupBy("group_id", "code").agg(F.min("name").alias("name"))


def current_eligible(members: DataFrame, watched: DataFrame, lo: int = MONITORED_MIN,
                     hi: int = MONITORED_MAX) -> DataFrame:
    """C5/C6 with their members: current members of the selected groups of eligible size."""
    current = current_members(keep_groups(members, watched))
    sized = current.groupBy("group_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n").between(lo, hi))
    return keep_groups(current, sized)


def group_sizes(members: DataFrame) -> DataFrame:
    """Member count of each group at its latest snapshot."""
    return latest_by(members, ["group_id"]).groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))


def in_pool(groups: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Groups of the attribution pool.

    ``pool`` holds the configured group ids; prefixes 885/886 always pass. No
    pool means the pool is disabled and every group passes.
    """
    if pool is None:
        return groups
    listed = pool.select("group_id").distinct().withColumn("__listed", F.lit(True))
    return (
        groups.join(listed, "group_id", "left")
        .filter(F.coalesce("__listed", F.lit(False)) | C.has_pool_prefix())
        .drop("__listed")
    )


def observe_groups(groups: DataFrame) -> DataFrame:
    """C4: groups of the observation pool."""
    return groups.filter(C.is_domestic_group() & C.is_observed_group())


def monitorable(members: DataFrame, lo: int = MONITORED_MIN, hi: int = MONITORED_MAX) -> DataFrame:
    """Groups whose latest snapshot has lo..hi members, bounds included."""
    return group_sizes(members).filter(F.col("member_count").between(lo, hi))


def effective_scope(watched: DataFrame, groups: DataFrame, members: DataFrame,
                    pool: DataFrame | None = None) -> DataFrame:
    """Selected groups of eligible size, else the fallback pool.

    Only the selected groups' members are counted; the short list of eligible
    ones is staged and its emptiness decides.
    """
    chosen = stage(monitorable(keep_groups(members, watched)).select("group_id"), "selected_groups")
    if not chosen.isEmpty():
        return chosen
    return in_pool(groups.filter(C.is_domestic_group()), pool).select("group_id").distinct()


def universe(kind: str, members: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Distinct instruments.

    ``latest``: domestic codes of the globally latest snapshot (members or
    mapping); ``groups``: members of the given groups (J2); ``custom``: all
    codes of a membership that keeps no snapshots.
    """
    if kind == "latest":
        return latest_by(members, []).filter(C.is_domestic()).select("code").distinct()
    if kind == "groups":
        return keep_groups(latest_by(members, ["group_id"]), groups).select("code").distinct()
    if kind == "custom":
        return members.select("code").distinct()
    raise ValueError(f"unknown universe: {kind}")


def new_listings(bars: DataFrame, calc_date, min_days: int = LISTING_DAYS,
                 until_calc_date: bool = False) -> DataFrame:
    """Codes first seen after the ``min_days``-th latest trading date.

    Empty while fewer than ``min_days`` dates are loaded. First bars are looked
    up in the whole history, or only up to ``calc_date`` on request.
    """
    upto = bars.filter(F.col("trade_date") <= F.lit(calc_date).cast("date"))
    recent = upto.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(min_days)
    cutoff = recent.select(
        F.when(F.count(F.lit(1)) >= min_days, F.min("trade_date"))
    ).scalar()
    seen = upto if until_calc_date else bars
    return (
        seen.groupBy("code").agg(F.min("trade_date").alias("first_date"))
        .filter(F.col("first_date") > cutoff)
    )


def filter_candidates(df: DataFrame, level: str | None = None, watched: bool | None = None,
                      keyword: str | None = None) -> DataFrame:
    """Candidate rows by level prefix, selected state and a text in id or name."""
    if level:
        df = df.filter(F.col("group_id").startswith(level))
    if watched is not None:
        df = df.filter(F.col("watched") == watched)
    if keyword:
        df = df.filter(F.col("group_id").contains(keyword) | F.col("group_name").contains(keyword))
    return df


def rotation_groups(members: DataFrame, groups: DataFrame,
                    min_members: int = ROTATION_MIN_MEMBERS) -> DataFrame:
    """Groups for rotation: not ZT, not the holding group, enough members."""
    sizes = members.groupBy("group_id").agg(F.count_distinct("code").alias("member_count"))
    return (
        sizes.join(groups.select("group_id", "group_name"), "group_id")
        .filter(~C.is_zt() & ~C.is_holding_group() & (F.col("member_count") >= min_members))
    )


def missing_groups(mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """Domestic groups seen in the mapping but absent from the dictionary."""
    return (
        mapping.filter(C.is_domestic_group())
        .groupBy("group_id").agg(F.min("group_name").alias("group_name"))
        .join(groups, "group_id", "left_anti")
    )


ST_NAME = r"^(S?\*)?ST"  # fixed values: the prefixes ST, *ST and S*ST


def screen(bars: DataFrame, body_or_max: float | None = None, min_amount: float | None = None,
           listed_days: int | None = None, change_lo: float | None = None,
           change_hi: float | None = None, exclude_limit_up: bool = False,
           exclude_st: bool = False, history: DataFrame | None = None) -> DataFrame:
    """Bars passing every given condition, for all dates at once.

    ``bars`` may be daily, or as of a minute (``intraday.as_of_bars``). ``body_or_max``:
    body or the maximum gain so far exceeds it. ``listed_days``: more loaded trading
    dates than this since the first bar, that day included; dates and first bars are
    those of ``history``, by default ``bars``. ``exclude_st`` needs a ``name`` column.
    """
    df = bars
    if body_or_max is not None:
        body = M.body_pct("open", "close")
        gain = M.pct_change("high", "pre_close")
        df = df.filter((body > body_or_max) | F.coalesce(gain > body_or_max, F.lit(False)))
    if min_amount is not None:
        df = df.filter(F.col("amount") > min_amount)
    if change_lo is not None:
        df = df.filter(F.col("change_ratio") > change_lo)
    if change_hi is not None:
        df = df.filter(F.col("change_ratio") < change_hi)
    if exclude_limit_up:
        df = df.filter(~C.is_limit_up())
    if exclude_st:
        df = df.filter(~F.upper(F.trim(F.coalesce("name", F.lit("")))).rlike(ST_NAME))
    if listed_days is not None:
        history = bars if history is None else history
        first = history.groupBy("code").agg(F.min("trade_date").alias("__first"))
        numbered = session_numbers(history)
        df = (
            df.join(first, "code")
            .join(F.broadcast(numbered), "trade_date")
            .join(F.broadcast(numbered.select(F.col("trade_date").alias("__first"),
                                              F.col("session_no").alias("__from"))), "__first")
            .filter(F.col("session_no") - F.col("__from") + 1 > listed_days)
            .select(*bars.columns)
        )
    return df


def session_numbers(bars: DataFrame) -> DataFrame:
    """Loaded trading dates numbered in order; one row per calendar day."""
    days = bars.select("trade_date").distinct().withColumn("__k", F.lit(1))
    w = Window.partitionBy("__k").orderBy("trade_date")
    return days.select("trade_date", F.row_number().over(w).alias("session_no"))


def eligible_selection(requested: DataFrame, members: DataFrame,
                       keep: Sequence[int] = (MONITORED_MIN, MONITORED_MAX)) -> tuple[DataFrame, DataFrame]:
    """B3 without the write: the eligible part of a selection and the rest."""
    requested = requested.select("group_id").distinct()
    ok = monitorable(members, *keep)
    return keep_groups(requested, ok), requested.join(ok, "group_id", "left_anti")
