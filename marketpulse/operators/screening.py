"""Classify screen hits by group and build alert digests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import measures as M
from marketpulse.operators.ranking import steady, top_per_group
from marketpulse.staging import stage

# Digest caps and the structured conditions of the alert slots.
MAX_GROUPS, MAX_HITS = 12, 8
SLOTS = {
    "933": {"time": "09:33", "body_or_max": 3.0, "min_amount": 6e8, "listed_days": 5},
    "945": {"time": "09:45", "body_or_max": 3.0, "min_amount": 1e9},
    "1000": {"time": "10:00", "body_or_max": 4.0, "min_amount": 2e9},
    "1430": {"time": "14:30", "change_lo": 7.0, "change_hi": 12.1, "exclude_limit_up": True, "exclude_st": True},
}

DIGEST_GROUPS = ("array<struct<group_pos:int,group_id:string,group_name:string,hit_count:bigint,member_total:bigint,coverage:double,"
                 "hit_avg_change:double,band:string,hits:array<struct<hit_pos:int,code:string,name:string,change_ratio:double,band:string>>>>")


@dataclass
class Classification:
    """Groups with hit figures, their hits in long form, and totals per snapshot."""

    groups: DataFrame
    hits: DataFrame
    totals: DataFrame


def classify_hits(hits: DataFrame, members: DataFrame, groups: DataFrame, scope: str = "custom",
                  by: Sequence[str] = ("trade_date",), digits: int | None = 2, unique: bool = False) -> Classification:
    """Which groups the hits concentrate in.

    Every hit counts in each of its groups. ``pool_size`` counts all hits,
    ``hit_total`` the distinct hits inside the scope's members; since a hit in
    scope always has a group, both scopes share the definition. Hits stay rows
    (a group may own most of them); ordering them is left to the reader. ``unique`` says
    that ``members`` hold no pair twice and are cheap to read again, as stored ones.
    """
    if scope not in ("custom", "market"):
        raise ValueError(f"unknown scope: {scope}")
    keys = [*by, "group_id"]
    pairs = members.select("group_id", "code")
    if not unique:
        pairs = stage(pairs.distinct(), "scope")
    sizes = pairs.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_total"))
    change = M.rounded(F.coalesce("change_ratio", F.lit(0.0)), digits)
    unique = stage(
        hits.groupBy(*by, "code").agg(F.max(F.struct("change_ratio", "name")).alias("h"))
        .select(*by, "code", "h.*"),
        "hits")
    in_groups = unique.withColumn("change_ratio", change).join(pairs, "code")
    classified = (
        in_groups.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("hit_count"), M.rounded(F.avg("change_ratio"), digits).alias("hit_avg_change"))
        .join(sizes, "group_id")
        .join(groups.select("group_id", "group_name"), "group_id", "left")
        .select(
            *keys, F.coalesce("group_name", "group_id").alias("group_name"), "hit_count", "member_total",
            M.rounded(F.col("hit_count") / F.col("member_total"), None if digits is None else 4).alias("coverage"),
            "hit_avg_change",
        )
    )
    inside = unique.join(pairs.select("code").distinct(), "code", "left_semi")
    totals = (
        unique.groupBy(*by).agg(F.count(F.lit(1)).alias("pool_size"))
        .join(inside.groupBy(*by).agg(F.count(F.lit(1)).alias("hit_total")), list(by), "left")
        .join(classified.groupBy(*by).agg(F.count(F.lit(1)).alias("group_hit_count")), list(by), "left")
        .na.fill(0, ["hit_total", "group_hit_count"])
    )
    return Classification(classified, in_groups.select(*keys, "code", "name", "change_ratio"), totals)


def alert_digest(result: Classification, scope: str, max_groups: int = MAX_GROUPS, max_hits: int = MAX_HITS,
                 by: Sequence[str] = ("trade_date",), error: str | None = None) -> DataFrame:
    """One row per snapshot and scope: totals and the leading groups with hits.

    At most ``max_groups`` groups of ``max_hits`` hits go into the array; the
    totals say how many there are. Snapshots without groups keep their row, and
    an ``error`` gives a row of its own (see ``error_digest``).
    """
    keys = [*by, "group_id"]
    order = [F.col("hit_count").desc(), steady("hit_avg_change").desc(), F.col("group_id").asc()]
    picked = stage(top_per_group(result.groups, by, order, max_groups, "group_pos"), "digest_groups")
    shown = top_per_group(
        result.hits.join(picked.select(*keys), keys, "left_semi"), keys,
        [F.col("change_ratio").desc(), F.col("code").asc()], max_hits, "hit_pos",
    ).withColumn("band", M.return_band("change_ratio"))
    hit = F.struct("hit_pos", "code", "name", "change_ratio", "band")
    lists = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    group = F.struct("group_pos", "group_id", "group_name", "hit_count", "member_total",
                     "coverage", "hit_avg_change", M.return_band("hit_avg_change").alias("band"), "hits")
    body = picked.join(lists, keys).groupBy(*by).agg(F.array_sort(F.collect_list(group)).alias("groups"))
    return result.totals.join(body, list(by), "left").select(
        *by, F.lit(scope).alias("scope"), F.lit(error).cast("string").alias("error"),
        "pool_size", "hit_total", "group_hit_count", "groups")


def error_digest(snapshots: DataFrame, scope: str, message: str) -> DataFrame:
    """The row a failed scope contributes for each snapshot."""
    empty = F.lit(None)
    return snapshots.distinct().select(
        "*", F.lit(scope).alias("scope"), F.lit(message).alias("error"), empty.cast("long").alias("pool_size"),
        empty.cast("long").alias("hit_total"), empty.cast("long").alias("group_hit_count"), empty.cast(DIGEST_GROUPS).alias("groups"))


def with_empty_digests(digest: DataFrame, snapshots: DataFrame, scope: str) -> DataFrame:
    """``digest`` with a row of zero hits for every snapshot it lacks."""
    lacking = snapshots.distinct().join(digest.select(*snapshots.columns), list(snapshots.columns), "left_anti")
    zero = F.lit(0).cast("long")
    return digest.unionByName(lacking.select(
        "*", F.lit(scope).alias("scope"), F.lit(None).cast("string").alias("error"), zero.alias("pool_size"), zero.alias("hit_total"),
        zero.alias("group_hit_count"), F.lit(None).cast(DIGEST_GROUPS).alias("groups")))


def digest_lines(digest: DataFrame, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Flat view of a digest: one row per shown hit."""
    g = digest.select(*by, "scope", F.explode("groups").alias("g"))
    return g.select(*by, "scope", "g.group_pos", "g.group_id", F.explode("g.hits").alias("h")).select(
        *by, "scope", "group_pos", "group_id", "h.*")
