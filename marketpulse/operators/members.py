"""Members inside groups: scores, rankings, reverse lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.operators import ranking as R
from marketpulse.staging import stage

# Member score weights; sort keys and limit bounds of a ranking.
MEMBER_WEIGHTS = {"change_ratio": 0.4, "speed": 0.2, "body": 0.2}
LIMIT_WEIGHT = 0.2
SORT_KEYS = ("change_ratio", "speed", "acceleration", "body", "score")
MAX_RANKING = 50


def score_members(df: DataFrame, by: Sequence[str] = ("trade_date", "group_id"),
                  weights: dict[str, float] | None = None, limit_weight: float = LIMIT_WEIGHT,
                  rank: bool = False) -> DataFrame:
    """H4: weighted member score inside each group.

    Change, speed and body are standardised in the group, the limit flag is
    not. Missing metrics count as 0. ``rank`` adds the group rank, built
    without gathering a group in one task.
    """
    weights = weights or MEMBER_WEIGHTS
    metrics = [*weights, "acceleration"]
    have = set(df.columns)
    filled = df.select(
        *[c for c in df.columns if c not in metrics],
        *[(F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in metrics],
    ).withColumn("limit_score", C.limit_score())
    scored = R.standardise(filled, list(weights), by).withColumn(
        "score", R.weighted(weights) + F.lit(limit_weight) * F.col("limit_score")
    )
    if not rank:
        return scored
    keyed = stage(scored.withColumn("__key", R.steady("score")), "member_scores")
    return R.spread_rank(keyed, "__key", by).drop("__key")


def member_ranking(scored: DataFrame, key: str = "score", descending: bool = True, limit: int = 10,
                   by: Sequence[str] = ("trade_date", "group_id")) -> DataFrame:
    """Members of each group by a chosen key; ties by score, then code.

    All members are sorted before the cut; ``limit`` is clamped to 1..50. Only the score
    rests on sums and is compared in steady digits; the other figures come from a
    member's own prices, alike on every run, and are compared as they are.
    """
    if key not in SORT_KEYS:
        raise ValueError(f"unsupported sort key: {key}")
    figure = R.steady(key) if key == "score" else F.col(key)
    first = figure.desc() if descending else figure.asc()
    n = max(1, min(int(limit), MAX_RANKING))
    return R.top_per_group(scored, by, [first, R.steady("score").desc(), F.col("code").asc()], n)


def section_members(scored: DataFrame, picked: DataFrame, figure: str = "score", n: int = 10,
                    by: Sequence[str] = ("trade_date", "group_id")) -> DataFrame:
    """``n`` members of every listed group, best first, or worst first in
    bottom sections; ties by code. ``picked`` carries ``by`` and ``section``."""
    listed = scored.join(picked.select(*by, "section"), list(by))
    return R.top_per_group(listed, [*by, "section"], [R.signed(figure).desc(), F.col("code").asc()], n)


def history_members(quotes: DataFrame, members: DataFrame, picked: DataFrame, n: int = 10,
                    by: Sequence[str] = ("trade_date", "group_id")) -> DataFrame:
    """I4: members of listed groups by daily change, with the quoted count."""
    pairs = members.select("group_id", "code").distinct()
    known = quotes.filter(F.col("change_ratio").isNotNull()).join(pairs, "code")
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("member_count"))
    return section_members(known, picked, "change_ratio", n, by).join(counts, list(by))


def groups_of_instrument(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct group names per instrument, ordered by the group's id.

    An array holds at most one entry per group name, so it is bounded by the
    dictionary, not by the data.
    """
    named = members.select("code", "group_id").join(groups.select("group_id", "group_name"), "group_id")
    first = named.groupBy("code", "group_name").agg(F.min("group_id").alias("group_id"))
    ordered = F.array_sort(F.collect_list(F.struct("group_id", "group_name")))
    return first.groupBy("code").agg(F.transform(ordered, lambda g: g["group_name"]).alias("group_names"))


def holding_codes(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Instruments of the group named as the holding group."""
    held = groups.filter(C.is_holding_group()).select("group_id")
    return members.join(held, "group_id", "left_semi").select("code").distinct()


def holdings_in_groups(members: DataFrame, holdings: DataFrame) -> DataFrame:
    """Held instruments inside each group, over its whole membership."""
    return (
        members.select("group_id", "code").distinct()
        .join(holdings.select("code").distinct(), "code", "left_semi")
    )


def custom_group_names(custom: DataFrame) -> DataFrame:
    """Distinct (group_id, group_name) pairs of user groups."""
    return custom.select("group_id", "group_name").distinct()
