"""Weighted attribution of instrument returns to groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators.latest import latest_by
from marketpulse.operators.scopes import in_pool, keep_groups
from marketpulse.operators.strength import group_return
from marketpulse.staging import stage

ENTRY = "array<struct<group_id:string,weight:double,group_return:double,contribution:double,contrib_pct:double>>"
TOTAL_EPSILON = 1e-8


def equal_weights(mapping: DataFrame, keys=("code", "map_date")) -> DataFrame:
    """K3: weight 1/n over an instrument's groups of one mapping date.

    Counted with a combining aggregate and joined back.
    """
    counts = mapping.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return mapping.join(counts, list(keys)).withColumn("weight", 1.0 / F.col("__n")).drop("__n")


def groups_from_members(members: DataFrame, groups: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """K8: groups an instrument appears in at its own latest snapshot (D2),
    limited to dictionary groups of the pool; weight 1."""
    current = latest_by(members, ["code"]).select("code", "group_id").distinct()
    scope = in_pool(groups.select("group_id"), pool).distinct()
    return keep_groups(current, scope).withColumn("weight", F.lit(1.0))


def attribute(instruments: DataFrame, weights: DataFrame, group_returns: DataFrame,
              digits: int | None = 4, days: Column | None = None, keys: Sequence[str] = ("code",)) -> DataFrame:
    """K1: one row per (snapshot, instrument) with its ordered contributions.

    ``instruments``: trade_date, code, total_return. ``weights``: code,
    group_id, weight. ``group_returns``: trade_date, group_id, group_return;
    missing ones count as 0. Shares divide the rounded contribution by the
    signed total of unrounded ones, 0 when the total vanishes. ``days`` may
    give the array of dates in ``instruments`` when the caller knows it. ``keys`` tell
    whose weights they are: an instrument's, or those of an instrument in a snapshot.

    The contributions depend on an instrument's groups and weights only, not on
    the instrument: they are worked out once per date and distinct profile of
    groups, and instruments take their profile's. Arrays hold the groups of one
    instrument, so the dictionary bounds them.
    """
    if days is None:
        days = instruments.select(F.collect_set("trade_date")).scalar()
    profiles = _profiles(weights, keys)
    held = instruments.join(profiles.select(*keys, "profile_id"), list(keys))
    return _with_detail(held, _detail(profiles, group_returns, digits, days))


def _profiles(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per instrument (``keys``) its groups with their weights, and the id of that profile."""
    return stage(
        weights.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("group_id", "weight"))).alias("profile"))
        .withColumn("profile_id", F.md5(F.to_json("profile"))),
        "profiles")


def _detail(profiles: DataFrame, group_returns: DataFrame, digits: int | None, days: Column) -> DataFrame:
    """Per date and distinct profile its ordered contributions, and their JSON text; few rows."""
    distinct = profiles.dropDuplicates(["profile_id"]).select("profile_id", "profile").withColumn("__days", days)
    rows = (
        distinct.select("profile_id", "profile", F.explode("__days").alias("trade_date"))
        .select("trade_date", "profile_id", F.inline("profile"))
        .join(group_returns, ["trade_date", "group_id"], "left")
        .withColumn("group_return", F.coalesce(F.nanvl("group_return", F.lit(0.0)), F.lit(0.0)))
        .withColumn("raw", F.col("weight") * F.col("group_return"))
        .withColumn("contribution", M.rounded("raw", digits))
    )
    entry = F.struct(
        (-F.abs("contribution")).alias("order"), "group_id",
        M.rounded("weight", digits).alias("weight"),
        M.rounded("group_return", digits).alias("group_return"), "contribution",
    )
    per_profile = rows.groupBy("trade_date", "profile_id").agg(
        F.sum("raw").alias("total"), F.array_sort(F.collect_list(entry)).alias("entries"))
    total = F.col("total")

    def finish(e):
        pct = F.when(F.abs(total) > TOTAL_EPSILON, M.rounded(F.try_divide(e["contribution"], total), digits))
        return F.struct(
            e["group_id"].alias("group_id"), e["weight"].alias("weight"),
            e["group_return"].alias("group_return"), e["contribution"].alias("contribution"),
            F.coalesce(pct, F.lit(0.0)).alias("contrib_pct"),
        )

    finished = per_profile.select("trade_date", "profile_id", F.transform("entries", finish).alias("attributions"))
    return stage(finished.withColumn("attribution_json", F.to_json("attributions")), "profile_attributions")


def _with_detail(instruments: DataFrame, detail: DataFrame, as_json: bool = False) -> DataFrame:
    """Instruments (trade_date, code, total_return, profile_id) with their profile's contributions, as an array or as its JSON text."""
    top = F.col("attributions")[0]
    ready = detail.select("trade_date", "profile_id", top["group_id"].alias("top_group"), top["contrib_pct"].alias("top_contrib_pct"),
                          "attribution_json" if as_json else "attributions")
    return instruments.join(ready, ["trade_date", "profile_id"]).select(
        "trade_date", "code", "total_return", "top_group", "top_contrib_pct", ready.columns[-1])


def daily_attribution(bars: DataFrame, members: DataFrame, groups: DataFrame, scope: DataFrame | None = None,
                      pool: DataFrame | None = None, dates: DataFrame | None = None,
                      digits: int | None = 4, as_json: bool = False) -> DataFrame:
    """K2: attribution of the whole market, for every date of ``bars`` (or ``dates``).

    Group returns use each group's latest members within ``scope``. Each
    instrument spreads weight 1/n over its pool groups. Domestic instruments of
    the globally latest snapshot are attributed; without a quote they count as
    return 0, with an unknown change they are skipped.

    An instrument meets its profile and its quotes as one row, with the quotes of
    all dates in an array (bounded by the calendar); its dates are unfolded after that, so
    no product of instruments and dates is shuffled; they are dealt anew before, as broadcasts would
    leave them in the few tasks of a small file. ``as_json`` gives the store form
    (B6), whose text is made once per date and profile.
    """
    if dates is not None:
        bars = bars.join(F.broadcast(dates.select("trade_date")), "trade_date", "left_semi")
    days = bars.select(F.collect_set("trade_date")).scalar()
    scoped = members if scope is None else keep_groups(members, scope)
    returns = stage(group_return(
        bars.filter(F.col("change_ratio").isNotNull()).select("trade_date", "code", "change_ratio"),
        latest_by(scoped, ["group_id"])), "group_returns")
    weights = equal_weights(groups_from_members(members, groups, pool).drop("weight"), keys=("code",))
    universe = latest_by(members, []).filter(C.is_domestic()).select("code").distinct()
    quotes = bars.groupBy("code").agg(F.collect_list(F.struct("trade_date", F.col("change_ratio").alias("total_return"))).alias("quotes"))
    profiles = _profiles(weights, ("code",))
    known = F.filter(F.coalesce("quotes", F.array().cast("array<struct<trade_date:date,total_return:double>>")), lambda q: q["total_return"].isNotNull())
    silent = F.array_except(F.col("__days"), F.coalesce(F.col("quotes")["trade_date"], F.array().cast("array<date>")))
    each = F.concat(known, F.transform(silent, lambda d: F.struct(d.alias("trade_date"), F.lit(0.0).alias("total_return"))))
    instruments = (
        universe.join(profiles.select("code", "profile_id"), "code").join(quotes, "code", "left")
        .repartition("code").withColumn("__days", days).select("code", "profile_id", F.inline(each))
    )
    return _with_detail(instruments, _detail(profiles, returns, digits, days), as_json)


def mapped_attribution(bars: DataFrame, mapping: DataFrame, members: DataFrame, groups: DataFrame,
                       scope: DataFrame | None = None, dated: bool = True, digits: int | None = 4) -> DataFrame:
    """K2 without a pool: instruments and their groups come from the dated mapping.

    ``mapping``: code, group_id, map_date. Every date of ``bars`` takes the latest
    snapshot of the mapping that is not after it (``dated``; a date before the first has no
    rows), so a backfill sees what was known then, or else the latest of all. The domestic
    instruments of that snapshot are attributed over its dictionary groups; quotes and
    group returns are those of ``daily_attribution``. Snapshots are given to
    dates, which are few; instruments meet only the dates of their snapshot.
    """
    days = bars.select("trade_date").distinct()
    known = mapping.select("map_date").distinct()
    if dated:
        marks = days.select(F.col("trade_date").alias("at"), "trade_date", F.lit(None).cast("date").alias("map_date")).unionByName(
            known.select(F.col("map_date").alias("at"), F.lit(None).cast("date").alias("trade_date"), "map_date"))
        up_to = Window.partitionBy(F.lit(0)).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)  # a row for each date of the calendar
        valid = marks.withColumn("map_date", F.max("map_date").over(up_to)).where(F.col("trade_date").isNotNull() & F.col("map_date").isNotNull())
    else:
        valid = days.withColumn("map_date", known.agg(F.max("map_date")).scalar())
    valid = stage(valid.select("trade_date", "map_date"), "mapping-days")
    pairs = mapping.join(F.broadcast(valid.select("map_date").distinct()), "map_date", "left_semi").select("map_date", "code", "group_id").distinct()
    universe = pairs.filter(C.is_domestic()).select("map_date", "code").distinct().join(F.broadcast(valid), "map_date")
    quotes = bars.select("trade_date", "code", "change_ratio", F.lit(True).alias("__quoted"))
    instruments = (
        universe.join(quotes, ["trade_date", "code"], "left")
        .filter(F.col("change_ratio").isNotNull() | F.col("__quoted").isNull())
        .select("map_date", "trade_date", "code", F.coalesce("change_ratio", F.lit(0.0)).alias("total_return"))
    )
    scoped = members if scope is None else keep_groups(members, scope)
    returns = stage(group_return(
        bars.filter(F.col("change_ratio").isNotNull()).select("trade_date", "code", "change_ratio"),
        latest_by(scoped, ["group_id"])), "group_returns")
    weights = equal_weights(keep_groups(pairs, groups.select("group_id").distinct()), keys=("map_date", "code"))
    return attribute(instruments, weights, returns, digits, valid.select(F.collect_set("trade_date")).scalar(), keys=("map_date", "code"))


def attribution_rows(attributed: DataFrame) -> DataFrame:
    """Long form of the detail: one row per contribution, numbered from 1."""
    return attributed.select("trade_date", "code", F.posexplode("attributions").alias("pos", "e")).select(
        "trade_date", "code", (F.col("pos") + 1).alias("pos"), "e.*")


def attribution_to_json(attributed: DataFrame) -> DataFrame:
    """Store form, with the detail as JSON text."""
    return attributed.withColumn("attribution_json", F.to_json("attributions")).drop("attributions")


def attribution_from_json(stored: DataFrame) -> DataFrame:
    """Read form, with the JSON text parsed back into the detail array."""
    return stored.withColumn(
        "attributions", F.from_json(F.coalesce("attribution_json", F.lit("[]")), ENTRY)
    ).drop("attribution_json")


def get_attribution(attributed: DataFrame, codes: DataFrame, date=None) -> DataFrame:
    """K4: stored attribution of the wanted codes; absent ones are omitted."""
    if date is not None:
        attributed = attributed.filter(F.col("trade_date") == F.lit(date).cast("date"))
    return attributed.join(codes.select("code").distinct(), "code", "left_semi")


CODE_BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int")


def store_by_code(attributed: DataFrame, path: str, buckets: int = CODE_BUCKETS) -> None:
    """K4: store attribution (B6 form) in folders by date and bucket of codes, sorted by code; whole dates are replaced."""
    rows = attributed.withColumn("code_bucket", _bucket(buckets))
    (rows.repartition("trade_date", "code_bucket").sortWithinPartitions("trade_date", "code_bucket", "code").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "code_bucket").parquet(path))


def lookup(spark: SparkSession, path: str, codes: DataFrame, dates: Sequence, buckets: int = CODE_BUCKETS) -> DataFrame:
    """K4: stored attribution of the wanted codes on some dates; absent ones are omitted.

    Dates and the codes' buckets (at most ``buckets`` numbers) become literals, so
    only the folders that can hold an answer are read.
    """
    wanted = codes.select("code").distinct()
    found = [r[0] for r in wanted.select(_bucket(buckets)).distinct().collect()]
    days = [F.lit(str(d)).cast("date") for d in dates]
    stored = spark.read.parquet(path).where(F.col("trade_date").isin(days) & F.col("code_bucket").isin(found))
    return stored.join(wanted, "code", "left_semi").drop("code_bucket")


def with_names(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach group names; groups missing from the dictionary vanish."""
    return df.join(groups.select("group_id", "group_name"), "group_id")


def rankings(strength: DataFrame, groups: DataFrame, date=None, top_n: int | None = None) -> DataFrame:
    """K7/I8: ranked groups with names, per date, optionally the first ``top_n``."""
    if date is not None:
        strength = strength.filter(F.col("trade_date") == F.lit(date).cast("date"))
    named = with_names(strength, groups)
    order = Window.partitionBy("trade_date").orderBy(F.col("rank_1d").asc_nulls_last(), "group_id")
    placed = named.withColumn("pos", F.row_number().over(order))
    return placed if top_n is None else placed.filter(F.col("pos") <= top_n)
