"""Canonical frames derived from the star-schema tables used for checking.

``events`` play the tick feed (an instrument per user), ``lineitem`` long price
histories (an instrument per supplier), ``customer`` the group memberships and
``orders`` the portfolio. Every mapping covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OLD_SNAPSHOT, NEW_SNAPSHOT = "2024-01-01", "2024-01-15"
STALE_REGION = 0        # groups of this region have the old snapshot only
OLD_MIN_BALANCE = 1000  # customers of the old snapshot
HELD_NATION = 3         # its user group is the holding group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key) -> Column:
    """Instrument code of a numeric key: boards and a foreign exchange by last digit."""
    key = F.col(key) if isinstance(key, str) else key
    p = F.lpad(key.cast("string"), 6, "0")
    d = key % 10
    return (
        F.when(d == 0, F.concat(F.lit("300"), p, F.lit(".SZ")))
        .when(d == 1, F.concat(F.lit("688"), p, F.lit(".SH")))
        .when(d == 2, F.concat(F.lit("8"), p, F.lit(".BJ")))
        .when(d == 9, F.concat(F.lit("9"), p, F.lit(".HK")))
        .when(d % 2 == 0, F.concat(F.lit("6"), p, F.lit(".SH")))
        .otherwise(F.concat(F.lit("0"), p, F.lit(".SZ")))
    )


def _finish_bars(daily: DataFrame) -> DataFrame:
    pre = F.lag("close").over(Window.partitionBy("code").orderBy("trade_date"))
    return daily.withColumn("pre_close", pre).select(
        "code", "trade_date", "pre_close", "open", "high", "low", "close",
        ((F.try_divide("close", "pre_close") - 1) * 100).alias("change_ratio"), "volume", "amount")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the event stream: one per user and day."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("trade_date"))
        .agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"),
            F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
            (F.count(F.lit(1)) * 100.0).alias("volume"), F.sum("value").alias("amount"),
        )
    )
    return _finish_bars(daily.withColumn("code", code_of("user_id")))


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long price histories: one bar per supplier and shipping day."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("trade_date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"), "l_quantity", "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("at"))
    daily = lines.groupBy("l_suppkey", "trade_date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"))
    return _finish_bars(daily.withColumn("code", code_of("l_suppkey")))


def supplier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the long histories: supplier nations."""
    return table(spark, sf_dir, "supplier").select(
        F.format_string("884%03d.TI", F.col("s_nationkey")).alias("group_id"),
        code_of("s_suppkey").alias("code"), F.col("s_name").alias("name"),
        F.lit(NEW_SNAPSHOT).cast("date").alias("as_of"))


def _nation_id() -> Column:
    return F.format_string("884%03d.TI", F.col("n_nationkey"))


def _segment_id() -> Column:
    return F.concat(F.lit("885"), F.substring("c_mktsegment", 1, 3), F.lit(".TI"))


def _region_id() -> Column:
    return F.format_string("861%03d.US", F.col("n_regionkey"))


def _nation_segment_id() -> Column:
    return F.concat(F.format_string("886%02d", F.col("n_nationkey")), F.substring("c_mktsegment", 1, 1), F.lit(".TI"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def _in_kinds(base: DataFrame, kinds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per customer and kind of group, in a single scan."""
    entries = F.array(*[
        F.struct(F.lit(kind).alias("kind"), group_id.alias("group_id"), name.alias("group_name"))
        for kind, (group_id, name) in kinds.items()])
    return base.withColumn("__g", F.explode(entries)).select("*", "__g.*").drop("__g")


def _named_kinds() -> dict[str, tuple[Column, Column]]:
    return {
        "nation": (_nation_id(), F.col("n_name")),
        "segment": (_segment_id(), F.col("c_mktsegment")),
        "region": (_region_id(), F.col("r_name")),
        "nation_segment": (_nation_segment_id(), F.concat_ws(" ", "n_name", "c_mktsegment")),
    }


def _in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated memberships of customers in nations, segments, regions and nation-segments.

    The old snapshot holds customers with a balance, the new one everybody;
    nation and nation-segment groups of one region keep only the old one.
    """
    rows = _in_kinds(_in_regions(spark, sf_dir), _named_kinds())
    stale = F.col("kind").isin("nation", "nation_segment") & (F.col("n_regionkey") == STALE_REGION)
    dates = F.array_compact(F.array(
        F.when(F.col("c_acctbal") >= OLD_MIN_BALANCE, F.lit(OLD_SNAPSHOT).cast("date")),
        F.when(~stale, F.lit(NEW_SNAPSHOT).cast("date"))))
    return rows.select(
        "group_id", code_of("c_custkey").alias("code"), F.col("c_name").alias("name"), F.explode(dates).alias("as_of"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group dictionary with names and kinds."""
    rows = _in_kinds(_in_regions(spark, sf_dir), _named_kinds())
    return rows.select("group_id", "group_name", "kind").distinct()


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected groups: all segments, and nations and nation-segments outside one region."""
    rows = _in_kinds(_in_regions(spark, sf_dir), _named_kinds())
    chosen = (F.col("kind") == "segment") | (
        F.col("kind").isin("nation", "nation_segment") & (F.col("n_regionkey") != STALE_REGION))
    return rows.filter(chosen).select("group_id").distinct()


def custom_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User groups without snapshots: nations, segments and nation-segments.

    Building segments are ZT collections, one nation is the holding group.
    """
    building = F.col("c_mktsegment") == "BUILDING"
    kinds = {
        "nation": (_nation_id(), F.when(F.col("n_nationkey") == HELD_NATION, "CC").otherwise(F.col("n_name"))),
        "segment": (_segment_id(), F.concat(F.when(building, "ZT").otherwise(""), "c_mktsegment")),
        "nation_segment": (_nation_segment_id(),
                           F.concat(F.when(building, " zt ").otherwise(""), F.concat_ws(" ", "n_name", "c_mktsegment"))),
    }
    rows = _in_kinds(_customers(spark, sf_dir), kinds)
    return rows.select("group_id", "group_name", code_of("c_custkey").alias("code"))


def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument-to-group mapping with dates, built from the memberships."""
    return members(spark, sf_dir).select("code", "group_id", F.col("as_of").alias("map_date"))


def ticks_of(events: DataFrame, opens: int = 10) -> DataFrame:
    """Tick rows of an event frame, batch or stream; before ten, or another hour, is the auction."""
    k = F.get_json_object("props", "$.k").cast("double")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        code_of("user_id").alias("code"), F.to_date("ts").alias("trade_date"),
        F.when(F.hour("ts") < opens, "pre_market").otherwise("trading").alias("phase"),
        F.col("event_id").alias("seq"), ts.alias("ts"), F.date_format("ts", "HH:mm").alias("hhmm"),
        F.col("value").alias("price"), F.col("value").alias("avg_price"), k.alias("volume"),
        (F.col("value") * 100).alias("turnover"), (k * 10 + 100).alias("matched_vol"),
        k.alias("unmatched_buy"), (100 - k).alias("unmatched_sell"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days: weekdays with events."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("trade_date")).distinct()
    return days.filter(F.weekday("trade_date") < 5)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a holding of its customer's instrument."""
    return table(spark, sf_dir, "orders").select(
        code_of("o_custkey").alias("code"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("shares"),
        F.col("o_totalprice").alias("cost_price"))


def index_bars(bars: DataFrame, members_now: DataFrame) -> DataFrame:
    """Index series: mean open and close of every group's members per date."""
    return (
        bars.join(members_now.select("group_id", "code").distinct(), "code")
        .groupBy(F.col("group_id").alias("code"), "trade_date")
        .agg(F.avg("open").alias("open"), F.avg("close").alias("close"), F.avg("change_ratio").alias("change_ratio"),
             F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    )
