"""Batch jobs over stored tables: the daily run, alerts and the portfolio report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators import attribution as K
from marketpulse.operators import portfolio as Q
from marketpulse.operators import screening as H
from marketpulse.operators import upkeep as U
from marketpulse.operators.intraday import as_of_bars
from marketpulse.operators.scopes import current_members, effective_scope, keep_groups, screen
from marketpulse.operators.strength import MIN_MEMBERS, multi_period_strength_on
from marketpulse.operators.versions import VersionedTable
from marketpulse.sources.ingest import unpack_bars
from marketpulse.staging import stage

BARS, STRENGTH, ATTRIBUTION = "daily_bars", "group_strength", "instrument_attribution"


def daily_run(spark: SparkSession, warehouse: str, raw_bars: DataFrame, members: DataFrame, groups: DataFrame,
              watched: DataFrame, date, pool: DataFrame | None = None, min_members: int = MIN_MEMBERS,
              precision: int | None = 4) -> None:
    """Load payloads, then store strength and attribution of one date.

    Bars are upserted by (code, date), rewriting only the date partitions in
    the payload, beside the old ones until one rename makes them current; results
    replace their date. Every step restarts cleanly and reads only the dates it needs.
    """
    stored = VersionedTable(spark, f"{warehouse}/{BARS}")
    stored.upsert(unpack_bars(raw_bars), ["code", "trade_date"])
    scope = effective_scope(watched, groups, members, pool)
    scoped = stage(current_members(keep_groups(members, scope)), "scope")
    strength = multi_period_strength_on(stored.read(end=date), scoped, date, min_members=min_members, precision=precision)
    U.replace_partition(strength, f"{warehouse}/{STRENGTH}")
    detail = K.daily_attribution(stored.read(dates=[date]), members, groups, scope, pool, digits=precision)
    VersionedTable(spark, f"{warehouse}/{ATTRIBUTION}").upsert(K.attribution_to_json(detail), ["code", "trade_date"])


def alert_run(bars: DataFrame, custom: DataFrame, market_members: DataFrame, groups: DataFrame, slot: str,
              history: DataFrame | None = None, **changed) -> DataFrame:
    """Screen with a slot's conditions, classify in both scopes, build digests.

    ``bars`` carry a ``name``; every date of theirs has a row in either scope, and rows
    without a code only stand for their date. ``history`` holds the bars that listing
    ages are counted from. ``changed`` replaces single conditions. An unknown slot
    raises ``KeyError``.
    """
    return slot_digests(bars.withColumn("slot", F.lit(slot)), custom, market_members, groups, history, {slot: changed})


def slot_digests(bars: DataFrame, custom: DataFrame, market_members: DataFrame, groups: DataFrame,
                 history: DataFrame | None = None, slots: dict[str, dict] | None = None) -> DataFrame:
    """M11 for several slots in one run: ``bars`` name their ``slot``, ``slots`` hold changed conditions of each."""
    hits, by = None, ["trade_date", "slot"]
    for slot, changed in (slots or {s: {} for s in H.SLOTS}).items():
        conditions = {k: v for k, v in H.SLOTS[slot].items() if k != "time"} | changed
        mine = bars.where((F.col("slot") == slot) & F.col("code").isNotNull())
        found = screen(mine, **conditions, history=history).select(*by, "code", "name", "change_ratio")
        hits = found if hits is None else hits.unionByName(found)
    hits = stage(hits, "slot-hits")
    custom_names = custom.select("group_id", "group_name").distinct()
    own = hits.join(custom.select("code").distinct(), "code", "left_semi")
    mine = H.classify_hits(own, custom, custom_names, "custom", by)
    pool = hits.groupBy(*by).agg(F.count_distinct("code").alias("pool_size"))
    mine.totals = pool.join(mine.totals.drop("pool_size"), by, "left").na.fill(0, ["hit_total", "group_hit_count"])
    market = H.classify_hits(hits, market_members, groups, "market", by)
    snapshots = bars.select(*by).distinct()
    both = [H.with_empty_digests(H.alert_digest(c, name, by=by), snapshots, name) for c, name in ((mine, "custom"), (market, "market"))]
    return both[0].unionByName(both[1])


def slot_run(ticks: DataFrame, names: DataFrame, history: DataFrame, custom: DataFrame, market_members: DataFrame,
             groups: DataFrame, slot: str, **changed) -> DataFrame:
    """M11 on a session's ticks: the alert run of a slot over all ticks up to its minute.

    The slot's minute cuts every session alike; dates without a tick by then have a row of no
    hits. ``names`` are (code, name).
    """
    bars = as_of_bars(ticks, H.SLOTS[slot]["time"])
    silent = ticks.select("trade_date").distinct().join(bars.select("trade_date").distinct(), "trade_date", "left_anti")
    named = with_labels(bars.unionByName(silent, allowMissingColumns=True), names)
    return alert_run(named, custom, market_members, groups, slot, history, **changed)


def with_labels(bars: DataFrame, names: DataFrame) -> DataFrame:
    """``bars`` with the name of their instrument, or its code."""
    labels = names.groupBy("code").agg(F.min("name").alias("name"))
    return bars.join(labels, "code", "left").withColumn("name", F.coalesce("name", "code"))


def isolated_digests(builders: dict[str, object], snapshots: DataFrame) -> DataFrame:
    """Build and run each scope's digest apart, so one scope's failure leaves the others.

    ``builders`` map a scope to a function returning its digest, which is written
    at once: capped lists, so small. ``snapshots`` are all rows (of ``trade_date``)
    that every scope owes: one that fails, while building or in a task, gives an
    error row for each, and a snapshot without hits an empty one.
    """
    result = None
    for scope, build in builders.items():
        try:
            frame = H.with_empty_digests(stage(build(), "digest"), snapshots, scope)
        except Exception as e:  # the message becomes the scope's digest
            cause = e.getCondition() if isinstance(e, PySparkException) and e.getCondition() else type(e).__name__
            text = str(e).splitlines()[0] if not isinstance(e, PySparkException) else cause
            frame = H.error_digest(snapshots, scope, f"{cause}: {text}" if text != cause else cause)
        result = frame if result is None else result.unionByName(frame)
    return result


@dataclass
class PortfolioReport:
    exposure: DataFrame
    dominant: DataFrame
    alerts: DataFrame
    leaders: DataFrame


def portfolio_report(holdings: DataFrame, mapping: DataFrame, strength: DataFrame, groups: DataFrame,
                     date=None) -> PortfolioReport:
    """Exposure per group, the dominant one, exposed leading groups, top five."""
    exposure = Q.portfolio_exposure(holdings, K.with_names(mapping, groups))
    ranked = K.rankings(strength, groups, date)
    dominant = Q.dominant_group(exposure).join(groups.select("group_id", "group_name"), "group_id", "left")
    return PortfolioReport(exposure, dominant, Q.alert_groups(exposure, ranked), Q.leading_groups(ranked))
