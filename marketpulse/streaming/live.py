"""Structured Streaming over the tick feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketpulse.functions import clock
from marketpulse.functions import measures as M
from marketpulse.operators.intraday import KEY, compact_ticks, indicators, session_anchors
from marketpulse.operators.screening import SLOTS
from marketpulse.operators.strength import MIN_MEMBERS, group_strength
from marketpulse.operators.upkeep import write_partitions
from marketpulse.schemas import TRADING
from marketpulse.staging import exists, stage

LATENESS = "2 minutes"


def dedupe_ticks(ticks: DataFrame, lateness: str = LATENESS, keys=("code", "trade_date", "phase", "seq")) -> DataFrame:
    """Drop repeated ticks; state is kept only for the lateness bound.

    Ticks later than the bound are dropped by the stateful operators downstream
    and counted in the query's progress (see ``late_rows``).
    """
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def late_rows(query: StreamingQuery) -> int:
    """Rows the query dropped for being too late, over its recent progress."""
    return sum(
        op.numRowsDroppedByWatermark
        for progress in query.recentProgress for op in progress.stateOperators
    )


def minute_bars(ticks: DataFrame, lateness: str | None = LATENESS, key: str = "code") -> DataFrame:
    """One-minute bars of trading ticks. The same code serves batch frames
    (``lateness=None``) and streams."""
    if lateness is not None:
        ticks = ticks.withWatermark("ts", lateness)
    return (
        ticks.filter(F.col("phase") == TRADING)
        .groupBy(F.window("ts", "1 minute").alias("w"), key)
        .agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
            F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"),
        )
        .select(key, F.col("w.start").alias("minute"), "open", "high", "low", "close", "volume", "amount")
    )


def sliding_speed(ticks: DataFrame, length: str = "3 minutes", slide: str = "1 minute",
                  lateness: str | None = LATENESS) -> DataFrame:
    """Move from the first to the last trading price of sliding windows."""
    if lateness is not None:
        ticks = ticks.withWatermark("ts", lateness)
    return (
        ticks.filter((F.col("phase") == TRADING) & (F.col("price") > 0))
        .groupBy(F.window("ts", length, slide).alias("w"), "code")
        .agg(F.min_by("price", "seq").alias("first"), F.max_by("price", "seq").alias("last"))
        .select("code", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                M.step_pct("first", "last").alias("speed"))
    )


def gated(ticks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Ticks of trading days past the pre-open. The calendar is a static
    table of days."""
    days = F.broadcast(calendar.select("trade_date", F.lit(True).alias("is_td")))
    joined = ticks.join(days, "trade_date")
    phase = clock.session_phase("ts", "is_td")
    return joined.filter(clock.stream_gate(phase, F.col("is_td"))).drop("is_td")


class LatestState:
    """Latest state per instrument, kept as a table of few ticks per session.

    Each micro-batch merges its ticks into the sessions it touches and rewrites
    only those date partitions. Merging is idempotent (a tick is identified by
    its sequence), so a batch replayed after a failure changes nothing.
    """

    def __init__(self, path: str, members: DataFrame | None = None, min_members: int = MIN_MEMBERS,
                 precision: int | None = 4):
        self.path = path.rstrip("/")
        self.members = members
        self.min_members = min_members
        self.precision = precision

    @property
    def state_path(self) -> str:
        return f"{self.path}/state"

    def strength_path(self, batch_id: int | None = None) -> str:
        root = f"{self.path}/strength"
        return root if batch_id is None else f"{root}/batch_id={batch_id}"

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        spark = batch.sparkSession
        touched = F.broadcast(batch.select("trade_date").distinct())

        def touched_state():
            stored = spark.read.schema(batch.schema).parquet(self.state_path)
            return stored.join(touched, "trade_date", "left_semi").select(*batch.columns)

        known = exists(spark, self.state_path)
        merged = touched_state().unionByName(batch) if known else batch
        write_partitions(compact_ticks(merged), self.state_path, "trade_date")
        if self.members is not None:
            strength = group_strength(indicators(touched_state()), self.members,
                                      min_members=self.min_members, precision=self.precision)
            strength.write.mode("overwrite").parquet(self.strength_path(batch_id))

    def start(self, ticks: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            ticks.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "3 seconds"})).start()
        )


def slot_alerts(run: Callable[..., DataFrame], out: str, anchored: bool = False) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function firing each slot whose minute is in the batch.

    ``run(batch, slot)`` builds the digest rows (see ``plans.jobs.alert_run``).
    The check asks a batch only for the presence of the few slot minutes.
    ``anchored`` gives ``run(ticks, slot, anchors)`` the batch's ticks, as far as
    ``intraday.indicators`` reads them, and their session anchors, both written once for
    all slots: every action on a micro-batch reads its source and makes all columns again.
    """
    def fire(batch: DataFrame, batch_id: int) -> None:
        also = ()
        if anchored:
            batch = stage(batch.select(*KEY, "phase", "hhmm", "seq", "price", "turnover"), "slot-ticks")
            also = (stage(session_anchors(batch), "slot-anchors"),)
        minutes = {slot: conf["time"] for slot, conf in SLOTS.items()}
        seen = batch.agg(*[F.max((F.col("hhmm") == t).cast("int")).alias(s) for s, t in minutes.items()]).first()
        for slot in minutes:
            if seen[slot]:
                run(batch, slot, *also).write.mode("overwrite").parquet(f"{out}/slot={slot}/batch={batch_id}")

    return fire


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Append finished rows to a parquet table, exactly once."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()
    )
