"""Keyed session state of a tick stream: latest quotes and quotes as of fixed minutes.

A key is an instrument's session. What a session's ticks say at a minute is a small
sketch (first and last auction point, first trading point, last three trading points,
highest trading price), which folds ticks in any order and repeated ones without change.
The sketches live in the state store, so a trigger works on the keys of its own ticks
alone; ``state_settings`` names the store. Quotes as of fixed minutes are aggregates over
windows that end there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketpulse.functions import measures as M
from marketpulse.operators.intraday import EXACT, TAIL, session_bars, with_metrics
from marketpulse.operators.screening import SLOTS
from marketpulse.operators.strength import BY_DATE, MIN_MEMBERS, SCORE_WEIGHTS, finish_figures, score_groups
from marketpulse.schemas import PRE_MARKET, TRADING
from marketpulse.staging import exists, remove, stage

# Processors travel to the workers by value; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ("trade_date", "code")
MINUTE_MS, DAY_MS = 60_000, 86_400_000

POINT = "struct<seq: long, price: double>"
SKETCH = (f"pre_first {POINT}, pre_last {POINT}, trade_first {POINT}, "
          "tail array<struct<hhmm: string, seq: long, price: double, turnover: double>>, high double")
EMPTY = (None, None, None, [], None)


def state_settings(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, off the heap and written as changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _sketch(row) -> tuple:
    """A stored sketch as plain tuples."""
    points = [None if p is None else (p[0], p[1]) for p in row[:3]]
    return (*points, [tuple(t) for t in row[3] or ()], row[4])


def fold(sketch: tuple, ticks: Iterable) -> tuple:
    """``sketch`` with further ticks in it."""
    pre_first, pre_last, trade_first, tail, high = sketch
    newest = {(t[0], t[1]): t for t in tail}
    for t in ticks:
        if t.phase == PRE_MARKET:
            if pre_first is None or t.seq < pre_first[0]:
                pre_first = (t.seq, t.price)
            if pre_last is None or t.seq > pre_last[0]:
                pre_last = (t.seq, t.price)
        elif t.phase == TRADING:
            if trade_first is None or t.seq < trade_first[0]:
                trade_first = (t.seq, t.price)
            newest[(t.hhmm, t.seq)] = (t.hhmm, t.seq, t.price, t.turnover)
            if len(newest) > 8 * TAIL:
                newest = {k: newest[k] for k in sorted(newest)[-TAIL:]}
            if t.price is not None and (high is None or t.price > high):
                high = t.price
    return pre_first, pre_last, trade_first, [newest[k] for k in sorted(newest)[-TAIL:]], high


def _chunks(rows: Iterable, size: int = 1000) -> Iterator[list]:
    rows = iter(rows)
    while chunk := list(islice(rows, size)):
        yield chunk


def quote(sketch: tuple) -> dict:
    """The figures of a sketch: the state columns of ``operators.intraday`` and a bar."""
    pre_first, pre_last, trade_first, tail, high = sketch
    price = [None if p is None else p[1] for p in (pre_first, pre_last, trade_first)]
    first = price[2] if price[0] is None else price[0]
    return {"tail": [t[2] for t in tail], "pre_price": price[1], "turnover": tail[-1][3] if tail else None, "pre_close": first,
            "open": price[2] if price[1] is None else price[1], "high": high, "close": tail[-1][2] if tail else price[1]}


# ---- latest state (S2) ----

_QUOTE = "struct<tail: array<double>, pre_price: double, turnover: double, pre_close: double, open: double, high: double, close: double>"
CHANGES = f"trade_date date, code string, before {_QUOTE}, after {_QUOTE}"


class LatestQuotes(StatefulProcessor):
    """Folds a trigger's ticks into each session's sketch; gives the quotes before and after.

    A session's state is dropped ``keep_days`` after its day, by an event-time timer.
    """

    def __init__(self, keep_days: int):
        self.keep_ms = (1 + keep_days) * DAY_MS

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", SKETCH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.latest.exists()
        before = after = _sketch(self.latest.get()) if known else EMPTY
        for chunk in _chunks(rows):
            after = fold(after, chunk)
        if after != before:
            self.latest.update(after)
        if not known:
            self.handle.registerTimer(chunk[0].day_ms + self.keep_ms)
        yield Row(trade_date=key[0], code=key[1], before=Row(**quote(before)) if known else None, after=Row(**quote(after)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        return iter(())


def _keyed(ticks: DataFrame, lateness: str) -> DataFrame:
    day = F.unix_millis(F.col("trade_date").cast("timestamp"))
    return ticks.withWatermark("ts", lateness).select(*KEY, "phase", "hhmm", "seq", "price", "turnover", "ts", day.alias("day_ms"))


def quote_changes(ticks: DataFrame, lateness: str = "2 minutes", keep_days: int = 1) -> DataFrame:
    """A row for each session touched by a trigger: its quote ``before`` (NULL if new) and ``after``."""
    return _keyed(ticks, lateness).groupBy(*KEY).transformWithState(LatestQuotes(keep_days), CHANGES, "append", "eventTime")


def stored_quotes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """D8 figures of all sessions in the state store of ``quote_changes``, read from its checkpoint."""
    kept = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint).select("key.*", "value.*")
    tail = F.col("tail")
    return with_metrics(kept.select(
        *KEY, F.transform(tail, lambda t: t["price"]).alias("tail"), F.col("pre_last.price").alias("pre_price"),
        F.try_element_at(tail, F.lit(-1))["turnover"].alias("turnover"),
        F.coalesce("pre_first.price", "trade_first.price").alias("pre_close"), F.coalesce("pre_last.price", "trade_first.price").alias("open")))


def figures_of(changes: DataFrame, when: str) -> DataFrame:
    """D8 figures of one side of ``quote_changes``; sessions without a usable quote drop out."""
    return with_metrics(changes.where(F.col(when).isNotNull()).select(*KEY, f"{when}.*").drop("high", "close"))


# ---- quotes as of the slots (S5) ----

BAR = ("pre_close", "open", "high", "close", "amount")

def slot_quotes(ticks: DataFrame, slots: dict[str, str] | None = None, lateness: str = "2 minutes") -> DataFrame:
    """The stream of bars as of each slot; ``slots`` maps names to minutes.

    A session's bar as of a slot comes once, when the watermark passes the slot's minute: a
    streamed aggregate over the day's window that ends there. A tick counts for the slots whose
    minute is not before its own. Ticks after a slot give rows without a code, which only say
    that the date has a session; they follow the bars of their date and slot.
    """
    slots = slots or {s: c["time"] for s, c in SLOTS.items()}
    ends = {s: (int(at[:2]) * 60 + int(at[3:]) + 1) * MINUTE_MS for s, at in slots.items()}
    zone = ticks.sparkSession.conf.get("spark.sql.session.timeZone")
    clock = F.from_utc_timestamp("ts", zone)  # windows begin at the session's hours, whatever its zone
    timed = ticks.withColumn("clock", clock).withWatermark("clock", lateness)
    # Ticks are chosen by the watermark's own column: by another one they would be chosen before it, and a branch's watermark would stand still.
    of_day = F.pmod(F.unix_millis("clock"), F.lit(DAY_MS))
    after = F.filter(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(end).alias("end")) for s, end in ends.items()]), lambda x: x["end"] <= of_day)
    silent = timed.select("trade_date", "clock", F.explode(F.transform(after, lambda x: x["slot"])).alias("slot")).groupBy(F.window("clock", "1 minute"), "trade_date", "slot").count()
    out = silent.select("slot", "trade_date", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("double").alias(c) for c in BAR])
    for slot, end in ends.items():
        bars = session_bars(timed.where(of_day < end), F.window("clock", "1 day", startTime=f"{end // MINUTE_MS} minutes"))
        code = F.when(F.col("close").isNotNull(), F.col("code")).alias("code")
        out = out.unionByName(bars.select(F.lit(slot).alias("slot"), "trade_date", code, *BAR))
    return out


def fire_slots(run: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over ``slot_quotes`` that writes one digest per (slot, date).

    ``run(bars)`` builds the digest rows of every (trade_date, slot) in ``bars`` (see
    ``plans.jobs.slot_digests``). Dates whose slot has fired already are left alone, and a
    batch replayed after a failure replaces just what it wrote, so every (slot, date) has
    one digest.
    """
    def fire(batch: DataFrame, batch_id: int) -> None:
        bars = stage(batch.withColumn("change_ratio", M.pct_change("close", "pre_close")), "slot-quotes")
        if exists(bars.sparkSession, out):
            fired = bars.sparkSession.read.parquet(out).where(F.col("batch_id") != batch_id).select("slot", "trade_date").distinct()
            bars = bars.join(fired, ["slot", "trade_date"], "left_anti")
        if not bars.isEmpty():
            (run(bars).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(out))

    return fire


# ---- strength by differences (S3) ----

MARKET = ""  # the id under which a date's whole market is summed
SUMS = ("change", "known", "up", "n", "body")


class StrengthByDelta:
    """S3: group strength kept up to date by what each trigger changes.

    A touched session takes its old contribution out of its groups' sums and puts the new one
    in, so a trigger joins only its own sessions with the members. Sums are exact decimals
    (nothing drifts) in one small table per batch: a row for each open date and group, built from the table of the
    batch before. A replayed batch builds the same table again. Dates end ``keep_days``
    after their day.
    """

    def __init__(self, path: str, members: DataFrame, min_members: int = MIN_MEMBERS, precision: int | None = 4, keep_days: int = 1):
        self.path, self.members = path.rstrip("/"), members.select("group_id", "code").distinct()
        self.min_members, self.precision, self.keep_days = min_members, precision, keep_days

    @property
    def strength_path(self) -> str:
        return f"{self.path}/strength"

    def _table(self, batch_id: int) -> str:
        return f"{self.path}/sums/batch_id={batch_id}"

    def merge(self, changes: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function over ``quote_changes``."""
        spark = changes.sparkSession
        changes = stage(changes, "quote-changes")
        change = F.col("change_ratio")

        def contributions(when: str, sign: int) -> DataFrame:
            values = {"change": F.coalesce(change, F.lit(0.0)).cast(EXACT), "known": change.isNotNull().cast("long"),
                      "up": F.coalesce(change > 0, F.lit(False)).cast("long"), "n": F.lit(1).cast("long"), "body": F.col("body").cast(EXACT)}
            return figures_of(changes, when).select(*KEY, *[(v * sign).alias(c) for c, v in values.items()])

        def added(df: DataFrame, *keys: str) -> DataFrame:
            return df.groupBy(*keys).agg(*[F.sum(c).cast(EXACT if c in ("change", "body") else "long").alias(c) for c in SUMS])

        steps = added(contributions("after", 1).unionByName(contributions("before", -1)), *KEY)
        market = added(steps, "trade_date").withColumn("group_id", F.lit(MARKET))
        sums = added(steps.join(self.members, "code"), "trade_date", "group_id").unionByName(market)
        earlier = next((self._table(i) for i in range(batch_id - 1, -1, -1) if exists(spark, self._table(i))), None)
        if earlier:
            known = spark.read.schema(sums.schema).parquet(earlier)
            latest = known.agg(F.max("trade_date")).scalar()
            opened = known.where(F.date_add("trade_date", self.keep_days) >= latest)
            sums = added(opened.unionByName(sums), "trade_date", "group_id")
        sums.write.mode("overwrite").parquet(self._table(batch_id))
        now = spark.read.schema(sums.schema).parquet(self._table(batch_id)).join(changes.select("trade_date").distinct(), "trade_date", "left_semi")
        mean = lambda c, n: F.try_divide(F.col(c).cast("double"), F.col(n))
        groups = now.where(F.col("group_id") != MARKET).select(
            "trade_date", "group_id", mean("change", "known").alias("s1"), "up", F.col("n").alias("member_count"), mean("body", "n").alias("body_mean"))
        whole = now.where(F.col("group_id") == MARKET).select("trade_date", mean("change", "known").alias("market_return"))
        figures = finish_figures(groups, whole, BY_DATE, self.min_members, self.precision)
        score_groups(figures, BY_DATE, SCORE_WEIGHTS).write.mode("overwrite").parquet(f"{self.strength_path}/batch_id={batch_id}")
        if batch_id > 1:
            remove(spark, self._table(batch_id - 2))
