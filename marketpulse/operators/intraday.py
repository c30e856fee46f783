"""Per-instrument figures from intraday ticks, as of any minute.

A third of all ticks may belong to one instrument. Nothing here sorts a whole
instrument in one task: anchors are combining aggregates, tails use the
pre-shuffle pruning of ``row_number() <= k``, and full orderings are split by
minute and stitched together over at most 1,440 minute rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions import measures as M
from marketpulse.operators.latest import resolve_snapshot
from marketpulse.operators.ranking import top_per_group
from marketpulse.schemas import PRE_MARKET, TRADING

KEY = ("trade_date", "code")
TAIL = 3


def _is(phase: str):
    return F.col("phase") == phase


def _newest_first():
    """Trading points before auction points, each newest first."""
    return [_is(TRADING).desc(), F.col("hhmm").desc(), F.col("seq").desc()]


def session_anchors(ticks: DataFrame) -> DataFrame:
    """Pre-close and open per instrument and session.

    Pre-close is the first auction reference price and the open the last one;
    without auction points both are the first trading price.
    """
    return (
        ticks.groupBy(*KEY).agg(
            F.min_by(F.when(_is(PRE_MARKET), F.col("price")), F.when(_is(PRE_MARKET), F.col("seq"))).alias("pre_first"),
            F.max_by(F.when(_is(PRE_MARKET), F.col("price")), F.when(_is(PRE_MARKET), F.col("seq"))).alias("pre_last"),
            F.min_by(F.when(_is(TRADING), F.col("price")), F.when(_is(TRADING), F.col("seq"))).alias("trade_first"),
        )
        .select(*KEY, F.coalesce("pre_first", "trade_first").alias("pre_close"),
                F.coalesce("pre_last", "trade_first").alias("open"))
    )


def cut_ticks(ticks: DataFrame, at=None) -> DataFrame:
    """Ticks up to a minute: None keeps all, a text cuts every session alike, a
    frame ``(trade_date, snapshot_time)`` cuts each session at its own minute."""
    if at is None:
        return ticks
    if isinstance(at, str):
        return ticks.filter(F.col("hhmm") <= at)
    bounds = F.broadcast(at.select("trade_date", "snapshot_time"))
    return ticks.join(bounds, "trade_date").filter(F.col("hhmm") <= F.col("snapshot_time")).drop("snapshot_time")


def with_metrics(states: DataFrame) -> DataFrame:
    """F1-F7 from ``tail`` (trailing trading prices, oldest first), ``pre_price``
    (last auction price), ``turnover`` and the session anchors.

    In the auction phase only the change is known; the other figures are 0.
    Instruments without a usable pre-close or without any price drop out.
    """
    traded = F.size("tail") > 0
    last = F.when(traded, F.try_element_at("tail", F.lit(-1))).otherwise(F.col("pre_price"))

    def live(value):
        return F.when(traded, value).otherwise(0.0)

    keep = [c for c in states.columns if c not in ("tail", "pre_price", "turnover", "pre_close", "open")]
    return (
        states.filter((F.col("pre_close") != 0) & (traded | F.col("pre_price").isNotNull()))
        .select(
            *keep,
            M.pct_change(last, "pre_close").alias("change_ratio"),
            live(M.speed("tail")).alias("speed"),
            live(M.body_pct("open", last)).alias("body"),
            live(M.acceleration("tail")).alias("acceleration"),
            live(F.coalesce("turnover", F.lit(0.0))).alias("amount"),
        )
    )


def _tails(newest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Collapse the newest points per key (``pos`` from 1) into a state row."""

    def trade(i, c="price"):
        return F.max(F.when((F.col("pos") == i) & _is(TRADING), F.col(c)))

    def traded(i):
        return F.max(F.when(F.col("pos") == i, _is(TRADING)))

    slots = newest.groupBy(*keys).agg(
        *[F.struct(trade(i).alias("p"), F.coalesce(traded(i), F.lit(False)).alias("ok")).alias(f"s{i}")
          for i in range(1, TAIL + 1)],
        trade(1, "turnover").alias("turnover"),
        F.max(F.when((F.col("pos") == 1) & _is(PRE_MARKET), F.col("price"))).alias("pre_price"),
    )
    filled = F.filter(F.array(*[F.col(f"s{i}") for i in range(TAIL, 0, -1)]), lambda s: s["ok"])
    return slots.select(*keys, F.transform(filled, lambda s: s["p"]).alias("tail"), "pre_price", "turnover")


def as_of_ticks(ticks: DataFrame, at=None, anchors: DataFrame | None = None) -> DataFrame:
    """State per instrument and session at a minute.

    The last three trading points up to the minute, or the last auction point
    when there is no trading yet, next to the session anchors (which always
    come from the whole session); ``anchors`` are those of ``ticks``, where they are known.
    """
    newest = top_per_group(
        cut_ticks(ticks, at).select(*KEY, "phase", "hhmm", "seq", "price", "turnover"),
        KEY, _newest_first(), TAIL)
    return _tails(newest, KEY).join(session_anchors(ticks) if anchors is None else anchors, list(KEY))


def indicators(ticks: DataFrame, at=None, resolve: bool = True, anchors: DataFrame | None = None) -> DataFrame:
    """D8 with F1-F7: change, speed, body, acceleration, amount per instrument.

    A text minute goes through D10 first unless ``resolve`` is off.
    """
    if isinstance(at, str):
        at = None if at in ("", "latest") else at
    if isinstance(at, str) and resolve:
        at = resolve_snapshot(ticks, at)
    return with_metrics(as_of_ticks(ticks, at, anchors))


def as_of_bars(ticks: DataFrame, at=None) -> DataFrame:
    """C12 on ticks: a bar per instrument and session as of a minute (see ``cut_ticks``).

    Everything is known at that minute: the anchors of the ticks up to it, the highest
    trading price, the last price (of the auction while nothing has traded) and the
    cumulative turnover. One combining aggregate.
    """
    return session_bars(cut_ticks(ticks, at))


def session_bars(ticks: DataFrame, *also: Column) -> DataFrame:
    """The bars of ``as_of_bars`` from ticks that are cut already, batch or stream; ``also`` are further grouping columns, left out of the result."""
    trading = lambda c: F.when(_is(TRADING), c)
    auction = lambda c: F.when(_is(PRE_MARKET), c)
    place = F.struct("hhmm", "seq")
    state = ticks.groupBy(*KEY, *also).agg(
        F.min_by(F.struct(auction(F.col("price")).alias("p")), auction(F.col("seq"))).alias("a"),
        F.max_by(F.struct(auction(F.col("price")).alias("p")), auction(F.col("seq"))).alias("z"),
        F.min_by(F.struct(trading(F.col("price")).alias("p")), trading(F.col("seq"))).alias("t"),
        F.max_by(F.struct("price", "turnover"), trading(place)).alias("last"), F.max(trading(F.col("price"))).alias("high"))
    bars = state.select(
        *KEY, F.coalesce("a.p", "t.p").alias("pre_close"), F.coalesce("z.p", "t.p").alias("open"), "high",
        F.when(F.col("last").isNotNull(), F.col("last.price")).otherwise(F.col("z.p")).alias("close"),
        F.coalesce("last.turnover", F.lit(0.0)).alias("amount"))
    return bars.withColumn("change_ratio", M.pct_change("close", "pre_close"))


def running_highs(ticks: DataFrame) -> DataFrame:
    """The highest trading price up to every minute of an instrument's session, and the gain it makes.

    Minutes are reduced to their maximum before the shuffle; the running maximum then
    sees at most 1,440 rows of a session, however many ticks it has. The base is the first
    auction price or, without one, the first trading price.
    """
    keys = [*KEY, "hhmm"]
    minutes = ticks.filter(_is(TRADING)).groupBy(*keys).agg(F.max("price").alias("minute_high"))
    so_far = Window.partitionBy(*KEY).orderBy("hhmm").rowsBetween(Window.unboundedPreceding, 0)
    return (
        minutes.withColumn("high", F.max("minute_high").over(so_far))
        .join(session_anchors(ticks).select(*KEY, "pre_close"), list(KEY))
        .select(*keys, "high", M.pct_change("high", "pre_close").alias("max_gain"))
    )


def compact_ticks(ticks: DataFrame) -> DataFrame:
    """The few ticks that determine the latest state of each instrument.

    First and last auction point, first trading point and the last three
    trading points: at most six rows per instrument and session. Compacting a
    union of compacted parts gives the same rows, repeated ticks or not, so this
    is a mergeable state.
    """
    ticks = ticks.dropDuplicates([*KEY, "phase", "seq"])
    spec = Window.partitionBy(*KEY, "phase")
    up = F.row_number().over(spec.orderBy(F.col("seq").asc()))
    down = F.row_number().over(spec.orderBy(F.col("hhmm").desc(), F.col("seq").desc()))
    first = ticks.withColumn("__r", up).filter(F.col("__r") <= 1)
    last = ticks.withColumn("__r", down).filter(F.col("__r") <= TAIL)
    return first.unionByName(last).drop("__r").dropDuplicates([*KEY, "phase", "seq"])


def minute_positions(ticks: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Number the points of each key from 0 in (hhmm, seq) order, as ``idx``.

    Points are numbered inside their minute and shifted by the count of all
    earlier minutes of the key.
    """
    inside = Window.partitionBy(*keys, "hhmm").orderBy("seq")
    before = Window.partitionBy(*keys).orderBy("hhmm").rowsBetween(Window.unboundedPreceding, -1)
    minutes = ticks.groupBy(*keys, "hhmm").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    offsets = minutes.select(
        *keys, "hhmm", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), total.alias("n_points"))
    return (
        ticks.withColumn("__in", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "hhmm"])
        .withColumn("idx", F.col("__offset") + F.col("__in"))
        .drop("__in", "__offset")
    )


def speed_series(ticks: DataFrame) -> DataFrame:
    """Step of every trading point against its predecessor; first is 0.

    Inside a minute the predecessor is a lag; the first point of a minute takes
    the last price of the instrument's previous minute.
    """
    trading = ticks.filter(_is(TRADING)).select(*KEY, "hhmm", "seq", "price")
    inside = Window.partitionBy(*KEY, "hhmm").orderBy("seq")
    closes = trading.groupBy(*KEY, "hhmm").agg(F.max_by(F.struct("price"), "seq").alias("__close"))
    earlier = closes.select(
        *KEY, "hhmm", F.lag("__close").over(Window.partitionBy(*KEY).orderBy("hhmm")).alias("__earlier"))
    prev = F.coalesce(F.col("__lag"), F.col("__earlier"))["price"]
    return (
        trading.withColumn("__lag", F.lag(F.struct("price")).over(inside))
        .join(earlier, [*KEY, "hhmm"])
        .select(*KEY, "hhmm", "seq", "price", M.step_pct(prev, "price").alias("speed"))
    )


def tick_summary(ticks: DataFrame, tail: int = 30) -> DataFrame:
    """session figures per instrument against its first auction price.

    Open/close/high/low changes, the change over the last ``tail`` points, the
    final turnover and five prices sampled at 0, 1/4, 1/2, 3/4 and the end.
    Changes are 0 when there was no auction price.
    """
    trading = ticks.filter(_is(TRADING))
    base = (
        ticks.filter(_is(PRE_MARKET) & (F.col("price") != 0))
        .groupBy(*KEY).agg(F.min_by("price", "seq").alias("pre_close"))
    )
    n = F.col("n_points")
    marks = [F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4), n - 1]
    placed = minute_positions(trading.select(*KEY, "hhmm", "seq", "price", "turnover"))
    idx = F.col("idx")
    figures = placed.groupBy(*KEY).agg(
        F.max("n_points").alias("n_points"),
        *[F.max(F.when(idx == m, F.col("price"))).alias(f"sample_{i}") for i, m in enumerate(marks)],
        F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.max(F.when(idx == n - 1, F.col("turnover"))).alias("turnover"),
        F.max(F.when(idx == F.greatest(n - tail, F.lit(0)), F.col("price"))).alias("tail_price"),
    )

    def versus_base(price):
        return F.when(F.col("pre_close") > 0, M.pct_change(price, "pre_close")).otherwise(0.0)

    return figures.join(base, list(KEY), "left").select(
        *KEY, "n_points", "pre_close",
        versus_base("sample_0").alias("open_change"),
        versus_base("sample_4").alias("close_change"),
        versus_base("high_price").alias("high_change"),
        versus_base("low_price").alias("low_change"),
        F.when(n >= 2, F.coalesce(M.pct_change("sample_4", "tail_price"), F.lit(0.0)))
        .otherwise(0.0).alias("tail_change"),
        "turnover", *[f"sample_{i}" for i in range(5)],
    )


def minute_states(ticks: DataFrame) -> DataFrame:
    """State intervals per instrument: valid from ``hhmm`` until ``next_hhmm``.

    The newest three points of every minute are kept before the shuffle; the
    carry-forward then runs over minute rows, at most 1,440 per instrument and
    session. Auction minutes count only until the first trading minute.
    """
    keys = [*KEY, "hhmm"]
    newest = top_per_group(
        ticks.select(*keys, "phase", "seq", "price", "turnover"), keys, _newest_first(), TAIL)
    per_minute = _tails(newest, keys)
    whole = Window.partitionBy(*KEY)
    ordered = whole.orderBy("hhmm")
    traded = F.size("tail") > 0
    first_trade = F.min(F.when(traded, F.col("hhmm"))).over(whole)
    live = (
        per_minute.withColumn("__first_trade", first_trade)
        .filter(traded | F.col("__first_trade").isNull() | (F.col("hhmm") < F.col("__first_trade")))
        .drop("__first_trade")
    )
    none = F.array().cast("array<double>")
    earlier = F.concat(F.coalesce(F.lag("tail", 2).over(ordered), none),
                       F.coalesce(F.lag("tail", 1).over(ordered), none), F.col("tail"))
    size = F.size("__all")
    return (
        live.withColumn("__all", F.when(traded, earlier).otherwise(none))
        .withColumn("next_hhmm", F.lead("hhmm").over(ordered))
        .withColumn("tail", F.slice("__all", F.greatest(size - (TAIL - 1), F.lit(1)), TAIL))
        .drop("__all")
    )


def session_axes(ticks: DataFrame) -> DataFrame:
    """Each session's sorted minute axis as one array of at most 1,440 entries."""
    return ticks.groupBy("trade_date").agg(F.array_sort(F.collect_set("hhmm")).alias("axis"))


EXACT = "decimal(32,14)"
STEP_SUMS = ("change", "body", "up", "n")


def replay_steps(ticks: DataFrame) -> DataFrame:
    """What each new state of an instrument changes in the sums it enters.

    One row per (instrument, minute with a new state): the differences of
    change, body, up flag and count against the instrument's previous state.
    """
    states = with_metrics(minute_states(ticks).drop("next_hhmm").join(session_anchors(ticks), list(KEY)))
    valued = states.select(
        *KEY, "hhmm", F.col("change_ratio").cast(EXACT).alias("change"), F.col("body").cast(EXACT).alias("body"),
        (F.col("change_ratio") > 0).cast("int").alias("up"), F.lit(1).alias("n"))
    ordered = Window.partitionBy(*KEY).orderBy("hhmm")

    def step(c):
        return (F.col(c) - F.coalesce(F.lag(c).over(ordered), F.lit(0))).alias(c)

    return valued.select(*KEY, "hhmm", *[step(c) for c in STEP_SUMS])


def running_totals(steps: DataFrame, keys: Sequence[str], axes: DataFrame) -> DataFrame:
    """Totals of each key at every axis minute from its first step on.

    Steps of a minute add up in a combining aggregate; the running sums see one
    row per minute of a key, and each total is spread over the axis minutes
    until the key's next step.
    """
    summed = steps.groupBy(*keys, "hhmm").agg(*[F.sum(c).alias(c) for c in STEP_SUMS])
    ordered = Window.partitionBy(*keys).orderBy("hhmm")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    totals = summed.select(
        *keys, "hhmm", F.lead("hhmm").over(ordered).alias("__next"),
        *[F.sum(c).over(so_far).cast("double" if c in ("change", "body") else "long").alias(c) for c in STEP_SUMS])
    start = F.array_position("axis", F.col("hhmm"))
    end = F.coalesce(F.array_position("axis", F.col("__next")), F.size("axis") + 1)
    minutes = F.slice("axis", start.cast("int"), (end - start).cast("int"))
    return totals.join(axes, "trade_date").select(*keys, F.explode(minutes).alias("hhmm"), *STEP_SUMS)
