"""Event-time state per session: slots that fire once, state that survives restarts, strength by differences."""

from collections import namedtuple
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketpulse.operators import intraday as I
from marketpulse.operators.strength import group_strength
from marketpulse.plans import jobs as J
from marketpulse.schemas import TICKS
from marketpulse.streaming import sessions as W

D = date(2024, 1, 15)
Tick = namedtuple("Tick", "phase hhmm seq price turnover")


def ticks_at(spark, points):
    """points: (code, day, seq, 'HH:MM:SS', price, turnover); before 09:25 is the auction."""
    data = []
    for code, day, seq, at, price, turnover in points:
        ts = datetime.combine(D + timedelta(days=day), datetime.strptime(at, "%H:%M:%S").time())
        data.append((code, ts.date(), "pre_market" if at < "09:25" else "trading", seq, ts, at[:5], price, price, 1.0, turnover, 0.0, 0.0, 0.0))
    return spark.createDataFrame(data, TICKS)


@pytest.fixture
def feed(spark, tmp_path):
    W.state_settings(spark)
    path = str(tmp_path / "feed")
    ticks_at(spark, []).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(path)

    def run(points, df, each, log="log"):
        ticks_at(spark, points).coalesce(1).write.mode("append").parquet(path)
        q = df.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / log)).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    return stream, run


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["pre_market", "trading"]), st.integers(0, 9), st.one_of(st.none(), st.integers(1, 5))), max_size=25, unique_by=lambda x: x[1]), st.randoms())
def test_sketches_do_not_depend_on_order_or_repeats(points, rnd):
    ticks = [Tick(phase, f"09:{30 + seq // 3}", seq, price, float(seq)) for phase, seq, price in points]
    want = W.fold(W.EMPTY, sorted(ticks, key=lambda t: t.seq))
    mixed = ticks + [t for t in ticks if rnd.random() < 0.5]
    rnd.shuffle(mixed)
    cut = rnd.randint(0, len(mixed))
    assert W._sketch(W.fold(W._sketch(W.fold(W.EMPTY, mixed[:cut])), mixed[cut:])) == want
    trading = sorted((t for t in ticks if t.phase == "trading"), key=lambda t: t.seq)
    assert W.quote(want)["tail"] == [t.price for t in trading[-3:]]
    assert want[4] == max((t.price for t in trading if t.price is not None), default=None)


MORNING = [("a", 0, 1, "09:20:00", 10.0, 0.0), ("b", 0, 2, "09:21:00", 20.0, 0.0), ("a", 0, 3, "09:31:00", 11.0, 700.0), ("a", 0, 4, "09:32:30", 10.2, 800.0)]


def test_slots_fire_once_over_all_ticks_up_to_them(spark, feed, tmp_path):
    stream, run = feed
    out, seen = str(tmp_path / "out"), []
    quotes = W.slot_quotes(stream, {"933": "09:33", "1000": "10:00"})
    write = W.fire_slots(lambda bars: bars, out)

    def each(batch, batch_id):
        seen.append(batch_id)
        write(batch, batch_id)
        write(batch, batch_id)  # a replay

    run(MORNING, quotes, each)
    run([("b", 0, 5, "09:33:59", 21.0, 50.0), ("b", 0, 6, "09:34:00", 29.0, 60.0)], quotes, each)  # the watermark is at 09:32
    run([("a", 0, 7, "09:40:00", 99.0, 900.0)], quotes, each)  # restarts from the checkpoint; 09:33 passes in a silent minute
    run([("c", 0, 8, "11:00:00", 5.0, 1.0), ("d", 1, 9, "15:00:00", 6.0, 1.0), ("d", 2, 10, "09:00:00", 6.5, 1.0)], quotes, each)
    run([("e", 1, 11, "15:30:00", 6.0, 1.0)], quotes, each)  # a late tick of another day
    got = {(str(r.slot), r.trade_date.day, r.code): r for r in spark.read.parquet(out).collect()}
    a, b = got["933", 15, "a"], got["933", 15, "b"]
    assert (a.pre_close, a.open, a.high, a.close, a.amount) == (10.0, 10.0, 11.0, 10.2, 800.0) and a.change_ratio == pytest.approx(2.0)
    assert (b.pre_close, b.high, b.close, b.amount) == (20.0, 21.0, 21.0, 50.0)
    assert got["1000", 15, "a"].close == 99.0 and got["1000", 15, "b"].close == 29.0
    assert ("1000", 15, "c") not in got and ("933", 16, None) in got and ("1000", 16, None) in got  # d came after the slots: its date has an empty one
    rows = spark.read.parquet(out)
    assert rows.groupBy("slot", "trade_date").agg(F.count_distinct("batch_id").alias("n")).where("n > 1").count() == 0
    assert len(seen) >= 5
    batch = {r.code: r for r in I.as_of_bars(ticks_at(spark, MORNING + [("b", 0, 5, "09:33:59", 21.0, 50.0)]), "09:33").collect()}
    assert (batch["a"].close, batch["a"].high, batch["b"].amount) == (10.2, 11.0, 50.0)


def test_digests_of_slots_with_own_conditions(spark, rows):
    bars = rows([("933", D, "600001.SH", 10.0, 10.0, 10.5, 10.1, 7e8, 1.0, "x"), ("933", D, "600002.SH", 10.0, 10.0, 10.1, 10.1, 7e8, 1.0, "y"),
                 ("1430", D, "600001.SH", 10.0, 10.0, 11.0, 10.9, 7e8, 9.0, "ST x"), ("945", D, None, None, None, None, None, None, None, None)],
                "slot string, trade_date date, code string, pre_close double, open double, high double, close double, amount double, change_ratio double, name string")
    members = rows([("g", "n", "600001.SH"), ("g", "n", "600002.SH")], "group_id string, group_name string, code string")
    old = rows([(date(2024, 1, d), "600001.SH") for d in range(1, 16)] + [(D, "600002.SH")], "trade_date date, code string")
    got = {(r.slot, r.scope): (r.pool_size, r.hit_total) for r in J.slot_digests(bars, members, members, members, old).collect()}
    assert got == {(s, c): (1, 1) if s == "933" else (0, 0) for s in ("933", "945", "1430") for c in ("custom", "market")}


def test_state_survives_restarts_and_ends(spark, feed, tmp_path):
    stream, run = feed
    changes, updated = W.quote_changes(stream), []
    ignore = lambda batch, _: batch.write.format("noop").mode("overwrite").save()
    many = [(f"k{i}", 0, 100 + i, "09:31:00", 10.0, 1.0) for i in range(40)]
    all_ = []
    for points in (MORNING + many, [("a", 0, 7, "09:40:00", 12.0, 900.0)], [("a", 0, 7, "09:40:00", 12.0, 900.0), ("b", 0, 8, "09:41:00", 21.0, 5.0)]):
        q = run(points, changes, ignore)
        all_ += points
        updated.append(max(p.stateOperators[0].numRowsUpdated for p in q.recentProgress))
    assert updated[1] <= 2 and updated[2] <= 4  # work goes with the batch, not with the 42 sessions
    log = str(tmp_path / "log")
    assert sorted(map(tuple, W.stored_quotes(spark, log).collect())) == sorted(map(tuple, I.indicators(ticks_at(spark, list(dict.fromkeys(all_)))).collect()))
    run([("a", 3, 9, "10:00:00", 1.0, 1.0)], changes, ignore)
    assert {r.trade_date.day for r in W.stored_quotes(spark, log).collect()} == {18}


def test_strength_by_differences_equals_batch_strength(spark, feed, tmp_path):
    stream, run = feed
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "b"), ("h", "c"), ("h", "c")], "group_id string, code string")
    delta = W.StrengthByDelta(str(tmp_path / "s"), members, min_members=1, precision=None)
    merged = []

    def each(batch, batch_id):
        kept = batch.sparkSession.createDataFrame(batch.collect(), batch.schema)
        delta.merge(kept, batch_id)
        delta.merge(kept, batch_id)  # a replay
        merged.append(batch_id)

    changes, all_ = W.quote_changes(stream), []
    for points in (MORNING, [("a", 0, 7, "09:40:00", 12.0, 900.0), ("c", 0, 8, "09:41:00", 3.0, 1.0)], [("c", 0, 9, "09:42:00", 4.0, 1.0), ("b", 1, 10, "09:30:00", 1.0, 1.0)]):
        before = len(merged)
        run(points, changes, each)
        all_ += points
        now = [spark.read.parquet(f"{delta.strength_path}/batch_id={i}") for i in merged[before:]]
        got = {(r.trade_date, r.group_id): r for df in now for r in df.collect()}
        want = group_strength(I.indicators(ticks_at(spark, all_)), members, min_members=1, precision=None).collect()
        days = {D + timedelta(days=p[1]) for p in points}
        assert {k for k in got} == {(r.trade_date, r.group_id) for r in want if r.trade_date in days}
        for r in want:
            if r.trade_date in days:
                g = got[r.trade_date, r.group_id]
                assert (g.member_count, g.rank_1d) == (r.member_count, r.rank_1d)
                assert [g.s1_return, g.s2_breadth, g.s4_relative, g.s_body, g.score] == pytest.approx([r.s1_return, r.s2_breadth, r.s4_relative, r.s_body, r.score])
