from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import intraday as I
from marketpulse.operators import latest as L
from marketpulse.operators import members as P
from marketpulse.plans import dashboards as B
from marketpulse.schemas import TICKS

D = date(2024, 1, 15)


def tick(code, phase, seq, hhmm, price, turnover=0.0, buy=0.0, sell=0.0, vol=0.0):
    ts = datetime(2024, 1, 15, *map(int, hhmm.split(":")))
    return (code, D, phase, seq, ts, hhmm, price, price, 1.0, turnover, vol, buy, sell)


@pytest.fixture
def ticks(spark):
    data = [tick("a", "pre_market", 1, "09:15", 100.0), tick("a", "pre_market", 2, "09:25", 100.0)]
    data += [tick("a", "trading", 10 + i, f"09:3{i}", p, 10.0 * (i + 1)) for i, p in enumerate([100.0, 101.0, 103.0, 102.0])]
    data += [tick("pre", "pre_market", 1, "09:15", 10.0), tick("pre", "pre_market", 2, "09:20", 11.0)]
    data += [tick("zero", "trading", 1, "09:30", 5.0), tick("zero", "trading", 2, "09:31", 0.0), tick("zero", "trading", 3, "09:31", 10.0)]
    data += [tick("nobase", "pre_market", 1, "09:15", 0.0), tick("nobase", "trading", 2, "09:31", 10.0)]
    return spark.createDataFrame(data, TICKS)


def at(df):
    return {r.code: r for r in df.collect()}


def test_as_of_minute(ticks):
    got = at(I.indicators(ticks, "09:32"))
    a = got["a"]
    assert a.change_ratio == pytest.approx(3.0) and a.body == pytest.approx(3.0) and a.amount == 30.0
    assert a.speed == pytest.approx((103 / 101 - 1) * 100)
    assert a.acceleration == pytest.approx(a.speed - (101 / 100 - 1) * 100)
    assert "nobase" not in got


def test_auction_phase_knows_only_the_change(ticks):
    r = at(I.indicators(ticks))["pre"]
    assert (r.speed, r.body, r.acceleration, r.amount) == (0.0, 0.0, 0.0, 0.0)
    assert r.change_ratio == pytest.approx(10.0)


def test_zero_price_in_the_tail(ticks):
    r = at(I.indicators(ticks))["zero"]
    assert r.speed == pytest.approx(100.0)          # skips the invalid price
    assert r.acceleration == pytest.approx(0.0 + 100.0)  # does not


def test_no_tick_yet_drops_out(ticks):
    assert set(at(I.indicators(ticks, "09:16", resolve=False))) == {"a", "pre"}


def test_early_times_mean_latest(ticks):
    got = L.resolve_snapshot(ticks, "08:00").collect()[0]
    assert (got.first_time, got.latest_time, got.snapshot_time) == ("09:15", "09:33", "09:33")
    assert L.resolve_snapshot(ticks, "latest").collect()[0].snapshot_time == "09:33"


def test_compact_ticks_merge(ticks):
    whole = I.indicators(ticks).collect()
    parts = I.compact_ticks(ticks.filter("seq < 12")).unionByName(ticks.filter("seq >= 11"))
    merged = I.compact_ticks(I.compact_ticks(parts).unionByName(parts))
    assert sorted(map(tuple, I.indicators(merged).collect())) == sorted(map(tuple, whole))
    assert merged.groupBy("code").count().agg({"count": "max"}).first()[0] <= 6


def test_series_and_summary(ticks):
    series = {r.seq: r.speed for r in I.speed_series(ticks).filter("code = 'a'").collect()}
    assert series[10] == 0.0 and series[12] == pytest.approx((103 / 101 - 1) * 100)
    s = at(I.tick_summary(ticks))["a"]
    assert (s.n_points, s.sample_0, s.sample_1, s.sample_2, s.sample_3, s.sample_4) == (4, 100, 101, 103, 102, 102)
    assert s.high_change == pytest.approx(3.0) and s.tail_change == pytest.approx(2.0) and s.turnover == 40.0


def test_replay_equals_every_snapshot(spark, ticks):
    members = spark.createDataFrame([("g", "a"), ("g", "zero"), ("h", "a"), ("h", "pre"), ("h", "nobase")],
                                    "group_id string, code string")
    groups = spark.createDataFrame([("g", "G"), ("h", "H")], "group_id string, group_name string")
    names = spark.createDataFrame([("g", "a", "A", D)], "group_id string, code string, name string, as_of date")
    replay = {}
    for r in B.replay(ticks, members, min_members=1).collect():
        replay.setdefault(r.hhmm, {})[r.group_id] = (r.s1_return, r.s2_breadth, r.s_body, r.member_count, r.score)
    assert sorted(replay) == ["09:15", "09:20", "09:25", "09:30", "09:31", "09:32", "09:33"]
    for minute, got in replay.items():
        board = B.intraday_dashboard(ticks, members, groups, names, minute, min_members=1)
        want = {r.group_id: (r.s1_return, r.s2_breadth, r.s_body, r.member_count, r.score)
                for r in board.groups.filter("section = 'top'").collect()}
        assert set(want) == set(got)
        for g in want:
            assert got[g] == pytest.approx(want[g], abs=1e-9)


def test_drilldown_sorts_before_cutting(spark):
    data = []
    for i in range(12):
        data += [tick(f"c{i:02d}", "trading", 1, "09:30", 100.0), tick(f"c{i:02d}", "trading", 2, "09:31", 100.0 + i)]
    ticks = spark.createDataFrame(data, TICKS)
    members = spark.createDataFrame([("g", f"c{i:02d}") for i in range(12)], "group_id string, code string")
    names = spark.createDataFrame([("g", "c01", "one", D)], "group_id string, code string, name string, as_of date")
    got = sorted(B.member_drilldown(ticks, members, names, key="speed", limit=10).collect(), key=lambda r: r.pos)
    assert [r.code for r in got] == [f"c{i:02d}" for i in range(11, 1, -1)]
    assert {r.member_count for r in got} == {12} and got[0].name == ""


def test_ranking_tells_figures_apart_beyond_nine_digits(rows):
    near = 1.0 + 2e-10
    scored = rows([(D, "g", "a", 1.0, 1.0, 3.0), (D, "g", "b", near, near, 2.0), (D, "g", "c", near, 1.0, 1.0), (D, "g", "d", 0.5, 2.0, 9.0)],
                  "trade_date date, group_id string, code string, speed double, change_ratio double, score double")

    def order(*how):
        return [r.code for r in sorted(P.member_ranking(scored, *how).collect(), key=lambda r: r.pos)]

    assert order("speed") == ["b", "c", "a", "d"]
    assert order("change_ratio", False) == ["a", "c", "b", "d"]
    steady = scored.withColumn("score", F.when(F.col("code") == "b", 3.0 + 1e-12).otherwise(F.col("score")))
    assert [r.code for r in sorted(P.member_ranking(steady).collect(), key=lambda r: r.pos)] == ["d", "a", "b", "c"]
