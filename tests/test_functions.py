from datetime import datetime

from pyspark.sql import functions as F

from marketpulse.functions import clock
from marketpulse.functions import codes as C
from marketpulse.functions import measures as M


def test_codes(rows):
    df = rows([("600519.SH",), ("300001.SZ",), ("688001.SH",), ("830001.BJ",), ("00700.HK",), (None,)], "code string")
    got = df.select("code", C.is_domestic().alias("d"), C.board().alias("b"), C.vendor_code().alias("v")).collect()
    assert [r.d for r in got] == [True, True, True, True, False, False]
    assert [r.b for r in got[:5]] == ["main", "gem_star", "gem_star", "bj", "main"]
    assert got[0].v == "SH600519"


def test_limit_up_thresholds(rows):
    data = [("600000.SH", 9.8), ("600000.SH", 9.79), ("300001.SZ", 19.5), ("300001.SZ", 10.0), ("830001.BJ", 29.0),
            ("830001.BJ", 28.9), ("600000.SH", None), ("600000.SH", float("nan"))]
    got = [r[0] for r in rows(data, "code string, change_ratio double").select(C.is_limit_up()).collect()]
    assert got == [True, False, True, False, True, False, False, False]


def test_group_rules(rows):
    df = rows([("884001.TI", " zt one"), ("700001.TI", "CC"), ("861001.US", "cc"), (None, None)],
              "group_id string, group_name string")
    got = df.select(C.is_domestic_group(), C.is_observed_group(), C.is_zt(), C.is_holding_group()).collect()
    assert [tuple(r) for r in got] == [(True, True, True, False), (True, False, False, True),
                                       (False, False, False, False), (False, False, False, False)]


def test_bands_and_rounding(rows):
    df = rows([(9.8,), (5.0,), (0.01,), (0.0,), (-1.0,), (None,)], "c double")
    assert [r[0] for r in df.select(M.return_band("c")).collect()] == ["limit", "strong", "up", "flat", "down", "flat"]
    assert [r[0] for r in df.select(M.direction("c")).collect()] == ["up", "up", "up", "", "down", ""]
    shades = rows([(2.5, "top"), (1.0, "top"), (-2.0, "bottom"), (0.5, "zt")], "s double, k string")
    assert [r[0] for r in shades.select(M.score_shade("s", "k")).collect()] == [2, 1, 2, 0]
    marks = rows([(0.02,), (-0.02,), (0.01,)], "a double")
    assert [r[0] for r in marks.select(M.acceleration_mark("a")).collect()] == ["rising", "falling", "steady"]


def test_zero_bases_never_raise(rows):
    df = rows([(1.0, 0.0), (None, 2.0), (3.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(M.pct_change("a", "b")).collect()] == [None, None, None, 50.0]
    assert [r[0] for r in df.select(M.body_pct("b", "a")).collect()] == [0.0, 0.0, 0.0, 50.0]


def test_speed_and_acceleration(rows):
    data = [([1.0, 2.0, 3.0],), ([2.0, 0.0, 3.0],), ([2.0, 3.0],), ([2.0],), ([],), ([2.0, 4.0, 0.0],)]
    got = rows(data, "t array<double>").select(M.speed("t"), M.acceleration("t")).collect()
    assert [tuple(r) for r in got] == [
        (50.0, 50.0 - 100.0), (50.0, 0.0 - -100.0), (50.0, 50.0), (0.0, 0.0), (0.0, 0.0), (100.0, -100.0 - 100.0)]


def test_missing_to_null(rows):
    df = M.missing_to_null(rows([(float("nan"), "a"), (1.0, "b")], "x double, s string"))
    assert [r.x for r in df.collect()] == [None, 1.0]


def test_session_phases(rows):
    times = ["09:14", "09:15", "09:25", "09:30", "11:30", "13:00", "15:00"]
    df = rows([(datetime(2024, 1, 15, *map(int, t.split(":"))), True) for t in times]
              + [(datetime(2024, 1, 14, 10, 0), False)], "ts timestamp, td boolean")
    phased = df.withColumn("p", clock.session_phase("ts", "td"))
    got = phased.select("p", clock.next_open_time("p").alias("n"), clock.in_session("p").alias("i"),
                        clock.stream_gate("p", F.col("td")).alias("g")).collect()
    assert [r.p for r in got] == ["pre_open", "auction", "pre_morning", "morning", "lunch", "afternoon", "closed", "closed"]
    assert [r.n for r in got] == ["09:15", None, None, None, None, None, "09:15", "09:15"]
    assert [r.i for r in got] == [False, True, True, True, True, True, False, False]
    assert [r.g for r in got] == [False, True, True, True, True, True, True, False]
