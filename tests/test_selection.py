from datetime import date

from pyspark.sql import functions as F

from marketpulse.operators import latest as L
from marketpulse.operators import scopes as Z
from marketpulse.operators import tradingdays as T

OLD, NEW = date(2024, 1, 1), date(2024, 1, 15)
MEMBERS = "group_id string, code string, name string, as_of date"


def pairs(df):
    return sorted((r.group_id, r.code) for r in df.collect())


def test_three_kinds_of_latest(rows):
    m = rows([("g", "1", "", OLD), ("g", "2", "", OLD), ("h", "2", "", OLD), ("h", "2", "", NEW), ("h", "3", "", NEW)], MEMBERS)
    assert pairs(L.latest_by(m, ["group_id"])) == [("g", "1"), ("g", "2"), ("h", "2"), ("h", "3")]
    assert pairs(L.latest_by(m, ["code"])) == [("g", "1"), ("h", "2"), ("h", "3")]
    assert pairs(L.latest_by(m, [])) == [("h", "2"), ("h", "3")]
    one = L.latest_by(m.filter("group_id = 'h'"), ["group_id"])
    assert pairs(one) == pairs(L.latest_by(m, ["group_id"]).filter("group_id = 'h'"))


def test_size_limits_are_inclusive(rows):
    sizes = {"s9": 9, "s10": 10, "s500": 500, "s501": 501}
    m = rows([(g, str(i), "", NEW) for g, n in sizes.items() for i in range(n)], MEMBERS)
    assert sorted(r.group_id for r in Z.monitorable(m).collect()) == ["s10", "s500"]
    wanted = rows([(g,) for g in [*sizes, "absent"]], "group_id string")
    ok, rest = Z.eligible_selection(wanted, m)
    assert ok.count() == 2 and sorted(r.group_id for r in rest.collect()) == ["absent", "s501", "s9"]


def test_scope_falls_back_only_when_empty(rows):
    m = rows([("884001.TI", str(i), "", NEW) for i in range(10)], MEMBERS)
    groups = rows([("884001.TI", "a"), ("884002.TI", "b"), ("861001.US", "c"), ("881001.TI", "d")], "group_id string, group_name string")
    pool = rows([("884002.TI",)], "group_id string")
    chosen = rows([("884001.TI",), ("884002.TI",)], "group_id string")
    assert [r.group_id for r in Z.effective_scope(chosen, groups, m, pool).collect()] == ["884001.TI"]
    none = rows([("884002.TI",)], "group_id string")
    assert [r.group_id for r in Z.effective_scope(none, groups, m, pool).collect()] == ["884002.TI"]


def test_union_of_scopes(rows):
    m = rows([("a", "1", "", NEW), ("a", "2", "", NEW), ("b", "2", "", NEW), ("b", "3", "", NEW)], MEMBERS)
    both = rows([("a",), ("b",)], "group_id string")
    assert sorted(r.code for r in Z.universe("groups", m, both).collect()) == ["1", "2", "3"]


def test_new_listings(rows):
    days = [date(2024, 1, d) for d in range(1, 8)]
    bars = rows([("old", d) for d in days] + [("new", d) for d in days[4:]], "code string, trade_date date")
    assert [r.code for r in Z.new_listings(bars, "2024-01-07").collect()] == ["new"]
    assert Z.new_listings(bars, "2024-01-04").count() == 0  # fewer than five dates


def test_screen_conditions(rows):
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    bars = rows([("600001.SH", d1, 10.0, 10.0, 10.0, 10.0, 0.0, 5.0, "ok"),
                 ("600001.SH", d2, 10.0, 10.0, 10.9, 10.8, 8.0, 50.0, "ok"),
                 ("600002.SH", d2, 10.0, 10.0, 11.0, 11.0, 10.0, 50.0, "limit"),
                 ("600003.SH", d2, 10.0, 10.0, 10.9, 10.8, 8.0, 50.0, "*ST x")],
                "code string, trade_date date, pre_close double, open double, high double, close double, change_ratio double, amount double, name string")
    got = Z.screen(bars, change_lo=7, change_hi=12.1, exclude_limit_up=True, exclude_st=True)
    assert [r.code for r in got.collect()] == ["600001.SH"]
    assert sorted(r.code for r in Z.screen(bars, body_or_max=3, min_amount=10, listed_days=1).collect()) == ["600001.SH"]


def test_prev_volume_is_strictly_before(rows):
    bars = rows([("a", date(2024, 1, 1), 5.0), ("a", date(2024, 1, 3), 0.0), ("b", date(2024, 1, 3), 7.0), ("a", date(2024, 1, 4), 9.0)],
                "code string, trade_date date, volume double")
    assert [(r.code, r.prev_volume) for r in L.prev_volume(bars, "2024-01-04").collect()] == [("b", 7.0)]
    every = sorted((str(r.trade_date), r.code, r.prev_volume) for r in L.prev_volume(bars).collect())
    assert every == [("2024-01-03", "a", 5.0), ("2024-01-04", "b", 7.0)]


def test_calendar(rows):
    cal = rows([(date(2024, 1, d),) for d in (2, 3, 5)], "trade_date date")
    dates = rows([(date(2023, 12, 30),), (date(2024, 1, 1),), (date(2024, 1, 3),), (date(2024, 1, 4),), (date(2024, 1, 6),), (date(2024, 1, 8),)], "d date")

    def column(df, name):
        return [r[name] for r in df.orderBy("d").collect()]

    assert column(T.is_trading_day(dates, cal), "is_trading_day") == [False, True, True, False, False, True]
    assert column(T.latest_trading_day(dates, cal), "latest_trading_day") == [
        None, None, date(2024, 1, 3), date(2024, 1, 3), date(2024, 1, 5), date(2024, 1, 5)]
    assert column(T.next_trading_day(dates, cal), "next_trading_day") == [
        date(2024, 1, 2), date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 5), date(2024, 1, 8), date(2024, 1, 8)]


def test_missing_dates(rows):
    cal = rows([(date(2024, 1, d),) for d in (2, 3, 4, 5)], "trade_date date")
    bars = rows([("a", date(2024, 1, 3))], "code string, trade_date date")
    assert sorted(r.trade_date.day for r in T.missing_dates(cal, bars, "2024-01-08").collect()) == [4, 5, 8]
    asked = cal.select(F.col("trade_date").alias("d"))
    assert sorted(r.trade_date.day for r in T.missing_among(asked, cal, bars).collect()) == [2, 4, 5]
