from datetime import date

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import returns as T
from marketpulse.operators import strength as S

D = date(2024, 1, 15)


@pytest.fixture
def quotes(rows):
    return rows([(D, "1", 1.0, .5), (D, "2", 2.0, 1.5), (D, "3", -1.0, -.5), (D, "4", 0.0, 0.0)],
                "trade_date date, code string, change_ratio double, body double")


@pytest.fixture
def members(rows):
    return rows([("a", "1"), ("a", "2"), ("a", "2"), ("b", "3"), ("b", "4")], "group_id string, code string")


def by_group(df):
    return {r.group_id: r for r in df.collect()}


def test_hand_computed(quotes, members):
    got = by_group(S.group_strength(quotes, members, min_members=0))
    a, b = got["a"], got["b"]
    assert (a.s1_return, a.s2_breadth, a.s4_relative, a.s_body, a.member_count, a.rank_1d) == (1.5, 1.0, 1.0, 1.0, 2, 1)
    assert (b.s1_return, b.s2_breadth, b.s4_relative, b.rank_1d) == (-0.5, 0.0, -1.0, 2)
    assert a.score == pytest.approx(0.5 ** 0.5)
    assert a.score + b.score == pytest.approx(0)


def test_unknown_changes_count_as_members(rows, members):
    q = rows([(D, "1", 4.0), (D, "2", None), (D, "3", None), (D, "4", None)],
             "trade_date date, code string, change_ratio double")
    got = by_group(S.group_strength(q, members, min_members=2))
    assert (got["a"].s1_return, got["a"].s2_breadth, got["a"].member_count) == (4.0, 0.5, 2)
    assert got["b"].score is None and got["b"].rank_1d is None


def test_minimum_and_ties(rows, quotes, members):
    assert S.group_strength(quotes, members, min_members=3).count() == 0
    same = rows([(g, c) for g in "xyz" for c in "12"] + [("w", "3"), ("w", "4")], "group_id string, code string")
    got = by_group(S.group_strength(quotes, same, min_members=2))
    assert [got[g].rank_1d for g in "xyzw"] == [1, 1, 1, 4]


def test_duplicate_quotes_keep_the_last(rows, members):
    q = rows([(D, "1", 9.0, 1), (D, "1", 1.0, 2), (D, "2", 1.0, 1)],
             "trade_date date, code string, change_ratio double, at int")
    got = by_group(S.group_strength(q, members, min_members=1, precision=None, order="at"))
    assert got["a"].s1_return == 1.0
    assert got["a"].s4_relative == pytest.approx(1.0 - 11 / 3)  # the market mean sees all quotes


BARS = "code string, trade_date date, pre_close double, close double, change_ratio double"


def test_period_return_falls_back_and_skips_unknown_base(rows):
    bars = rows([("a", date(2024, 1, 1), None, 9.0, None), ("a", date(2024, 1, 2), 10.0, 11.0, 10.0),
                 ("a", date(2024, 1, 5), 11.0, 12.0, 9.0), ("b", date(2024, 1, 2), 5.0, 6.0, 20.0),
                 ("z", date(2024, 1, 5), 0.0, 6.0, 20.0)], BARS)
    got = {r.code: r for r in T.period_return(bars, "2024-01-07", 3).collect()}
    assert set(got) == {"a", "z"}  # b has no bar on the common end date
    assert got["a"].change_ratio == pytest.approx(20.0) and got["a"].trade_date == date(2024, 1, 5)
    assert got["z"].change_ratio == 0.0
    asof = {r.code: r for r in T.period_return_asof(bars, "2024-01-08", 3).collect()}
    assert set(asof) == {"b", "a"} and asof["b"].change_ratio == pytest.approx(20.0)
    first_row = T.period_return_asof(bars, "2024-01-07", 3).filter("code = 'a'").collect()
    assert first_row == []  # the first row's base is unknown


def test_multi_period_single_date_equals_all_dates(rows, spark):
    data = []
    for i in range(12):
        for c in range(8):
            pre, close = 10 + c + i, 10 + c + i + ((i * c) % 5) - 1
            data.append((str(c), date(2024, 1, 1 + i), float(pre), float(close), (close / pre - 1) * 100))
    bars = rows(data, BARS)
    members = rows([("g%d" % (c % 2), str(c)) for c in range(8)], "group_id string, code string")
    every = S.multi_period_strength(bars, members, min_members=2).filter("trade_date = '2024-01-10'")
    one = S.multi_period_strength_on(bars, members, "2024-01-10", min_members=2)
    columns = ["group_id", "score_1d", "score_5d", "score_20d", "score_final", "rank_1d"]
    key = lambda r: r.group_id
    for a, b in zip(sorted(every.select(columns).collect(), key=key), sorted(one.select(columns).collect(), key=key)):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])


def test_missing_horizon_scores_zero(rows, members):
    bars = rows([("1", D, None, 1.0, 3.0), ("2", D, None, 1.0, 1.0), ("3", D, None, 1.0, 0.0), ("4", D, None, 1.0, 0.0)], BARS)
    got = by_group(S.multi_period_strength_on(bars, members, D, min_members=1))
    assert got["a"].score_5d == 0.0 and got["a"].score_final == pytest.approx(0.5 * got["a"].score_1d)


def test_market_stats_and_statistics(quotes):
    r = S.market_stats(quotes).collect()[0]
    assert (r.stock_count, r.up_count, r.down_count, r.flat_count, r.limit_up_count) == (4, 2, 1, 1, 0)
    df, watch = S.run_statistics(quotes.withColumn("score", F.col("change_ratio")))
    df.collect()
    assert watch.get == {"rows_saved": 4, "rows_unscored": 0}
