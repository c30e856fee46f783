from datetime import date

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import attribution as K
from marketpulse.operators import portfolio as Q
from marketpulse.operators import screening as H
from marketpulse.plans import jobs as J

D, OLD = date(2024, 1, 15), date(2024, 1, 1)


@pytest.fixture
def world(rows):
    bars = rows([("1.SH", D, 4.0), ("2.SH", D, -2.0), ("3.SH", D, None)], "code string, trade_date date, change_ratio double")
    members = rows([("884001.TI", c, "", D) for c in ("1.SH", "2.SH", "3.SH", "4.SH")]
                   + [("885001.TI", "1.SH", "", D), ("885002.TI", "9.HK", "", D), ("884009.TI", "1.SH", "", OLD)],
                   "group_id string, code string, name string, as_of date")
    groups = rows([(g, g[:6]) for g in ("884001.TI", "885001.TI", "885002.TI", "884009.TI")], "group_id string, group_name string")
    return bars, members, groups


def test_daily_attribution(world):
    got = {r.code: r for r in K.daily_attribution(*world).collect()}
    assert set(got) == {"1.SH", "2.SH", "4.SH"}  # unknown change and foreign code are skipped
    one = got["1.SH"]  # its own latest snapshot has two groups; group means are 1.0 and 4.0
    assert [(e.group_id, e.weight, e.contribution, e.contrib_pct) for e in one.attributions] == [
        ("885001.TI", 0.5, 2.0, 0.8), ("884001.TI", 0.5, 0.5, 0.2)]
    assert (one.top_group, one.top_contrib_pct, one.total_return) == ("885001.TI", 0.8, 4.0)
    assert got["4.SH"].total_return == 0.0  # not quoted
    for r in got.values():
        total = sum(e.contribution for e in r.attributions)
        assert sum(e.contrib_pct for e in r.attributions) == pytest.approx(1.0 if abs(total) > 1e-8 else 0.0)


def test_shares_vanish_with_the_total(rows):
    inst = rows([(D, "x", 1.0)], "trade_date date, code string, total_return double")
    weights = rows([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", 0.25)], "code string, group_id string, weight double")
    returns = rows([(D, "a", 2.0), (D, "b", -2.0)], "trade_date date, group_id string, group_return double")
    r = K.attribute(inst, weights, returns).collect()[0]
    assert [e.contrib_pct for e in r.attributions] == [0.0, 0.0, 0.0]
    assert [e.group_id for e in r.attributions] == ["a", "b", "c"]  # by size, then id


def test_json_round_trip(world):
    df = K.daily_attribution(*world)
    back = K.attribution_from_json(K.attribution_to_json(df))
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_pool_limits_groups(world):
    _, members, groups = world
    pool = groups.filter("group_id = '884009.TI'").select("group_id")
    got = {(r.code, r.group_id) for r in K.groups_from_members(members, groups, pool).collect()}
    assert got == {("1.SH", "885001.TI"), ("9.HK", "885002.TI")}


def test_portfolio(rows, world):
    _, members, groups = world
    holdings = rows([("1.SH", 2.0, 10.0), ("1.SH", 1.0, 10.0), ("2.SH", 1.0, 5.0)], "code string, shares double, cost_price double")
    strength = rows([(D, "885001.TI", 1.0, 11), (D, "884001.TI", 2.0, 1)], "trade_date date, group_id string, score_final double, rank_1d int")
    report = J.portfolio_report(holdings, members, strength, groups)
    assert {r.group_id: r.exposure_weight for r in report.exposure.collect()} == {
        "884001.TI": 35.0, "885001.TI": 30.0, "884009.TI": 30.0}
    assert report.dominant.first().group_id == "884001.TI"
    assert [r.group_id for r in report.alerts.collect()] == ["884001.TI"]
    assert [r.group_id for r in report.leaders.collect()] == ["884001.TI"]
    assert Q.exposed_holdings(holdings, members).count() == 4


@pytest.fixture
def classified(rows):
    hits = rows([(D, f"{i:02d}", f"n{i}", float(i)) for i in range(10)] + [(D, "out", "o", 99.0)],
                "trade_date date, code string, name string, change_ratio double")
    members = rows([("big", f"{i:02d}") for i in range(10)] + [("big", "quiet"), ("small", "09"), ("none", "quiet")],
                   "group_id string, code string")
    groups = rows([("big", "Big")], "group_id string, group_name string")
    return H.classify_hits(hits, members, groups)


def test_classification(classified):
    got = {r.group_id: r for r in classified.groups.collect()}
    assert set(got) == {"big", "small"}
    assert (got["big"].hit_count, got["big"].member_total, got["big"].coverage, got["big"].hit_avg_change) == (10, 11, 0.9091, 4.5)
    assert got["small"].group_name == "small"
    t = classified.totals.collect()[0]
    assert (t.pool_size, t.hit_total, t.group_hit_count) == (11, 10, 2)


def test_digest_caps_and_isolation(classified):
    row = H.alert_digest(classified, "custom", max_groups=1).collect()[0]
    assert row.group_hit_count == 2 and [g.group_id for g in row.groups] == ["big"]
    assert [h.code for h in row.groups[0].hits] == [f"{i:02d}" for i in range(9, 1, -1)]

    def fails():
        raise RuntimeError("no answer")

    both = J.isolated_digests({"custom": fails, "market": lambda: H.alert_digest(classified, "market")},
                               classified.totals.select("trade_date"))
    got = {r.scope: r for r in both.collect()}
    assert got["custom"].error == "RuntimeError: no answer" and got["custom"].groups is None
    assert got["market"].error is None and got["market"].pool_size == 11


def test_digest_of_a_scope_without_groups(rows, classified):
    hits = rows([(D, "x", "x", 1.0)], "trade_date date, code string, name string, change_ratio double")
    members = rows([("g", "y")], "group_id string, code string")
    row = H.alert_digest(H.classify_hits(hits, members, members.select("group_id", members.code.alias("group_name"))), "market").collect()[0]
    assert (row.pool_size, row.hit_total, row.group_hit_count, row.groups) == (1, 0, 0, None)


def test_unknown_scope_and_slot(classified, rows):
    with pytest.raises(ValueError):
        H.classify_hits(classified.hits, classified.groups, classified.groups, "other")
    with pytest.raises(KeyError):
        J.alert_run(classified.hits, classified.groups, classified.groups, classified.groups, "0000")


def test_daily_attribution_shuffles_no_product_of_dates(rows):
    """Quoted, unquoted and unknown changes over dates; instruments are unfolded over dates after the shuffles, and the JSON form is the same."""
    bars = rows([("000001.SZ", "2024-01-02", 1.0), ("000001.SZ", "2024-01-03", None), ("000002.SZ", "2024-01-03", 3.0)],
                "code string, trade_date string, change_ratio double").withColumn("trade_date", F.col("trade_date").cast("date"))
    members = rows([("885001.TI", c, c, "2024-01-01") for c in ("000001.SZ", "000002.SZ", "000003.SZ")],
                   "group_id string, code string, name string, as_of string").withColumn("as_of", F.col("as_of").cast("date"))
    groups = rows([("885001.TI", "one")], "group_id string, group_name string")
    out = K.daily_attribution(bars, members, groups)
    got = sorted((str(r.trade_date), r.code, r.total_return, r.attributions[0].contribution) for r in out.collect())
    assert got == [("2024-01-02", "000001.SZ", 1.0, 1.0), ("2024-01-02", "000002.SZ", 0.0, 1.0), ("2024-01-02", "000003.SZ", 0.0, 1.0),
                   ("2024-01-03", "000002.SZ", 3.0, 3.0), ("2024-01-03", "000003.SZ", 0.0, 3.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression")
    text = K.attribution_from_json(K.daily_attribution(bars, members, groups, as_json=True))
    assert sorted(map(str, text.select(*out.columns).collect())) == sorted(map(str, out.collect()))
