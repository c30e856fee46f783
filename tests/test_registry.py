"""Registered queries against DuckDB at the smallest scale, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from marketpulse.checks.queries import REGISTRY
from marketpulse.checks.registry import Frames
from marketpulse.checks.run import TABLES
from marketpulse.operators import attribution as K
from marketpulse.operators import coherency as G
from marketpulse.operators import strength as S
from marketpulse.plans import dashboards as B

SAMPLE = ["a1_unpack_bars", "a8_screen_hits", "b1_upsert", "c6_effective_scope", "d8_as_of_indicators", "f4_speed_series",
          "f8_rolling_return_20d_long", "f17_tick_summary", "g2_group_strength_long", "g5_multi_period", "g6_coherency_long",
          "g11_auction_groups", "g16_classify_market", "h4_member_scores", "k2_daily_attribution", "l4_next_trading_day",
          "m1_dashboard_members", "m5_history_custom", "m6_candidates", "m9_replay", "s3_strength_stream"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(frame):
    order = sorted(frame.columns)
    text = frame[order].astype(object).where(frame[order].notna(), None).map(repr)
    return text.sort_values(order).reset_index(drop=True)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, duck, name):
    q = REGISTRY[name]
    got, want = canonical(q.run(spark, SMALL).toPandas()), canonical(duck.execute(q.sql).fetch_df())
    assert got.equals(want)


def test_every_statement_is_valid_sql(duck):
    for name, text in E.oracle_sql().items():
        duck.execute(f"EXPLAIN {text}")
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_plans_have_no_cross_joins(spark):
    t = Frames(spark, SMALL)
    plans = {
        "g2": S.group_strength(t.bars, t.current), "g5": S.multi_period_strength(t.bars, t.current),
        "g5 on": S.multi_period_strength_on(t.bars, t.current, "2024-01-25"),
        "k2": K.daily_attribution(t.bars, t.members, t.groups), "g6": G.coherency(t.bars, t.current),
        "m9": B.replay(t.ticks, t.current),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stored_bars_prune_partitions(spark, tmp_path):
    from marketpulse.operators.upkeep import write_partitions
    from marketpulse.sources.ingest import read_bars

    path = str(tmp_path / "bars")
    write_partitions(Frames(spark, SMALL).bars, path, "trade_date")
    df = read_bars(spark, path, "2024-01-10", "2024-01-12", codes=["8000002.BJ"]).select("code", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan and "ReadSchema: struct<code:string,close:double>" in plan
    assert "PushedFilters: [IsNotNull(code), EqualTo(code,8000002.BJ)]" in plan
