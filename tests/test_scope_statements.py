"""Queries whose DuckDB statement must hold at any size of the groups."""

import os
import random
from functools import reduce

import duckdb
import pytest

from conftest import SMALL
from marketpulse.checks.queries import REGISTRY
from marketpulse.checks.run import TABLES
from test_registry import canonical


def folder(path, **changed):
    """The smallest tables with some replaced by a SELECT over them."""
    con = duckdb.connect()
    for t in TABLES:
        source, out = f"{SMALL}/{t}.parquet", f"{path}/{t}.parquet"
        if t in changed:
            con.execute(f"CREATE VIEW {t}_in AS SELECT * FROM '{source}'")
            con.execute(f"COPY ({changed[t]}) TO '{out}' (FORMAT parquet)")
        else:
            os.symlink(source, out)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}'")
    return str(path), con


def events_of(values):
    return f"SELECT * REPLACE (value::DOUBLE AS value) FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)"


def both(spark, name, path, con):
    q = REGISTRY[name]
    return canonical(q.run(spark, path).toPandas()), canonical(con.execute(q.sql).fetch_df())


@pytest.mark.parametrize("name", ["c6_effective_scope", "c7_universe_groups", "m10_daily_strength", "m10_daily_attribution"])
def test_no_group_of_eligible_size(spark, tmp_path, name):
    """All watched groups have more than 500 members, so the scope is the fallback pool."""
    path, con = folder(tmp_path, customer="""SELECT c_custkey + 1000 * i AS c_custkey, 'c' || c_custkey || '-' || i AS c_name, c_custkey % 2 + 7 AS c_nationkey,
        c_acctbal, c_mktsegment FROM customer_in, range(120) r(i)""")
    got, want = both(spark, name, path, con)
    assert len(got) and got.equals(want)


def test_last_change_unknown(spark, tmp_path):
    """A member whose latest bar has no change (its pre-close is 0) does not count with an older change."""
    day = "TIMESTAMP '2024-01-0{} 12:00:00'"
    bars = [(u, d, v) for u in range(0, 40) for d, v in ((1, 10.0), (2, 11.0 + u), (3, 0.0 if u % 3 == 0 else 12.0), (4, 9.0 + u))]
    values = ", ".join(f"({i}, {day.format(d)}, {u}, 'view', {v}, '{{\"k\": 1}}')" for i, (u, d, v) in enumerate(bars))
    path, con = folder(tmp_path, events=events_of(values))
    got, want = both(spark, "g4_group_mean_return", path, con)
    assert len(got) and got.equals(want)


def test_amount_at_the_bound(spark, tmp_path):
    """Amounts that are 200 in decimals but not in every order of adding doubles are not above 200."""
    draw, hard = random.Random(1), []
    while len(hard) < 30:
        t = [draw.randrange(1, 4500) for _ in range(6)]
        t.append(20000 - sum(t))
        if t[-1] > 2 * t[0] and reduce(float.__add__, (c / 100 for c in t)) > 200:
            hard.append(t)
    rows_ = [(u, m, c / 100) for u, t in enumerate(hard) for m, c in enumerate(t)]
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-02 12:0{m}:00', {u}, 'view', {v!r}, '{{\"k\": 1}}')" for i, (u, m, v) in enumerate(rows_))
    path, con = folder(tmp_path, events=events_of(values))
    got, want = both(spark, "m11_alert_run_1000", path, con)
    assert len(hard) and got.equals(want) and set(want["pool_size"]) == {"0"}
