from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from marketpulse.operators import coherency as G


def expected(frame, members):
    out = {}
    for g, codes in members.items():
        sub = frame[frame.code.isin(codes)]
        wide = sub.pivot_table(index="trade_date", columns="code", values="change_ratio")
        if wide.shape[1] < 2:
            out[g] = 0.0
            continue
        corr = wide.corr().to_numpy()
        upper = corr[np.triu_indices_from(corr, k=1)]
        upper = upper[~np.isnan(upper)]
        out[g] = float(upper.mean()) if len(upper) else 0.0
    return out


@pytest.mark.parametrize("gaps", [0.0, 0.02, 0.5])
@pytest.mark.parametrize("block", [3, 64])
def test_matches_pairwise_pandas(spark, gaps, block):
    rng = np.random.default_rng(7)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(14)]
    market = rng.normal(size=len(days))
    data = []
    for c in range(24):
        flat = c in (5, 6)
        for i, d in enumerate(days):
            if rng.random() < gaps and c % 2:
                continue
            data.append((f"c{c:02d}", d, 1.5 if flat else float(market[i] * (c % 3) + rng.normal())))
    data.append(("lonely", days[0], 1.0))
    frame = pd.DataFrame(data, columns=["code", "trade_date", "change_ratio"])
    members = {"all": sorted(frame.code.unique()), "some": ["c00", "c01", "c02", "c05"], "flat": ["c05", "c06"],
               "one": ["c03"], "none": ["missing"]}
    pairs = spark.createDataFrame([(g, c) for g, cs in members.items() for c in cs], "group_id string, code string")
    got = {r.group_id: r.coherency for r in G.coherency(spark.createDataFrame(frame), pairs, digits=None, block=block).collect()}
    assert got == pytest.approx(expected(frame, members), abs=1e-9)


def test_series_of_a_large_group_are_not_copied_by_its_size(spark):
    """3,000 gapped members fit one block, so each series goes to one task (before: blocks of 256, 12 copies of each); pairs are whole."""
    days = spark.range(4).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS trade_date", "id AS d")
    bars = spark.range(3000).crossJoin(days).where("(id + d) % 4 > 0").selectExpr("format_string('c%04d', id) AS code", "trade_date", "cast((id * 7 + d * d * 3) % 11 AS double) AS change_ratio")
    members = bars.selectExpr("'g' AS group_id", "code").distinct()
    shaped = G._with_group_shape(G._series(bars), members)
    assert G._block_copies(shaped, G.ROWS).count() == 3000
    whole, cut = (G.coherency(bars, members, digits=None, **kind).first() for kind in ({}, {"block": 500}))
    assert whole.pairs == cut.pairs > 1_000_000
    assert whole.coherency == pytest.approx(cut.coherency, abs=1e-9)
