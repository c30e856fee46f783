import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketpulse.operators import ranking as R


@pytest.fixture(scope="module")
def skewed():
    random.seed(1)
    data = [("hot", i, random.choice([0.0, random.gauss(0, 1), random.gauss(0, 1e4), None])) for i in range(1500)]
    data += [(f"k{i % 7}", i, random.gauss(0, 1e-4)) for i in range(300)]
    return pd.DataFrame(data, columns=["k", "i", "v"])


def test_spread_rank_matches_pandas(spark, skewed):
    got = R.spread_rank(spark.createDataFrame(skewed.astype(object).where(skewed.notna(), None), "k string, i long, v double"), "v", ["k"]).toPandas()
    want = skewed.assign(rank=skewed.groupby("k").v.rank(ascending=False, method="min"))
    both = got.merge(want, on=["k", "i"])
    pd.testing.assert_series_equal(both["rank_x"].astype(float), both["rank_y"], check_names=False)


def test_exact_median_matches_pandas(spark, skewed):
    df = spark.createDataFrame(skewed.astype(object).where(skewed.notna(), None), "k string, i long, v double")
    got = R.exact_median(df, "v", ["k"]).toPandas().set_index("k")["median"].sort_index()
    pd.testing.assert_series_equal(got, skewed.groupby("k").v.median().sort_index(), check_names=False)


def test_standardise_and_zscore(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", 5.0), ("c", 1.0)], "k string, v double")
    want = {("a", v): (v - 7 / 3) / np.std([1, 2, 4], ddof=1) for v in (1.0, 2.0, 4.0)}
    for got in (R.standardise(df, ["v"], ["k"]).collect(),
                df.select("k", "v", R.zscore("v", ["k"]).alias("z_v")).collect()):
        for r in got:
            assert r.z_v == pytest.approx(want.get((r.k, r.v), 0.0))
        assert sum(r.z_v for r in got) == pytest.approx(0.0)


def test_narrow_band_and_nan(spark):
    """Values of one key in a narrow band rank exactly, and NaN ranks like an unknown value."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, float("nan")).otherwise(10 + F.col("id") * 1e-9).alias("v"), "id")
    got = {r.id: r.rank for r in R.spread_rank(df, "v", ["k"]).collect()}
    assert got[7] is None and got[19_999] == 1 and got[0] == 19_999 and got[8] == 19_992


def test_top_bottom_overlap_and_order(spark):
    df = spark.createDataFrame([("d", f"g{i}", float(i)) for i in range(5)], "trade_date string, group_id string, score double")
    got = R.top_bottom(df, "score", 3, ["trade_date"]).orderBy("section", "pos").collect()
    assert [(r.section, r.group_id) for r in got] == [
        ("bottom", "g0"), ("bottom", "g1"), ("bottom", "g2"), ("top", "g4"), ("top", "g3"), ("top", "g2")]


def test_top_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = R.top_per_group(df, ["k"], [F.col("id").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_order_nulls(spark):
    df = spark.createDataFrame([(None, "n"), (-1.0, "m"), (1.0, "p")], "v double, k string")
    assert [r.k for r in R.order_nulls(df, "v").collect()] == ["p", "m", "n"]
    assert [r.k for r in R.order_nulls(df, "v", nulls="zero").collect()] == ["p", "n", "m"]
