import os

from pyspark.sql import functions as F

from marketpulse import staging


def test_stages_leave_no_shuffle_files_and_can_be_discarded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(staging, "shared_path", lambda s, label, f=staging.shared_path: seen.append(f(s, label)) or seen[-1])
    before = spark.conf.get(staging.CLEANUP)
    asked = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda w, path, **k: asked.append(spark.conf.get(staging.CLEANUP)) or write(w, path, **k))
    df = staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert asked == ["true"] and spark.conf.get(staging.CLEANUP) == before
    assert sorted(r["count"] for r in df.collect()) == [142] + [143] * 6 and os.path.isdir(seen[0])
    staging.discard(df)
    assert not os.path.exists(seen[0])
