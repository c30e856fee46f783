"""Feeds of fixed micro-batches, and slot bars without a Python worker per session."""

from pyspark.sql import functions as F

from marketpulse.checks import q_jobs as Q
from marketpulse.schemas import TICKS
from marketpulse.streaming import sessions as W


def test_a_batch_is_as_many_files_as_its_rows_need(spark, tmp_path):
    assert [Q.feed_files(n) for n in (None, 0, 1, Q.FILE_ROWS, Q.FILE_ROWS + 1, 10 * Q.FILE_ROWS)] == [1, 1, 1, 1, 2, 10]
    path = str(tmp_path / "feed")
    for n in (2, 0, 50):  # fewer rows than files too: a trigger must never take the next batch's
        Q.append_files(spark.range(n).withColumn("n", F.lit(n)), path, 5)
    seen = []
    stream = spark.readStream.schema("id long, n int").option("maxFilesPerTrigger", 5).parquet(path)
    stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.n for r in b.collect()))).option(
        "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[2, 2], [], [50] * 50]


def test_slot_bars_are_aggregates_of_the_engine(spark, tmp_path):
    path = str(tmp_path / "ticks")
    spark.createDataFrame([], TICKS).write.parquet(path)
    plan = W.slot_quotes(spark.readStream.schema(TICKS).parquet(path))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and plan.count("Aggregate [") == 5
