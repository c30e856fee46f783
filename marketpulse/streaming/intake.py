"""Late and repeated ticks (S4): a stored feed with a side output, merged later as revisions.

The watermark of a micro-batch is the greatest event time of the batches before it less
the lateness, as in Structured Streaming's own stateful operators; those drop what is
older, this keeps it. Every batch writes folders of its own, so a replayed batch
writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators.versions import VersionedTable
from marketpulse.staging import exists, stage

TICK_KEYS = ("code", "trade_date", "phase", "seq")
ON_TIME, LATE, TOO_LATE = "on_time", "late", "too_late"


class TickIntake:
    """Sorts a tick stream into on-time ticks without repeats, late ones and those past ``horizon``.

    ``lateness`` and ``horizon`` are intervals such as ``2 minutes``. On-time ticks are
    compared with the stored ones not older than the watermark, which is all that a repeat
    of an on-time tick can equal; only their dates' folders are read.
    """

    def __init__(self, path: str, lateness: str = "2 minutes", horizon: str = "1 day", keys: Sequence[str] = TICK_KEYS):
        self.path, self.lateness, self.horizon, self.keys = path.rstrip("/"), lateness, horizon, list(keys)

    def _clock(self, batch_id: int) -> str:
        return f"{self.path}/clock/batch_id={batch_id}"

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        spark = batch.sparkSession
        batch = stage(batch, "ticks")
        earlier = next((self._clock(i) for i in range(batch_id - 1, -1, -1) if exists(spark, self._clock(i))), None)
        before = None if earlier is None else spark.read.parquet(earlier).first()[0]  # one row
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {self.lateness}")
        last = mark - F.expr(f"INTERVAL {self.horizon}")
        kind = F.when(mark.isNull() | (F.col("ts") >= mark), ON_TIME).when(F.col("ts") >= last, LATE).otherwise(TOO_LATE)
        sorted_ = batch.withColumn("kind", kind)
        fresh = sorted_.where(F.col("kind") == ON_TIME).drop("kind").dropDuplicates(self.keys)
        if before is not None and exists(spark, f"{self.path}/ticks"):
            since = spark.range(1).select(mark.cast("date")).first()[0]
            known = (spark.read.schema(self._stored(batch)).parquet(f"{self.path}/ticks")
                     .where((F.col("trade_date") >= F.lit(since)) & (F.col("batch_id") < batch_id) & (F.col("ts") >= mark)))
            fresh = fresh.join(known.select(*self.keys), self.keys, "left_anti")
        self._write(fresh, "ticks", batch_id)
        self._write(sorted_.where(F.col("kind") == LATE).drop("kind"), "late", batch_id)
        count = {k: F.count_if(F.col("kind") == k).alias(k) for k in (ON_TIME, LATE, TOO_LATE)}
        stored = self._own(spark, batch, batch_id).count()
        (sorted_.agg(F.count(F.lit(1)).alias("arrived"), *count.values())
         .select("arrived", (F.col(ON_TIME) - stored).alias("repeated"), F.lit(stored).cast("long").alias(ON_TIME), LATE, TOO_LATE)
         .write.mode("overwrite").parquet(f"{self.path}/counts/batch_id={batch_id}"))
        batch.agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(self._clock(batch_id))

    def _stored(self, batch: DataFrame):
        return batch.withColumn("batch_id", F.lit(0)).schema

    def _own(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> DataFrame:
        return spark.read.schema(self._stored(batch)).parquet(f"{self.path}/ticks").where(F.col("batch_id") == batch_id)

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "trade_date").parquet(f"{self.path}/{kind}"))

    def counts(self, spark: SparkSession) -> DataFrame:
        """Per batch: arrived, repeated, on_time, late, too_late."""
        return spark.read.parquet(f"{self.path}/counts")

    def revise(self, ticks: DataFrame, table: VersionedTable, up_to: int | None = None) -> None:
        """Merge what came in into the ticks of ``table``; the last arrival of a tick wins.

        ``ticks`` gives the schema. A late tick that is unknown is added, a known one replaced;
        only the dates that the arrivals name are rewritten, and merging again changes nothing.
        """
        spark, chosen = ticks.sparkSession, F.lit(True) if up_to is None else F.col("batch_id") <= up_to
        parts = [self._read(spark, ticks, kind, chosen) for kind in ("ticks", "late") if exists(spark, f"{self.path}/{kind}")]
        if parts:
            arrived = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            table.upsert(arrived, self.keys, order="batch_id")

    def _read(self, spark: SparkSession, ticks: DataFrame, kind: str, chosen: Column) -> DataFrame:
        return spark.read.schema(self._stored(ticks)).parquet(f"{self.path}/{kind}").where(chosen)
