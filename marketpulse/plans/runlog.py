"""Run statistics (G21): what each step of a run saw, skipped, saved and failed at, stored as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators.strength import MIN_MEMBERS, group_strength

SCHEMA = "run_id string, step string, metric string, value long, error string"


class RunLog:
    """Steps of one run with named observations at any point of their plans.

    Observations are filled by the step's own write, so counting costs no pass of
    its own. ``save`` stores the log; a run stored again replaces its rows.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path.rstrip("/"), run_id
        self.rows: list[tuple] = []
        self.watched: list[Observation] = []

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` with counts that end up in the log of the step that writes it."""
        self.watched.append(Observation())
        return df.observe(self.watched[-1], *[m.alias(name) for name, m in metrics.items()])

    def step(self, name: str, build: Callable[[], DataFrame], sink: Callable[[DataFrame], None]) -> bool:
        """Build and write one step. A failure becomes a row, and later steps still run."""
        self.watched = []
        try:
            sink(build())
            found = {k: v for o in self.watched for k, v in o.get.items()}
        except Exception as e:  # what failed is the content of the row
            cause = e.getCondition() if isinstance(e, PySparkException) and e.getCondition() else type(e).__name__
            self.rows.append((self.run_id, name, "failed", 1, cause))
            return False
        self.rows += [(self.run_id, name, metric, value, None) for metric, value in found.items()]
        self.rows.append((self.run_id, name, "failed", 0, None))
        return True

    def save(self) -> DataFrame:
        """Write the log, a few rows per step, and read the stored log of all runs."""
        (self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path))
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def strength_step(log: RunLog, quotes: DataFrame, members: DataFrame, sink: Callable[[DataFrame], None],
                  min_members: int = MIN_MEMBERS, **options) -> bool:
    """Group strength with its statistics: groups seen, skipped for size, saved and saved without a score."""
    def build() -> DataFrame:
        small = F.count_if(F.col("member_count") < min_members)
        strength = group_strength(quotes, members, min_members=min_members, **options,
                                  watch=lambda df: log.watch(df, groups_seen=F.count(F.lit(1)), skipped_for_size=small))
        return log.watch(strength, rows_saved=F.count(F.lit(1)), rows_unscored=F.count_if(F.col("score").isNull()))

    return log.step("group_strength", build, sink)
