"""A partitioned table whose partitions are rewritten beside the old ones (B1).

Layout below the table's path: ``data/rows_version=<n>/<partition>=<value>/`` holds rows, and
``pointers/<n>`` has the schema and which version of every partition is current. A write puts the new
partitions into a version of their own and then publishes the next pointer by one rename
that fails if it exists. Readers follow the newest pointer, so they see a write whole or
not at all; a job that dies in between leaves files that nobody points to, and
two writers cannot both publish the same version.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketpulse.operators.upkeep import upsert, write_partitions
from marketpulse.staging import file_system, exists, remove, stage


class VersionedTable:
    """Rows partitioned by one date column, with keyed upserts and whole-partition replacement.

    Without a partition column the table is replaced whole.
    """

    def __init__(self, spark: SparkSession, path: str, partition: str | None = "trade_date"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    # ---- pointers ----

    def _listed(self, folder: str) -> list[str]:
        if not exists(self.spark, f"{self.path}/{folder}"):
            return []
        target, fs = file_system(self.spark, f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(target)]

    def version(self) -> int:
        """Number of the newest pointer, 0 before the first write."""
        return max((int(x) for x in self._listed("pointers") if x.isdigit()), default=0)

    def _pointer(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "current": {}}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{version}", wholetext=True).first().value)

    def current(self, version: int | None = None) -> dict[str, int]:
        """Partition value to the version of its rows: one entry per date of the calendar."""
        return self._pointer(version)["current"]

    def _publish(self, version: int, schema: StructType, current: dict[str, int]) -> None:
        jvm = self.spark._jvm
        draft, fs = file_system(self.spark, f"{self.path}/pointers/_{version}-{self.spark.sparkContext.applicationId}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "current": current}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(context.makeQualified(draft), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/{version}")), none)

    # ---- reading ----

    def read(self, start: date | str | None = None, end: date | str | None = None, dates: Sequence | None = None,
             version: int | None = None) -> DataFrame:
        """Current rows, or those of an older version; only folders of the dates asked for are listed.

        A table that was never written raises ``ValueError``.
        """
        pointer = self._pointer(version)
        if pointer["schema"] is None:
            raise ValueError(f"no rows were published in {self.path}")
        schema = StructType.fromJson(pointer["schema"])
        if self.partition is None:
            return self.spark.read.schema(schema).parquet(f"{self.path}/data/rows_version={pointer['current']['']}")
        lo, hi = (None if x is None else str(x) for x in (start, end))
        only = None if dates is None else {str(d) for d in dates}
        folders = [f"{self.path}/data/rows_version={v}/{self.partition}={d}" for d, v in sorted(pointer["current"].items())
                   if (lo is None or d >= lo) and (hi is None or d <= hi) and (only is None or d in only)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields]).add("rows_version", "integer")
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders).select(*schema.names)

    # ---- writing ----

    def replace(self, rows: DataFrame) -> None:
        """B2: the partitions in ``rows`` get these rows alone."""
        self._write(stage(rows, "to-replace"), None, None)

    def upsert(self, rows: DataFrame, keys: Sequence[str], order: str | None = None) -> None:
        """B1: rows replace those of equal keys; only the partitions in ``rows`` are read and rewritten."""
        self._write(stage(rows, "to-upsert"), keys, order)

    def _write(self, rows: DataFrame, keys: Sequence[str] | None, order: str | None) -> None:
        base = self.version()
        if self.partition is None:
            remove(self.spark, f"{self.path}/data/rows_version={base + 1}")
            rows.write.parquet(f"{self.path}/data/rows_version={base + 1}")
            self._publish(base + 1, rows.schema, {"": base + 1})
            return
        dates = [str(r[0]) for r in rows.select(F.col(self.partition).cast("string")).distinct().collect()]  # days of the calendar
        if not dates:
            return
        if keys is not None:
            rows = upsert(self.read(dates=dates, version=base) if base else rows.limit(0), rows, keys, order)
        folder = f"{self.path}/data/rows_version={base + 1}"
        remove(self.spark, folder)  # what a writer left that died before it published
        write_partitions(rows, folder, self.partition)
        self._publish(base + 1, rows.schema, self.current(base) | dict.fromkeys(dates, base + 1))

    def vacuum(self, keep: int = 2) -> None:
        """Delete partitions that none of the newest ``keep`` pointers names, and older pointers."""
        newest = self.version()
        named: dict[int, set[str]] = {}
        for n in range(max(1, newest - keep + 1), newest + 1):
            for d, v in self.current(n).items():
                named.setdefault(v, set()).add(f"{self.partition}={d}")
        for name in self._listed("data"):
            v = int(name.removeprefix("rows_version="))
            if v <= newest:
                for part in self._listed(f"data/{name}"):
                    if part.startswith(f"{self.partition}=") and part not in named.get(v, ()):
                        remove(self.spark, f"{self.path}/data/{name}/{part}")
                if v not in named:
                    remove(self.spark, f"{self.path}/data/{name}")
        for name in self._listed("pointers"):
            if name.isdigit() and int(name) <= newest - keep:
                remove(self.spark, f"{self.path}/pointers/{name}")
