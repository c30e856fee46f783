"""Sinks and maintenance of stored tables (parquet, partitioned by date)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.staging import exists, file_system, remove, stage


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """B1: keyed upsert, the last write wins.

    Rows of ``new`` beat ``existing``; among equals the greatest ``order``
    value wins. A combining aggregate, so a hot key is reduced map-side.
    """
    rank = F.lit(0) if order is None else F.col(order)

    def ranked(df, generation):
        return df.withColumn("__at", F.struct(F.lit(generation).alias("g"), rank.alias("o")))

    both = ranked(existing, 0).unionByName(ranked(new, 1))
    rest = [c for c in existing.columns if c not in keys]
    return (
        both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__at").alias("r"))
        .select(*keys, "r.*").select(*existing.columns)
    )


def write_partitions(df: DataFrame, path: str, partition: str | Sequence[str]) -> None:
    """B2 for any partition column: replace exactly the partitions in ``df``.

    The rebalance gathers each partition into few well-sized files and lets
    adaptive execution split a partition that holds most of the rows.
    """
    columns = [partition] if isinstance(partition, str) else list(partition)
    (
        df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns).parquet(path)
    )


def replace_partition(df: DataFrame, path: str, partition: str = "trade_date") -> None:
    """B2: replace whole result dates; no stale group of such a date survives."""
    write_partitions(df, path, partition)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str,
                 order: str | None = None) -> None:
    """B1 on a stored table: only the partitions ``new`` touches are rewritten."""
    if exists(spark, path):
        touched = new.select(partition).distinct()
        stored = spark.read.schema(new.schema).parquet(path)
        current = stored.join(F.broadcast(touched), partition, "left_semi").select(*new.columns)
    else:
        current = new.limit(0)
    write_partitions(upsert(current, new, keys, order), path, partition)


def purge(df: DataFrame, in_scope: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and a one-row count of the rows to delete."""
    keep = F.coalesce(in_scope, F.lit(False))
    return df.filter(keep), df.select(F.count_if(~keep).alias("deleted"))


def purge_foreign(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """B4 over a set of tables: by group prefix where a table has groups only,
    by instrument suffix where it has instruments.

    Returns the kept frames and ``(table_name, deleted)`` counts.
    """
    kept, counts = {}, None
    for name, df in tables.items():
        kept[name], deleted = purge(df, foreign_scope(name, df.columns))
        row = deleted.select(F.lit(name).alias("table_name"), "deleted")
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def foreign_scope(table: str, columns: Sequence[str]) -> Column:
    """What stays in a table: domestic groups where a table is about groups, else domestic instruments."""
    about_groups = "group_id" in columns and table != "instrument_group_map"
    return C.is_domestic_group() if about_groups else C.is_domestic()


def purge_stored(spark: SparkSession, path: str, in_scope: Column) -> int:
    """B4 on a stored parquet table: rewrites only the files that hold rows out of scope; returns how many went.

    Every such file is written anew beside the table and then put in its place by one
    renaming that replaces it, so a file is either as it was or purged whatever
    dies, and a second run finishes the first. Rows are dealt by file, which bounds a
    task by a file. The driver handles names of files, not rows.
    """
    keep = F.coalesce(in_scope, F.lit(False))
    rows = spark.read.option("mergeSchema", "false").parquet(path)
    name = F.col("_metadata.file_path")
    touched = stage(rows.where(~keep).groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("deleted"))
                    .withColumn("key", F.md5("file")), "foreign-files")
    files = touched.collect()
    if not files:
        return 0
    stored = [c for c in rows.columns if c not in _partition_columns(rows, path)]
    clean = f"{path.rstrip('/')}/_purged-{uuid.uuid4().hex}"  # a name that readers of the table pass over
    kept = spark.read.option("basePath", path).parquet(*[f.file for f in files]).where(keep).withColumn("key", F.md5("_metadata.file_path"))
    kept.select(*stored, "key").repartition(len(files), "key").write.partitionBy("key").parquet(clean)
    jvm, context = spark._jvm, None
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    for f in files:
        old, fs = file_system(spark, f.file)
        folder = jvm.org.apache.hadoop.fs.Path(f"{clean}/key={f.key}")
        parts = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")] if fs.exists(folder) else []
        if not parts:
            fs.delete(old, False)
            continue
        context = context or jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(parts[0]), context.makeQualified(old), replace)
    remove(spark, clean)
    spark.catalog.refreshByPath(path)
    return sum(f.deleted for f in files)


def _partition_columns(rows: DataFrame, path: str) -> set[str]:
    """Columns that the table's folders name."""
    first = rows.select("_metadata.file_path").first()[0]
    return {part.split("=", 1)[0] for part in first.split("/") if "=" in part} & set(rows.columns)


def retain_since(df: DataFrame, cutoff=None, keep_days: int | None = None, column: str = "trade_date") -> DataFrame:
    """Drop rows before a cutoff date, or all but the last ``keep_days`` loaded days."""
    if cutoff is not None:
        return df.filter(F.col(column) >= F.lit(cutoff).cast("date"))
    recent = df.select(column).distinct().orderBy(F.col(column).desc()).limit(keep_days)
    return df.filter(F.col(column) >= recent.select(F.min(column)).scalar())


def save_selection(requested: DataFrame, members: DataFrame, path: str) -> tuple[int, int]:
    """Overwrite the stored selection with its eligible groups.

    Returns the numbers of saved and of excluded groups. Readers see the old selection
    until the new one is whole (see ``saved``).
    """
    from marketpulse.operators.scopes import eligible_selection

    eligible, excluded = eligible_selection(requested, members)
    save_whole(eligible.withColumn("added_at", F.current_timestamp()), path)
    return saved(eligible.sparkSession, path).count(), excluded.count()


def save_whole(rows: DataFrame, path: str) -> None:
    """Replace a small stored table (a selection, the user groups) by ``rows``."""
    from marketpulse.operators.versions import VersionedTable

    VersionedTable(rows.sparkSession, path, None).replace(rows)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``save_whole`` or ``save_selection`` stored last."""
    from marketpulse.operators.versions import VersionedTable

    return VersionedTable(spark, path, None).read()
