"""Stored tables with a pointer per version: pruning, crashes and competing writers."""

from datetime import date

import pytest

from marketpulse.operators import upkeep as U
from marketpulse.operators.versions import VersionedTable

A, B, C = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
SCHEMA = "code string, trade_date date, v int"
KEYS = ["code", "trade_date"]


@pytest.fixture
def table(spark, rows, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.upsert(rows([("a", A, 1), ("b", A, 1), ("a", B, 1)], SCHEMA), KEYS)
    return t


def found(df):
    return sorted((r.code, r.trade_date, r.v) for r in df.collect())


def test_only_touched_dates_are_read_and_rewritten(table, rows):
    table.upsert(rows([("a", B, 2), ("c", C, 2), ("c", C, 5)], SCHEMA), KEYS, order="v")
    assert table.current() == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 2}
    assert found(table.read()) == [("a", A, 1), ("a", B, 2), ("b", A, 1), ("c", C, 5)]
    assert all("trade_date=2024-01-02" in f for f in table.read(dates=[B]).inputFiles())
    assert found(table.read(start=B)) == [("a", B, 2), ("c", C, 5)] and found(table.read(end=A)) == [("a", A, 1), ("b", A, 1)]
    plan = table.read().where("trade_date = date'2024-01-02'").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan
    table.replace(rows([("z", A, 9)], SCHEMA))
    assert found(table.read(dates=[A])) == [("z", A, 9)] and found(table.read(dates=[A], version=2)) == [("a", A, 1), ("b", A, 1)]


@pytest.mark.parametrize("step", ["data", "pointer"])
def test_a_crash_leaves_the_old_rows(table, rows, monkeypatch, step):
    def crash(*a, **k):
        raise RuntimeError("lost")

    new = rows([("a", A, 7)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr("marketpulse.operators.versions.write_partitions" if step == "data" else "marketpulse.operators.versions.VersionedTable._publish", crash)
        with pytest.raises(RuntimeError):
            table.upsert(new, KEYS)
    assert found(table.read()) == [("a", A, 1), ("a", B, 1), ("b", A, 1)]
    table.upsert(new, KEYS)
    assert found(table.read()) == [("a", A, 7), ("a", B, 1), ("b", A, 1)]


def test_two_writers_cannot_publish_one_version(table, rows):
    schema = rows([], SCHEMA).schema
    table._publish(2, schema, {"2024-01-01": 1})
    with pytest.raises(Exception, match="FileAlreadyExists"):
        table._publish(2, schema, {})
    assert table.current() == {"2024-01-01": 1}


def test_vacuum_keeps_what_is_named(table, rows):
    for i in range(2, 5):
        table.upsert(rows([("a", A, i)], SCHEMA), KEYS)
    table.vacuum(keep=2)
    assert sorted(table._listed("pointers")) == ["3", "4"] and sorted(table._listed("data")) == ["rows_version=1", "rows_version=3", "rows_version=4"]
    assert table._listed("data/rows_version=1") and "trade_date=2024-01-01" not in table._listed("data/rows_version=1")
    assert found(table.read()) == [("a", A, 4), ("a", B, 1), ("b", A, 1)] and found(table.read(version=3)) == [("a", A, 3), ("a", B, 1), ("b", A, 1)]


def test_empty_writes_and_unwritten_tables(spark, rows, tmp_path, table):
    table.upsert(rows([], SCHEMA), KEYS)
    assert table.version() == 1 and table.read(dates=[C]).count() == 0
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "none")).read()
    path = str(tmp_path / "groups")
    U.save_whole(rows([("a", A, 1)], SCHEMA), path)
    U.save_whole(rows([("b", B, 2)], SCHEMA), path)
    assert found(U.saved(spark, path)) == [("b", B, 2)]


def test_purge_rewrites_only_files_with_foreign_rows(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "bars")
    for code, day in (("1.SH", A), ("1.HK", A), ("2.SZ", B), ("9.HK", C)):
        rows([(code, day, 1), (code if day != A else "3.SH", day, 2)], SCHEMA).coalesce(1).write.mode("append").partitionBy("trade_date").parquet(path)

    def files():
        return {f: spark.read.parquet(path).where(F.col("_metadata.file_path") == f).count() for f in spark.read.parquet(path).inputFiles()}

    before = files()
    scope = U.foreign_scope("daily_bars", ["code"])
    assert U.purge_stored(spark, path, scope) == 3
    left = spark.read.parquet(path)
    assert sorted((r.code, r.trade_date) for r in left.collect()) == [("1.SH", A), ("2.SZ", B), ("2.SZ", B), ("3.SH", A), ("3.SH", A)]
    after = files()
    assert set(after) < set(before) and len(before) - len(after) == 1  # one file held foreign rows alone
    assert U.purge_stored(spark, path, scope) == 0 and files() == after


def test_lookup_reads_only_the_folders_of_its_codes(spark, rows, tmp_path):
    from marketpulse.operators import attribution as K

    path = str(tmp_path / "att")
    K.store_by_code(rows([(f"c{i}", d, i) for i in range(40) for d in (A, B)], SCHEMA), path, buckets=8)
    found = K.lookup(spark, path, rows([("c3",), ("c3",), ("gone",)], "code string"), [B], buckets=8)
    assert [(r.code, r.trade_date, r.v) for r in found.collect()] == [("c3", B, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "code_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
