"""Run statistics, late ticks as revisions, ordered positions and dated mappings."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import attribution as K
from marketpulse.operators import ranking as R
from marketpulse.operators.versions import VersionedTable
from marketpulse.plans.runlog import RunLog, strength_step
from marketpulse.schemas import TICKS
from marketpulse.streaming.intake import TickIntake

D = date(2024, 1, 15)


def test_run_log_counts_skipped_groups_and_failures(spark, rows, tmp_path):
    quotes = rows([(D, c, 1.0) for c in "abcd"] + [(D, "e", None)], "trade_date date, code string, change_ratio double")
    members = rows([("big", c) for c in "abc"] + [("small", "d"), ("unknown", "e")], "group_id string, code string")
    log = RunLog(spark, str(tmp_path / "log"), "monday")
    assert strength_step(log, quotes, members, lambda df: df.write.parquet(str(tmp_path / "s")), min_members=2)
    assert not log.step("next", lambda: quotes.select("none"), lambda df: df.write.parquet(str(tmp_path / "n")))
    log.save()
    kept = {(r.step, r.metric): r.value for r in log.save().collect()}  # a second save replaces the first
    assert kept == {("group_strength", "groups_seen"): 3, ("group_strength", "skipped_for_size"): 2, ("group_strength", "rows_saved"): 1,
                    ("group_strength", "rows_unscored"): 0, ("group_strength", "failed"): 0, ("next", "failed"): 1}
    other = RunLog(spark, str(tmp_path / "log"), "tuesday")
    other.step("one", lambda: other.watch(quotes, n=F.count(F.lit(1))), lambda df: df.write.format("noop").mode("overwrite").save())
    assert {(r.run_id, r.metric) for r in other.save().where("step = 'one'").collect()} == {("tuesday", "n"), ("tuesday", "failed")}
    assert [r.error for r in other.save().where("step = 'next'").collect()][0].startswith("UNRESOLVED_COLUMN")


def ticks_at(spark, points):
    base = datetime(2024, 1, 15, 9, 30)
    return spark.createDataFrame([("a", D, "trading", s, base + timedelta(minutes=m), "09:30", p, p, 1.0, 0.0, 0.0, 0.0, 0.0) for s, m, p in points], TICKS)


def test_late_ticks_are_kept_and_merged_as_revisions(spark, tmp_path):
    box = TickIntake(str(tmp_path / "in"), "2 minutes", "10 minutes")
    table = VersionedTable(spark, str(tmp_path / "ticks"))
    batches = [[(1, 0, 1.0), (1, 0, 1.0), (2, 20, 2.0)], [(2, 20, 2.0), (3, 18, 3.0), (4, 10, 4.0), (1, 9, 9.0), (5, 7, 5.0)], []]
    for i, points in enumerate(batches):
        box.merge(ticks_at(spark, points), i)
        box.merge(ticks_at(spark, points), i)  # a replay
    counts = {r.batch_id: (r.arrived, r.repeated, r.on_time, r.late, r.too_late) for r in box.counts(spark).collect()}
    assert counts == {0: (3, 1, 2, 0, 0), 1: (5, 1, 1, 2, 1), 2: (0, 0, 0, 0, 0)}
    for up_to, want in ((0, {1: 1.0, 2: 2.0}), (None, {1: 9.0, 2: 2.0, 3: 3.0, 4: 4.0}), (None, {1: 9.0, 2: 2.0, 3: 3.0, 4: 4.0})):
        box.revise(ticks_at(spark, []), table, up_to)
        assert {r.seq: r.price for r in table.read().collect()} == want


@pytest.mark.parametrize("descending,nulls", [(True, "last"), (False, "zero"), (True, "zero"), (False, "last")])
def test_positions_follow_the_order(rows, descending, nulls):
    data = [(i, None if i % 7 == 0 else float((i * 37) % 23 - 11)) for i in range(300)]
    got = sorted(R.ordered_positions(rows(data, "id int, v double").repartition(9), "v", descending, nulls, ["id"]).collect(), key=lambda r: r.pos)
    known = [(i, 0.0 if v is None and nulls == "zero" else v) for i, v in data]
    want = sorted(known, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
    assert [r.id for r in got] == [i for i, _ in want] and [r.pos for r in got] == list(range(1, 301))


def test_a_backfill_takes_the_mapping_of_its_own_date(rows):
    days = [date(2024, 1, d) for d in (1, 5, 9)]
    bars = rows([(d, "1.SH", 2.0) for d in days], "trade_date date, code string, change_ratio double")
    mapping = rows([("1.SH", "old", date(2024, 1, 3)), ("2.SZ", "old", date(2024, 1, 3)), ("1.SH", "new", date(2024, 1, 8)), ("x.HK", "new", date(2024, 1, 8)),
                    ("1.SH", "nameless", date(2024, 1, 8))], "code string, group_id string, map_date date")
    members = rows([(g, "1.SH", "", days[0]) for g in ("old", "new")], "group_id string, code string, name string, as_of date")
    groups = rows([("old", "Old"), ("new", "New")], "group_id string, group_name string")
    got = {(r.trade_date.day, r.code): (r.top_group, r.total_return) for r in K.mapped_attribution(bars, mapping, members, groups).collect()}
    assert got == {(5, "1.SH"): ("old", 2.0), (5, "2.SZ"): ("old", 0.0), (9, "1.SH"): ("new", 2.0)}
    latest = K.mapped_attribution(bars, mapping, members, groups, dated=False).collect()
    assert {(r.trade_date.day, r.top_group) for r in latest} == {(1, "new"), (5, "new"), (9, "new")}
