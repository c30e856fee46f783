import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import intraday as I
from marketpulse.operators import upkeep as U
from marketpulse.schemas import TICKS
from marketpulse.sources import ingest
from marketpulse.streaming import live as V

D = date(2024, 1, 15)


def test_upsert_last_write_wins(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    schema = "code string, trade_date date, v int"
    U.upsert_table(spark, path, rows([("a", D, 1), ("b", D, 1), ("a", date(2024, 1, 1), 1)], schema), ["code", "trade_date"], "trade_date")
    U.upsert_table(spark, path, rows([("a", D, 2), ("c", D, 2), ("a", D, 3)], schema), ["code", "trade_date"], "trade_date", order="v")
    got = sorted((r.code, r.trade_date.day, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1, 1), ("a", 15, 3), ("b", 15, 1), ("c", 15, 2)]


def test_replace_leaves_no_stale_groups(spark, rows, tmp_path):
    path, schema = str(tmp_path / "s"), "trade_date date, group_id string, score double"
    U.replace_partition(rows([(D, "old-a", 1.0), (D, "old-b", 2.0), (date(2024, 1, 2), "keep", 1.0)], schema), path)
    U.replace_partition(rows([(D, "new-only", 3.0)], schema), path)
    assert sorted(r.group_id for r in spark.read.parquet(path).collect()) == ["keep", "new-only"]


def test_selection_counts(spark, rows, tmp_path):
    m = rows([("g", str(i), "", D) for i in range(10)], "group_id string, code string, name string, as_of date")
    assert U.save_selection(rows([("g",), ("h",)], "group_id string"), m, str(tmp_path / "w")) == (1, 1)


def test_purge_and_retention(rows):
    df = rows([("1.SH", D), ("1.HK", D), (None, D), ("2.SZ", date(2024, 1, 1))], "code string, trade_date date")
    kept, counts = U.purge_foreign({"daily_bars": df})
    assert kept["daily_bars"].count() == 2 and counts.first().deleted == 2
    assert U.retain_since(df, keep_days=1).count() == 3


def test_payload_edge_cases(rows):
    raw = rows([(json.dumps({"thscode": "a", "time": ["2024-01-01", "20240102"], "table": {"close": [1.5], "preClose": [None, 2]}}),)], "payload string")
    got = sorted(ingest.unpack_bars(raw).collect(), key=lambda r: r.trade_date)
    assert [(r.trade_date.day, r.close, r.pre_close, r.open) for r in got] == [(1, 1.5, None, None), (2, None, 2.0, None)]
    quotes = rows([(json.dumps({"thscode": "q", "table": {"open": [1.0], "latest": []}}),),
                   (json.dumps({"thscode": "empty", "table": {"open": []}}),)], "payload string")
    assert [(r.code, r.quote) for r in ingest.unpack_quotes(quotes).collect()] == [("q", {"open": 1.0})]


def test_screen_table_rules(rows):
    table = "\n".join(["|序号|股票简称|股票代码|最新涨跌幅|", "|---|---|---|---|", "|1|x|600001.SH|1.5|", "|2|y|600001.SH|bad|",
                       "|3|z|00700.HK|2|", "|4|short|", "|5|w|000002.SZ|-3|"])
    df = rows([("a", table), ("b", json.dumps({"data": json.dumps({"answer": table})})),
               ("c", json.dumps({"data": {"result": table}})), ("d", "未找到"), ("e", "no table"), ("f", "|股票简称|\n|x|")],
              "response_id string, payload string")
    hits, errors = ingest.parse_screen_tables(df)
    want = {("600001.SH", "y", 0.0), ("000002.SZ", "w", -3.0)}
    for key in "abc":
        assert {(r.code, r.name, r.change_ratio) for r in hits.filter(F.col("response_id") == key).collect()} == want
    assert hits.filter("response_id in ('d', 'e', 'f')").count() == 0
    assert [r.response_id for r in errors.collect()] == ["d"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "codes.txt").write_text(" 600001.SH \n\n000002.SZ\n")
    assert sorted(r.code for r in ingest.read_codes(spark, str(tmp_path / "codes.txt")).collect()) == ["000002.SZ", "600001.SH"]
    (tmp_path / "cal.txt").write_text("20240103\n2024-01-02\n20240103\n")
    assert [r.trade_date.day for r in ingest.read_calendar(spark, str(tmp_path / "cal.txt")).collect()] == [2, 3]
    (tmp_path / "g.json").write_text(json.dumps({"groups": [{"block_id": "7", "stocks": [
        {"code": "600001", "market_code": "17"}, {"code": "x", "market_code": "48"}]}]}))
    kept, stats = ingest.import_groups_file(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in kept.collect()] == [("7", "7", "600001.SH")]
    assert stats.first().asDict() == {"group_count": 1, "stock_count": 1, "row_count": 1, "skipped": 1}


def ticks_at(spark, points):
    base = datetime(2024, 1, 15, 9, 30)
    data = [(c, D, "trading", s, base + timedelta(seconds=t), (base + timedelta(seconds=t)).strftime("%H:%M"),
             p, p, 1.0, 0.0, 0.0, 0.0, 0.0) for c, s, t, p in points]
    return spark.createDataFrame(data, TICKS)


@pytest.fixture
def feed(spark, tmp_path):
    path = str(tmp_path / "feed")

    def push(points):
        ticks_at(spark, points).coalesce(1).write.mode("append").parquet(path)

    push([("a", 0, 0, 100.0)])
    return path, push, spark.readStream.schema(TICKS).parquet(path)


def test_minute_bars_drop_and_count_late_ticks(spark, feed, tmp_path):
    path, push, stream = feed
    out, log = str(tmp_path / "bars"), str(tmp_path / "log")

    def drain():
        q = V.write_stream(V.minute_bars(stream), out, log, availableNow=True)
        q.awaitTermination()
        return V.late_rows(q)

    push([("a", 1, 20, 102.0), ("a", 2, 70, 101.0), ("b", 3, 30, 5.0)])
    drain()
    push([("a", 4, 600, 110.0)])
    drain()
    push([("a", 5, 40, 999.0), ("a", 6, 900, 111.0)])  # the first is far too late
    assert drain() == 1
    bars = {(r.code, r.minute.strftime("%H:%M")): (r.open, r.high, r.low, r.close) for r in spark.read.parquet(out).collect()}
    assert bars[("a", "09:30")] == (100.0, 102.0, 100.0, 102.0)
    assert bars[("b", "09:30")] == (5.0, 5.0, 5.0, 5.0)


def test_deduplication(spark, feed, tmp_path):
    _, push, stream = feed
    push([("a", 0, 0, 100.0), ("a", 1, 1, 101.0)])
    out = str(tmp_path / "d")
    V.write_stream(V.dedupe_ticks(stream), out, str(tmp_path / "l"), availableNow=True).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [0, 1]


def test_latest_state_survives_replayed_batches(spark, tmp_path):
    points = [("a", i, i * 25, 100.0 + i * i) for i in range(8)] + [("b", 20, 5, 50.0)]
    members = spark.createDataFrame([("g", "a"), ("g", "b")], "group_id string, code string")
    state = V.LatestState(str(tmp_path / "state"), members, min_members=1)
    batches = [ticks_at(spark, points[:3]), ticks_at(spark, points[3:6]), ticks_at(spark, points[6:])]
    for i, batch in enumerate(batches):
        state.merge(batch, i)
        state.merge(batch, i)  # replay
    stored = spark.read.schema(TICKS).parquet(state.state_path)
    want = sorted(map(tuple, I.indicators(ticks_at(spark, points)).collect()))
    assert sorted(map(tuple, I.indicators(stored).collect())) == want
    last = spark.read.parquet(state.strength_path(2)).collect()
    assert [(r.group_id, r.member_count) for r in last] == [("g", 2)]


def test_slots_fire_on_their_minute(spark, tmp_path):
    out = str(tmp_path / "alerts")
    fire = V.slot_alerts(lambda batch, slot: batch.select("code"), out)
    fire(ticks_at(spark, [("a", 0, 60, 1.0)]), 0)
    fire(ticks_at(spark, [("a", 1, 185, 1.0)]), 1)
    got = spark.read.parquet(out).select("slot", "batch").distinct().collect()
    assert [(str(r.slot), r.batch) for r in got] == [("933", 1)]


def test_slots_of_a_batch_share_its_ticks_and_anchors(spark, tmp_path, monkeypatch):
    """Four slots fire on one batch: its source is read for the stored ticks only (before: by every action of every slot), anchors are made once."""
    out, reads, made = str(tmp_path / "alerts"), spark.sparkContext.accumulator(0), []
    batch = ticks_at(spark, [("a", i, m, 1.0 + i) for i, m in enumerate((0, 180, 183, 185, 390, 500, 800, 900))]).coalesce(1)

    def counted(batches):
        reads.add(1)
        yield from batches

    real = V.session_anchors
    monkeypatch.setattr(V, "session_anchors", lambda ticks: made.append(1) or real(ticks))
    monkeypatch.setattr(V, "SLOTS", {s: {"time": at} for s, at in zip("wxyz", [r.hhmm for r in batch.select("hhmm").distinct().sort("hhmm").collect()[-4:]])})
    V.slot_alerts(lambda ticks, slot, anchors: I.indicators(ticks, V.SLOTS[slot]["time"], resolve=False, anchors=anchors), out, anchored=True)(
        batch.mapInArrow(counted, batch.schema), 0)
    assert (reads.value, len(made)) == (1, 1)
    for slot, conf in V.SLOTS.items():
        want = I.indicators(batch, conf["time"], resolve=False)
        assert spark.read.parquet(f"{out}/slot={slot}").drop("batch").collect() == want.collect() != []
