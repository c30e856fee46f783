"""Sources and sinks (A, B)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.checks.registry import query
from marketpulse.checks.sql import DOMESTIC
from marketpulse.functions import measures as M
from marketpulse.operators import attribution as K
from marketpulse.operators import returns as T
from marketpulse.operators import scopes as Z
from marketpulse.operators import upkeep as U
from marketpulse.operators.upkeep import write_partitions
from marketpulse.operators.versions import VersionedTable
from marketpulse.operators.intraday import session_anchors
from marketpulse.sources import ingest
from marketpulse.staging import shared_path

BAR_SPEC = ("code trade_date:d pre_close:f open:f high:f low:f close:f change_ratio:f volume:f amount:f")


def bar_payloads(bars, key="code"):
    """One payload per code: its bars as parallel arrays, the volume list one short."""
    fields = {v: k for k, v in ingest.BAR_FIELDS.items() if v in bars.columns}
    rows = bars.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("trade_date", *fields))).alias("r"))

    def values(n):
        arr = F.col(f"r.{n}")
        return F.slice(arr, F.lit(1), F.size(arr) - 1) if n == "volume" else arr

    table = F.struct(*[values(n).alias(api) for n, api in fields.items()])
    times = F.transform("r.trade_date", lambda d: F.date_format(d, "yyyy-MM-dd"))
    return rows.select(F.to_json(F.struct(
        F.col(key).alias("thscode"), times.alias("time"), table.alias("table"))).alias("payload"))


_SHORT_VOLUME = """SELECT * REPLACE (CASE WHEN trade_date = max(trade_date) OVER (PARTITION BY code) THEN NULL
    ELSE volume END AS volume) FROM bars"""


@query("a1_unpack_bars", BAR_SPEC, _SHORT_VOLUME)
def _(t):
    return ingest.unpack_bars(bar_payloads(t.bars))


@query("a2_unpack_group_map", "code group_id group_name pos:i",
       """SELECT code, group_id, group_name, row_number() OVER (PARTITION BY code ORDER BY group_id) - 1 AS pos
          FROM cur JOIN grp USING (group_id)""")
def _(t):
    named = K.with_names(t.current, t.groups).groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct("group_id", "group_name"))).alias("g"))
    names = F.concat(F.lit(" ,"), F.concat_ws(" , ", "g.group_name"), F.lit(",, unpaired"))
    table = F.struct(F.array(names).alias(ingest.GROUP_NAMES_FIELD),
                     F.array(F.concat_ws(",", "g.group_id")).alias(ingest.GROUP_CODES_FIELD))
    return ingest.unpack_group_map(named.select(
        F.to_json(F.struct(F.col("code").alias("thscode"), table.alias("table"))).alias("payload")))


@query("a3_unpack_group_dict", "group_id short_name full_name index_code main_code thscode",
       "SELECT group_id, group_name AS short_name, kind AS full_name, '' AS index_code, '' AS main_code, "
       "group_id AS thscode FROM grp")
def _(t):
    f = list(ingest.DICT_FIELDS)
    table = F.struct(F.array("group_name").alias(f[0]), F.array("kind").alias(f[1]),
                     F.array().cast("array<string>").alias(f[2]), F.array("group_id").alias(f[4]))
    return ingest.unpack_group_dict(t.groups.select(
        F.to_json(F.struct(F.col("group_id").alias("thscode"), table.alias("table"))).alias("payload")))


@query("a4_unpack_members", "group_id as_of:d code name",
       """SELECT group_id, as_of, code, CASE WHEN row_number() OVER (PARTITION BY group_id, as_of, substr(name, 1, 16)
          ORDER BY code DESC) = 1 THEN '' ELSE name END AS name FROM members""")
def _(t):
    chunks = t.members.groupBy("group_id", "as_of", F.substring("name", 1, 16).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("code", "name"))).alias("r"))
    names = F.slice("r.name", F.lit(1), F.size("r") - 1)
    table = F.struct(F.col("r.code").alias(ingest.MEMBER_CODES_FIELD), names.alias(ingest.MEMBER_NAMES_FIELD))
    return ingest.unpack_members(chunks.select(
        "group_id", "as_of", F.to_json(F.struct(table.alias("table"))).alias("payload")))


def quote_payloads(index):
    """Live quotes of every group's last bar; counts come empty, one code has no value."""
    last = T.last_bar(index)
    table = F.struct(F.array("change_ratio").alias("changeRatio"), F.array("open").alias("open"),
                     F.array("close").alias("latest"), F.array().cast("array<double>").alias("riseCount"))
    return last.select(F.to_json(F.struct(F.col("code").alias("thscode"), table.alias("table"))).alias("payload"))


_QUOTES = "SELECT code, arg_max(change_ratio, trade_date) AS change_ratio, arg_max(open, trade_date) AS open, " \
          "arg_max(close, trade_date) AS latest FROM idx GROUP BY 1"


@query("a5_unpack_quotes", "code change_ratio:f open:f latest:f n_values:i",
       "SELECT *, 3 AS n_values FROM quotes", quotes=_QUOTES)
def _(t):
    q = ingest.unpack_quotes(quote_payloads(t.index))
    pick = {"change_ratio": "changeRatio", "open": "open", "latest": "latest"}
    return q.select("code", *[F.try_element_at("quote", F.lit(v)).alias(k) for k, v in pick.items()],
                    F.size("quote").alias("n_values"))


def _group_documents(t):
    suffixes = {".SH": "17", ".SZ": "33", ".BJ": "151", ".HK": "177"}
    market = F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair])
    parts = t.custom.select(
        "group_id", "group_name", F.substring_index("code", ".", 1).alias("pure"),
        F.concat(F.lit("."), F.substring_index("code", ".", -1)).alias("suffix"))
    chunk = F.expr("substring(pure, 1, length(pure) - 2)")
    docs = parts.groupBy("group_id", "group_name", chunk.alias("chunk")).agg(F.collect_list(F.struct(
        F.col("pure").alias("code"), F.try_element_at(market, F.col("suffix")).alias("market_code"))).alias("stocks"))
    block = F.struct(F.col("group_id").alias("block_id"), F.col("group_name").alias("block_name"), "stocks")
    return docs.select(F.to_json(F.struct(F.array(block).alias("groups"))).alias("payload"))


@query("a6_import_groups", "group_id group_name code", f"SELECT group_id, group_name, code FROM custom WHERE {DOMESTIC}")
def _(t):
    return ingest.import_groups(_group_documents(t))[0]


@query("a6_import_stats", "group_count:i stock_count:i row_count:i skipped:i",
       f"""SELECT count(DISTINCT group_id) FILTER (WHERE {DOMESTIC}) AS group_count,
       count(DISTINCT code) FILTER (WHERE {DOMESTIC}) AS stock_count,
       count(*) FILTER (WHERE {DOMESTIC}) AS row_count, count(*) FILTER (WHERE NOT {DOMESTIC}) AS skipped FROM custom""")
def _(t):
    return ingest.import_groups(_group_documents(t))[1]


@query("a7_normalise_ticks",
       "code trade_date:d phase hhmm price:f avg_price:f volume:f turnover:f matched_vol:f unmatched_buy:f unmatched_sell:f",
       """SELECT code, trade_date, phase, hhmm, price,
          CASE WHEN phase = 'trading' THEN price ELSE 0 END AS avg_price, CASE WHEN phase = 'trading' THEN volume ELSE 0 END AS volume,
          CASE WHEN phase = 'trading' THEN turnover ELSE 0 END AS turnover,
          CASE WHEN phase = 'trading' THEN 0 ELSE matched_vol END AS matched_vol,
          CASE WHEN phase = 'trading' THEN 0 ELSE unmatched_buy END AS unmatched_buy,
          CASE WHEN phase = 'trading' THEN 0 ELSE unmatched_sell END AS unmatched_sell FROM ticks""")
def _(t):
    live = F.col("phase") == "trading"
    time = F.concat("hhmm", F.lit(":00"))
    trading = F.struct(time.alias("time"), F.col("price").alias("last_price"), "avg_price", "volume", "turnover")
    auction = F.struct(time.alias("time"), F.col("price").alias("ref_price"), "matched_vol",
                       F.col("unmatched_buy").alias("non_matched_vol_buy"),
                       F.col("unmatched_sell").alias("non_matched_vol_sell"))
    docs = t.ticks.groupBy("code", "trade_date", "hhmm").agg(
        F.collect_list(F.when(live, trading)).alias("trading"),
        F.collect_list(F.when(~live, auction)).alias("pre_market"))
    return ingest.normalise_ticks(docs.select(F.to_json(F.struct(
        "code", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "trading", "pre_market")).alias("payload")))


@query("a7_session_anchors", "trade_date:d code pre_close:f open:f", "SELECT * FROM anchors")
def _(t):
    return session_anchors(t.ticks)


_A8 = {"hits": f"SELECT trade_date, code, change_ratio FROM bars WHERE {DOMESTIC} AND change_ratio > 7"}


def _responses(t):
    """Screen responses: a table per date and block of codes, in three wrappings."""
    hits = Z.screen(t.bars, change_lo=7.0)
    pure = F.substring_index("code", ".", 1)
    line = F.concat_ws("|", F.lit(""), F.concat(F.lit(" "), "code"), F.concat(F.lit("n"), pure),
                       F.col("change_ratio").cast("string"), F.lit("x"), F.lit(""))
    chunk = F.expr("substring(substring_index(code, '.', 1), 1, length(substring_index(code, '.', 1)) - 2)")
    body = hits.groupBy("trade_date", chunk.alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    header = "结果\n|股票代码|股票简称|涨跌幅:前复权|备注|\n|---|---|---|---|\n"
    text = F.concat(F.lit(header), "rows", F.lit("\n|short|\n|000001.SZ|"))
    once = F.to_json(F.struct(F.lit(1).alias("code"), F.struct(text.alias("answer")).alias("data")))
    twice = F.to_json(F.struct(F.to_json(F.struct(text.alias("result"))).alias("data")))
    forms = F.array(*[F.struct(F.lit(n).alias("form"), v.alias("payload"))
                      for n, v in (("plain", text), ("once", once), ("twice", twice))])
    tables = body.select("trade_date", "chunk", F.explode(forms).alias("f")).select(
        F.concat_ws("/", "trade_date", "chunk", "f.form").alias("response_id"), "f.payload")
    empty = t.bars.select("trade_date").distinct().select(
        F.concat_ws("/", "trade_date", F.lit("none")).alias("response_id"), F.lit("未找到符合条件的股票").alias("payload"))
    return tables.unionByName(empty)


@query("a8_screen_hits", "trade_date:d form code name change_ratio:f",
       "SELECT trade_date, form, code, 'n' || split_part(code, '.', 1) AS name, change_ratio FROM hits, "
       "(VALUES ('plain'), ('once'), ('twice')) v(form)", **_A8)
def _(t):
    hits, _ = ingest.parse_screen_tables(_responses(t))
    return hits.select("*", F.substring_index("response_id", "/", 1).alias("trade_date"),
                       F.substring_index("response_id", "/", -1).alias("form"))


@query("a8_screen_errors", "response_id error",
       "SELECT DISTINCT CAST(trade_date AS VARCHAR) || '/none' AS response_id, 'not found' AS error FROM bars")
def _(t):
    return ingest.parse_screen_tables(_responses(t))[1]


@query("a9_read_bars", BAR_SPEC, "SELECT * FROM bars WHERE trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def _(t):
    path = shared_path(t.spark, "a9")
    U.write_partitions(t.bars, path, "trade_date")
    return ingest.read_bars(t.spark, path, "2024-01-10", "2024-01-20")


@query("a10_read_codes", "code", "SELECT DISTINCT code FROM bars")
def _(t):
    path = shared_path(t.spark, "a10")
    codes = t.bars.select("code").distinct()
    codes.select(F.explode(F.array(F.concat(F.lit("  "), "code", F.lit(" ")), F.lit(""))).alias("v")).write.text(path)
    return ingest.read_codes(t.spark, path)


@query("a11_read_calendar", "trade_date:d", "SELECT * FROM cal")
def _(t):
    path = shared_path(t.spark, "a11")
    text = F.array(F.date_format("trade_date", "yyyyMMdd"), F.date_format("trade_date", "yyyy-MM-dd"), F.lit(" "))
    t.calendar.select(F.explode(text).alias("v")).write.text(path)
    return ingest.read_calendar(t.spark, path)


@query("a12_index_returns", "code return_3d:f return_5d:f",
       """SELECT code, round((max(close) FILTER (rn = 1) / nullif(max(close) FILTER (rn = 4), 0) - 1) * 100, 4) AS return_3d,
          round((max(close) FILTER (rn = 1) / nullif(max(close) FILTER (rn = 6), 0) - 1) * 100, 4) AS return_5d
          FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM idx) GROUP BY 1""")
def _(t):
    bars = ingest.unpack_bars(bar_payloads(t.index))
    return T.bar_return(bars, 3).join(T.bar_return(bars, 5), "code")


@query("b1_upsert", "code trade_date:d close:f amount:f",
       "SELECT code, trade_date, CASE WHEN trade_date >= DATE '2024-01-15' THEN close ELSE close + 1 END AS close, "
       "CASE WHEN trade_date >= DATE '2024-01-15' THEN amount ELSE 0 END AS amount FROM bars")
def _(t):
    path = shared_path(t.spark, "b1")
    keys = ["code", "trade_date"]
    rows = t.bars.select(*keys, "close", "amount")
    first = rows.withColumn("close", F.col("close") + 1).withColumn("amount", F.lit(0.0))
    U.upsert_table(t.spark, path, first, keys, "trade_date")
    U.upsert_table(t.spark, path, rows.filter("trade_date >= date'2024-01-15'"), keys, "trade_date")
    return t.spark.read.parquet(path)


@query("b1_versioned_upsert", "code trade_date:d close:f amount:f version:i",
       "SELECT code, trade_date, CASE WHEN trade_date >= DATE '2024-01-15' THEN close ELSE close + 1 END AS close, "
       "CASE WHEN trade_date >= DATE '2024-01-15' THEN amount ELSE 0 END AS amount, 2 AS version FROM bars "
       "UNION ALL SELECT code, trade_date, close + 1, 0, 1 FROM bars WHERE trade_date = DATE '2024-01-15'")
def _(t):
    table = VersionedTable(t.spark, shared_path(t.spark, "b1-versions"))
    keys = ["code", "trade_date"]
    rows = t.bars.select(*keys, "close", "amount")
    table.upsert(rows.withColumn("close", F.col("close") + 1).withColumn("amount", F.lit(0.0)), keys)
    table.upsert(rows.filter("trade_date >= date'2024-01-15'"), keys)
    write_partitions(rows.limit(0), f"{table.path}/data/rows_version=3", "trade_date")  # a writer that died before it published
    now, before = table.read().withColumn("version", F.lit(2)), table.read(dates=["2024-01-15"], version=1).withColumn("version", F.lit(1))
    return now.unionByName(before)


@query("b3_saved_selection", "group_id",
       "SELECT group_id FROM mon WHERE group_id IN (SELECT group_id FROM watched)")
def _(t):
    path = shared_path(t.spark, "b3")
    U.save_selection(t.watched.where("group_id LIKE '885%'"), t.members, path)
    U.save_selection(t.watched, t.members, path)
    return U.saved(t.spark, path)


@query("a6_stored_groups", "group_id group_name code", "SELECT group_id, group_name, code FROM custom WHERE code LIKE '6%'")
def _(t):
    path = shared_path(t.spark, "a6")
    U.save_whole(t.custom, path)
    U.save_whole(t.custom.where("code LIKE '6%'"), path)
    return U.saved(t.spark, path)


@query("b1_upsert_order", "code close:f amount:f",
       "SELECT code, arg_max(close, trade_date) AS close, arg_max(amount, trade_date) AS amount FROM bars GROUP BY 1")
def _(t):
    rows = t.bars.select("code", "close", "amount", "trade_date")
    return U.upsert(rows.filter("trade_date < date'2024-01-03'"), rows, ["code"], "trade_date")


@query("b2_replace_partition", "trade_date:d group_id s1_return:f",
       """SELECT trade_date, group_id, avg(change_ratio) AS s1_return FROM bars JOIN cur USING (code)
          GROUP BY 1, 2 HAVING trade_date <> DATE '2024-01-15' OR group_id LIKE '885%'""")
def _(t):
    path = shared_path(t.spark, "b2")
    rows = t.bars.join(t.current, "code").groupBy("trade_date", "group_id").agg(F.avg("change_ratio").alias("s1_return"))
    U.replace_partition(rows, path)
    U.replace_partition(rows.filter("trade_date = date'2024-01-15' and group_id like '885%'"), path)
    return t.spark.read.parquet(path)


@query("b3_save_selection", "group_id saved:b",
       "SELECT group_id, group_id IN (SELECT group_id FROM mon) AS saved FROM (SELECT DISTINCT group_id FROM watched)")
def _(t):
    ok, rest = Z.eligible_selection(t.watched, t.members)
    return ok.withColumn("saved", F.lit(True)).unionByName(rest.withColumn("saved", F.lit(False)))


@query("b4_purge", "table_name deleted:i",
       f"""SELECT 'group_dict' AS table_name, count(*) FILTER (WHERE substr(group_id, 1, 3) NOT IN
            ('700','881','883','884','885','886')) AS deleted FROM grp
       UNION ALL SELECT 'group_members', count(*) FILTER (WHERE substr(group_id, 1, 3) NOT IN
            ('700','881','883','884','885','886')) FROM members
       UNION ALL SELECT 'instrument_group_map', count(*) FILTER (WHERE NOT {DOMESTIC}) FROM members
       UNION ALL SELECT 'daily_bars', count(*) FILTER (WHERE NOT {DOMESTIC}) FROM bars""")
def _(t):
    tables = {"group_dict": t.groups, "group_members": t.members, "daily_bars": t.bars,
              "instrument_group_map": t.members.select("code", "group_id", F.col("as_of").alias("map_date"))}
    return U.purge_foreign(tables)[1]


_FOREIGN_GROUP = "substr(group_id, 1, 3) NOT IN ('700','881','883','884','885','886')"
_STORED = {"group_dict": ("grp", _FOREIGN_GROUP), "group_members": ("members", _FOREIGN_GROUP), "instrument_group_map": ("members", f"NOT {DOMESTIC}"),
           "daily_bars": ("bars", f"NOT {DOMESTIC}"), "group_strength": ("gs", _FOREIGN_GROUP), "instrument_attribution": ("bars", f"NOT {DOMESTIC}")}


@query("b4_purge_stored", "table_name deleted:i kept:i again:i",
       " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) FILTER ({gone}) AS deleted, count(*) FILTER (NOT ({gone})) AS kept, 0 AS again FROM {source}"
                          for name, (source, gone) in _STORED.items()),
       gs="SELECT trade_date, group_id FROM bars JOIN cur USING (code) GROUP BY 1, 2")
def _(t):
    strength = t.bars.join(t.current, "code").groupBy("trade_date", "group_id").agg(F.avg("change_ratio").alias("s1_return"))
    frames = {"group_dict": (t.groups, ()), "group_members": (t.members, ("as_of",)), "daily_bars": (t.bars, ("trade_date",)),
              "instrument_group_map": (t.members.select("code", "group_id", F.col("as_of").alias("map_date")), ("map_date",)),
              "group_strength": (strength, ("trade_date",)),
              "instrument_attribution": (t.bars.select("code", "trade_date", F.col("change_ratio").alias("total_return")), ("trade_date",))}
    rows = []
    for name, (df, parts) in frames.items():
        path = shared_path(t.spark, f"b4-{name}")
        df.hint("rebalance", *parts).write.partitionBy(*parts).parquet(path)
        scope = U.foreign_scope(name, df.columns)
        deleted, again = U.purge_stored(t.spark, path, scope), U.purge_stored(t.spark, path, scope)
        counted = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept"))
        rows.append(counted.select(F.lit(name).alias("table_name"), F.lit(deleted).alias("deleted"), "kept", F.lit(again).alias("again")))
    return reduce(DataFrame.unionByName, rows)


@query("b4_purged_bars", BAR_SPEC, f"SELECT * FROM bars WHERE {DOMESTIC}")
def _(t):
    return U.purge_foreign({"daily_bars": t.bars})[0]["daily_bars"]


@query("b5_retain_since", "code trade_date:d close:f",
       "SELECT code, trade_date, close FROM bars WHERE trade_date >= DATE '2024-01-20'")
def _(t):
    return U.retain_since(t.bars, cutoff="2024-01-20")


@query("b5_retain_days", "code trade_date:d close:f",
       "SELECT code, trade_date, close FROM bars WHERE trade_date IN (SELECT trade_date FROM days ORDER BY 1 DESC LIMIT 2)")
def _(t):
    return U.retain_since(t.bars, keep_days=2)


@query("b8_return_bands", "code trade_date:d band direction",
       """SELECT code, trade_date, CASE WHEN c >= 9.8 THEN 'limit' WHEN c >= 5 THEN 'strong' WHEN c > 0 THEN 'up'
          WHEN c < 0 THEN 'down' ELSE 'flat' END AS band,
          CASE WHEN change_ratio > 0 THEN 'up' WHEN change_ratio < 0 THEN 'down' ELSE '' END AS direction
          FROM (SELECT *, coalesce(change_ratio, 0) AS c FROM bars)""")
def _(t):
    return t.bars.select("code", "trade_date", M.return_band("change_ratio").alias("band"),
                         M.direction("change_ratio").alias("direction"))
