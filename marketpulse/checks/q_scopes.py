"""Scopes, latest selection, joins and set operations (C, D, E, J)."""

from pyspark.sql import functions as F

from marketpulse.checks.registry import query
from marketpulse.checks.sql import DOMESTIC, ZT, limit_up
from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators import attribution as K
from marketpulse.operators import latest as L
from marketpulse.operators import scopes as Z
from marketpulse.operators import strength as S
from marketpulse.operators import tradingdays as D

_PREFIX = "substr(group_id, 1, 3)"


@query("c1_domestic_codes", "code trade_date:d is_domestic:b board vendor_code",
       f"""SELECT code, trade_date, {DOMESTIC} AS is_domestic,
        CASE WHEN code LIKE '%.BJ' THEN 'bj' WHEN code LIKE '300%' OR code LIKE '688%' THEN 'gem_star' ELSE 'main' END AS board,
        split_part(code, '.', 2) || split_part(code, '.', 1) AS vendor_code FROM bars""")
def _(t):
    return t.bars.select("code", "trade_date", C.is_domestic().alias("is_domestic"), C.board().alias("board"),
                         C.vendor_code().alias("vendor_code"))


@query("c2_c4_group_flags", "group_id domestic:b observed:b zt:b level",
       f"""SELECT group_id, {_PREFIX} IN ('700','881','883','884','885','886') AS domestic,
        {_PREFIX} IN ('884','885','886') AS observed, {ZT} AS zt,
        CASE WHEN {_PREFIX} = '884' THEN '三级行业' WHEN {_PREFIX} IN ('885','886') THEN '概念板块' ELSE '其他' END AS level
        FROM (SELECT group_id, group_name FROM custom_names UNION SELECT group_id, group_name FROM grp WHERE kind = 'region')""")
def _(t):
    regions = t.groups.filter("kind = 'region'").select("group_id", "group_name")
    return t.custom_names.unionByName(regions).select(
        "group_id", C.is_domestic_group().alias("domestic"), C.is_observed_group().alias("observed"),
        C.is_zt().alias("zt"), C.group_level().alias("level"))


@query("c3_in_pool", "group_id group_name",
       f"""SELECT group_id, group_name FROM grp WHERE {_PREFIX} IN ('885', '886')
        OR group_id IN (SELECT group_id FROM sizes WHERE {_PREFIX} = '884' AND member_count >= 50)""")
def _(t):
    pool = Z.group_sizes(t.members).filter((F.col("member_count") >= 50) & F.col("group_id").startswith("884"))
    return Z.in_pool(t.groups, pool)


@query("c5_monitorable", "group_id member_count:i", "SELECT * FROM mon")
def _(t):
    return Z.monitorable(t.members)


@query("c6_effective_scope", "group_id", "SELECT group_id FROM eff")
def _(t):
    return Z.effective_scope(t.watched, t.groups, t.members)


@query("c6_scope_fallback", "group_id", f"SELECT group_id FROM grp WHERE {_PREFIX} IN ('884','885','886')")
def _(t):
    none = t.groups.filter("kind = 'region'").select("group_id")
    return Z.effective_scope(none.filter(C.is_domestic_group()), t.groups, t.members)


@query("c7_universe_latest", "code",
       f"SELECT DISTINCT code FROM members WHERE as_of = (SELECT max(as_of) FROM members) AND {DOMESTIC}")
def _(t):
    return Z.universe("latest", t.members)


@query("c7_universe_groups", "code", "SELECT DISTINCT code FROM em")
def _(t):
    return Z.universe("groups", t.members, Z.effective_scope(t.watched, t.groups, t.members))


@query("c7_universe_custom", "code", "SELECT DISTINCT code FROM custom")
def _(t):
    return Z.universe("custom", t.custom)


@query("c8_new_listings", "code first_date:d",
       """SELECT code, min(trade_date) AS first_date FROM bars GROUP BY 1
          HAVING min(trade_date) > (SELECT trade_date FROM days WHERE trade_date <= DATE '2024-01-05' ORDER BY 1 DESC LIMIT 1 OFFSET 4)""")
def _(t):
    return Z.new_listings(t.bars, "2024-01-05")


@query("c9_filter_candidates", "group_id group_name watched:b",
       """SELECT group_id, group_name, true AS watched FROM grp WHERE group_id LIKE '886%'
          AND group_id IN (SELECT group_id FROM watched) AND (group_name LIKE '%1 M%' OR group_id LIKE '%1 M%')""")
def _(t):
    marked = t.groups.join(t.watched.withColumn("watched", F.lit(True)), "group_id", "left").na.fill(False, ["watched"])
    return Z.filter_candidates(marked, "886", True, "1 M")


@query("c10_rotation_groups", "group_id group_name member_count:i",
       f"""SELECT group_id, group_name, count(DISTINCT code) AS member_count FROM custom
           WHERE NOT ({ZT}) AND group_name <> 'CC' GROUP BY 1, 2 HAVING count(DISTINCT code) >= 6""")
def _(t):
    return Z.rotation_groups(t.custom, t.custom_names)


_LISTED = """SELECT b.*, (SELECT count(*) FROM days d WHERE d.trade_date BETWEEN f.first_date AND b.trade_date) AS n_days
    FROM bars b JOIN (SELECT code, min(trade_date) AS first_date FROM bars GROUP BY 1) f USING (code)"""


@query("c12_screen", "code trade_date:d change_ratio:f",
       """SELECT code, trade_date, change_ratio FROM listed WHERE ((close / nullif(open, 0) - 1) * 100 > 3
          OR (high / nullif(pre_close, 0) - 1) * 100 > 3) AND amount > 50 AND n_days > 5""", listed=_LISTED)
def _(t):
    return Z.screen(t.bars, body_or_max=3.0, min_amount=50.0, listed_days=5)


@query("c12_screen_range", "code trade_date:d change_ratio:f",
       f"SELECT code, trade_date, change_ratio FROM bars WHERE change_ratio > 7 AND change_ratio < 12.1 AND NOT {limit_up()}")
def _(t):
    named = t.bars.withColumn("name", F.col("code"))
    return Z.screen(named, change_lo=7.0, change_hi=12.1, exclude_limit_up=True, exclude_st=True)


@query("c13_missing_groups", "group_id group_name",
       f"SELECT group_id, min(group_name) AS group_name FROM custom WHERE {_PREFIX} = '886' GROUP BY 1")
def _(t):
    return Z.missing_groups(t.custom, t.groups.filter("kind <> 'nation_segment'"))


@query("c14_missing_dates", "trade_date:d",
       """SELECT CAST(d AS DATE) AS trade_date FROM (SELECT unnest(generate_series(max(trade_date) + INTERVAL 1 DAY, TIMESTAMP '2024-02-20', INTERVAL 1 DAY)) AS d
          FROM days WHERE trade_date < DATE '2024-01-22') WHERE CAST(d AS DATE) IN (SELECT trade_date FROM cal)
          OR (CAST(d AS DATE) > (SELECT max(trade_date) FROM cal) AND isodow(d) <= 5)""")
def _(t):
    return D.missing_dates(t.calendar, t.bars.filter("trade_date < date'2024-01-22'"), "2024-02-20")


@query("c15_missing_to_null", "code trade_date:d change_ratio:f",
       "SELECT code, trade_date, CASE WHEN change_ratio > 0 THEN change_ratio END AS change_ratio FROM bars")
def _(t):
    nan = F.when(F.col("change_ratio") > 0, F.col("change_ratio")).otherwise(F.lit(float("nan")))
    return M.missing_to_null(t.bars.withColumn("change_ratio", nan))


@query("d1_latest_per_group", "group_id code as_of:d",
       "SELECT group_id, code, as_of FROM members JOIN (SELECT group_id, max(as_of) AS as_of FROM members GROUP BY 1) USING (group_id, as_of)")
def _(t):
    return L.latest_by(t.members, ["group_id"])


@query("d2_latest_per_instrument", "group_id code as_of:d",
       "SELECT group_id, code, as_of FROM members JOIN (SELECT code, max(as_of) AS as_of FROM members GROUP BY 1) USING (code, as_of)")
def _(t):
    return L.latest_by(t.members, ["code"])


@query("d3_latest_global", "group_id code as_of:d",
       "SELECT group_id, code, as_of FROM members WHERE as_of = (SELECT max(as_of) FROM members)")
def _(t):
    return L.latest_by(t.members, [])


@query("d4_snapshot", "group_id code as_of:d", "SELECT group_id, code, as_of FROM members WHERE as_of = DATE '2024-01-01'")
def _(t):
    return L.snapshot(t.members, "2024-01-01")


@query("d5_as_of_date", "trade_date:d", "SELECT max(trade_date) AS trade_date FROM lbars WHERE trade_date <= DATE '1997-03-02'")
def _(t):
    return L.as_of_date(t.long_bars, "1997-03-02")


@query("d6_prev_volume", "trade_date:d code prev_volume:f", "SELECT * FROM prevvol")
def _(t):
    return L.prev_volume(t.bars)


@query("d6_prev_volume_on", "code prev_volume:f",
       "SELECT code, volume AS prev_volume FROM bars WHERE volume > 0 AND trade_date = DATE '2024-01-14'")
def _(t):
    return L.prev_volume(t.bars, "2024-01-15")


@query("d7_last_bar", "code trade_date:d close:f8 change_ratio:f",
       """SELECT code, trade_date, close, change_ratio FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn
          FROM lbars WHERE trade_date <= DATE '1999-06-30') WHERE rn = 1""")
def _(t):
    return L.last_bar(t.long_bars, "1999-06-30")


@query("d9_time_axis", "trade_date:d hhmm", "SELECT DISTINCT trade_date, hhmm FROM ticks")
def _(t):
    return L.time_axis(t.ticks)


@query("d10_resolve_snapshot", "trade_date:d first_time latest_time snapshot_time",
       """SELECT trade_date, min(hhmm) AS first_time, max(hhmm) AS latest_time,
          CASE WHEN '00:10' >= min(hhmm) THEN '00:10' ELSE max(hhmm) END AS snapshot_time FROM ticks GROUP BY 1""")
def _(t):
    return L.resolve_snapshot(t.ticks, "00:10")


@query("d11_names", "code trade_date:d name",
       "SELECT b.code, b.trade_date, coalesce(n.name, b.code) AS name FROM bars b LEFT JOIN names n USING (code)")
def _(t):
    return L.with_member_names(t.bars, t.members, default=None)


@query("d12_available_dates", "trade_date:d", "SELECT * FROM days")
def _(t):
    return L.available_dates(t.bars)


@query("e1_quotes_by_group", "trade_date:d group_id code change_ratio:f",
       "SELECT trade_date, group_id, code, change_ratio FROM bars JOIN cur USING (code)")
def _(t):
    return S.quotes_by_group(t.bars, t.current)


@query("e2_with_names", "group_id code group_name",
       "SELECT group_id, code, group_name FROM members JOIN grp USING (group_id) WHERE kind <> 'region' AND as_of = DATE '2024-01-15'")
def _(t):
    return K.with_names(L.snapshot(t.members, "2024-01-15"), t.groups.filter("kind <> 'region'"))


@query("e6_keep_members", "code trade_date:d close:f",
       "SELECT code, trade_date, close FROM bars WHERE code IN (SELECT code FROM wm)")
def _(t):
    return Z.keep_members(t.bars, t.scope)


@query("e7_drop_members", "code trade_date:d close:f",
       "SELECT code, trade_date, close FROM bars WHERE code NOT IN (SELECT code FROM custom WHERE group_name LIKE 'ZT%')")
def _(t):
    return Z.drop_members(t.bars, t.custom.filter("group_name like 'ZT%'"))


@query("e8_coalesce_sources", "code trade_date:d change_ratio:f",
       "SELECT code, trade_date, coalesce(change_ratio, (close / nullif(open, 0) - 1) * 100) AS change_ratio FROM bars")
def _(t):
    from marketpulse.sources.ingest import coalesce_sources

    body = t.bars.select("code", "trade_date", M.pct_change("close", "open").alias("change_ratio"))
    return coalesce_sources(t.bars.select("code", "trade_date", "change_ratio"), body,
                            ["code", "trade_date"], ["change_ratio"])


@query("j_set_operations", "code inside:b only_old:b",
       """SELECT code, bool_or(n) AND bool_or(o) AS inside, bool_or(o) AND NOT bool_or(n) AS only_old FROM (
          SELECT code, false AS n, true AS o FROM members WHERE as_of = DATE '2024-01-01'
          UNION ALL SELECT code, true, false FROM members WHERE as_of = DATE '2024-01-15') GROUP BY 1""")
def _(t):
    old = L.snapshot(t.members, "2024-01-01").select("code").distinct()
    new = L.snapshot(t.members, "2024-01-15").select("code").distinct()
    both, gone = old.intersect(new), old.exceptAll(new)
    flags = {"inside": both, "only_old": gone}
    out = old.union(new).distinct()
    for name, df in flags.items():
        out = out.join(df.withColumn(name, F.lit(True)), "code", "left")
    return out.na.fill(False, list(flags))
