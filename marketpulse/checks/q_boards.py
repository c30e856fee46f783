"""Dashboards, candidate lists, rotation and replay (M1-M9)."""

from pyspark.sql import functions as F

from marketpulse.checks.q_groups import (
    AG_SPEC, AUCTION_GROUPS, ROT_CTES, ROT_SPEC, ROT_SQL, STATS_SPEC, bench_index, multi_ctes, stats_sql)
from marketpulse.checks.q_ingest import bar_payloads, quote_payloads
from marketpulse.checks.q_metrics import FACTOR_SPEC, auction_score_sql, factors_sql, member_score_sql
from marketpulse.checks.registry import query
from marketpulse.checks.sql import ZT, figures, limit_up, scored, snapshots, tick_states
from marketpulse.functions import codes as C
from marketpulse.operators import returns as T
from marketpulse.operators.strength import multi_period_strength
from marketpulse.plans import candidates as N
from marketpulse.plans import dashboards as D
from marketpulse.sources import ingest

GROUP_SPEC = "trade_date:d section pos:i group_id group_name score:f s1_return:f s_body:f s2_breadth:f member_count:i"
MEMBER_SPEC = ("trade_date:d section group_id pos:i code name change_ratio:f speed:f body:f acceleration:f limit_up:i "
               "score:f")

_LISTS = """SELECT trade_date, 'top' AS section, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, group_id) AS pos,
      * EXCLUDE (trade_date) FROM {src}
    UNION ALL SELECT trade_date, 'bottom', row_number() OVER (PARTITION BY trade_date ORDER BY score ASC NULLS FIRST, group_id DESC),
      * EXCLUDE (trade_date) FROM {src}"""
_MEMBER_LISTS = """SELECT s.*, coalesce(n.name, '') AS name, s.limit_score AS limit_up, row_number() OVER (PARTITION BY s.trade_date, s.group_id, p.section
      ORDER BY CASE WHEN p.section = 'bottom' THEN -round(s.score, 9) ELSE round(s.score, 9) END DESC, s.code) AS pos, p.section
    FROM ms s JOIN picked p USING (trade_date, group_id) LEFT JOIN names n USING (code)"""


def m1_ctes(at):
    return {
        "sticks": "SELECT * FROM ticks WHERE code IN (SELECT code FROM wm)",
        "snap": snapshots("sticks", at),
        "cut": "SELECT t.* FROM sticks t JOIN snap USING (trade_date) WHERE hhmm <= snapshot_time",
        "ind": tick_states("cut", "trade_date, code"),
        "fig": figures("ind", "wm", body="q.body"), "sc": scored("fig", "trade_date"),
        "lists": _LISTS.format(src="sc"),
        "picked": "SELECT l.*, g.group_name FROM lists l JOIN grp g USING (group_id) WHERE pos <= 10",
        "gm": "SELECT i.*, c.group_id FROM ind i JOIN (SELECT DISTINCT group_id, code FROM wm) c USING (code)",
        "ms": member_score_sql("gm"), "ml": _MEMBER_LISTS,
    }


def m1(t, at="14:30"):
    return D.intraday_dashboard(t.ticks, t.scope, t.groups, t.members, at, precision=None)


@query("m1_dashboard_groups", GROUP_SPEC, "SELECT * FROM picked", **m1_ctes("14:30"))
def _(t):
    return m1(t).groups


@query("m1_dashboard_members", MEMBER_SPEC, "SELECT * FROM ml WHERE pos <= 10", **m1_ctes("14:30"))
def _(t):
    return m1(t).members


@query("m1_dashboard_stats", STATS_SPEC, stats_sql("ind"), **m1_ctes("14:30"))
def _(t):
    return m1(t).stats


@query("m1_dashboard_morning", GROUP_SPEC, "SELECT * FROM picked", **m1_ctes("08:45"))
def _(t):
    return m1(t, "08:45").groups


def m2_ctes(at=None):
    return {
        "sticks": "SELECT * FROM ticks WHERE code IN (SELECT code FROM custom)",
        "snap": snapshots("sticks", at),
        "cut": "SELECT t.* FROM sticks t JOIN snap USING (trade_date) WHERE hhmm <= snapshot_time",
        "ind": tick_states("cut", "trade_date, code"),
        "fig0": figures("ind", "custom", body="q.body", minimum=0),
        "fig": "SELECT f.*, n.group_name FROM fig0 f JOIN custom_names n USING (group_id)",
        "large": "SELECT * FROM fig WHERE member_count >= 6", "scl": scored("large", "trade_date"),
        "small": f"SELECT * FROM fig WHERE member_count < 6 AND {ZT}", "scs": scored("small", "trade_date"),
        "plain": f"SELECT * FROM scl WHERE NOT ({ZT})",
        "zts": f"SELECT *, 'all' AS cross_section FROM scl WHERE {ZT} UNION ALL SELECT *, 'zt' FROM scs",
        "lists": _LISTS.format(src="plain"),
        "picked": """SELECT *, 'all' AS cross_section FROM lists WHERE pos <= 10 UNION ALL BY NAME
            SELECT *, 'zt' AS section, row_number() OVER (PARTITION BY trade_date ORDER BY s1_return DESC NULLS LAST, group_id) AS pos FROM zts""",
        "held": "SELECT group_id, count(DISTINCT code) AS holding_count FROM custom "
                "WHERE code IN (SELECT code FROM custom WHERE group_name = 'CC') GROUP BY 1",
        "gm": "SELECT i.*, c.group_id FROM ind i JOIN (SELECT DISTINCT group_id, code FROM custom) c USING (code)",
        "ms": member_score_sql("gm"), "ml": _MEMBER_LISTS,
    }


def m2(t):
    return D.custom_dashboard(t.ticks, t.custom, t.members, precision=None)


@query("m2_custom_groups", GROUP_SPEC + " cross_section holding_count:i",
       "SELECT p.*, coalesce(h.holding_count, 0) AS holding_count FROM picked p LEFT JOIN held h USING (group_id)", **m2_ctes())
def _(t):
    return m2(t).groups


@query("m2_custom_members", MEMBER_SPEC, "SELECT * FROM ml WHERE pos <= 10", **m2_ctes())
def _(t):
    return m2(t).members


@query("m3_member_drilldown",
       "trade_date:d group_id member_count:i pos:i code name change_ratio:f speed:f body:f acceleration:f score:f",
       """SELECT r.*, coalesce(n.name, '') AS name FROM (SELECT *, count(*) OVER (PARTITION BY trade_date, group_id) AS member_count,
          row_number() OVER (PARTITION BY trade_date, group_id ORDER BY change_ratio ASC, score DESC, code) AS pos FROM ms) r
          LEFT JOIN names n USING (code) WHERE pos <= 10""",
       cut="SELECT * FROM ticks WHERE hhmm <= '14:30'", ind=tick_states("cut", "trade_date, code"),
       gm="SELECT i.*, c.group_id FROM ind i JOIN (SELECT DISTINCT group_id, code FROM wm) c USING (code)",
       ms=member_score_sql("gm"))
def _(t):
    return D.member_drilldown(t.ticks, t.scope, t.members, "14:30", "change_ratio", False)


M4_CTES = {
    "fac": factors_sql("09:25"), "asc_": auction_score_sql(), "ag": AUCTION_GROUPS,
    "apick": "SELECT *, CASE WHEN is_zt THEN 'zt' ELSE 'main' END AS section FROM (SELECT *, row_number() OVER "
             "(PARTITION BY trade_date, is_zt ORDER BY round_even(score, 4) DESC, group_id) AS pos FROM ag) WHERE is_zt OR pos <= 20",
    "gnames": "SELECT code, string_agg(group_name, '|' ORDER BY group_id) AS group_names FROM (SELECT code, group_name, "
              "min(group_id) AS group_id FROM custom GROUP BY 1, 2) GROUP BY 1",
    "deco": "SELECT s.*, coalesce(n.name, '') AS name, g.group_names, s.code IN (SELECT code FROM custom WHERE group_name = 'CC') AS holding "
            "FROM asc_ s LEFT JOIN names n USING (code) LEFT JOIN gnames g USING (code)",
}
_STOCK = FACTOR_SPEC + " score:f pos:i name group_names holding:b"


def m4(t):
    return D.auction_dashboard(t.ticks, t.bars, t.custom, t.members, "09:25")


@query("m4_auction_stocks", _STOCK,
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS pos FROM deco) WHERE pos <= 30",
       **M4_CTES)
def _(t):
    return m4(t).stocks.withColumn("group_names", F.concat_ws("|", "group_names"))


@query("m4_auction_groups", AG_SPEC + " section pos:i", "SELECT * FROM apick", **M4_CTES)
def _(t):
    return m4(t).groups


@query("m4_auction_group_members", _STOCK + " group_id",
       """SELECT * FROM (SELECT d.*, c.group_id, row_number() OVER (PARTITION BY d.trade_date, c.group_id ORDER BY d.score DESC, d.code) AS pos
          FROM deco d JOIN custom c USING (code) WHERE (d.trade_date, c.group_id) IN (SELECT (trade_date, group_id) FROM apick)) WHERE pos <= 10""",
       **M4_CTES)
def _(t):
    return m4(t).group_members.withColumn("group_names", F.concat_ws("|", "group_names"))


_HIST_MEMBERS = """SELECT * FROM (SELECT k.*, p.section, coalesce(n.name, '') AS name, row_number() OVER (PARTITION BY k.trade_date, k.group_id, p.section
      ORDER BY CASE WHEN p.section = 'bottom' THEN -k.change_ratio ELSE k.change_ratio END DESC, k.code) AS pos
    FROM known k JOIN picked p USING (trade_date, group_id) LEFT JOIN names n USING (code)) WHERE pos <= 10"""


def _known(members):
    return ("SELECT b.trade_date, b.code, b.change_ratio, c.group_id, count(*) OVER (PARTITION BY b.trade_date, c.group_id) AS member_count "
            f"FROM bars b JOIN (SELECT DISTINCT group_id, code FROM {members}) c USING (code) WHERE b.change_ratio IS NOT NULL")


M5_SECTOR = {
    **multi_ctes(), "ranked": "SELECT g5.*, group_name FROM g5 JOIN grp USING (group_id) WHERE group_id IN (SELECT group_id FROM wm)",
    "picked": """SELECT * FROM (SELECT trade_date, group_id, group_name, score_final AS score, s1_return, s2_breadth, 'top' AS section,
          row_number() OVER (PARTITION BY trade_date ORDER BY rank_1d NULLS LAST, group_id) AS pos FROM ranked
        UNION ALL SELECT trade_date, group_id, group_name, score_final, s1_return, s2_breadth, 'bottom',
          row_number() OVER (PARTITION BY trade_date ORDER BY rank_1d DESC NULLS FIRST, group_id DESC) FROM ranked) WHERE pos <= 10""",
    "known": _known("wm"), "hm": _HIST_MEMBERS,
}
M5_CUSTOM = {
    "dr": """SELECT trade_date, group_id, n.group_name, avg(change_ratio) AS score, avg(change_ratio) AS s1_return,
        avg(CASE WHEN change_ratio > 0 THEN 1.0 ELSE 0 END) AS s2_breadth FROM bars JOIN custom c USING (code) JOIN custom_names n USING (group_id)
        WHERE change_ratio IS NOT NULL GROUP BY 1, 2, 3""",
    "picked": f"""SELECT * FROM (SELECT *, 'top' AS section, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, group_id) AS pos FROM dr WHERE NOT ({ZT})
        UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY trade_date ORDER BY score, group_id DESC) FROM dr WHERE NOT ({ZT})) WHERE pos <= 10
        UNION ALL SELECT *, 'zt', row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, group_id) FROM dr WHERE {ZT}""",
    "known": _known("custom"), "hm": _HIST_MEMBERS,
}
HIST_SPEC = "trade_date:d section pos:i group_id group_name score:f s1_return:f s2_breadth:f"
HM_SPEC = "trade_date:d section group_id pos:i code name change_ratio:f member_count:i"


def m5_sector(t):
    strength = multi_period_strength(t.bars, t.current, precision=None).withColumn("rank_1d", F.col("rank_1d"))
    return D.history_dashboard(t.bars, t.scope, t.groups, t.members, strength)


def m5_custom(t):
    return D.history_dashboard(t.bars, t.custom, t.custom_names, t.members)


@query("m5_history_sector", HIST_SPEC, "SELECT * FROM picked", **M5_SECTOR)
def _(t):
    return m5_sector(t).groups


@query("m5_history_sector_members", HM_SPEC, "SELECT * FROM hm", **M5_SECTOR)
def _(t):
    return m5_sector(t).members


@query("m5_history_custom", HIST_SPEC, "SELECT * FROM picked", **M5_CUSTOM)
def _(t):
    return m5_custom(t).groups


@query("m5_history_custom_members", HM_SPEC, "SELECT * FROM hm", **M5_CUSTOM)
def _(t):
    return m5_custom(t).members


@query("m5_history_stats", STATS_SPEC, stats_sql("scoped"),
       scoped="SELECT * FROM bars WHERE change_ratio IS NOT NULL AND code IN (SELECT code FROM custom)")
def _(t):
    return m5_custom(t).stats


_FRAME = """SELECT group_id, g.group_name, member_count AS size, group_id IN (SELECT group_id FROM watched) AS watched,
    CASE WHEN group_id LIKE '884%' THEN '三级行业' ELSE '概念板块' END AS level
    FROM mon JOIN grp g USING (group_id) WHERE substr(group_id, 1, 3) IN ('884', '885', '886')"""


def _asof_group(n):
    return f"""SELECT group_id, avg(r) AS return_{n}d FROM (SELECT code, (arg_max(close, trade_date) / nullif(max(pre_close) FILTER (first), 0) - 1) * 100 AS r
        FROM (SELECT *, trade_date = min(trade_date) OVER (PARTITION BY code) AS first FROM bars
              WHERE trade_date BETWEEN (SELECT d FROM lastday) - {2 * n} AND (SELECT d FROM lastday)) GROUP BY 1) JOIN cur USING (code)
        WHERE r IS NOT NULL AND code NOT IN (SELECT code FROM fresh) GROUP BY 1"""


@query("m6_candidates",
       "group_id group_name level change_ratio:f body:f return_3d:f return_5d:f member_count:i watched:b pos:i",
       """SELECT f.*, d.change_ratio, d.body, r3.return_3d, r5.return_5d, coalesce(d.quoted, f.size) AS member_count,
          row_number() OVER (ORDER BY d.change_ratio DESC NULLS LAST, group_id) AS pos FROM frame f
          LEFT JOIN day1 d USING (group_id) LEFT JOIN r3 USING (group_id) LEFT JOIN r5 USING (group_id)""",
       frame=_FRAME, r3=_asof_group(3), r5=_asof_group(5),
       fresh="""SELECT code FROM bars GROUP BY 1 HAVING min(trade_date) > (SELECT min(trade_date) FROM (SELECT trade_date FROM days ORDER BY 1 DESC LIMIT 5))""",
       day1="""SELECT group_id, avg(c) AS change_ratio, count(c) AS quoted, avg(b) AS body FROM (SELECT code, arg_max(change_ratio, trade_date) AS c,
          (arg_max(close, trade_date) / nullif(arg_max(open, trade_date), 0) - 1) * 100 AS b FROM bars GROUP BY 1) JOIN cur USING (code)
          GROUP BY 1 HAVING count(c) > 0""")
def _(t):
    return N.candidates(t.bars, t.members, t.groups, t.watched, digits=None)


@query("m7_quoted_candidates",
       "group_id group_name level change_ratio:f body:f rise_count:f0 limit_up_count:f0 return_3d:f return_5d:f member_count:i watched:b",
       """SELECT f.*, q.chg AS change_ratio, q.body, CAST(NULL AS DOUBLE) AS rise_count,
          CAST(NULL AS DOUBLE) AS limit_up_count, q.return_3d, q.return_5d, f.size AS member_count FROM frame f LEFT JOIN q USING (group_id)""",
       frame=_FRAME,
       q="""SELECT code AS group_id, max(change_ratio) FILTER (rn = 1) AS chg, (max(close) FILTER (rn = 1) / nullif(max(open) FILTER (rn = 1), 0) - 1) * 100 AS body,
          (max(close) FILTER (rn = 1) / nullif(max(close) FILTER (rn = 4), 0) - 1) * 100 AS return_3d,
          (max(close) FILTER (rn = 1) / nullif(max(close) FILTER (rn = 6), 0) - 1) * 100 AS return_5d
          FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM idx) GROUP BY 1""")
def _(t):
    # Nation indices have no live quote and fall back to their history.
    live = ingest.unpack_quotes(quote_payloads(t.index.filter(~F.col("code").startswith("884"))))
    history = ingest.unpack_bars(bar_payloads(t.index))
    return N.quoted_candidates(live, history, t.members, t.groups, t.watched, digits=None)


_COUNTS = f"""SELECT group_id, count(*) FILTER (b.change_ratio > 0) AS rise_count, count(*) FILTER (b.change_ratio < 0) AS fall_count,
    count(*) FILTER ({limit_up("b.code", "b.change_ratio")}) AS limit_up_count
    FROM cur JOIN (SELECT code AS group_id, max(trade_date) AS trade_date FROM idx GROUP BY 1) USING (group_id) JOIN bars b USING (code, trade_date) GROUP BY 1"""


@query("m7_live_counts", "group_id change_ratio:f rise_count:f0 fall_count:f0 limit_up_count:f0 pos:i",
       """SELECT f.group_id, change_ratio, rise_count, fall_count, limit_up_count, row_number() OVER (ORDER BY change_ratio DESC NULLS LAST, f.group_id) AS pos
          FROM frame f LEFT JOIN (SELECT code AS group_id, arg_max(change_ratio, trade_date) AS change_ratio FROM idx WHERE code NOT LIKE '886%' GROUP BY 1) USING (group_id)
          LEFT JOIN (SELECT * FROM counts_ WHERE group_id NOT LIKE '886%') USING (group_id)""", frame=_FRAME, counts_=_COUNTS)
def _(t):
    # Groups of one kind are neither quoted nor in the history: they come last, without figures.
    index = t.index.filter(~F.col("code").startswith("886"))
    last = T.last_bar(index)
    counts = (t.bars.join(t.current.select("group_id", "code"), "code").groupBy(F.col("group_id").alias("code"), "trade_date")
              .agg(F.count_if(F.col("change_ratio") > 0).alias("rise"), F.count_if(F.col("change_ratio") < 0).alias("fall"), F.count_if(C.is_limit_up()).alias("limit")))
    one = lambda c: F.array(F.col(c).cast("double"))
    table = F.struct(one("change_ratio").alias("changeRatio"), one("open").alias("open"), one("close").alias("latest"),
                     one("rise").alias("riseCount"), one("fall").alias("fallCount"), one("limit").alias("upLimitCount"))
    payloads = last.join(counts, ["code", "trade_date"]).select(F.to_json(F.struct(F.col("code").alias("thscode"), table.alias("table"))).alias("payload"))
    return N.quoted_candidates(ingest.unpack_quotes(payloads), index, t.members, t.groups, t.watched, digits=None)


def m8(t):
    return N.rotation_table(t.bars, t.custom, bench_index(t))


@query("m8_rotation_table", ROT_SPEC, ROT_SQL, **ROT_CTES)
def _(t):
    return m8(t).groups


M9_CTES = {
    "sticks": "SELECT * FROM ticks WHERE code IN (SELECT code FROM wm)",
    "axis": "SELECT DISTINCT trade_date, hhmm AS minute FROM sticks",
    "upto": "SELECT t.*, a.minute FROM sticks t JOIN axis a ON a.trade_date = t.trade_date AND t.hhmm <= a.minute",
    "ind": tick_states("upto", "trade_date, code, minute"),
    "fig": figures("ind", "wm", "trade_date, minute", body="q.body"), "sc": scored("fig", "trade_date, minute"),
}


@query("m9_replay",
       "trade_date:d hhmm group_id s1_return:f8 s2_breadth:f s4_relative:f s_body:f8 member_count:i score:f rank_1d:f0",
       "SELECT *, minute AS hhmm FROM sc", **M9_CTES)
def _(t):
    return D.replay(t.ticks, t.scope, precision=None)
