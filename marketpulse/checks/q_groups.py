"""Group aggregates, rankings, attribution (G, H, I, K)."""

from pyspark.sql import functions as F

from marketpulse.checks.q_metrics import SUMMARY, auction_score_sql, factors_sql, member_score_sql
from marketpulse.checks.registry import query
from marketpulse.checks.sql import DOMESTIC, ZT, figures, limit_up, scored, tick_states, z
from marketpulse.functions.measures import missing_to_null
from marketpulse.operators import attribution as K
from marketpulse.operators import auction as A
from marketpulse.operators import coherency as G
from marketpulse.operators import intraday as I
from marketpulse.operators import latest as L
from marketpulse.operators import members as P
from marketpulse.operators import portfolio as Q
from marketpulse.operators import ranking as R
from marketpulse.operators import returns as T
from marketpulse.operators import rotation as O
from marketpulse.operators import screening as H
from marketpulse.operators import scopes as Z
from marketpulse.operators import strength as S
from marketpulse.plans.runlog import RunLog, strength_step
from marketpulse.staging import shared_path, stage

G2_SPEC = ("trade_date:d group_id s1_return:f s2_breadth:f s4_relative:f s_body:f member_count:i "
           "z_s1:f z_s2:f z_s4:f score:f rank_1d:f0")

RANKED = "CASE WHEN {s} IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY round({s}, 9) DESC NULLS LAST) END"


@query("g1_one_group", G2_SPEC, "SELECT * FROM sc", fig=figures("bars", "one", minimum=1),
       one="SELECT * FROM cur WHERE group_id = '884004.TI'", sc=scored("fig", "trade_date"))
def _(t):
    only = t.groups.filter("group_id = '884004.TI'")
    return S.group_strength(t.bars, t.current, min_members=1, precision=None, groups=only)


@query("g2_group_strength", G2_SPEC, "SELECT * FROM sc", fig=figures("bars", "cur"), sc=scored("fig", "trade_date"))
def _(t):
    return S.group_strength(t.bars, t.current, precision=None)


@query("g2_group_strength_rounded", G2_SPEC, "SELECT * FROM sc", fig=figures("bars", "cur", digits=4),
       sc=scored("fig", "trade_date"))
def _(t):
    return S.group_strength(t.bars, t.current)


@query("g2_group_strength_ticks", G2_SPEC, "SELECT * FROM sc", ind=tick_states("ticks", "trade_date, code"),
       fig=figures("ind", "cur", body="q.body"), sc=scored("fig", "trade_date"))
def _(t):
    return S.group_strength(I.indicators(t.ticks), t.current, precision=None)


@query("g2_group_strength_long", G2_SPEC, "SELECT * FROM sc", fig=figures("lbars", "lmembers", minimum=3),
       sc=scored("fig", "trade_date"))
def _(t):
    return S.group_strength(t.long_bars, t.long_members, min_members=3, precision=None)


@query("g3_market_return", "trade_date:d market_return:f",
       "SELECT trade_date, avg(change_ratio) AS market_return FROM lbars GROUP BY 1")
def _(t):
    return S.market_return(t.long_bars)


@query("g4_group_mean_return", "group_id group_return:f member_count:i",
       """SELECT group_id, avg(r) AS group_return, count(r) AS member_count FROM (SELECT code, change_ratio AS r
          FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn = 1)
          JOIN cur USING (code) GROUP BY 1 HAVING count(r) >= 1""")
def _(t):
    return S.group_mean_return(L.last_bar(t.bars), t.current)


_HORIZON = """SELECT e.code, e.trade_date, e.change_ratio,
    CASE WHEN b5 = 0 THEN 0 ELSE (e.close / b5 - 1) * 100 END AS r5, CASE WHEN b20 = 0 THEN 0 ELSE (e.close / b20 - 1) * 100 END AS r20
    FROM {bars} e JOIN (SELECT e.code, e.trade_date,
       arg_min(s.pre_close, s.trade_date) FILTER (WHERE s.pre_close IS NOT NULL AND s.trade_date >= e.trade_date - 10) AS b5,
       arg_min(s.pre_close, s.trade_date) FILTER (WHERE s.pre_close IS NOT NULL) AS b20
       FROM {bars} e JOIN {bars} s ON s.code = e.code AND s.trade_date BETWEEN e.trade_date - 40 AND e.trade_date GROUP BY 1, 2) w
    USING (code, trade_date)"""


def multi_ctes(bars="bars", members="cur", minimum=6, where="true"):
    """Common table expressions ending in ``g5``."""
    return {
        "hz": f"SELECT * FROM ({_HORIZON.format(bars=bars)}) WHERE {where}",
        "fg1": figures("hz", members, minimum=minimum), "sc1": scored("fg1", "trade_date"),
        "fg5": figures("hz", members, minimum=minimum, change="r5"), "sc5": scored("fg5", "trade_date"),
        "fg20": figures("hz", members, minimum=minimum, change="r20"), "sc20": scored("fg20", "trade_date"),
        "fused": "SELECT sc1.* EXCLUDE (score, rank_1d), sc1.score AS score_1d, coalesce(sc5.score, 0) AS score_5d, "
                 "coalesce(sc20.score, 0) AS score_20d, 0.5 * sc1.score + 0.3 * coalesce(sc5.score, 0) "
                 "+ 0.2 * coalesce(sc20.score, 0) AS score_final FROM sc1 LEFT JOIN sc5 USING (trade_date, group_id) "
                 "LEFT JOIN sc20 USING (trade_date, group_id)",
        "g5": f"SELECT *, {RANKED.format(s='score_final')} AS rank_1d FROM fused",
    }


G5_SPEC = ("trade_date:d group_id s1_return:f s2_breadth:f s4_relative:f member_count:i z_s1:f z_s2:f z_s4:f "
           "score_1d:f score_5d:f score_20d:f score_final:f rank_1d:f0")


@query("g5_multi_period", G5_SPEC, "SELECT * FROM g5", **multi_ctes())
def _(t):
    return S.multi_period_strength(t.bars, t.current, precision=None)


@query("g5_multi_period_long", G5_SPEC, "SELECT * FROM g5", **multi_ctes("lbars", "lmembers", 3))
def _(t):
    return S.multi_period_strength(t.long_bars, t.long_members, min_members=3, precision=None)


@query("g5_multi_period_on", G5_SPEC, "SELECT * FROM g5", **multi_ctes(where="trade_date = DATE '2024-01-25'"))
def _(t):
    return S.multi_period_strength_on(t.bars, t.current, "2024-01-25", precision=None)


_COHERENCY = """SELECT p.group_id, coalesce(avg(r), 0) AS coherency, count(r) AS pairs FROM (SELECT DISTINCT group_id FROM {m}) p
    LEFT JOIN (SELECT x.group_id, x.code, y.code AS other, CASE WHEN count(*) >= 2 AND min(x.v) < max(x.v) AND min(y.v) < max(y.v)
        THEN corr(x.v, y.v) END AS r
      FROM mv x JOIN mv y ON x.group_id = y.group_id AND x.trade_date = y.trade_date AND x.code < y.code GROUP BY 1, 2, 3) c
    ON c.group_id = p.group_id GROUP BY 1"""
_MV = "SELECT m.group_id, b.code, b.trade_date, b.change_ratio AS v FROM {b} b JOIN (SELECT DISTINCT group_id, code FROM {m}) m USING (code) " \
      "WHERE b.change_ratio IS NOT NULL"


@query("g6_coherency", "group_id coherency:f pairs:i", _COHERENCY.format(m="cur"), mv=_MV.format(b="bars", m="cur"))
def _(t):
    return G.coherency(t.bars, t.current, digits=None)


@query("g6_coherency_long", "group_id coherency:f pairs:i", _COHERENCY.format(m="lmembers"),
       mv=_MV.format(b="lbars", m="lmembers"))
def _(t):
    return G.coherency(t.long_bars, t.long_members, digits=None)


@query("g6_coherency_indices", "group_id coherency:f pairs:i", _COHERENCY.format(m="im"),
       im="SELECT 'all' AS group_id, group_id AS code FROM grp", mv=_MV.format(b="idx", m="im"))
def _(t):
    everything = t.groups.select(F.lit("all").alias("group_id"), F.col("group_id").alias("code"))
    return G.coherency(t.index, everything, digits=None, block=32)


@query("g7_group_return", "trade_date:d group_id group_return:f",
       "SELECT trade_date, group_id, avg(change_ratio) AS group_return FROM bars JOIN cur USING (code) "
       "WHERE change_ratio IS NOT NULL GROUP BY 1, 2")
def _(t):
    return S.group_return(t.bars, t.current)


_STATS = """SELECT trade_date, count(*) AS stock_count, avg(change_ratio) AS market_avg_change,
    count(*) FILTER (WHERE change_ratio > 0) AS up_count, count(*) FILTER (WHERE change_ratio < 0) AS down_count,
    count(*) FILTER (WHERE change_ratio = 0) AS flat_count, count(*) FILTER (WHERE {lim}) AS limit_up_count
    FROM {src} GROUP BY 1"""
STATS_SPEC = "trade_date:d stock_count:i market_avg_change:f up_count:i down_count:i flat_count:i limit_up_count:i"


def stats_sql(source):
    return _STATS.format(lim=limit_up(), src=source)


@query("g8_market_stats", STATS_SPEC, stats_sql("bars"))
def _(t):
    return S.market_stats(t.bars)


@query("g9_scoped_stats", STATS_SPEC, stats_sql("scoped"),
       scoped="SELECT * FROM bars WHERE change_ratio IS NOT NULL AND code IN (SELECT code FROM wm)")
def _(t):
    return S.market_stats(t.bars, t.scope, known_only=True)


@query("g10_auction_stats",
       "trade_date:d stock_count:i avg_gap:f up_count:i down_count:i strong_gap_count:i limit_up_count:i explode_count:i",
       """SELECT trade_date, count(*) AS stock_count, avg(gap_pct) AS avg_gap, count(*) FILTER (WHERE gap_pct > 0) AS up_count,
          count(*) FILTER (WHERE gap_pct < 0) AS down_count, count(*) FILTER (WHERE gap_pct >= 2) AS strong_gap_count,
          count(*) FILTER (WHERE gap_pct >= 9.8) AS limit_up_count, count(*) FILTER (WHERE vol_ratio >= 2) AS explode_count
          FROM fac GROUP BY 1""", fac=factors_sql())
def _(t):
    return A.auction_stats(A.auction_factors(t.ticks, L.prev_volume(t.bars), "09:25"))


AUCTION_GROUPS = f"""SELECT trade_date, group_id, max(n.group_name) AS group_name, count(*) AS member_count, avg(gap_pct) AS sector_gap, median(vol_ratio) AS sector_vol_ratio,
    avg(order_imbalance) AS sector_imbalance, avg(CASE WHEN gap_pct >= 2 THEN 1 ELSE 0 END) AS coherency, avg(score) AS score,
    bool_or({ZT}) AS is_zt FROM asc_ s JOIN custom c USING (code) JOIN custom_names n USING (group_id) GROUP BY 1, 2""".replace("upper(trim(group_name))", "upper(trim(n.group_name))")
AG_SPEC = ("trade_date:d group_id group_name member_count:i sector_gap:f sector_vol_ratio:f sector_imbalance:f8 "
           "coherency:f score:f is_zt:b")


@query("g11_auction_groups", AG_SPEC, AUCTION_GROUPS, fac=factors_sql(), asc_=auction_score_sql())
def _(t):
    scored_ = A.auction_score(A.auction_factors(t.ticks, L.prev_volume(t.bars), "09:25"))
    return A.auction_groups(scored_, t.custom, t.custom_names)


ROT_CTES = {
    "summ": f"SELECT * FROM ({SUMMARY.format(t='bars')}) WHERE n_bars >= 2",
    "bench": f"SELECT coalesce(avg(total_change), 0) AS bench_total, coalesce(avg(last_change), 0) AS bench_last FROM ({SUMMARY.format(t='bidx')})",
    "bidx": "SELECT * FROM idx WHERE code LIKE '885%'",
    "elig": f"SELECT group_id, group_name, count(DISTINCT code) AS member_count FROM custom WHERE NOT ({ZT}) AND group_name <> 'CC' "
            "GROUP BY 1, 2 HAVING count(DISTINCT code) >= 6",
    "rot": """SELECT e.group_id, e.group_name, e.member_count, count(*) AS valid_count, count(*) FILTER (WHERE last_change > 0) AS up_count,
        avg(total_change) AS avg_total, avg(last_change) AS avg_last, avg(volume_ratio) AS volume_ratio
        FROM summ JOIN custom c USING (code) JOIN elig e ON e.group_id = c.group_id GROUP BY 1, 2, 3""",
}
ROT_SQL = """SELECT *, up_count / valid_count * 100 AS up_pct, CASE WHEN avg_total > (SELECT bench_total FROM bench) + 1 THEN '强于大盘'
    WHEN avg_total < (SELECT bench_total FROM bench) - 1 THEN '弱于大盘' ELSE '同步' END AS vs_index FROM rot"""
ROT_SPEC = ("group_id group_name member_count:i valid_count:i up_count:i avg_total:f avg_last:f volume_ratio:f "
            "up_pct:f vs_index")


def bench_index(t):
    return t.index.filter(F.col("code").startswith("885"))


@query("g12_rotation_stats", ROT_SPEC, ROT_SQL, **ROT_CTES)
def _(t):
    return O.rotation_stats(O.valid_summaries(t.bars), t.custom, t.custom_names, O.benchmark(bench_index(t)))


@query("g13_benchmark", "bench_total:f bench_last:f", "SELECT * FROM bench", **ROT_CTES)
def _(t):
    return O.benchmark(bench_index(t))


@query("g14_daily_group_rank", "trade_date:d group_id s1_return:f s2_breadth:f member_count:i score:f",
       """SELECT trade_date, group_id, avg(change_ratio) AS s1_return, avg(CASE WHEN change_ratio > 0 THEN 1.0 ELSE 0 END) AS s2_breadth,
          count(*) AS member_count, avg(change_ratio) AS score FROM bars JOIN custom USING (code) WHERE change_ratio IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return S.daily_group_rank(t.bars, t.custom)


def classify_ctes(members, groups):
    return {
        "hit": "SELECT trade_date, code, change_ratio FROM bars WHERE change_ratio > 7",
        "pool": f"SELECT group_id, count(DISTINCT code) AS member_total FROM {members} GROUP BY 1",
        "cls": f"""SELECT trade_date, m.group_id, g.group_name, count(*) AS hit_count, max(member_total) AS member_total,
            count(*) / max(member_total) AS coverage, avg(change_ratio) AS hit_avg_change
            FROM hit JOIN (SELECT DISTINCT group_id, code FROM {members}) m USING (code) JOIN pool USING (group_id)
            JOIN {groups} g ON g.group_id = m.group_id GROUP BY 1, 2, 3""",
        "tot": f"""SELECT trade_date, count(*) AS pool_size, count(*) FILTER (WHERE code IN (SELECT code FROM {members})) AS hit_total,
            coalesce(max(n), 0) AS group_hit_count FROM hit LEFT JOIN (SELECT trade_date, count(*) AS n FROM cls GROUP BY 1) USING (trade_date) GROUP BY 1""",
    }


CLS_SPEC = "trade_date:d group_id group_name hit_count:i member_total:i coverage:f hit_avg_change:f"


def hits_of(t):
    return Z.screen(t.bars, change_lo=7.0).select("trade_date", "code", F.col("code").alias("name"), "change_ratio")


@query("g15_classify_custom", CLS_SPEC, "SELECT * FROM cls", **classify_ctes("custom", "custom_names"))
def _(t):
    return H.classify_hits(hits_of(t), t.custom, t.custom_names, "custom", digits=None).groups


@query("g15_classify_totals", "trade_date:d pool_size:i hit_total:i group_hit_count:i", "SELECT * FROM tot",
       **classify_ctes("custom", "custom_names"))
def _(t):
    return H.classify_hits(hits_of(t), t.custom, t.custom_names, "custom", digits=None).totals


@query("g16_classify_market", CLS_SPEC, "SELECT * FROM cls", **classify_ctes("wm", "grp"))
def _(t):
    return H.classify_hits(hits_of(t), t.scope, t.groups, "market", digits=None).groups


@query("g16_classify_totals", "trade_date:d pool_size:i hit_total:i group_hit_count:i", "SELECT * FROM tot",
       **classify_ctes("wm", "grp"))
def _(t):
    return H.classify_hits(hits_of(t), t.scope, t.groups, "market", digits=None).totals


EXPO = "SELECT group_id, sum(shares * cost_price) AS exposure_weight, count(*) AS holding_count FROM holdings " \
       "JOIN (SELECT DISTINCT group_id, code FROM cur) c USING (code) GROUP BY 1"


@query("g17_portfolio_exposure", "group_id exposure_weight:f2 holding_count:i", EXPO)
def _(t):
    return Q.portfolio_exposure(t.holdings, t.current)


@query("g17_exposed_holdings", "group_id code",
       "SELECT DISTINCT group_id, code FROM holdings JOIN cur USING (code)")
def _(t):
    return Q.exposed_holdings(t.holdings, t.current)


@query("g18_holdings_in_groups", "group_id code",
       "SELECT DISTINCT group_id, code FROM custom WHERE code IN (SELECT code FROM custom WHERE group_name = 'CC')")
def _(t):
    return P.holdings_in_groups(t.custom, P.holding_codes(t.custom, t.custom_names))


@query("g19_groups_of_instrument", "code group_names",
       "SELECT code, string_agg(group_name, '|' ORDER BY group_id) AS group_names FROM (SELECT code, group_name, "
       "min(group_id) AS group_id FROM custom GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return P.groups_of_instrument(t.custom, t.custom_names).select("code", F.concat_ws("|", "group_names").alias("group_names"))


@query("g20_group_sizes", "group_id member_count:i", "SELECT * FROM sizes")
def _(t):
    return Z.group_sizes(t.members)


@query("g21_run_statistics", G2_SPEC, "SELECT * FROM sc", fig=figures("bars", "cur"), sc=scored("fig", "trade_date"))
def _(t):
    watched, _ = S.run_statistics(S.group_strength(t.bars, t.current, precision=None))
    return watched


@query("g21_run_log", "run_id step metric value:i error",
       """SELECT 'r' AS run_id, 'group_strength' AS step, unnest(['groups_seen', 'skipped_for_size', 'rows_saved', 'rows_unscored', 'failed']) AS metric,
          unnest([(SELECT count(*) FROM allg), (SELECT count(*) FROM allg WHERE member_count < 12), (SELECT count(*) FROM sc),
                  (SELECT count(*) FROM sc WHERE score IS NULL), 0]) AS value, NULL AS error
          UNION ALL SELECT 'r', 'attribution', 'failed', 1, 'ValueError'""",
       allg=figures("bars", "cur", minimum=0), fig=figures("bars", "cur", minimum=12), sc=scored("fig", "trade_date"))
def _(t):
    def broken():
        raise ValueError("no mapping")

    log = RunLog(t.spark, shared_path(t.spark, "g21-log"), "r")
    out = shared_path(t.spark, "g21-strength")
    strength_step(log, t.bars, t.current, lambda df: df.write.parquet(out), min_members=12, precision=None)
    log.step("attribution", broken, lambda df: df.write.parquet(out))
    return log.save()


@query("i5_positions", "code trade_date:d change_ratio:f pos:i",
       "SELECT code, trade_date, change_ratio, row_number() OVER (ORDER BY change_ratio DESC NULLS LAST, code, trade_date) AS pos FROM bars")
def _(t):
    return R.ordered_positions(t.bars.select("code", "trade_date", "change_ratio"), "change_ratio", True, "last", ["code", "trade_date"])


@query("i6_positions_zero", "code trade_date:d change_ratio:f pos:i",
       "SELECT code, trade_date, change_ratio, row_number() OVER (ORDER BY coalesce(change_ratio, 0), code, trade_date) AS pos FROM bars")
def _(t):
    return R.ordered_positions(t.bars.select("code", "trade_date", "change_ratio"), "change_ratio", False, "zero", ["code", "trade_date"])


_TB = """SELECT trade_date, 'top' AS section, group_id, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, group_id) AS pos FROM sc
    UNION ALL SELECT trade_date, 'bottom', group_id, score, row_number() OVER (PARTITION BY trade_date ORDER BY score ASC NULLS FIRST, group_id DESC) FROM sc"""


@query("i1_top_bottom", "trade_date:d section pos:i group_id score:f", "SELECT * FROM tb WHERE pos <= 5",
       fig=figures("bars", "cur"), sc=scored("fig", "trade_date"), tb=_TB)
def _(t):
    return R.top_bottom(S.group_strength(t.bars, t.current, precision=None), "score", 5, ["trade_date"])


@query("i3_member_ranking", "trade_date:d group_id pos:i code speed:f score:f",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, group_id ORDER BY speed DESC, round(score, 9) DESC, code) AS pos FROM sc) WHERE pos <= 10""",
       ind=tick_states("ticks", "trade_date, code"), gm="SELECT i.*, c.group_id FROM ind i JOIN cur c USING (code)",
       sc=member_score_sql("gm"))
def _(t):
    sc = P.score_members(stage(S.quotes_by_group(I.indicators(t.ticks), t.current), "quotes"))
    return P.member_ranking(sc, "speed", True, 10)


@query("i5_order_nulls", "code trade_date:d change_ratio:f", "SELECT code, trade_date, change_ratio FROM bars")
def _(t):
    return R.order_nulls(t.bars, "change_ratio", True, "zero", ["code", "trade_date"])


@query("i7_auction_top_stocks", "trade_date:d pos:i code score:f",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS pos FROM asc_) WHERE pos <= 30",
       fac=factors_sql(), asc_=auction_score_sql())
def _(t):
    return A.auction_top_stocks(A.auction_score(A.auction_factors(t.ticks, L.prev_volume(t.bars), "09:25")))


@query("i9_rotation_leaders", "group_id pos:i code last_change:f",
       """SELECT * FROM (SELECT c.group_id, row_number() OVER (PARTITION BY c.group_id ORDER BY last_change DESC, code) AS pos, code, last_change
          FROM summ JOIN custom c USING (code) JOIN elig e ON e.group_id = c.group_id) WHERE pos <= 3""", **ROT_CTES)
def _(t):
    return O.rotation_leaders(O.valid_summaries(t.bars), t.custom, t.custom_names)


# ---- attribution -------------------------------------------------------------------

ATTR_CTES = {
    "scope_": "SELECT group_id FROM wm GROUP BY 1",
    "gret": "SELECT trade_date, group_id, avg(change_ratio) AS gr FROM bars JOIN wm USING (code) WHERE change_ratio IS NOT NULL GROUP BY 1, 2",
    "mine": "SELECT DISTINCT m.code, m.group_id FROM members m JOIN (SELECT code, max(as_of) AS as_of FROM members GROUP BY 1) USING (code, as_of) "
            "JOIN grp USING (group_id)",
    "wts": "SELECT code, group_id, 1.0 / count(*) OVER (PARTITION BY code) AS weight FROM mine",
    "uni": f"SELECT DISTINCT code FROM members WHERE as_of = (SELECT max(as_of) FROM members) AND {DOMESTIC}",
    "inst": "SELECT d.trade_date, u.code, coalesce(b.change_ratio, 0) AS total_return FROM uni u CROSS JOIN days d "
            "LEFT JOIN bars b ON b.code = u.code AND b.trade_date = d.trade_date WHERE b.code IS NULL OR b.change_ratio IS NOT NULL",
    "contrib": "SELECT i.trade_date, i.code, i.total_return, w.group_id, w.weight, coalesce(g.gr, 0) AS group_return, "
               "w.weight * coalesce(g.gr, 0) AS contribution FROM inst i JOIN wts w USING (code) "
               "LEFT JOIN gret g ON g.trade_date = i.trade_date AND g.group_id = w.group_id",
    "att": "SELECT *, CASE WHEN abs(sum(contribution) OVER k) > 1e-8 THEN contribution / sum(contribution) OVER k ELSE 0 END AS contrib_pct, "
           "row_number() OVER (PARTITION BY trade_date, code ORDER BY abs(contribution) DESC, group_id) AS pos "
           "FROM contrib WINDOW k AS (PARTITION BY trade_date, code)",
}


def daily_attribution(t, as_json=False):
    return K.daily_attribution(t.bars, t.members, t.groups, scope=t.scope.select("group_id").distinct(), digits=None, as_json=as_json)


@query("k1_attribution_rows",
       "trade_date:d code pos:i group_id weight:f group_return:f contribution:f contrib_pct:f4", "SELECT * FROM att", **ATTR_CTES)
def _(t):
    return K.attribution_rows(daily_attribution(t))


@query("k2_daily_attribution", "trade_date:d code total_return:f top_group top_contrib_pct:f4",
       "SELECT trade_date, code, total_return, group_id AS top_group, contrib_pct AS top_contrib_pct FROM att WHERE pos = 1", **ATTR_CTES)
def _(t):
    return daily_attribution(t)


_DAY_MAPS = "SELECT d.trade_date, max(m.as_of) AS as_of FROM days d JOIN (SELECT DISTINCT as_of FROM members) m ON m.as_of <= d.trade_date GROUP BY 1"
_LAST_MAPS = "SELECT trade_date, (SELECT max(as_of) FROM members) AS as_of FROM days"


def _mapped(day_maps):
    return ATTR_CTES | {
        "dm": day_maps,
        "wts": "SELECT as_of, code, group_id, 1.0 / count(*) OVER (PARTITION BY as_of, code) AS weight FROM (SELECT DISTINCT as_of, code, group_id FROM members) JOIN grp USING (group_id)",
        "uni": f"SELECT DISTINCT as_of, code FROM members WHERE {DOMESTIC}",
        "inst": "SELECT d.trade_date, d.as_of, u.code, coalesce(b.change_ratio, 0) AS total_return FROM dm d JOIN uni u USING (as_of) "
                "LEFT JOIN bars b ON b.code = u.code AND b.trade_date = d.trade_date WHERE b.code IS NULL OR b.change_ratio IS NOT NULL",
        "contrib": "SELECT i.trade_date, i.code, i.total_return, w.group_id, w.weight, coalesce(g.gr, 0) AS group_return, "
                   "w.weight * coalesce(g.gr, 0) AS contribution FROM inst i JOIN wts w USING (as_of, code) "
                   "LEFT JOIN gret g ON g.trade_date = i.trade_date AND g.group_id = w.group_id"}


def _mapping_check(name, day_maps, dated):
    @query(name, "trade_date:d code total_return:f top_group top_contrib_pct:f4 n:i total:f",
           "SELECT trade_date, code, total_return, max(group_id) FILTER (pos = 1) AS top_group, max(contrib_pct) FILTER (pos = 1) AS top_contrib_pct, "
           "count(*) AS n, sum(contribution) AS total FROM att GROUP BY 1, 2, 3", **_mapped(day_maps))
    def _(t):
        mapping = t.members.select("code", "group_id", F.col("as_of").alias("map_date"))
        out = K.mapped_attribution(t.bars, mapping, t.members, t.groups, t.scope.select("group_id").distinct(), dated, digits=None)
        return out.withColumn("n", F.size("attributions")).withColumn("total", F.aggregate("attributions", F.lit(0.0), lambda a, e: a + e["contribution"]))


_mapping_check("k2_mapping_attribution", _DAY_MAPS, True)
_mapping_check("k2_mapping_latest", _LAST_MAPS, False)


@query("k3_equal_weights", "code group_id map_date:d weight:f",
       "SELECT code, group_id, as_of AS map_date, 1.0 / count(*) OVER (PARTITION BY code, as_of) AS weight FROM members")
def _(t):
    return K.equal_weights(t.members.select("code", "group_id", F.col("as_of").alias("map_date")))


@query("k4_get_attribution", "trade_date:d code total_return:f top_group",
       "SELECT trade_date, code, total_return, group_id AS top_group FROM att WHERE pos = 1 AND code IN (SELECT code FROM holdings) "
       "AND trade_date = DATE '2024-01-15'", **ATTR_CTES)
def _(t):
    return K.get_attribution(daily_attribution(t), t.holdings, "2024-01-15")


@query("k4_stored_lookup", "trade_date:d code total_return:f top_group n:i",
       "SELECT trade_date, code, max(total_return) AS total_return, max(group_id) FILTER (pos = 1) AS top_group, count(*) AS n FROM att "
       "WHERE code IN (SELECT code FROM holdings WHERE code LIKE '%7.SZ') AND trade_date IN (DATE '2024-01-15', DATE '2024-01-20') GROUP BY 1, 2", **ATTR_CTES)
def _(t):
    path = shared_path(t.spark, "k4")
    K.store_by_code(daily_attribution(t, as_json=True), path, buckets=16)
    found = K.lookup(t.spark, path, t.holdings.where("code LIKE '%7.SZ'"), ["2024-01-15", "2024-01-20"], buckets=16)
    return K.attribution_from_json(found).withColumn("n", F.size("attributions"))


@query("b6_attribution_json", "trade_date:d code n:i top_group contribution:f",
       "SELECT trade_date, code, count(*) AS n, min(group_id) FILTER (pos = 1) AS top_group, sum(contribution) AS contribution "
       "FROM att GROUP BY 1, 2", **ATTR_CTES)
def _(t):
    back = K.attribution_from_json(daily_attribution(t, as_json=True))
    return back.select("trade_date", "code", F.size("attributions").alias("n"), "top_group",
                       F.aggregate("attributions", F.lit(0.0), lambda a, e: a + e["contribution"]).alias("contribution"))


@query("k7_rankings", "trade_date:d pos:i group_id group_name score_final:f",
       """SELECT * FROM (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY rank_1d NULLS LAST, group_id) AS pos,
          group_id, group_name, score_final FROM g5 JOIN grp USING (group_id)) WHERE pos <= 10""", **multi_ctes())
def _(t):
    return K.rankings(S.multi_period_strength(t.bars, t.current, precision=None), t.groups, top_n=10)


@query("k8_groups_from_members", "code group_id weight:f",
       "SELECT DISTINCT code, group_id, 1.0 AS weight FROM mine WHERE substr(group_id, 1, 3) IN ('885', '886')", **ATTR_CTES)
def _(t):
    nothing = t.groups.filter("kind = 'none'").select("group_id")
    return K.groups_from_members(t.members, t.groups, nothing)


# ---- missing values through the whole chain (C15) ----

_HOLED = "SELECT * REPLACE (CASE WHEN code[-4:-4] = '5' THEN NULL ELSE change_ratio END AS change_ratio) FROM bars"


def holed_bars(t):
    """Bars whose change is NaN for one instrument in ten, as a loader leaves them."""
    nan = F.when(F.substring("code", -4, 1) == "5", F.lit(float("nan"))).otherwise(F.col("change_ratio"))
    return missing_to_null(t.bars.withColumn("change_ratio", nan))


@query("c15_nan_group_strength", G2_SPEC, "SELECT * FROM sc", holed=_HOLED, fig=figures("holed", "cur"), sc=scored("fig", "trade_date"))
def _(t):
    return S.group_strength(holed_bars(t), t.current, precision=None)


@query("c15_nan_group_return", "trade_date:d group_id group_return:f",
       "SELECT trade_date, group_id, avg(change_ratio) AS group_return FROM holed JOIN cur USING (code) WHERE change_ratio IS NOT NULL GROUP BY 1, 2", holed=_HOLED)
def _(t):
    return S.group_return(holed_bars(t), t.current)


@query("c15_nan_attribution", "trade_date:d code total_return:f top_group top_contrib_pct:f4",
       "SELECT trade_date, code, total_return, group_id AS top_group, contrib_pct AS top_contrib_pct FROM att WHERE pos = 1",
       **{k: v.replace("FROM bars", "FROM holed").replace("JOIN bars", "JOIN holed") for k, v in ATTR_CTES.items()}, holed=_HOLED)
def _(t):
    return K.daily_attribution(holed_bars(t), t.members, t.groups, scope=t.scope.select("group_id").distinct(), digits=None)


@query("c15_nan_spread_rank", "code trade_date:d change_ratio:f rank:f0",
       "SELECT code, trade_date, change_ratio, CASE WHEN change_ratio IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY change_ratio DESC NULLS LAST) END AS rank "
       "FROM holed WHERE code[-4:-4] <> '5'", holed=_HOLED)
def _(t):
    ranked = R.spread_rank(holed_bars(t).select("code", "trade_date", "change_ratio"), "change_ratio", ["trade_date"])
    return ranked.where(F.substring("code", -4, 1) != "5")
