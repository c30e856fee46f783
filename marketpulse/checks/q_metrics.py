"""Per-instrument metrics from bars and ticks (D8, F, H4, H5)."""

from pyspark.sql import functions as F

from marketpulse.checks.registry import query
from marketpulse.checks.sql import limit_up, snapshots, tick_states, z
from marketpulse.functions import codes as C
from marketpulse.functions import measures as M
from marketpulse.operators import auction as A
from marketpulse.operators import intraday as I
from marketpulse.operators import latest as L
from marketpulse.operators import members as P
from marketpulse.operators import ranking as R
from marketpulse.operators import returns as T
from marketpulse.operators import strength as S
from marketpulse.staging import stage

IND_SPEC = "trade_date:d code change_ratio:f speed:f body:f acceleration:f amount:f"


@query("d8_as_of_indicators", IND_SPEC, "SELECT * FROM ind", snap=snapshots("ticks", "14:30"),
       cut="SELECT ticks.* FROM ticks JOIN snap USING (trade_date) WHERE hhmm <= snapshot_time",
       ind=tick_states("cut", "trade_date, code"))
def _(t):
    return I.indicators(t.ticks, "14:30")


@query("d8_latest_indicators", IND_SPEC, tick_states("ticks", "trade_date, code"))
def _(t):
    return I.indicators(t.ticks)


@query("d8_auction_indicators", IND_SPEC, tick_states("cut", "trade_date, code"),
       cut="SELECT * FROM ticks WHERE hhmm <= '09:25'")
def _(t):
    return I.indicators(t.ticks, "09:25", resolve=False)


@query("f2_body_and_limit", "code trade_date:d body:f limit_up:b limit_score:f",
       f"""SELECT code, trade_date, coalesce((close - open) / nullif(open, 0) * 100, 0) AS body, {limit_up()} AS limit_up,
           CASE WHEN {limit_up()} THEN 1 ELSE 0 END AS limit_score FROM bars""")
def _(t):
    return t.bars.select("code", "trade_date", M.body_pct("open", "close").alias("body"),
                         C.is_limit_up().alias("limit_up"), C.limit_score().alias("limit_score"))


@query("f4_speed_series", "trade_date:d code seq:i speed:f",
       """SELECT trade_date, code, seq, CASE WHEN prev > 0 THEN (price - prev) / prev * 100 ELSE 0 END AS speed
          FROM (SELECT *, lag(price) OVER (PARTITION BY trade_date, code ORDER BY hhmm, seq) AS prev FROM ticks WHERE phase = 'trading')""")
def _(t):
    return I.speed_series(t.ticks)


@query("f5_acceleration_marks", "trade_date:d code mark",
       "SELECT trade_date, code, CASE WHEN acceleration > 0.01 THEN 'rising' WHEN acceleration < -0.01 THEN 'falling' "
       "ELSE 'steady' END AS mark FROM ind", ind=tick_states("ticks", "trade_date, code"))
def _(t):
    return I.indicators(t.ticks).select("trade_date", "code", M.acceleration_mark("acceleration").alias("mark"))


def _f8(n, end="2024-01-25"):
    return f"""SELECT w.code, DATE '{end}' AS trade_date,
        CASE WHEN base = 0 THEN 0 ELSE (e.close / base - 1) * 100 END AS change_ratio, e.close
        FROM (SELECT code, arg_min(pre_close, trade_date) FILTER (WHERE pre_close IS NOT NULL) AS base FROM bars
              WHERE trade_date BETWEEN DATE '{end}' - {2 * n} AND DATE '{end}' GROUP BY 1) w
        JOIN bars e ON e.code = w.code AND e.trade_date = DATE '{end}'"""


@query("f8_period_return_5d", "code trade_date:d change_ratio:f close:f", _f8(5))
def _(t):
    return T.period_return(t.bars, "2024-01-25", 5)


@query("f8_period_return_fallback", "code trade_date:d change_ratio:f close:f", _f8(20, "2024-01-30"))
def _(t):
    return T.period_return(t.bars, "2024-02-15", 20)


_ROLLING = """SELECT b.code, b.trade_date, CASE WHEN base = 0 THEN 0 ELSE (b.close / base - 1) * 100 END AS change_ratio
    FROM (SELECT e.code, e.trade_date, e.close, arg_min(s.pre_close, s.trade_date) FILTER (WHERE s.pre_close IS NOT NULL) AS base
          FROM {t} e JOIN {t} s ON s.code = e.code AND s.trade_date BETWEEN e.trade_date - {d} AND e.trade_date
          GROUP BY 1, 2, 3) b"""


@query("f8_rolling_return_5d", "code trade_date:d change_ratio:f", _ROLLING.format(t="bars", d=10))
def _(t):
    return T.rolling_period_return(t.bars, 5)


@query("f8_rolling_return_20d_long", "code trade_date:d change_ratio:f", _ROLLING.format(t="lbars", d=40))
def _(t):
    return T.rolling_period_return(t.long_bars, 20)


_F9 = """SELECT code, max(trade_date) AS end_date, (arg_max(close, trade_date) / nullif(max(pre_close) FILTER (first), 0) - 1) * 100 AS change_ratio
    FROM (SELECT *, trade_date = min(trade_date) OVER (PARTITION BY code) AS first FROM bars
          WHERE trade_date BETWEEN DATE '2024-01-25' - {d} AND DATE '2024-01-25') GROUP BY 1"""


@query("f9_period_return_asof", "code end_date:d change_ratio:f",
       "SELECT * FROM r WHERE change_ratio IS NOT NULL", r=_F9.format(d=6))
def _(t):
    return T.period_return_asof(t.bars, "2024-01-25", 3)


@query("f10_bar_return", "code return_5d:f",
       """SELECT code, (max(close) FILTER (rn = 1) / nullif(max(close) FILTER (rn = 6), 0) - 1) * 100 AS return_5d
          FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM lbars) GROUP BY 1""")
def _(t):
    return T.bar_return(t.long_bars, 5, digits=None)


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars " \
        "WHERE trade_date <= DATE '2024-01-25') WHERE rn = 1"


@query("f11_daily_body", "code body:f",
       "SELECT code, (close / nullif(open, 0) - 1) * 100 AS body FROM lastrow WHERE open <> 0", lastrow=_LAST)
def _(t):
    return T.daily_body(t.bars, "2024-01-25")


@query("f12_daily_change", "code change_ratio:f",
       "SELECT code, change_ratio FROM lastrow WHERE change_ratio IS NOT NULL", lastrow=_LAST)
def _(t):
    return T.daily_change(t.bars, "2024-01-25")


SUMMARY = """SELECT code, count(*) AS n_bars,
      coalesce((max(close) FILTER (rn = 1) / nullif(arg_max(close, rn), 0) - 1) * 100, 0) AS total_change,
      coalesce((max(close) FILTER (rn = 1) / nullif(max(close) FILTER (rn = 2), 0) - 1) * 100, 0) AS last_change,
      coalesce(max(volume) FILTER (rn = 1) / nullif(coalesce(avg(volume) FILTER (rn > 1), max(volume) FILTER (rn = 1)), 0), 1) AS volume_ratio,
      coalesce((max(close) / nullif(min(close), 0) - 1) * 100, 0) AS amplitude,
      max(close) FILTER (rn = 1) AS last_close, max(amount) FILTER (rn = 1) AS last_amount,
      string_agg(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) AS dates
      FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM {t}) WHERE rn <= 5 GROUP BY 1"""


@query("f16_bar_summary",
       "code n_bars:i total_change:f last_change:f volume_ratio:f amplitude:f last_close:f8 last_amount:f dates",
       SUMMARY.format(t="lbars"))
def _(t):
    return T.bar_summary(t.long_bars).withColumn(
        "dates", F.concat_ws(",", F.transform("last_bars", lambda b: b["trade_date"].cast("string"))))


@query("f17_tick_summary",
       "trade_date:d code n_points:i open_change:f close_change:f high_change:f low_change:f tail_change:f turnover:f "
       "sample_0:f sample_1:f sample_2:f sample_3:f sample_4:f",
       """SELECT trade_date, code, n AS n_points, {0} AS open_change, {1} AS close_change, {2} AS high_change, {3} AS low_change,
          CASE WHEN n >= 2 THEN coalesce((s4 / nullif(tp, 0) - 1) * 100, 0) ELSE 0 END AS tail_change, turnover,
          s0 AS sample_0, s1 AS sample_1, s2 AS sample_2, s3 AS sample_3, s4 AS sample_4
          FROM (SELECT trade_date, code, max(n) AS n, max(price) AS hi, min(price) AS lo, max(turnover) FILTER (i = n - 1) AS turnover,
            max(price) FILTER (i = 0) AS s0, max(price) FILTER (i = n // 4) AS s1, max(price) FILTER (i = n // 2) AS s2,
            max(price) FILTER (i = n * 3 // 4) AS s3, max(price) FILTER (i = n - 1) AS s4,
            max(price) FILTER (i = greatest(n - 30, 0)) AS tp
            FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, code ORDER BY hhmm, seq) - 1 AS i,
                  count(*) OVER (PARTITION BY trade_date, code) AS n FROM ticks WHERE phase = 'trading') GROUP BY 1, 2)
          LEFT JOIN (SELECT trade_date, code, arg_min(price, seq) AS pc FROM ticks WHERE phase = 'pre_market' AND price <> 0 GROUP BY 1, 2)
          USING (trade_date, code)""".format(*[f"CASE WHEN pc > 0 THEN ({p} / pc - 1) * 100 ELSE 0 END" for p in ("s0", "s4", "hi", "lo")]))
def _(t):
    return I.tick_summary(t.ticks)


FACTORS = """SELECT f.trade_date, f.code, (price / pre_close - 1) * 100 AS gap_pct,
      CASE WHEN v.prev_volume > 0 THEN matched_vol / v.prev_volume ELSE 0 END AS vol_ratio,
      CASE WHEN unmatched_buy + unmatched_sell > 0 THEN (unmatched_buy - unmatched_sell) / (unmatched_buy + unmatched_sell) ELSE 0 END AS order_imbalance,
      CASE WHEN base > 0 THEN (price / base - 1) * 100 ELSE 0 END AS trend_score
      FROM (SELECT trade_date, code, count(*) AS n, arg_min(price, seq) AS pre_close,
        {last}, arg_max(price, (hhmm, seq)) FILTER (WHERE hhmm <= '{at}' AND hhmm <= '09:20') AS base,
        count(*) FILTER (WHERE hhmm <= '{at}') AS k
        FROM {src} WHERE phase = 'pre_market' GROUP BY 1, 2) f LEFT JOIN prevvol v USING (trade_date, code)
      WHERE n >= 2 AND pre_close <> 0 AND k > 0"""


def factors_sql(at="09:25", src="ticks"):
    last = ", ".join(f"arg_max({c}, (hhmm, seq)) FILTER (WHERE hhmm <= '{at}') AS {c}"
                     for c in ("price", "matched_vol", "unmatched_buy", "unmatched_sell"))
    return FACTORS.format(last=last, at=at, src=src)


def auction_score_sql(source="fac"):
    w = "(PARTITION BY trade_date)"
    parts = " + ".join(f"{k} * ({z(c, w)})" for c, k in A.AUCTION_WEIGHTS.items())
    return f"SELECT *, {parts} AS score FROM {source}"


FACTOR_SPEC = "trade_date:d code gap_pct:f vol_ratio:f order_imbalance:f trend_score:f"


@query("f18_auction_factors", FACTOR_SPEC, factors_sql())
def _(t):
    return A.auction_factors(t.ticks, L.prev_volume(t.bars), "09:25")


@query("h5_auction_score", FACTOR_SPEC + " score:f", auction_score_sql(), fac=factors_sql())
def _(t):
    return A.auction_score(A.auction_factors(t.ticks, L.prev_volume(t.bars), "09:25"))


def member_score_sql(source, by="trade_date, group_id"):
    w = f"(PARTITION BY {by})"
    parts = " + ".join(f"{k} * ({z(c, w)})" for c, k in P.MEMBER_WEIGHTS.items())
    flag = f"CASE WHEN {limit_up()} THEN 1 ELSE 0 END"
    return f"SELECT *, {flag} AS limit_score, {parts} + 0.2 * {flag} AS score FROM {source}"


_MEMBERS_OF = "SELECT i.*, c.group_id FROM ind i JOIN cur c USING (code)"


@query("h4_member_scores",
       "trade_date:d group_id code change_ratio:f speed:f body:f acceleration:f limit_score:f score:f rank:i",
       "SELECT *, rank() OVER (PARTITION BY trade_date, group_id ORDER BY round(score, 9) DESC) AS rank FROM sc",
       ind=tick_states("ticks", "trade_date, code"), gm=_MEMBERS_OF, sc=member_score_sql("gm"))
def _(t):
    quotes = stage(S.quotes_by_group(I.indicators(t.ticks), t.current), "quotes")
    return P.score_members(quotes, rank=True)


@query("h1_zscore_bounded", "trade_date:d group_id z:f",
       f"SELECT trade_date, group_id, {z('m', '(PARTITION BY trade_date)')} AS z FROM (SELECT trade_date, group_id, "
       "avg(close) AS m FROM bars JOIN cur USING (code) GROUP BY 1, 2)")
def _(t):
    means = t.bars.join(t.current, "code").groupBy("trade_date", "group_id").agg(F.avg("close").alias("m"))
    return means.select("trade_date", "group_id", R.zscore("m", ["trade_date"]).alias("z"))


@query("h6_spread_rank", "code trade_date:d rank:f0",
       "SELECT code, trade_date, CASE WHEN change_ratio IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY change_ratio DESC NULLS LAST) END AS rank FROM bars")
def _(t):
    return R.spread_rank(t.bars, "change_ratio", ["trade_date"])


@query("h7_tail_frame", "code trade_date:d pos:i close:f8",
       """SELECT * FROM (SELECT code, trade_date, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS pos, close FROM lbars)
          WHERE pos <= 30""")
def _(t):
    return R.top_per_group(t.long_bars, ["code"], [F.col("trade_date").desc()], 30)
