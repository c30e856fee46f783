"""DuckDB side of the checks: the canonical frames as common table expressions.

``sql(spec, body)`` wraps a final SELECT, pulls in the expressions it names and
casts the columns exactly as ``tidy`` does on the Spark side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"s": "VARCHAR", "d": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}


def columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "s") for c in spec.split()]


def tidy(df: DataFrame, spec: str) -> DataFrame:
    """Select the spec's columns with comparable types; doubles are rounded."""
    def one(name, kind):
        c = F.col(name)
        if kind.startswith("f"):
            c = F.round(c.cast("double"), int(kind[1:] or 6)) + 0.0
        else:
            c = c.cast({"s": "string", "d": "string", "i": "bigint", "b": "boolean"}[kind])
        return c.alias(name)
    return df.select(*[one(n, k) for n, k in columns(spec)])


def _cast(name: str, kind: str) -> str:
    if kind.startswith("f"):
        return f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {name}"
    return f"CAST({name} AS {_TYPES[kind]}) AS {name}"


def code(k: str) -> str:
    p = f"lpad(CAST({k} AS VARCHAR), 6, '0')"
    return (f"CASE {k} % 10 WHEN 0 THEN '300' || {p} || '.SZ' WHEN 1 THEN '688' || {p} || '.SH' "
            f"WHEN 2 THEN '8' || {p} || '.BJ' WHEN 9 THEN '9' || {p} || '.HK' "
            f"ELSE CASE WHEN {k} % 2 = 0 THEN '6' || {p} || '.SH' ELSE '0' || {p} || '.SZ' END END")


def limit_up(code_col: str = "code", change: str = "change_ratio") -> str:
    return (f"coalesce({change} >= CASE WHEN {code_col} LIKE '%.BJ' THEN 29.0 WHEN {code_col} LIKE '300%' "
            f"OR {code_col} LIKE '688%' THEN 19.5 ELSE 9.8 END, false)")


DOMESTIC = "(code LIKE '%.SH' OR code LIKE '%.SZ' OR code LIKE '%.BJ')"
ZT = "upper(trim(group_name)) LIKE 'ZT%'"


def z(x: str, w: str) -> str:
    return (f"CASE WHEN stddev_samp({x}) OVER {w} > 0 THEN ({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w} "
            f"ELSE 0 END")


def scored(source: str, by: str) -> str:
    """SELECT adding z-scores, score and rank to rows of group figures."""
    w = f"(PARTITION BY {by})"
    score = "CASE WHEN s1_return IS NOT NULL THEN 0.4 * z_s1 + 0.3 * z_s2 + 0.3 * z_s4 END"
    return f"""SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC NULLS LAST) END AS rank_1d
      FROM (SELECT *, {score} AS score FROM (SELECT *, {z('s1_return', w)} AS z_s1, {z('s2_breadth', w)} AS z_s2,
      {z('s4_relative', w)} AS z_s4 FROM {source}))"""


def figures(quotes: str, members: str, by: str = "trade_date", minimum: int = 6, body: str = "NULL",
            change: str = "change_ratio", digits: int | None = None) -> str:
    """SELECT of group figures from quotes and (group_id, code) members."""
    b = ", ".join(f"q.{c.strip()}" for c in by.split(","))
    names = ", ".join(c.strip() for c in by.split(","))

    def r(x):
        return x if digits is None else f"round_even({x}, {digits})"
    return f"""SELECT {names}, group_id, {r('s1')} AS s1_return, {r('up / member_count')} AS s2_breadth,
      {r('s1 - mr')} AS s4_relative, {r('bm')} AS s_body, member_count
      FROM (SELECT {b}, p.group_id, avg(q.{change}) AS s1, CAST(count(*) FILTER (WHERE q.{change} > 0) AS DOUBLE) AS up,
            count(*) AS member_count, avg({body}) AS bm
            FROM {quotes} q JOIN (SELECT DISTINCT group_id, code FROM {members}) p ON q.code = p.code
            GROUP BY {b}, p.group_id HAVING count(*) >= {minimum})
      JOIN (SELECT {names}, avg({change}) AS mr FROM {quotes} GROUP BY {names}) USING ({names})"""


CTES: dict[str, str] = {
    "edaily": "SELECT user_id, CAST(ts AS DATE) AS trade_date, arg_min(value, event_id) AS open, "
              "arg_max(value, event_id) AS close, max(value) AS high, min(value) AS low, "
              "count(*) * 100.0 AS volume, sum(value) AS amount FROM events GROUP BY 1, 2",
    "bars": f"SELECT {code('user_id')} AS code, trade_date, lag(close) OVER w AS pre_close, open, high, low, close, "
            "(close / nullif(lag(close) OVER w, 0) - 1) * 100 AS change_ratio, volume, amount "
            "FROM edaily WINDOW w AS (PARTITION BY user_id ORDER BY trade_date)",
    "sdaily": "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS trade_date, "
              "arg_min(l_extendedprice / nullif(l_quantity, 0), (l_orderkey, l_linenumber, l_extendedprice)) AS open, "
              "arg_max(l_extendedprice / nullif(l_quantity, 0), (l_orderkey, l_linenumber, l_extendedprice)) AS close, "
              "max(l_extendedprice / nullif(l_quantity, 0)) AS high, min(l_extendedprice / nullif(l_quantity, 0)) AS low, "
              "sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2",
    "lbars": f"SELECT {code('l_suppkey')} AS code, trade_date, lag(close) OVER w AS pre_close, open, high, low, close, "
             "(close / nullif(lag(close) OVER w, 0) - 1) * 100 AS change_ratio, volume, amount "
             "FROM sdaily WINDOW w AS (PARTITION BY l_suppkey ORDER BY trade_date)",
    "lmembers": f"SELECT printf('884%03d.TI', s_nationkey) AS group_id, {code('s_suppkey')} AS code FROM supplier",
    "cust": "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "kinds": f"""SELECT *, {code('c_custkey')} AS code FROM (
      SELECT cust.*, 'nation' AS kind, printf('884%03d.TI', n_nationkey) AS group_id, n_name AS group_name,
        CASE WHEN n_nationkey = 3 THEN 'CC' ELSE n_name END AS custom_name FROM cust
      UNION ALL SELECT cust.*, 'segment', '885' || substr(c_mktsegment, 1, 3) || '.TI', c_mktsegment,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'ZT' ELSE '' END || c_mktsegment FROM cust
      UNION ALL SELECT cust.*, 'region', printf('861%03d.US', n_regionkey), r_name, NULL FROM cust
      UNION ALL SELECT cust.*, 'nation_segment', printf('886%02d', n_nationkey) || substr(c_mktsegment, 1, 1) || '.TI',
        n_name || ' ' || c_mktsegment,
        CASE WHEN c_mktsegment = 'BUILDING' THEN ' zt ' ELSE '' END || n_name || ' ' || c_mktsegment FROM cust)""",
    "members": """SELECT group_id, code, c_name AS name, DATE '2024-01-01' AS as_of FROM kinds WHERE c_acctbal >= 1000
      UNION ALL SELECT group_id, code, c_name, DATE '2024-01-15' FROM kinds
      WHERE NOT (kind IN ('nation', 'nation_segment') AND n_regionkey = 0)""",
    "grp": "SELECT DISTINCT group_id, group_name, kind FROM kinds",
    "watched": "SELECT DISTINCT group_id FROM kinds WHERE kind = 'segment' "
               "OR (kind IN ('nation', 'nation_segment') AND n_regionkey <> 0)",
    "custom": "SELECT group_id, custom_name AS group_name, code FROM kinds WHERE kind <> 'region'",
    "custom_names": "SELECT DISTINCT group_id, group_name FROM custom",
    "cur": "SELECT group_id, code, min(name) AS name FROM members JOIN (SELECT group_id, max(as_of) AS as_of "
           "FROM members GROUP BY 1) USING (group_id, as_of) GROUP BY 1, 2",
    "sizes": "SELECT group_id, count(*) AS member_count FROM cur GROUP BY 1",
    "mon": "SELECT group_id, member_count FROM sizes WHERE member_count BETWEEN 10 AND 500",
    "wm": "SELECT cur.* FROM cur JOIN watched USING (group_id) JOIN mon USING (group_id)",
    "eff": "SELECT DISTINCT group_id FROM wm UNION ALL SELECT group_id FROM grp "
           "WHERE substr(group_id, 1, 3) IN ('700', '881', '883', '884', '885', '886') AND NOT EXISTS (SELECT 1 FROM wm)",
    "em": "SELECT cur.* FROM cur JOIN eff USING (group_id)",
    "names": "SELECT code, arg_min(name, group_id) AS name FROM members "
             "WHERE as_of = (SELECT max(as_of) FROM members) GROUP BY 1",
    "ticks": f"""SELECT {code('user_id')} AS code, CAST(ts AS DATE) AS trade_date,
      CASE WHEN hour(ts) < 10 THEN 'pre_market' ELSE 'trading' END AS phase, event_id AS seq, ts,
      strftime(ts, '%H:%M') AS hhmm, value AS price, kk AS volume, value * 100 AS turnover,
      kk * 10 + 100 AS matched_vol, kk AS unmatched_buy, 100 - kk AS unmatched_sell
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS kk FROM events)""",
    "cal": "SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events WHERE isodow(ts) <= 5",
    "holdings": f"SELECT {code('o_custkey')} AS code, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS shares, "
                "o_totalprice AS cost_price FROM orders",
    "anchors": """SELECT trade_date, code,
      coalesce(arg_min(price, seq) FILTER (WHERE phase = 'pre_market'), arg_min(price, seq) FILTER (WHERE phase = 'trading')) AS pre_close,
      coalesce(arg_max(price, seq) FILTER (WHERE phase = 'pre_market'), arg_min(price, seq) FILTER (WHERE phase = 'trading')) AS open
      FROM ticks GROUP BY 1, 2""",
    "days": "SELECT DISTINCT trade_date FROM bars",
    "prevdays": "SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_date FROM days",
    "prevvol": "SELECT p.trade_date, b.code, b.volume AS prev_volume FROM prevdays p "
               "JOIN bars b ON b.trade_date = p.prev_date AND b.volume > 0",
    "idx": "SELECT p.group_id AS code, trade_date, avg(open) AS open, avg(close) AS close, avg(change_ratio) AS change_ratio, "
           "sum(volume) AS volume, sum(amount) AS amount FROM bars b "
           "JOIN (SELECT DISTINCT group_id, code FROM cur) p ON b.code = p.code GROUP BY 1, 2",
    "lastday": "SELECT max(trade_date) AS d FROM bars",
}


def tick_states(source: str, keys: str) -> str:
    """SELECT of metrics from ticks already cut, keyed by ``keys`` (date, code, ...)."""
    last = "coalesce(p1, pre_price)"

    def step(a, b):
        return f"CASE WHEN {a} > 0 THEN ({b} - {a}) / {a} * 100 ELSE 0 END"
    return f"""SELECT {keys}, ({last} / nullif(pre_close, 0) - 1) * 100 AS change_ratio,
      CASE WHEN len(v) >= 2 THEN (v[-1] - v[-2]) / v[-2] * 100 ELSE 0 END AS speed,
      CASE WHEN p1 IS NULL THEN 0 ELSE coalesce((p1 - open) / nullif(open, 0) * 100, 0) END AS body,
      CASE WHEN p2 IS NULL THEN 0 ELSE ({step('p2', 'p1')}) - CASE WHEN p3 IS NULL THEN 0 ELSE ({step('p3', 'p2')}) END END AS acceleration,
      CASE WHEN p1 IS NULL THEN 0 ELSE coalesce(turnover, 0) END AS amount
      FROM (SELECT {keys},
        max(price) FILTER (WHERE phase = 'trading' AND rn = 1) AS p1, max(price) FILTER (WHERE phase = 'trading' AND rn = 2) AS p2,
        max(price) FILTER (WHERE phase = 'trading' AND rn = 3) AS p3, max(turnover) FILTER (WHERE phase = 'trading' AND rn = 1) AS turnover,
        max(price) FILTER (WHERE phase = 'pre_market' AND rn = 1) AS pre_price,
        list(price ORDER BY rn DESC) FILTER (WHERE phase = 'trading' AND rn <= 3 AND price > 0) AS v
        FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, phase ORDER BY hhmm DESC, seq DESC) AS rn FROM {source})
        GROUP BY {keys}) JOIN anchors USING (trade_date, code) WHERE pre_close <> 0"""


def snapshots(ticks: str, at: str | None) -> str:
    """SELECT of every session's effective minute."""
    if at is None:
        return f"SELECT trade_date, max(hhmm) AS snapshot_time FROM {ticks} GROUP BY 1"
    return (f"SELECT trade_date, CASE WHEN '{at}' >= min(hhmm) THEN '{at}' ELSE max(hhmm) END AS snapshot_time "
            f"FROM {ticks} GROUP BY 1")


def sql(spec: str, body: str, **ctes: str) -> str:
    """Complete statement for a final SELECT and extra expressions of its own."""
    known = {**CTES, **ctes}
    needed: list[str] = []

    def visit(text: str, own: str | None = None):
        for name in known:
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ("WITH " + ", ".join(f"{n} AS ({known[n]})" for n in needed) + " ") if needed else ""
    return f"{head}SELECT {', '.join(_cast(n, k) for n, k in columns(spec))} FROM ({body})"
