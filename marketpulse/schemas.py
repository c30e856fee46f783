"""Canonical schemas shared by all operators."""

from pyspark.sql import types as T

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DAILY_BARS = _struct(
    code=_S, trade_date=T.DateType(), pre_close=_D, open=_D, high=_D, low=_D,
    close=_D, change_ratio=_D, volume=_D, amount=_D,
)

# ``seq`` orders points inside one minute: auction points arrive every few
# seconds while ``hhmm`` is cut to the minute.
TICKS = _struct(
    code=_S, trade_date=T.DateType(), phase=_S, seq=_L, ts=T.TimestampType(), hhmm=_S,
    price=_D, avg_price=_D, volume=_D, turnover=_D,
    matched_vol=_D, unmatched_buy=_D, unmatched_sell=_D,
)

MEMBERS = _struct(group_id=_S, code=_S, name=_S, as_of=T.DateType())
GROUPS = _struct(group_id=_S, group_name=_S, kind=_S)
HOLDINGS = _struct(code=_S, shares=_D, cost_price=_D)
HITS = _struct(code=_S, name=_S, change_ratio=_D)

BAR_VALUES = ["pre_close", "open", "high", "low", "close", "change_ratio", "volume", "amount"]

PRE_MARKET = "pre_market"
TRADING = "trading"
