"""Trading-session phases of a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session bounds as minutes of the day, half open.
AUCTION_START = 9 * 60 + 15
AUCTION_END = 9 * 60 + 25
MORNING_START = 9 * 60 + 30
MORNING_END = 11 * 60 + 30
AFTERNOON_START = 13 * 60
AFTERNOON_END = 15 * 60
FIRST_DATA_TIME = "09:15"

LIVE_PHASES = ("auction", "pre_morning", "morning", "lunch", "afternoon")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def session_phase(ts, is_trading_day) -> Column:
    """One of seven phases; days without trading are ``closed``."""
    ts = _col(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (
        F.when(~F.coalesce(_col(is_trading_day), F.lit(False)), "closed")
        .when(minute < AUCTION_START, "pre_open")
        .when(minute < AUCTION_END, "auction")
        .when(minute < MORNING_START, "pre_morning")
        .when(minute < MORNING_END, "morning")
        .when(minute < AFTERNOON_START, "lunch")
        .when(minute < AFTERNOON_END, "afternoon")
        .otherwise("closed")
    )


def next_open_time(phase) -> Column:
    """Time at which data next appears, NULL while the session is live."""
    return F.when(_col(phase).isin("pre_open", "closed"), FIRST_DATA_TIME)


def in_session(phase) -> Column:
    """The phase may carry live data."""
    return _col(phase).isin(*LIVE_PHASES)


def stream_gate(phase, is_trading_day) -> Column:
    """Data should be processed: a trading day past its pre-open."""
    return F.coalesce(_col(is_trading_day), F.lit(False)) & (_col(phase) != "pre_open")
