"""Instrument and group code rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange suffixes, group prefixes, limit-up thresholds, names.
DOMESTIC_SUFFIXES = (".SH", ".SZ", ".BJ")
DOMESTIC_GROUP_PREFIXES = ("700", "881", "883", "884", "885", "886")
OBSERVED_GROUP_PREFIXES = ("884", "885", "886")
POOL_EXTRA_PREFIXES = ("885", "886")
GROWTH_BOARD_PREFIXES = ("300", "688")
LIMIT_UP = {"main": 9.8, "gem_star": 19.5, "bj": 29.0}
HOLDING_GROUP_NAME = "CC"
LEVEL_INDUSTRY, LEVEL_CONCEPT, LEVEL_OTHER = "三级行业", "概念板块", "其他"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return F.coalesce(result, F.lit(False))


def is_domestic(code="code") -> Column:
    """Instrument listed on one of the domestic exchanges."""
    return _any(_col(code).endswith(s) for s in DOMESTIC_SUFFIXES)


def _prefix_in(group, prefixes) -> Column:
    return F.coalesce(F.substring(_col(group), 1, 3).isin(*prefixes), F.lit(False))


def is_domestic_group(group="group_id") -> Column:
    """Group whose code prefix belongs to the domestic market."""
    return _prefix_in(group, DOMESTIC_GROUP_PREFIXES)


def is_observed_group(group="group_id") -> Column:
    """C4: group of the observation pool."""
    return _prefix_in(group, OBSERVED_GROUP_PREFIXES)


def has_pool_prefix(group="group_id") -> Column:
    """Prefixes the attribution pool always lets through."""
    return _prefix_in(group, POOL_EXTRA_PREFIXES)


def is_zt(name="group_name") -> Column:
    """C11: group named as a limit-up ("ZT") collection."""
    return F.coalesce(F.upper(F.trim(_col(name))).startswith("ZT"), F.lit(False))


def is_holding_group(name="group_name") -> Column:
    return F.coalesce(_col(name) == HOLDING_GROUP_NAME, F.lit(False))


def group_level(group="group_id") -> Column:
    """Display level of a group by its prefix."""
    prefix = F.substring(_col(group), 1, 3)
    return (
        F.when(prefix == "884", LEVEL_INDUSTRY)
        .when(prefix.isin("885", "886"), LEVEL_CONCEPT)
        .otherwise(LEVEL_OTHER)
    )


def board(code="code") -> Column:
    """board class that decides the daily price limit."""
    code = _col(code)
    return (
        F.when(code.endswith(".BJ"), "bj")
        .when(_any(code.startswith(p) for p in GROWTH_BOARD_PREFIXES), "gem_star")
        .otherwise("main")
    )


def is_limit_up(code="code", change="change_ratio") -> Column:
    """the change reaches the board's limit; unknown changes do not."""
    b, change = board(code), _col(change)
    threshold = (
        F.when(b == "bj", LIMIT_UP["bj"])
        .when(b == "gem_star", LIMIT_UP["gem_star"])
        .otherwise(LIMIT_UP["main"])
    )
    return F.coalesce((change >= threshold) & ~F.isnan(change), F.lit(False))


def limit_score(code="code", change="change_ratio") -> Column:
    """1.0 at the limit, else 0.0."""
    return is_limit_up(code, change).cast("int").cast("double")


def vendor_code(code="code") -> Column:
    """``600519.SH`` to ``SH600519``; codes without a dot stay."""
    return F.regexp_replace(_col(code), r"^([^.]*)\.([^.]*)$", "$2$1")
