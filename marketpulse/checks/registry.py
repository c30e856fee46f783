"""Registry of checked queries: a Spark function and its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from marketpulse.checks.sql import sql as statement
from marketpulse.checks.sql import tidy
from marketpulse.operators.scopes import current_members
from marketpulse.plans.dashboards import watched_members
from marketpulse.sources import star


class Frames:
    """The canonical frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return star.table(self.spark, self.dir, name)

    bars = cached_property(lambda self: star.daily_bars(self.spark, self.dir))
    long_bars = cached_property(lambda self: star.long_bars(self.spark, self.dir))
    long_members = cached_property(lambda self: star.supplier_members(self.spark, self.dir))
    members = cached_property(lambda self: star.members(self.spark, self.dir))
    groups = cached_property(lambda self: star.groups(self.spark, self.dir))
    watched = cached_property(lambda self: star.watched(self.spark, self.dir))
    custom = cached_property(lambda self: star.custom_groups(self.spark, self.dir))
    custom_names = cached_property(lambda self: self.custom.select("group_id", "group_name").distinct())
    ticks = cached_property(lambda self: star.ticks(self.spark, self.dir))
    calendar = cached_property(lambda self: star.calendar(self.spark, self.dir))
    holdings = cached_property(lambda self: star.holdings(self.spark, self.dir))
    current = cached_property(lambda self: current_members(self.members))
    scope = cached_property(lambda self: watched_members(self.members, self.watched))
    index = cached_property(lambda self: star.index_bars(self.bars, self.current))


@dataclass
class Query:
    spec: str
    build: Callable[[Frames], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Frames(spark, sf_dir)), self.spec)


REGISTRY: dict[str, Query] = {}


def query(name: str, spec: str, body: str | None = None, **ctes: str):
    """Register the decorated function; ``body`` is the oracle's final SELECT."""
    def register(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(spec, fn, None if body is None else statement(spec, body, **ctes))
        return fn
    return register
