"""Standardising, ranking and top-k.

Two kinds of cross-section occur. Groups of one snapshot number thousands at
most, so a window per snapshot is fine for them. Instruments of a snapshot or
of a (possibly huge) group are unbounded: for those the statistics are
aggregated and joined back, ranks are built from ranges of values, and top-k
relies on the pre-shuffle pruning Spark applies to ``row_number() <= k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.staging import stage

STEADY_DIGITS = 9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def steady(value) -> Column:
    """Sort key of a computed score, blind to the last bits.

    Sums of doubles depend on the order in which partitions arrive; scores that
    are equal in exact arithmetic must tie on every run.
    """
    return F.round(_col(value), STEADY_DIGITS)


def _z(value, mean, std) -> Column:
    return F.when(std > 0, (value - mean) / std).otherwise(0.0)


def zscore(value, by: Sequence[str]) -> Column:
    """H1: sample z-score over a bounded cross-section; no spread gives 0."""
    value = _col(value).cast("double")
    w = Window.partitionBy(*by)
    return _z(value, F.avg(value).over(w), F.stddev_samp(value).over(w))


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """H2: add ``z_<column>`` over cross-sections of any size.

    Partial aggregates combine map-side and the statistics (one row per
    cross-section) join back, so no task ever holds a whole cross-section.
    """
    stats = df.groupBy(*by).agg(*[
        agg(F.col(c).cast("double")).alias(f"__{name}_{c}")
        for c in columns for name, agg in (("mean", F.avg), ("std", F.stddev_samp))
    ])
    joined = df.join(stats, list(by))
    return joined.select(*df.columns, *[
        _z(F.col(c), F.col(f"__mean_{c}"), F.col(f"__std_{c}")).alias(f"z_{c}") for c in columns
    ])


def ordered_positions(df: DataFrame, key: str, descending: bool = True, nulls: str = "last",
                      tie: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """I5/I6 as rows: the place of each row, from 1, in the order of ``order_nulls``.

    Rows are range-partitioned and sorted in that order and staged with their place in
    their partition; partitions before it add one sum each. No task holds the list.
    ``tie`` has to make the order total for places to be the same on every run.
    """
    value = F.coalesce(F.col(key), F.lit(0)) if nulls == "zero" else F.col(key)
    order = [value.desc_nulls_last() if descending else value.asc_nulls_last(), *(F.col(c).asc() for c in tie)]
    placed = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"__b": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__b").withColumn(out, F.col("__start") + F.col("__i") + 1).select(*df.columns, out)


def weighted(weights: dict[str, float], prefix: str = "z_") -> Column:
    """Weighted sum of standardised columns."""
    total = None
    for name, weight in weights.items():
        term = F.lit(float(weight)) * F.col(f"{prefix}{name}")
        total = term if total is None else total + term
    return total


def min_rank(value, by: Sequence[str]) -> Column:
    """H6: descending rank, ties share the smallest; unknown values get NULL."""
    value = steady(value)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(value.desc_nulls_last()))
    return F.when(value.isNotNull(), rank.cast("long"))


def _value_counts(df: DataFrame, value: str, by: Sequence[str], descending: bool) -> DataFrame:
    """Distinct values per key with ``__n`` equal rows and ``__before`` rows ahead.

    The counted values are range-partitioned on (key, value), so a partition is a
    run of one order whatever the values look like, and staged with its number: a
    key's rows ahead are those of its earlier partitions, one sum each, and those
    ahead in its own. Neither window grows with a key. NaN counts as unknown.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = stage(
        df.filter(known).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
        .repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("__b", F.spark_partition_id()),
        "value_counts")

    def ordered(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    per_key = Window.partitionBy(*by).orderBy(ordered("__b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
        .select(*by, "__b", F.coalesce(F.sum("__bn").over(per_key), F.lit(0)).alias("__offset"))
    )
    in_bucket = (
        Window.partitionBy(*by, "__b").orderBy(ordered(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counts.withColumn("__local", F.coalesce(F.sum("__n").over(in_bucket), F.lit(0)))
        .join(buckets, [*by, "__b"])
        .select(*by, value, "__n", (F.col("__offset") + F.col("__local")).alias("__before"))
    )


def spread_rank(df: DataFrame, value: str, by: Sequence[str], out: str = "rank") -> DataFrame:
    """H6 over keys of any size: descending rank of exact values, no key in one task.

    rank = 1 + rows with a greater value = rows in later ranges + rows with
    greater values in the own range.
    """
    ranks = _value_counts(df, value, by, descending=True).select(
        *by, value, (F.col("__before") + 1).alias(out)
    )
    return df.join(ranks, [*by, value], "left").select(*df.columns, F.col(out).cast("long").alias(out))


def exact_median(df: DataFrame, value: str, by: Sequence[str], out: str = "median") -> DataFrame:
    """Exact median per key (even counts interpolate) without gathering a key."""
    values = _value_counts(df, value, by, descending=False)
    totals = values.groupBy(*by).agg(F.sum("__n").alias("__total"))
    low, high = F.expr("(__total - 1) div 2"), F.expr("__total div 2")
    end = F.col("__before") + F.col("__n")
    covers_low = (F.col("__before") <= low) & (low < end)
    covers_high = (F.col("__before") <= high) & (high < end)
    return (
        values.join(totals, list(by))
        .filter(covers_low | covers_high)
        .groupBy(*by)
        .agg(
            ((F.max(F.when(covers_low, F.col(value))) + F.max(F.when(covers_high, F.col(value)))) / 2)
            .alias(out)
        )
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                  position: str = "pos") -> DataFrame:
    """First ``n`` rows of each key, numbered from 1.

    The filter on ``row_number`` is pushed below the shuffle, so each map task
    keeps at most ``n`` rows per key.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= n)


def top_bottom(df: DataFrame, score: str, n: int, by: Sequence[str], tie: str = "group_id") -> DataFrame:
    """Strongest and weakest ``n`` groups per snapshot; the weakest come worst first.

    The weakest list is the reversed tail of the same total order, so the two
    lists may share rows when there are fewer than ``2n``. Both positions come
    from one pass over the (bounded) groups of a snapshot; ``section`` is
    ``top`` or ``bottom`` and ``pos`` counts from 1 in it.
    """
    w = Window.partitionBy(*by)
    best = F.row_number().over(w.orderBy(steady(score).desc_nulls_last(), F.col(tie).asc()))
    worst = F.row_number().over(w.orderBy(steady(score).asc_nulls_first(), F.col(tie).desc()))
    return sections(df.withColumn("__top", best).withColumn("__bottom", worst), n)


def sections(df: DataFrame, n: int, zt: str | None = None) -> DataFrame:
    """Rows of the top and bottom lists from positions ``__top`` and ``__bottom``.

    Rows flagged by ``zt`` make a ``zt`` section of their own, uncut, instead.
    """
    special = F.lit(False) if zt is None else F.col(zt)

    def entry(name, position, wanted):
        return F.when(wanted, F.struct(F.lit(name).alias("section"), F.col(position).alias("pos")))

    lists = F.array_compact(F.array(
        entry("top", "__top", ~special & (F.col("__top") <= n)),
        entry("bottom", "__bottom", ~special & (F.col("__bottom") <= n)),
        entry("zt", "__top", special)))
    return df.withColumn("__s", F.explode(lists)).select("*", "__s.*").drop("__s", "__top", "__bottom")


def signed(column, section="section") -> Column:
    """Sort key, greatest first, that turns a figure round in bottom sections."""
    column = steady(column)
    return F.when(_col(section) == "bottom", -column).otherwise(column)


def order_nulls(df: DataFrame, key: str, descending: bool = True, nulls: str = "last",
                tie: Sequence[str] = ()) -> DataFrame:
    """Sort on a key with NULLs last, or counted as zero (``nulls='zero'``)."""
    value = F.coalesce(F.col(key), F.lit(0)) if nulls == "zero" else F.col(key)
    first = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return df.orderBy(first, *tie)
