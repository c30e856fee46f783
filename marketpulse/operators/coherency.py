"""Mean pairwise correlation of a group's members.

Correlations are pairwise complete: each pair uses the sessions both members
traded. No pair is ever emitted as a row:

* Members that traded every session of the group share one set of sessions, so
  the sum over all their pairs follows from the sum of their unit vectors:
  sum_{i<j} z_i.z_j = (|sum z_i|^2 - m) / 2. That is one combining aggregate.
* Pairs with a gap on either side need the common sessions of that very pair.
  Members are hashed into blocks, as large as a task can hold (``ROWS`` members,
  ``CELLS`` sessions of members), so that a series is copied as seldom as possible;
  a task gets two blocks and reduces all their correlations to one sum and one
  count with matrix products, tile by tile. The work grows with the pairs, the
  memory of a task does not, and a huge group becomes many bounded tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import measures as M
from marketpulse.staging import stage

ROWS, CELLS = 8192, 1 << 23  # members of a block, and places of its matrix (members times sessions)
TILE = 128  # members whose correlations with as many others are held at once: matrices that stay in a core's cache
FLAT = 1e-12  # variance of a pair's common sessions below this share counts as none


def _shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _series(bars: DataFrame) -> DataFrame:
    """One row per code: sorted session numbers and changes (bounded by the calendar).

    Bars are dealt out anew: a task that made them too, from as many rows as adaptive
    execution gathers, would hold its sort and both aggregates at once. Twice the shuffle
    partitions, as Spark drops an exchange equal to the one that made the bars.
    """
    known = bars.filter(F.col("change_ratio").isNotNull()).select(
        "code", F.datediff("trade_date", F.lit("1970-01-01")).alias("day"), "change_ratio")
    clean = known.repartition(2 * _shuffle_tasks(bars), "code").groupBy("code", "day").agg(F.avg("change_ratio").alias("v"))
    ordered = clean.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s"))
    return ordered.select("code", F.col("s.day").alias("days"), F.col("s.v").alias("vals"))


def _with_group_shape(series: DataFrame, members: DataFrame) -> DataFrame:
    """Member series with ``complete`` and the block counts of their group.

    The flags per membership are staged without the series, which join again.
    """
    joined = series.join(members.select("group_id", "code").distinct(), "code")
    sessions = (
        joined.select("group_id", F.explode("days").alias("day")).distinct()
        .groupBy("group_id").agg(F.count(F.lit(1)).alias("n_days"))
    )
    flags = stage(
        joined.select("group_id", "code", F.size("days").alias("n")).join(sessions, "group_id")
        .select("group_id", "code", (F.col("n") == F.col("n_days")).alias("complete"), "n_days"),
        "coherency_flags")
    shape = flags.groupBy("group_id").agg(
        F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_gapped"), F.max("n_days").alias("n_days"))
    return flags.drop("n_days").join(shape, "group_id").join(series, "code")


def _complete_pairs(shaped: DataFrame) -> DataFrame:
    """Correlation sum and pair count among complete members, in linear work."""
    varying = shaped.filter(F.col("complete") & (F.array_min("vals") < F.array_max("vals")))
    size = F.size("vals")
    mean = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v) / size
    centred = varying.withColumn("__m", mean).select(
        "group_id", F.transform("vals", lambda v: v - F.col("__m")).alias("c"))
    unit = centred.withColumn("__n", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v))).select(
        "group_id", F.posexplode(F.transform("c", lambda v: v / F.col("__n"))).alias("pos", "z"))
    summed = unit.groupBy("group_id", "pos").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("m"))
    m = F.max("m")
    return summed.groupBy("group_id").agg(
        ((F.sum(F.col("s") * F.col("s")) - m) / 2).alias("corr_sum"), (m * (m - 1) / 2).alias("pairs"))


def _dense(block: pa.Table, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row per member: its changes less their mean, and marks of the sessions it traded."""
    days, vals = (block.column(c).combine_chunks() for c in ("days", "vals"))
    lengths = pc.list_value_length(days).to_numpy()
    row, v = np.repeat(np.arange(len(lengths)), lengths), vals.flatten().to_numpy()
    at = np.searchsorted(axis, days.flatten().to_numpy())
    x = np.zeros((len(lengths), len(axis)))
    mask = np.zeros_like(x)
    x[row, at] = v - (np.bincount(row, v, len(lengths)) / lengths)[row]
    mask[row, at] = 1.0
    return x, mask


def _tile_sums(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray, same: bool) -> tuple[float, int]:
    """Sum and count of the defined correlations; ``same`` members are paired once. Moments are times the sessions."""
    n, sx, sy = mx @ my.T, x @ my.T, mx @ y.T
    sxx, syy, cov = (x * x) @ my.T, mx @ (y * y).T, x @ y.T
    for m in (sxx, syy, cov):
        m *= n
    vx, vy = sxx - sx * sx, syy - sy * sy
    ok = (n >= 2) & (vx > FLAT * sxx) & (vy > FLAT * syy)
    if same:
        ok = np.triu(ok, k=1)
    cov -= sx * sy
    vx *= vy
    with np.errstate(invalid="ignore", divide="ignore"):
        cov /= np.sqrt(vx, out=vx)
    np.clip(cov, -1.0, 1.0, out=cov)
    return float(cov.sum(where=ok)), int(np.count_nonzero(ok))


def _block_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Sum and count of the defined correlations between two blocks."""
    group_id, left_id, right_id = (k.as_py() for k in key)
    axis = np.unique(np.concatenate([c.flatten().to_numpy() for c in table.column("days").chunks]))
    x, mx = _dense(table.filter(pc.equal(table.column("block"), left_id)), axis)
    y, my = (x, mx) if left_id == right_id else _dense(table.filter(pc.equal(table.column("block"), right_id)), axis)
    total, pairs = 0.0, 0
    for i in range(0, len(x), TILE):
        for j in range(i if left_id == right_id else 0, len(y), TILE):
            found = _tile_sums(x[i:i + TILE], mx[i:i + TILE], y[j:j + TILE], my[j:j + TILE], left_id == right_id and i == j)
            total, pairs = total + found[0], pairs + found[1]
    return pa.table({"group_id": [group_id], "corr_sum": [total], "pairs": [float(pairs)]})


def _block_copies(shaped: DataFrame, block: int) -> DataFrame:
    """The series of groups with a gapped member, once for each pair of blocks that needs it.

    Gapped blocks are numbered 0..g-1 and complete blocks g..g+c-1; every pair
    of blocks with a gapped one is a task, unordered pairs once.
    """
    size = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("n_days"))))

    def blocks(n):
        return F.ceil(F.col(n) / size).cast("int")

    hashed = F.xxhash64("code")
    sized = shaped.filter(F.col("n_gapped") > 0).select(
        "group_id", "code", "days", "vals", "complete",
        blocks("n_gapped").alias("g"), F.greatest(blocks("n_complete"), F.lit(0)).alias("c"))
    placed = sized.withColumn(
        "block",
        F.when(F.col("complete"), F.col("g") + F.pmod(hashed, F.greatest("c", F.lit(1))).cast("int"))
        .otherwise(F.pmod(hashed, F.col("g")).cast("int")))
    partners = F.when(F.col("complete"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("g") + F.col("c") - 1))
    return placed.withColumn("other", F.explode(partners)).select(
        "group_id", F.least("block", "other").alias("left_id"), F.greatest("block", "other").alias("right_id"),
        "block", "days", "vals")


def _gapped_pairs(shaped: DataFrame, block: int) -> DataFrame:
    """Correlation sum and pair count of pairs with at least one gapped member.

    Pairs of blocks are few bytes and much work, so they are dealt over all shuffle
    partitions instead of gathered by their size.
    """
    key = ["group_id", "left_id", "right_id"]
    return _block_copies(shaped, block).repartition(_shuffle_tasks(shaped), *key).groupBy(*key).applyInArrow(
        _block_sums, "group_id string, corr_sum double, pairs double")


def coherency(bars: DataFrame, members: DataFrame, digits: int | None = 4, block: int = ROWS) -> DataFrame:
    """Mean pairwise correlation of daily changes per group.

    Repeated bars of a day are averaged first; undefined pairs are left out;
    groups without a defined pair get 0.
    """
    shaped = _with_group_shape(stage(_series(bars), "coherency_series"), members)
    sums = _complete_pairs(shaped).unionByName(_gapped_pairs(shaped, block)).groupBy("group_id").agg(
        F.sum("corr_sum").alias("corr_sum"), F.sum("pairs").alias("pairs"))
    mean = F.when(F.col("pairs") > 0, F.col("corr_sum") / F.col("pairs"))
    return members.select("group_id").distinct().join(sums, "group_id", "left").select(
        "group_id", F.coalesce(M.rounded(mean, digits), F.lit(0.0)).alias("coherency"),
        F.coalesce("pairs", F.lit(0.0)).cast("long").alias("pairs"))
