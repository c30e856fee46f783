"""Connected components of an edge list, and of the links within inverted lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.staging import discard, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star steps: rows (node, root) for every node of the edges (a, b); root is its component's smallest node.

    Every step joins each node's smallest neighbour to its edges: the minimum is
    combined before the shuffle and the join may be split, so a hub with a large
    share of all edges is no single task's work. Steps are written to the shared
    folder, and their number grows with the logarithm of the longest chain.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "edges")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = stage(small.distinct(), "edges")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_lists(postings: DataFrame, linked: Callable[[DataFrame], DataFrame], num: int, den: int, marks: DataFrame | None = None,
               alike: Callable[[str, str], Column] | None = None, rounds: int = 3,
               finer: Callable[[DataFrame], DataFrame] | None = None, finer_pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components (node, root) of the links between nodes that share a list.

    ``postings``: rows (value, node, n), deleted once read if they are staged; a pair can only be linked if the smaller n
    is at least ``num / den`` of the larger. ``linked`` keeps the linked ones of
    pairs (a, b), and ``alike``, if given, is a cheap necessary condition for a link on two
    columns ``mark`` of ``marks`` (node, mark). ``finer`` may list the nodes (node, n) that lie in
    open lists anew, for the last round, by rows of which linked nodes share one too; ``finer_pairs`` then
    gives the pairs of these lists, and must keep all linked ones between components.

    A list is not expanded into pairs. Its members are compared with one member;
    where the links leave it in several components, with other members, chosen by
    hash, in further rounds; and in the last round all pairs of the list that still
    lie in different components, fit in size and are alike are compared. A pair inside a
    component needs no test, so no link between components is lost. A list within one
    component stays so, and only the others are read again.
    """
    found = stage(linked(_centre_pairs(postings.withColumn("root", F.col("node")), 0, num, den)), "links")
    labels = components(found)
    lists = postings
    for salt in range(1, rounds + 1):
        read, lists = lists, _open_lists(lists.select(*postings.columns), labels)
        discard(read)
        if finer and salt == rounds:
            coarse, listed = lists, stage(finer(lists.select("node", "n").distinct()), "postings")
            lists = _open_lists(listed, labels)
            discard(coarse, listed)
        if salt < rounds:
            pairs = _centre_pairs(lists, salt, num, den)
        else:
            pairs = finer_pairs(lists) if finer_pairs else _last_pairs(lists, num, den, marks, alike)
        found = stage(linked(pairs), "links")
        if not found.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
    discard(lists)
    return labels


def _fits(num: int, den: int) -> Column:
    return F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num


def _centre_pairs(lists: DataFrame, salt: int, num: int, den: int) -> DataFrame:
    """Pairs of a list's centre with its members in other components. lists: (value, node, n, root)."""
    rank = F.struct((F.xxhash64("node", "value", F.lit(salt)) if salt else F.col("node")).alias("rank"), "node", "n", "root")
    centre = stage(lists.groupBy("value").agg(F.min(rank).alias("c"), F.count("*").alias("m")).where("m > 1")
                   .select("value", F.col("c")["node"].alias("c"), F.col("c")["n"].alias("c_n"), F.col("c")["root"].alias("c_root")), "centres")
    pairs = lists.join(centre, "value").where("root <> c_root")
    return (pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"), F.col("n").alias("n_a"), F.col("c_n").alias("n_b"))
            .where(_fits(num, den)).select("a", "b").distinct())


def _open_lists(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings with their root, of lists that hold more than one component."""
    rooted = stage(postings.join(labels, "node", "left").select(*postings.columns, F.coalesce("root", "node").alias("root")), "rooted")
    split = stage(rooted.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("value"), "split-lists")
    lists = stage(rooted.join(split, "value"), "open-lists")
    discard(rooted, split)
    return lists


def _last_pairs(lists: DataFrame, num: int, den: int, marks: DataFrame | None, alike: Callable[[str, str], Column] | None) -> DataFrame:
    """All pairs of a list in different components that fit in size and, if there is a condition, are alike.

    One side leaves out the list's largest component, whose members meet the others from the other side.
    """
    parts = lists.groupBy("value", "root").agg(F.count("*").alias("m"))
    main = stage(parts.groupBy("value").agg(F.max(F.struct("m", "root"))["root"].alias("main")), "main-parts")
    marked = lists.withColumn("mark", F.lit(None)) if marks is None else lists.join(marks, "node")
    left = marked.join(main, "value").where("root <> main").select("value", F.col("node").alias("x"), F.col("n").alias("n_a"), F.col("root").alias("rx"), F.col("mark").alias("mark_x"))
    right = marked.select("value", F.col("node").alias("y"), F.col("n").alias("n_b"), F.col("root").alias("ry"), F.col("mark").alias("mark_y"))
    pairs = left.join(right, "value").where((F.col("rx") != F.col("ry")) & _fits(num, den) & (alike("mark_x", "mark_y") if alike else F.lit(True)))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
