"""Mix overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). The flow network has an arc into each pattern for every repetition of its
words, at a cost that rises with the repetition, arcs from a pattern to its
sources, and one from each source to the sink with the source's quota. All cost
is on the first arc of a path and no residual path leads back through it, so the
cheapest flow is found by opening the repetitions in the order of their cost and
augmenting until the quotas are full or nothing is left.

Where no document has a second source, nothing competes for the source's quota and the
cheapest flow is known: the whole of it, in passes over the one pattern. So sources, their
weights, targets and plans are tables however many there are, and only patterns of two or
more sources, with those of their sources alone, go through the network in the driver.
``MOST_PATTERNS`` bounds the patterns of two or more sources; beyond it an error is raised.

The flow gives each pattern a number of whole passes and a rest; the rest is
filled with documents in a seeded order. The cut in that order is found from
sums per bucket of the order key, twice refined, so no pattern is ever sorted in
one task. The plan is one row per pattern: it is broadcast if its counted bytes are at most
``BROADCAST_BYTES``, and otherwise joined with documents salted ``SALTS`` ways, so a
source with a third of all documents is many tasks' work either way.

Defined cases: a null text has size 0, a null source is a source of its own that
comes last; documents of size 0 are taken 0 words; an empty table gives an empty
result. Rows with equal id and text share their place in the order.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import WORD, free_name, text_or_empty, words_of
from marketpulse.operators.ranking import ordered_positions
from marketpulse.staging import stage

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
SEED = "mix"
MOST_PATTERNS = 10_000
BROADCAST_BYTES, SALTS = 8 << 20, 64
DIGITS = 3  # hexadecimal digits of the order key in a bucket, at either level


def n_words(column: str = "text") -> Column:
    return F.size(words_of(text_or_empty(column))).cast("long")


def targets(sizes: DataFrame, total: int, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Target of each source as goal / of. sizes: (source, size), a row per source; weights repeat in code point order, null last.

    ``total`` is shared by weight; a source above ``most`` times its size stops
    there and the excess is shared again by weight, until none is above. What is left
    per weight only grows, so a source that stopped once stays stopped.
    """
    share = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    placed = ordered_positions(sizes, "source", descending=False)
    wide = stage(placed.select("source", "size", share.cast("long").alias("w"), (F.col("size") * most).cast("decimal(38,0)").alias("limit")), "mix-sources")
    all_weight = wide.agg(F.sum("w")).first()[0] or 0
    left, weight = total, all_weight
    while True:
        stops = F.col("limit") * weight < F.lit(left).cast("decimal(38,0)") * F.col("w")
        gone, gone_weight = wide.where(stops).agg(F.coalesce(F.sum("limit"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if (total - int(gone), all_weight - gone_weight) == (left, weight):
            break
        left, weight = total - int(gone), all_weight - gone_weight
    shared = F.lit(left).cast("decimal(38,0)") * F.col("w")
    return wide.select("source", "size", F.when(stops, F.col("limit")).otherwise(shared).cast("decimal(38,0)").alias("goal"),
                       F.when(stops, 1).otherwise(weight).cast("long").alias("of"))


def cheapest_flow(patterns: list[tuple[tuple, int]], quotas: dict, most: int = MOST_PASSES) -> list[dict]:
    """Words each pattern sends to each of its sources. patterns: (sources, words)."""
    sent = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    of = {s: [] for s in quotas}
    for i, (sources, _) in enumerate(patterns):
        for s in sources:
            of[s].append(i)
    need = dict(quotas)
    room = [0] * len(patterns)
    for _ in range(most):  # repetitions in the order of their cost
        room = [r + words for r, (_, words) in zip(room, patterns)]
        while True:
            came: dict = {("p", i): None for i, r in enumerate(room) if r}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = queue.popleft()
                nexts = [("s", s) for s in patterns[x][0]] if kind == "p" else [("p", i) for i in of[x] if sent[i][x]]
                for y in nexts:
                    if y not in came:
                        came[y] = (kind, x)
                        if y[0] == "s" and need[y[1]]:
                            end = y
                            break
                        queue.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:]))
            amount = min([room[path[0][1]], need[end[1]], *(sent[b[1]][a[1]] for a, b in steps if a[0] == "s")])
            for a, b in steps:
                if a[0] == "p":
                    sent[a[1]][b[1]] += amount
                else:
                    sent[b[1]][a[1]] -= amount
            room[path[0][1]] -= amount
            need[end[1]] -= amount
    return sent


def _cut(sums: DataFrame, rest: DataFrame, bucket: str) -> DataFrame:
    """Per pattern the bucket in which the rest ends, and what is left for it."""
    order = Window.partitionBy("pattern").orderBy(bucket)
    before = (F.sum("size").over(order) - F.col("size")).alias("before")
    return (sums.join(rest, "pattern").select("pattern", bucket, "rest", "size", before)
            .where("before <= rest AND rest < before + size").select("pattern", bucket, (F.col("rest") - F.col("before")).alias("rest")))


def _plan(slim: DataFrame, weights, most: int) -> DataFrame:
    """Per pattern: source_size, target, passes and rest. slim: (pattern, size)."""
    found = slim.groupBy("pattern").agg(F.sum("size").alias("size")).withColumn("sources", F.from_json("pattern", "array<string>"))
    found = stage(found, "mix-patterns")
    total = found.agg(F.sum("size")).first()[0] or 0
    sizes = found.select("size", F.explode("sources").alias("source")).groupBy("source").agg(F.sum("size").alias("size"))
    alone = F.to_json(F.array("source"))  # never null, unlike a source
    goals = targets(sizes, total, weights, most).select(
        alone.alias("lead"), F.col("size").alias("source_size"), F.coalesce(F.col("goal").cast("double") / F.col("of"), F.lit(0.0)).alias("target"),
        F.when(F.col("of") > 0, F.expr("goal div of")).otherwise(0).cast("long").alias("quota"))
    goals = stage(goals, "mix-goals")
    shared = found.where(F.size("sources") > 1).limit(MOST_PATTERNS + 1).collect()
    if len(shared) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns of several sources")
    led = found.withColumn("lead", F.when(F.size("sources") > 0, F.to_json(F.slice("sources", 1, 1)))).join(goals, "lead", "left").select(
        "pattern", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("quota", F.lit(0)).alias("quota"))
    takes, some = f"least(quota, size * {most})", F.col("size") > 0
    plan = led.select("pattern", "source_size", "target", F.when(some, F.expr(f"{takes} div size")).otherwise(0).cast("long").alias("passes"),
                      F.when(some, F.expr(f"{takes} % size")).otherwise(0).cast("long").alias("rest"))
    return stage(_with_flow(plan, found, goals, shared, most) if shared else plan, "mix-plan")


def _with_flow(plan: DataFrame, found: DataFrame, goals: DataFrame, shared: list, most: int) -> DataFrame:
    """``plan`` with the flow's passes and rests for patterns of several sources and of their sources alone."""
    spark = plan.sparkSession
    sources = {s for r in shared for s in r["sources"]}
    leads = spark.createDataFrame([(json.dumps([s], ensure_ascii=False, separators=(",", ":")),) for s in sources], "lead string")
    alone = found.join(leads.select(F.to_json(F.from_json("lead", "array<string>")).alias("pattern")), "pattern").select(*found.columns).collect()
    quotas = {r["source"]: r["quota"] for r in goals.withColumn("source", F.from_json("lead", "array<string>")[0])
              .join(leads.select(F.to_json(F.from_json("lead", "array<string>")).alias("lead")), "lead").collect()}
    rows = sorted([*shared, *alone], key=lambda r: r["pattern"])
    flow = cheapest_flow([(tuple(r["sources"]), r["size"]) for r in rows], quotas, most)
    taken = [sum(sent.values()) for sent in flow]
    flowed = spark.createDataFrame([(r["pattern"], t // max(1, r["size"]), t % max(1, r["size"])) for r, t in zip(rows, taken)],
                                   "pattern string, flow_passes long, flow_rest long")
    return plan.join(flowed, "pattern", "left").select("pattern", "source_size", "target", F.coalesce("flow_passes", "passes").alias("passes"),
                                                       F.coalesce("flow_rest", "rest").alias("rest"))


def mixing_plan(docs: DataFrame, sources: Column, weights=WEIGHTS, most: int = MOST_PASSES, seed: str = SEED,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per pattern: passes, the last order key of the rest, and its first source's size and target.

    ``sources``: array of the sources that a document belongs to.
    """
    slim = stage(docs.select(pattern_of(sources).alias("pattern"), n_words(text_col).alias("size"),
                             order_key(seed, id_col, text_col).alias("key")), "mix-sizes")
    plan = _plan(slim, weights, most)
    first = _cut(slim.groupBy("pattern", F.substring("key", 1, DIGITS).alias("b1")).agg(F.sum("size").alias("size")),
                 plan.where("rest > 0").select("pattern", "rest"), "b1")
    first = stage(first, "mix-cut")
    inside = slim.withColumn("b1", F.substring("key", 1, DIGITS)).join(first.drop("rest"), ["pattern", "b1"])
    second = stage(_cut(inside.groupBy("pattern", F.substring("key", DIGITS + 1, DIGITS).alias("b2")).agg(F.sum("size").alias("size")),
                        first.select("pattern", "rest"), "b2"), "mix-cut")
    last = inside.withColumn("b2", F.substring("key", DIGITS + 1, DIGITS)).join(second, ["pattern", "b2"])
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ends = (last.withColumn("before", before).where("2 * before + size <= 2 * rest")
            .groupBy("pattern").agg(F.max("key").alias("end")))
    lead = first.join(second.drop("rest"), "pattern", "left").select("pattern", F.concat("b1", F.coalesce("b2", F.lit(""))).alias("lead"))
    # a key equal to the lead sorts before every key of the last bucket, so the lead alone ends the rest before that bucket
    return (plan.join(lead, "pattern", "left").join(ends, "pattern", "left")
            .select("pattern", "source_size", "target", "passes", F.coalesce("end", "lead", F.lit("")).alias("end")))


def pattern_of(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def order_key(seed: str, id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_or_empty(text_col)))


def mixed(docs: DataFrame, sources: Column, weights=WEIGHTS, most: int = MOST_PASSES, seed: str = SEED,
          id_col: str = "doc_id", text_col: str = "text", extra: tuple = ("source_size", "target")) -> DataFrame:
    """``docs`` with size, copies (how often it is taken) and the columns ``extra`` of its plan row."""
    plan = stage(mixing_plan(docs, sources, weights, most, seed, id_col, text_col), "mix-ends")
    names = {c: free_name(docs, c) for c in ("pattern", "size", "key", "copies", "passes", "end", "salt", *extra)}
    plan = plan.select(F.col("pattern").alias(names["pattern"]), F.col("passes").alias(names["passes"]), F.col("end").alias(names["end"]),
                       *(F.col(c).alias(names[c]) for c in extra))
    keyed = docs.withColumns({names["pattern"]: pattern_of(sources), names["size"]: n_words(text_col), names["key"]: order_key(seed, id_col, text_col)})
    part = (F.col(names["key"]) <= F.col(names["end"])).cast("long")
    copies = F.when(~text_or_empty(text_col).rlike(WORD), F.lit(0).cast("long")).otherwise(F.least(F.lit(most).cast("long"), F.col(names["passes"]) + part))
    by = [names["pattern"]]
    if (plan.agg(F.sum(F.octet_length(by[0]) + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        plan = F.broadcast(plan)
    else:
        by.append(names["salt"])
        keyed = keyed.withColumn(names["salt"], F.pmod(F.xxhash64(names["key"]), F.lit(SALTS)).cast("int"))
        plan = plan.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(plan, by).select(
        *docs.columns, names["size"], copies.alias(names["copies"]), *(names[c] for c in extra))


def mix(docs: DataFrame, sources: Column, **how) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    copies = free_name(docs, "copies")
    return (mixed(docs, sources, extra=(), **how).where(F.col(copies) > 0)
            .select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(copies)).select(*docs.columns))
