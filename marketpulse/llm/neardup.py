"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, hashed to 64 bits; documents
with equal sets are one node. Two nodes are linked when their Jaccard similarity
is ``NUM / DEN`` or more, confirmed on the full sets.

Candidates come from inverted lists of the ``K`` smallest hashes. Linked sets share
at least ``_overlap`` of them (exactly so for sets that fit the sketch; else the
smallest K of the union hold 72 shared ones on average with a deviation of 4.2,
and 45 are asked for). So it is enough to list a node under its rarest retained values,
all but the last ``overlap - 1`` of those that other nodes retain too, and a
passage that many documents share lists only documents that are little else.

Lists are compared by ``components.link_lists``, which loses no link. Before its last
round, in which the pairs of a list are compared, nodes that are still in lists with
several components are listed anew, by the rarest hashes of their full sets: linked
sets share three quarters of the larger one, so all but the last of these are left
out, and sets that share half or two thirds of their text no longer meet. A pair is
taken only where the values that both sides have left in the lists' order can still add up to
what linked sets of their sizes share, so sets that changed in different places are no pairs.
What is compared is first estimated from the smallest K of the union of two sketches. Hashes
are stored with their top bit flipped, so that signed longs have the order of the
unsigned hashes.

Node numbers are 64 bits of a digest of the set: among 10 ** 9 different sets 0.03
false unions are expected.

Defined cases: null texts count as empty; a text without words has an empty set,
is linked with nothing and stays; with fewer than five words the whole sequence is
the shingle; component ids are the smallest document id reachable (null ids count
only where a component has no other); repeated rows share a component, and
``near_dedup`` lets one of them through; an empty table gives an empty result;
other columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import byte_slices, free_name, text_or_empty
from marketpulse.llm.components import link_lists
from marketpulse.llm.shingles import shingle_sets
from marketpulse.staging import stage

SIZE, NUM, DEN = 5, 75, 100
K, SHARED = 96, 45


def _node(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = (np.concatenate(rows).astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def document_sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """Per row: id, print (a hash of the text), node, n (size of its set) and its K smallest hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                sets = list(shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("print"), pa.array([_node(s) for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), _arrays([s[:K] for s in sets])], ["id", "print", "node", "n", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("print"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, print long, node long, n long, sketch array<long>")


def _shared(union: Column, k: int = K) -> Column:
    """Shared values among the k smallest of a union of this size, of sets that are linked, at the least.

    Three in four of the union up to k. Beyond, three in four of k on average, less 6.4
    times the deviation of a draw without replacement.
    """
    share = NUM / DEN
    drawn = k * share - 6.4 * (k * share * (1 - share)) ** 0.5 * F.sqrt(F.greatest(F.lit(0.0), 1 - k / union))
    return F.when(union <= k, union * share).otherwise(drawn)


def _overlap(n: Column) -> Column:
    """Retained values that a set of this size shares with any set it is linked to; their union has up to n / 0.75."""
    return F.least(F.ceil(n * NUM / DEN), F.floor(_shared(F.greatest(n * DEN / NUM, F.lit(K + 1.0))))).cast("int")


def _postings(nodes: DataFrame) -> DataFrame:
    """Rows (value, node, n): each node under the rarest of its shared retained values."""
    each = nodes.select("node", "n", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    rare = (each.join(shared, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("values"))
            .withColumn("listed", F.size("values") - _overlap(F.col("n")) + 1).where("listed > 0"))
    return rare.select("node", "n", F.explode(F.slice("values", 1, F.col("listed"))["value"]).alias("value"))


def _full_postings(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (value, node, n, left, short) of the nodes (node, n): each under the rarest values of its full set, all but those that a linked set must share beyond one.

    Values have one order for all nodes, and ``left`` are the shared ones of this node that come after. ``short`` marks
    values that do for linked sets of at least this size, which share six in seven of this one.
    """
    each = nodes.join(sets, "node").select("node", "n", F.explode("values").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    rare = (each.join(shared, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("values"))
            .withColumn("shared", F.size("values")).withColumn("listed", F.col("shared") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1).where("listed > 0"))
    placed = rare.select("node", "n", "shared", F.posexplode(F.slice("values", 1, F.col("listed"))["value"]).alias("place", "value"))
    left = F.col("shared") - F.col("place") - 1
    return placed.select("value", "node", "n", left.alias("left"), ((left + 1) * (NUM + DEN) >= F.col("n") * (2 * NUM)).alias("short"))


def _full_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that may be linked, of lists (value, node, n, left, short, root).

    Linked sets share NUM / (NUM + DEN) of their sizes' sum, and no more than one value and what is left after it on
    either side where they meet first. A larger set needs a smaller one's short values only.
    """
    x, y = ([F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("left").alias(f"left_{s}"), F.col("root").alias(f"root_{s}"), "value"] for s in "xy")
    enough = (F.least("left_x", "left_y") + 1) * (NUM + DEN) >= (F.col("n_x") + F.col("n_y")) * NUM
    larger = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") > F.col("node_y")))
    pairs = lists.select(*x).join(lists.where("short").select(*y), "value").where((F.col("root_x") != F.col("root_y")) & larger & enough)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _alike(a: str, b: str) -> Column:
    """Sets share as many of their K smallest values as linked sets of these sizes."""
    union = (F.col("n_a") + F.col("n_b")) / (1 + NUM / DEN)  # the largest of linked sets of these sizes
    return F.size(F.array_intersect(a, b)) >= _shared(union, K) - 1.01


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = ([F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}")] for x in "ab")
    near = pairs.join(nodes.select(*two), "b").join(nodes.select(*one), "a")
    smallest = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
    both = F.array_intersect(smallest, F.array_intersect("sketch_a", "sketch_b"))
    near = stage(near.where(_alike("sketch_a", "sketch_b") & (F.size(both) >= F.least(F.lit(SHARED), F.floor(F.size(smallest) * NUM / DEN)))).select("a", "b"), "near-pairs")
    one, two = ([F.col("node").alias(x), F.col("values").alias(f"values_{x}")] for x in "ab")
    inter = F.size(F.array_intersect("values_a", "values_b"))
    full = near.join(sets.select(*two), "b").join(sets.select(*one), "a")
    return full.where(inter * DEN >= (F.size("values_a") + F.size("values_b") - inter) * NUM).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per row: id, print (hash of its text), n_shingles, component_id and kept."""
    rows = stage(document_sketches(docs, id_col, text_col, size), "sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print"))
    some = stage(rows.where("n > 0").groupBy("node").agg(best.alias("best"), F.min("n").alias("n")), "nodes")
    nodes = stage(some.join(rows.where("n > 0").select("node", "id", "print", "sketch"), "node")
                  .where(F.col("best")["id"].eqNullSafe(F.col("id")) & (F.col("best")["print"] == F.col("print")))
                  .dropDuplicates(["node"]).select("node", "n", "sketch", "id", "print"), "nodes")
    postings = stage(_postings(nodes), "postings")
    sets = stage(_full_sets(docs, nodes.join(postings.select("node").distinct(), "node"), id_col, text_col, size), "sets")
    labels = link_lists(postings, lambda pairs: _linked(pairs, nodes, sets), NUM, DEN, finer=lambda open_: _full_postings(open_, sets), finer_pairs=_full_pairs)
    labels = stage(some.select("node", F.col("best")["id"].alias("first"), F.col("best")["no_id"].alias("no_id")).join(labels, "node", "left")
                   .select("node", "first", "no_id", F.coalesce("root", "node").alias("root")), "labels")
    firsts = stage(labels.groupBy("root").agg(F.min(F.struct("no_id", "first"))["first"].alias("component_id")), "firsts")
    known = stage(labels.join(firsts, "root").select("node", "component_id"), "labels")
    out = rows.select("id", "print", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(known, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "print", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (node, values) of the nodes in ``wanted``, from the text of one document each."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("print"), F.col(text_col).alias("text"))
    wanted = wanted.select("node", F.col("id").alias("w_id"), F.col("print").alias("w_print"))
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("print") == F.col("w_print"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                sets = list(shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], size))
                yield pa.RecordBatch.from_arrays([batch.column("node"), _arrays(sets)], ["node", "values"])

    return texts.mapInArrow(run, "node long, values array<long>").dropDuplicates(["node"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    groups = near_groups(docs, id_col, text_col)
    n, first = F.count("*").alias("rows"), F.max("kept").alias("stays")
    odd = stage(groups.groupBy(id_col, "print").agg(n, first).where("rows > 1 OR NOT stays"), "verdicts")
    shown, rows, stays, place, d_id, d_print = (free_name(docs, c) for c in ("print", "rows", "stays", "place", "verdict_id", "verdict_print"))
    odd = odd.select(F.col(id_col).alias(d_id), F.col("print").alias(d_print), F.col("rows").alias(rows), F.col("stays").alias(stays))
    keyed = docs.withColumn(shown, F.xxhash64(text_or_empty(text_col)))
    met = keyed.join(odd, F.col(id_col).eqNullSafe(F.col(d_id)) & (F.col(shown) == F.col(d_print)), "left").where(F.coalesce(stays, F.lit(True)))
    once = met.where(F.col(rows).isNull() | (F.col(rows) == 1)).select(*docs.columns)
    order = Window.partitionBy(id_col, shown).orderBy(text_col)
    again = met.where(F.col(rows) > 1).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
    return once.union(again)
