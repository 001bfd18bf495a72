"""Connected components by contraction: joins and map-side-combined minima; nothing is collected.

Each round of a contraction is some ten jobs, whatever their size, and the driver keeps plans, tasks and compiled code
of each. So once few edges are left, one task joins them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch

#: Edges that one task joins, 16 bytes each; more are contracted first.
FEW = 200_000


def roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """parents (id, up) with up < id -> the same with up the last ancestor; chains shorten by halves each round."""
    while True:
        jump = parents.select(F.col("id").alias("jid"), F.col("up").alias("jup"))
        step = parents.join(jump, F.col("up") == F.col("jid"), "left").select("id", F.coalesce("jup", "up").alias("up"), F.col("jup").isNotNull().alias("moved"))
        new = scratch.keep(step, "jumped")
        scratch.drop(parents)
        parents = new.select("id", "up")
        parents._scratch_path = new._scratch_path
        if new.where("moved").limit(1).count() == 0:
            return parents


def _joined(batches):
    """Of all edges (a, b): (id, label) of each end."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(up.setdefault(a, a)), find(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
    ids = list(up)
    for lo in range(0, len(ids), 50_000):
        some = ids[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(map(find, some), pa.int64())], ["id", "label"])


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """edges (a long, b long), in any direction and with repeats -> (id, label), label the smallest id reachable.

    Each round hangs every node below its smallest smaller neighbour and puts the tree's root in place of each node
    of the tree, so only edges between different trees go on; at least half of the nodes that still have edges vanish.
    As soon as at most few edges are left, one task joins them. Every round is written out: joins read plain tables,
    whose hot keys AQE can split. Null ends and self-loops are ignored; ids on no proper edge are absent."""
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, labels = scratch.keep(edges.distinct(), "edges"), None
    while (n := edges.count()) > few:
        up = roots(scratch.keep(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), "parents"), scratch)
        low, high = up.select(F.col("id").alias("low"), F.col("up").alias("low_root")), up.select(F.col("id").alias("high"), F.col("up").alias("high_root"))
        ends = edges.join(high, F.col("b") == F.col("high")).join(low, F.col("a") == F.col("low"), "left").select(F.coalesce("low_root", "a").alias("a"), F.col("high_root").alias("b"))
        left = scratch.keep(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        # nodes of earlier rounds follow their root; those that first get one now come from this round
        if labels is None:
            new = up.select("id", F.col("up").alias("label"))
            own = edges.select(F.col("a").alias("id")).distinct().join(low, F.col("id") == F.col("low"), "left_anti").select("id", F.col("id").alias("label"))
            new = new.union(own)
        else:
            new = labels.join(low, F.col("label") == F.col("low"), "left").select("id", F.coalesce("low_root", "label").alias("label"))
        new = scratch.keep(new, "labels")
        scratch.drop(edges, up, *([labels] if labels is not None else []))
        edges, labels = left, new
    if n == 0 and labels is not None:
        return labels
    last = scratch.keep(edges.repartition(1).mapInArrow(_joined, "id long, label long"), "last")
    scratch.drop(edges)
    if labels is None:
        return last
    root = last.select(F.col("id").alias("low"), F.col("label").alias("low_root"))
    out = scratch.keep(labels.join(root, F.col("label") == F.col("low"), "left").select("id", F.coalesce("low_root", "label").alias("label")), "labels")
    scratch.drop(labels, last)
    return out
