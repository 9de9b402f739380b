"""Connected components of a graph whose nodes are numbers: by alternating star contraction, or in one task if edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

#: Each round shortens paths by half at least; this many rounds cover any graph of numbered nodes.
MAX_ROUNDS = 80
#: Up to so many distinct edges are joined in one task, which holds 16 bytes of each and a few copies. A round of stars runs 6 jobs over all partitions, however few edges there are.
FEW_EDGES = 200_000


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step. edges: distinct (u, v), u > v.

    The large star links each node's larger neighbours to the least node around it, the small star its smaller ones
    (and itself). A node may have any number of neighbours: only the least is gathered, and the step back to the
    neighbours deals a node over several tasks.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        around = both.where("v > u")
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        around = edges
    least = common.cut_lineage(least)
    pairs = common.salted_join(around, least, ["u"], ["v"], "n", sizes=least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (u, v) is the u of one edge, or the v of any number."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")
    counts = edges.select(ends).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up + down > 1").isEmpty()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u[i], v[i]), sorted, and of each the least that can be reached."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, to = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while len(a):
        # of the trees that still touch others all but the least around them are hung on another, so half are left at most
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to != (up := to[to])).any():
            to = up
        a, b = to[a], to[b]
        a, b = a[apart := a != b], b[apart]
    return nodes, nodes[to]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.array(x.column(0)), np.array(x.column(1))) for x in batches if x.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*map(np.concatenate, zip(*parts)))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, component) for each node of edges (a, b); component: the least node that can be reached.

    Loops, repeated and reversed edges change nothing; rows with a null are left out. No edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = common.cut_lineage(now)
    if now.count() <= few_edges:
        return _at_once(now.select("u", "v"))
    rounds = 0
    while not _are_stars(now):
        if rounds == max_rounds:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
        now, rounds = common.cut_lineage(_towards_least(_towards_least(now, True), False)), rounds + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
