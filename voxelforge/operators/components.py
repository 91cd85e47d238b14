"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

A graph whose counted links fit one task is solved there by hooking and pointer
jumping; the steps are for all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialize

MAX_ROUNDS = 40
#: Links of a graph that one task solves: 16 MB of them.
ONE_TASK_LINKS = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links (u, v) the least node of each one's component."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        ends = np.concatenate([*(p[0] for p in parts), *(p[1] for p in parts)])
        nodes, at = np.unique(ends, return_inverse=True)
        half = len(at) // 2
        root = least_reachable(at[:half], at[half:], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its partners; partners are pre-aggregated before the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _links(df: DataFrame) -> DataFrame:
    return df.where("u != v").distinct()


def connected_components(edges: DataFrame, *, one_task: int = 0) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the least node of its component.

    Links stay in tables of the shared folder; the driver sees two numbers a
    round. At most ``one_task`` links are solved by one task.
    """
    now = materialize(_links(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))), "links")
    if one_task and now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_solve, "node long, label long")
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _links(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars = _least(down)
        now = materialize(_links(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))), "links")
        was, state = state, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == was:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def ordered_ids(df: DataFrame, order: list, name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in the order given, without a single-task window.

    Rows are range-partitioned and written once; counts of the parts are added
    up over a table with a row for each part.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = cut.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    number = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before") + start
    return cut.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(name, number).drop("__part", "__p", "__before")


def numbered_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): components numbered from 1 in the order of their least nodes; nodes without links are their own."""
    return number_roots(nodes.select("node", F.col("node").alias("root")), edges)


def number_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of nodes that are grouped by ``root`` already, linked by ``edges`` between roots; as numbered_components."""
    labels = connected_components(edges, one_task=ONE_TASK_LINKS).select(F.col("node").alias("root"), F.col("label").alias("top"))
    roots = materialize(nodes.join(labels, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    numbers = ordered_ids(roots.select("root").distinct(), ["root"], "label", 1)
    return roots.join(numbers, "root").select("node", F.col("label").cast("long"))
