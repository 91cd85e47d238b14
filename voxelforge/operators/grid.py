"""Voxel-grid stencils and morphology on sparse tables.

A stencil scatters each voxel to the cells it counts for and aggregates there;
the partial aggregate runs before the only shuffle. Masks are tables of the
voxels that are set: (flat, i, j, k).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import flat_index, in_grid, unflatten
from ..schema import Grid
from ..tables import materialize, new_path
from .components import least_reachable, number_roots, ordered_ids

# Fixed value: the order in which the six neighbours are visited
SIX = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
#: Levels that a task spreads labels on its own, and the side of its block of cells, at least.
REACH = 32
#: Cells of a widened block that a task spreads labels in.
BLOCK_CELLS = 1 << 22
CUBE = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def offsets(shifts) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, (a, b, c) in enumerate(shifts)])).alias("o")


def scatter(cells: DataFrame, grid: Grid, shifts, carry: list[str] | None = None) -> DataFrame:
    """(flat, i, j, k, n, carry...): each cell copied to its in-grid neighbours; n is the number of the shift."""
    carry = carry or []
    moved = cells.select("i", "j", "k", *carry, offsets(shifts))
    moved = moved.select((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k"), F.col("o.n").alias("n"), *carry)
    moved = moved.where(in_grid(F.col("i"), F.col("j"), F.col("k"), grid.dims))
    return moved.select(flat_index(F.col("i"), F.col("j"), F.col("k"), grid.dims).alias("flat"), "i", "j", "k", "n", *carry)


def with_ijk(cells: DataFrame, grid: Grid) -> DataFrame:
    i, j, k = unflatten(F.col("flat"), grid.dims)
    rest = [c for c in cells.columns if c not in ("flat", "i", "j", "k")]
    return cells.select("flat", i.alias("i"), j.alias("j"), k.alias("k"), *rest)


def all_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    return with_ijk(spark.range(grid.size).select(F.col("id").alias("flat")), grid)


def mean_filter(field: DataFrame, grid: Grid, iterations: int = 1) -> DataFrame:
    """Sum over the 3x3x3 neighbourhood inside the grid over 27, ``iterations`` times."""
    for n in range(iterations):
        sums = scatter(field, grid, CUBE, ["value"]).groupBy("flat").agg((F.sum("value") / 27).alias("value"))
        field = with_ijk(sums, grid)
        if n + 1 < iterations:
            field = materialize(field, "smoothed")
    return field.select("flat", "i", "j", "k", "value")


def erode(mask: DataFrame, grid: Grid, iterations: int = 1) -> DataFrame:
    """Voxels that are set with all six neighbours; none on the border of the grid."""
    for n in range(iterations):
        full = scatter(mask, grid, [(0, 0, 0), *SIX]).groupBy("flat").agg(F.count("*").alias("c")).where("c = 7")
        mask = with_ijk(full.select("flat"), grid)
        if n + 1 < iterations:
            mask = materialize(mask, "eroded")
    return mask.select("flat", "i", "j", "k")


def dilate(mask: DataFrame, grid: Grid, iterations: int = 1) -> DataFrame:
    """Voxels that are set or next to one that is."""
    for n in range(iterations):
        mask = with_ijk(scatter(mask, grid, [(0, 0, 0), *SIX]).select("flat").distinct(), grid)
        if n + 1 < iterations:
            mask = materialize(mask, "dilated")
    return mask.select("flat", "i", "j", "k")


def majority(mask: DataFrame, grid: Grid) -> DataFrame:
    """Voxels with more than 13 of the 27 around them (themselves included) set."""
    return with_ijk(scatter(mask, grid, CUBE).groupBy("flat").agg(F.count("*").alias("c")).where("c > 13").select("flat"), grid)


def negate(mask: DataFrame, grid: Grid) -> DataFrame:
    return all_cells(mask.sparkSession, grid).join(mask.select("flat"), "flat", "left_anti")


def above(field: DataFrame, iso: float) -> DataFrame:
    return field.where(F.col("value") > F.lit(float(iso))).select("flat", "i", "j", "k")


def components(mask: DataFrame, grid: Grid, *, side: int = 2 * REACH) -> DataFrame:
    """(flat, label): 6-connected components numbered from 1 by their lowest flat index.

    Each cube of ``side`` cells is solved by a task; what is left to link are the
    pieces that touch across the faces of cubes.
    """
    pieces = blocks_around(mask.select("flat", "i", "j", "k"), grid, side, 0).groupBy("block").applyInPandas(_pieces(side), "flat long, root long, faces int")
    pieces = materialize(pieces, "pieces")
    rim = with_ijk(pieces.where("faces > 0").select("flat", "root"), grid).withColumn("u", F.col("root"))
    across = scatter(rim, grid, [(1, 0, 0), (0, 1, 0), (0, 0, 1)], ["u"]).select("u", "flat")
    edges = across.join(pieces.where("faces > 0").select("flat", F.col("root").alias("v")), "flat").where("u != v").select("u", "v").distinct()
    return number_roots(pieces.select(F.col("flat").alias("node"), "root"), edges).select(F.col("node").alias("flat"), "label")


def _pieces(side: int):
    """Components within a block: the least flat of each voxel's, and whether the voxel lies at a face of the block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("flat").sort_values("flat", ignore_index=True)
        at, (cells, *_), strides = _box(rows)
        row_of = np.full(cells, -1, np.int64)
        row_of[at] = np.arange(len(at))
        mates = np.concatenate([row_of[at + t] for t in strides])
        own = np.tile(np.arange(len(at)), 3)
        root = least_reachable(own[mates >= 0], mates[mates >= 0], len(at))
        flat = rows["flat"].to_numpy()
        edge = np.any([(rows[c].to_numpy() % side == 0) | (rows[c].to_numpy() % side == side - 1) for c in "ijk"], 0)
        return pd.DataFrame({"flat": flat, "root": flat[root], "faces": edge.astype(np.int32)})

    return run


def component_sizes(labels: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(label, count); with a grid also label 0, the background."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("count"))
    if grid is None:
        return sizes
    return sizes.unionByName(labels.agg((F.lit(grid.size) - F.count("*")).alias("count")).select(F.lit(0).cast("long").alias("label"), "count"))


def drop_small(mask: DataFrame, grid: Grid, smallest: int) -> DataFrame:
    """Components of at least ``smallest`` voxels."""
    if smallest <= 1:
        return mask
    labels = materialize(components(mask, grid), "labels")
    large = component_sizes(labels).where(F.col("count") >= smallest).select("label")
    return with_ijk(labels.join(large, "label", "left_semi").select("flat"), grid)


def keep_largest(mask: DataFrame, grid: Grid) -> DataFrame:
    """The component with the most voxels; of equal ones the first."""
    labels = materialize(components(mask, grid), "labels")
    top = component_sizes(labels).orderBy(F.desc("count"), "label").limit(1).select("label")
    return with_ijk(labels.join(F.broadcast(top), "label", "left_semi").select("flat"), grid)


def blocks_around(cells: DataFrame, grid: Grid, side: int, halo: int) -> DataFrame:
    """Rows (i, j, k, ...) copied to every block whose cube of ``side`` cells, widened by ``halo``, holds them; ``block`` numbers it."""
    block = F.lit(0).cast("long")
    for c, n in zip("ijk", grid.dims, strict=True):
        last = (n - 1) // side
        low, high = (F.floor((F.col(c) + d) / side) for d in (-halo, halo))
        near = F.sequence(F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(last), high).cast("int"))
        cells = cells.withColumn(f"__b{c}", F.explode(near) if halo else F.floor(F.col(c) / side).cast("int"))
        block = block * (last + 1) + F.col(f"__b{c}")
    return cells.withColumn("block", block).drop(*[f"__b{c}" for c in "ijk"])


def _box(rows: pd.DataFrame) -> tuple[np.ndarray, list[int], list[int]]:
    """Place of each row in its bounding box, which is a cell wider on every side; the box's least cell and its strides."""
    low = [int(rows[c].min()) - 1 for c in "ijk"]
    size = [int(rows[c].max()) + 2 - m for c, m in zip("ijk", low, strict=True)]
    strides = [size[1] * size[2], size[2], 1]
    return sum((rows[c].to_numpy(np.int64) - m) * t for c, m, t in zip("ijk", low, strides, strict=True)), [size[0] * strides[0], *low], strides


def _spread(dims: tuple[int, int, int], side: int, base: int):
    """Breadth-first spreading of ``side`` levels within a widened block, a level at a time as NumPy gathers.

    ``cur`` holds the last level in queue order; the first visit of a cell in
    the order of (queue, SIX) decides its place in the next level. Ways are
    traced back from the last level only.
    """
    per_axis = [(n - 1) // side + 1 for n in dims]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, (cells, *_), strides = _box(rows)
        rank, flat = rows["rank"].to_numpy(), rows["flat"].to_numpy()
        block = int(rows["block"].iloc[0])
        home = (block // (per_axis[1] * per_axis[2]), block // per_axis[2] % per_axis[1], block % per_axis[2])
        core = np.all([rows[c].to_numpy() // side == h for c, h in zip("ijk", home, strict=True)], 0)
        row_of = np.full(cells, -1, np.int32)
        row_of[at[rank < 0]] = np.flatnonzero(rank < 0)
        start = np.flatnonzero(rank >= 0)
        start = start[np.argsort(rank[start], kind="stable")]
        cur, root, label = at[start], rank[start], rows["label"].to_numpy()[start]
        steps = np.array([sum(d * t for d, t in zip(s, strides, strict=True)) for s in SIX])
        levels, own_rows, own_labels, own_roots, parents, turns, own = [], [], [], [], [], [], np.zeros(0, np.int64)
        for level in range(base + 1, base + side + 1):
            visits = (cur[:, None] + steps).ravel()
            visits = np.where(row_of[visits] >= 0, visits, -1)
            found, first = np.unique(visits, return_index=True)
            first = np.sort(first[found >= 0])
            if not len(first):
                break
            cur, parent = visits[first], first // len(steps)
            root, label = root[parent], label[parent]
            parents.append(parent.astype(np.int32))
            turns.append((first % len(steps)).astype(np.uint8))
            row, row_of[cur] = row_of[cur], -1
            own = np.flatnonzero(core[row])
            levels.append(np.full(len(own), level, np.int32))
            own_rows.append(row[own])
            own_labels.append(label[own])
            own_roots.append(root[own])
        if not levels:
            return pd.DataFrame({"flat": [], "label": [], "level": [], "rank": [], "way": []})
        out = pd.DataFrame({"flat": flat[np.concatenate(own_rows)], "label": np.concatenate(own_labels), "level": np.concatenate(levels), "rank": np.concatenate(own_roots), "way": b""})
        if len(levels) == side and len(own):
            back, way = own, np.zeros((len(own), side), np.uint8)
            for n in range(side - 1, -1, -1):
                way[:, n], back = turns[n][back], parents[n][back]
            out["way"] = [b""] * (len(out) - len(own)) + [w.tobytes() for w in way]
        return out

    return run


def widest_reach(dims: tuple[int, int, int], cells: int) -> int:
    """The most levels a round may spread so that a block of that side, widened by it, has at most ``cells`` cells (``REACH`` at least); all if the grid has no more."""
    if math.prod(dims) <= cells:
        return math.prod(dims)
    low, high = REACH, math.prod(dims)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if math.prod(min(n, 3 * mid) for n in dims) <= cells else (low, mid)
    return low


def propagate_labels(seeds: DataFrame, target: DataFrame, grid: Grid, *, reach: int | None = None) -> DataFrame:
    """(flat, label, level): seeds (flat, label) spread through the target in breadth-first order.

    Ties fall as in a queue: seeds in order of flat (of repeated ones the least
    label), then the neighbours of earlier voxels first, in the order of SIX. A
    round spreads ``reach`` levels: a task works on a cube of that side and as
    much around it, which is all that can reach the cube's voxels. Without
    ``reach`` it is as large as ``BLOCK_CELLS`` cells allow, so long thin grids
    take few rounds and small ones a single one. Only cubes near the last level take part.
    A voxel's place in the queue is the place of its ancestor at the start of
    the round, then the directions of its way; only the round's last level is
    numbered anew, by range partition.
    """
    spark, reach = target.sparkSession, reach or widest_reach(grid.dims, BLOCK_CELLS)
    path = new_path(spark, "waves")
    schema = "flat long, label int, level int, rank long, way binary"
    inside = target.select("flat").distinct()
    known = seeds.where("label != 0").groupBy("flat").agg(F.min("label").cast("int").alias("label")).join(inside, "flat", "left_semi")
    known.select("flat", "label", F.lit(0).alias("level"), F.col("flat").alias("rank"), F.lit(b"").alias("way")).write.parquet(f"{path}/0")
    reached = spark.read.schema(schema).parquet(f"{path}/0")
    wave, left, base = reached.select("flat", "label", "rank"), inside, 0
    while not wave.isEmpty():
        left = materialize(left.join(reached.select("flat"), "flat", "left_anti"), "unreached")
        rows = wave.unionByName(left.select("flat", F.lit(0).alias("label"), F.lit(-1).cast("long").alias("rank")))
        placed = blocks_around(with_ijk(rows, grid), grid, reach, reach)
        live = placed.where("rank >= 0").select("block").distinct()
        spread = placed.join(live, "block", "left_semi").groupBy("block").applyInPandas(_spread(grid.dims, reach, base), schema)
        base += reach
        spread.write.parquet(f"{path}/{base}")
        reached = spark.read.schema(schema).parquet(f"{path}/{base}")
        front = reached.where(F.col("level") == base)
        if front.isEmpty():
            break
        wave = materialize(ordered_ids(front.select("flat", "label", "rank", "way"), ["rank", "way"], "place").select("flat", "label", F.col("place").cast("long").alias("rank")), "wave")
    return spark.read.schema(schema).parquet(f"{path}/*").select("flat", "label", "level")
