"""Range and nearest-neighbour joins on cell hashes, and what is summed over them.

A radius predicate alone plans as a nested loop. Hashing both sides to cells of
twice the radius, and copying the probing side to the cells that its ball
touches (at most 8), makes it an equi-join that shuffles on cells and can be
split where a cell is hot. Sums over a radius need no pairs: they are formed
in blocks of space, see ``support_parts``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import dot, vec
from ..tables import materialize
from .reduce import finite, upper_median

NEIGHBOURS = 16


def _copied(rows: DataFrame, point: list[Column], side: float, reach: float, names: list[str]) -> DataFrame:
    """Rows copied to the cells of ``side`` (at least twice ``reach``) that lie within ``reach`` of the point: two an axis at most."""
    shifts = F.array(*[F.struct(*[F.lit(n >> c & 1).alias(x) for c, x in enumerate("ijk")]) for n in range(8)])
    low, high = ([F.floor((c + F.lit(float(d))) / F.lit(float(side))) for c in point] for d in (-reach, reach))
    spread = rows.select("*", *[c.alias(f"__l{x}") for c, x in zip(low, "ijk", strict=True)], *[c.alias(f"__h{x}") for c, x in zip(high, "ijk", strict=True)]).withColumn("__s", F.explode(shifts))
    cells = [F.col(f"__l{x}") + F.col(f"__s.{x}") for x in "ijk"]
    inside = [c <= F.col(f"__h{x}") for c, x in zip(cells, "ijk", strict=True)]
    return spread.where(inside[0] & inside[1] & inside[2]).select(*rows.columns, *[c.alias(n) for c, n in zip(cells, names, strict=True)])


def range_join(probes: DataFrame, index: DataFrame, radius: float, *, probe: str = "q", point: str = "p") -> DataFrame:
    """All pairs of a probe (columns ``q``x..z) and an index row (``p``x..z) at most ``radius`` apart, with ``d2``.

    Column names of the two sides must differ. Each pair meets in one cell, so
    nothing needs to be made distinct. Probes are the side that is copied; rows
    without a position meet nothing.
    """
    # the reach is wider than the radius by rounding errors, the predicate is exact
    reach = radius * (1 + 1e-9) + 1e-12
    side = 2 * reach
    keys = [f"__c{a}" for a in "ijk"]
    left = _copied(probes.where(_placed(probe)), vec(probe), side, reach, keys)
    right = index.where(_placed(point)).select(*index.columns, *[F.floor(c / F.lit(side)).alias(k) for c, k in zip(vec(point), keys, strict=True)])
    gap = [a - b for a, b in zip(vec(probe), vec(point), strict=True)]
    d2 = dot(gap, gap)
    return left.join(right, keys).where(d2 <= radius * radius).select(*probes.columns, *index.columns, d2.alias("d2"))


def _placed(prefix: str) -> Column:
    """All three components are there and finite."""
    return finite(F.col(f"{prefix}x")) & finite(F.col(f"{prefix}y")) & finite(F.col(f"{prefix}z"))


def neighbours_within(fixels: DataFrame, radius: float) -> DataFrame:
    """(a, b, d2) for all pairs of fixels within the radius, each fixel with itself included."""
    probes = fixels.select(F.col("fixel_id").alias("a"), *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"])
    return range_join(probes, fixels.select(F.col("fixel_id").alias("b"), "px", "py", "pz"), radius).select("a", "b", "d2")


def nearest(fixels: DataFrame, k: int = NEIGHBOURS, radius: float | None = None) -> DataFrame:
    """(a, b, va, vb, d2): the k nearest fixels of each, itself included.

    Rounds of growing radius: a fixel is done once it has k neighbours within
    the radius, or the radius spans everything; only the others are searched on.
    """
    points = fixels.select(F.col("fixel_id").alias("b"), F.col("voxel_idx").alias("vb"), "px", "py", "pz")
    probes = fixels.select(F.col("fixel_id").alias("a"), F.col("voxel_idx").alias("va"), *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"])
    n, *box = fixels.agg(F.count("*"), *[f(f"p{c}") for c in "xyz" for f in (F.min, F.max)]).first()
    if not n:
        return probes.join(points, F.lit(False)).select("a", "b", "va", "vb", F.lit(0.0).alias("d2"))
    sides = [hi - lo for lo, hi in zip(box[::2], box[1::2], strict=True)]
    span = sum(s * s for s in sides) ** 0.5 + 1e-6
    radius = radius or max(span / max(1.0, n ** (1 / 3)) * 2, 1e-6)
    out = None
    while True:
        met = range_join(probes, points, min(radius, span)).select("a", "b", "va", "vb", "d2")
        order = W.partitionBy("a").orderBy("d2", "b")
        first = materialize(met.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k), "nearest")
        done = first.select("a").distinct() if radius >= span else first.where(F.col("__n") == k).select("a")
        rows = first.drop("__n").join(done, "a", "left_semi")
        out = rows if out is None else out.unionByName(rows)
        if radius >= span:
            return out
        probes = probes.join(done, "a", "left_anti")
        if probes.isEmpty():
            return out
        radius *= 2


def median_neighbour_distance(fixels: DataFrame, k: int = NEIGHBOURS) -> float:
    """Upper median of the distance to the nearest fixel of another voxel among the k nearest; 0 if there is none."""
    first = nearest(fixels, k).where("va != vb").groupBy("a").agg(F.sqrt(F.min("d2")).alias("d"))
    return upper_median(first, "d") or 0.0


#: Samples, and points, of a block of space that one task works on, about.
GROUP, POINT_GROUP = 50_000, 200_000
#: Radii along the side of a block.
BLOCK = 8
#: Even powers up to this are summed as moments of the directions.
MOMENTS = 8
_PAIRS = 1 << 18
_CELL = ["__i", "__j", "__k"]


def _parent(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Cells of a radius to the blocks that hold them."""
    return rows.select(*[F.floor(F.col(c) / BLOCK).alias(c) for c in _CELL], *extra)


def _crowds(rows: DataFrame, group: int, name: str) -> DataFrame:
    return rows.groupBy("__level", *_CELL).agg(F.ceil(F.count("*") / group).alias(name)).where(F.col(name) > 1)


def support_parts(samples: DataFrame, index: DataFrame, radius: float, power: int, keys: list[str], *, group: int = GROUP, point_group: int = POINT_GROUP) -> DataFrame:
    """(keys, support) to be summed by keys: one row for each sample (qx..qz, ux..uz), or one for each part of its block's points.

    Space is cut into blocks of ``BLOCK`` radii, those with more than ``group``
    samples into cells of one radius. Points are copied to where they are within
    the radius of, samples are not copied. What is still crowded is cut by salts
    on both sides, each part of the samples meeting each part of the points. A
    task forms its sums without pairs leaving it, see ``_supports``. Samples
    without position or tangent get 0; points without position or direction
    count for nothing.
    """
    reach = radius * (1 + 1e-9) + 1e-12
    ident = ["fixel_id"] if "fixel_id" in index.columns else ["px", "py", "pz", "dx", "dy", "dz", "amplitude"]
    weight = F.when(finite(F.col("amplitude")), F.col("amplitude")).otherwise(F.lit(1.0)).alias("weight")
    usable = _placed("p") & _placed("d")
    points = index.where(usable).select("px", "py", "pz", "dx", "dy", "dz", weight, F.xxhash64(*ident).alias("__hp"))
    placed = samples.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], *[F.col(f"{a}{c}") for a in "qu" for c in "xyz"], F.xxhash64(*keys).alias("__hq"))
    placed = placed.select("*", *[F.floor(q / F.lit(reach)).alias(c) for q, c in zip(vec("q"), _CELL, strict=True)])
    counts = materialize(placed.groupBy(*_CELL).agg(F.count("*").alias("n")), "cell-counts")
    dense = materialize(_parent(counts, ["n"]).groupBy(*_CELL).agg(F.sum("n").alias("n")).where(F.col("n") > group).select(*[F.col(c).alias(f"__d{c}") for c in _CELL]), "dense-blocks")
    is_dense = [F.floor(F.col(c) / BLOCK) == F.col(f"__d{c}") for c in _CELL]
    mark = F.when(F.col(f"__d{_CELL[0]}").isNotNull(), 1).otherwise(0).alias("__level")
    leveled = placed.join(dense, is_dense, "left").select(*placed.columns, mark)
    fine = F.col("__level") == 1
    placed = leveled.select(*[c for c in placed.columns if c not in _CELL], "__level", *[F.when(fine, F.col(c)).otherwise(F.floor(F.col(c) / BLOCK)).alias(c) for c in _CELL])
    blocks = _copied(points, vec("p"), BLOCK * reach, reach, _CELL)
    same = [F.col(c) == F.col(f"__d{c}") for c in _CELL]
    coarse = blocks.join(dense, same, "left_anti").withColumn("__level", F.lit(0))
    narrow = blocks.join(dense, same, "left_semi")
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    narrow = narrow.withColumn("__s", shift)
    near = [F.floor(p / F.lit(reach)) + F.col(f"__s.{x}") for p, x in zip(vec("p"), "ijk", strict=True)]
    inside = [F.floor(n / BLOCK) == F.col(c) for n, c in zip(near, _CELL, strict=True)]
    narrow = narrow.where(inside[0] & inside[1] & inside[2]).select(*points.columns, *[n.alias(c) for n, c in zip(near, _CELL, strict=True)], F.lit(1).alias("__level"))
    points = coarse.unionByName(narrow)
    full = ["__level", *_CELL]
    cuts = materialize(_crowds(placed, group, "__nq").join(_crowds(points, point_group, "__np"), full, "full"), "crowded-cells")
    parts = lambda name: F.coalesce(F.col(name), F.lit(1)).cast("long")
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), parts(name) - 1))
    placed = placed.join(cuts, full, "left").withColumn("__sq", F.pmod("__hq", parts("__nq"))).withColumn("__sp", every("__np")).drop("__nq", "__np", "__hq")
    points = points.join(cuts, full, "left").withColumn("__sp", F.pmod("__hp", parts("__np"))).withColumn("__sq", every("__nq")).drop("__nq", "__np", "__hp")
    by = [*full, "__sq", "__sp"]
    types = dict(placed.dtypes)
    schema = ", ".join([*(f"__k{n} {types[f'__k{n}']}" for n in range(len(keys))), "support double"])
    out = placed.groupBy(*by).cogroup(points.groupBy(*by)).applyInArrow(_supports(len(keys), radius, power), schema)
    return out.select(*[F.col(f"__k{n}").alias(k) for n, k in enumerate(keys)], "support")


def _columns(table: pa.Table, names: str) -> np.ndarray:
    """Columns as a matrix, null as NaN."""
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in names.split()], 1) if table.num_rows else np.zeros((0, len(names.split())))


def _supports(n_keys: int, radius: float, power: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums over the points within the radius of each sample, by halving the samples along their widest axis.

    Of a node's points, those that are within the radius of all its samples are
    summed once: |u.d|^p is a polynomial in u for even p, so what counts are the
    weighted sums of the monomials of d. Those out of reach of all go. The rest
    is handed down, and compared one by one where a node has become small.
    """
    p = max(power, 1)
    powers = [(a, b, p - a - b) for a in range(p + 1) for b in range(p + 1 - a)] if p % 2 == 0 and p <= MOMENTS else []
    factor = np.array([math.factorial(p) / math.prod(math.factorial(e) for e in es) for es in powers])
    r2 = radius * radius

    def monomials(v: np.ndarray) -> np.ndarray:
        raised = [np.stack([v[:, c] ** e for e in range(p + 1)], 1) for c in range(3)]
        return np.stack([raised[0][:, a] * raised[1][:, b] * raised[2][:, c] for a, b, c in powers], 1) if powers else np.zeros((len(v), 0))

    def one_by_one(q: np.ndarray, u: np.ndarray, at: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(q)), max(1, _PAIRS // max(1, len(at)))
        axes, d = np.ascontiguousarray(at.T), np.ascontiguousarray(d.T)
        for s in range(0, len(q), step):
            part = q[s : s + step]
            d2, gap = part[:, :1] - axes[0], np.empty((len(part), len(at)))
            d2 *= d2
            for c in (1, 2):
                np.subtract(part[:, c : c + 1], axes[c], out=gap)
                gap *= gap
                d2 += gap
            cos = np.matmul(u[s : s + step], d, out=gap)
            if p % 2:
                np.abs(cos, out=cos)
            score = np.square(np.square(cos, out=cos), out=cos) if p == 4 else cos**p
            score *= d2 <= r2
            out[s : s + step] = score @ w
        return out

    def run(samples: pa.Table, points: pa.Table) -> pa.Table:
        q, u = _columns(samples, "qx qy qz"), _columns(samples, "ux uy uz")
        at, d, w = _columns(points, "px py pz"), _columns(points, "dx dy dz"), _columns(points, "weight").ravel()
        total = np.zeros(len(q))
        usable = np.flatnonzero(np.isfinite(q).all(1) & np.isfinite(u).all(1))
        moments, mono = monomials(d) * w[:, None], monomials(u[usable]) * factor
        place = np.zeros(len(q), np.int64)
        place[usable] = np.arange(len(usable))
        todo = [(usable, np.arange(len(at)), np.zeros(len(powers)))] if len(usable) and len(at) else []
        while todo:
            mine, around, known = todo.pop()
            low, high = q[mine].min(0), q[mine].max(0)
            rho, slack = float(np.sqrt(np.square(high - low).sum())) / 2, 1e-9 * (1 + float(np.abs([low, high]).max()))
            gap = at[around] - (low + high) / 2
            dist = np.sqrt(np.square(gap).sum(1))
            open_ = dist <= radius + rho + slack
            if powers and rho + slack < radius:
                inner = dist <= radius - rho - slack
                known = known + moments[around[inner]].sum(0)
                open_ &= ~inner
            around = around[open_]
            if not len(around) or rho == 0 or len(mine) * len(around) <= 20 * len(around) + 100_000:
                if powers:
                    total[mine] = mono[place[mine]] @ known
                if len(around):
                    total[mine] += one_by_one(q[mine], u[mine], at[around], d[around], w[around])
                continue
            axis, half = int(np.argmax(high - low)), len(mine) // 2
            order = mine[np.argpartition(q[mine, axis], half)]
            todo += [(order[:half], around, known), (order[half:], around, known)]
        return pa.table([*[samples.column(f"__k{n}") for n in range(n_keys)], pa.array(total)], names=[*[f"__k{n}" for n in range(n_keys)], "support"])

    return run


def data_support(samples: DataFrame, index: DataFrame, radius: float, power: int, keys: list[str]) -> DataFrame:
    """Support of each sample (keys, qx..qz, ux..uz): over the index fixels within the radius (whose edge counts), the sum of |cosine|^power times the amplitude (1 if that is not finite); none gives 0.

    Samples with equal keys are one. A power of 0 counts as 1.
    """
    return support_parts(samples, index, radius, power, keys).groupBy(*keys).agg(F.sum("support").alias("support"))


def capture_visited(trajectory: DataFrame, index: DataFrame, radius: float, cos_theta: float) -> DataFrame:
    """(fixel_id), distinct and in order: fixels near a point (qx..qz) and aligned with its tangent (ux..uz)."""
    near = range_join(trajectory.select("qx", "qy", "qz", "ux", "uy", "uz"), index.select("fixel_id", "px", "py", "pz", "dx", "dy", "dz"), radius)
    return near.where(F.abs(dot(vec("u"), vec("d"))) >= cos_theta).select("fixel_id").distinct().orderBy("fixel_id")
