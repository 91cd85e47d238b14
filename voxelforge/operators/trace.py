"""Deterministic tracing within a set of fixels: all seeds advance together, a step within cells of space that let no pairs out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import dot, vec
from ..schema import TraceParams
from ..tables import materialize
from .spatial import _CELL, _columns, _copied, _placed

SEARCH_STEPS, SEARCH_MIN_MM = 2.5, 3.0
#: Probes, and points, of a cell that one task compares, about.
PROBES, POINTS = 8_000, 500_000
#: First angle around a probe in which the best aligned point is looked for, and the side of cells of directions.
NARROW, TURN = 0.1, 0.2
_PAIRS = 1 << 20


def polyline_lengths(points: DataFrame, key: str = "sid", order: str = "idx") -> DataFrame:
    """(key, length): the sum of the distances of consecutive points."""
    w = W.partitionBy(key).orderBy(order)
    gap = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    return points.withColumn("__d", F.coalesce(F.sqrt(dot(gap, gap)), F.lit(0.0))).groupBy(key).agg(F.sum("__d").alias("length"))


def trace_within(index: DataFrame, members: DataFrame, seeds: DataFrame, params: TraceParams = TraceParams()) -> DataFrame:
    """(sid, idx, x, y, z) of the polylines from seeds (sid, fixel_id) through member fixels (fixel_id).

    A step goes ``step_mm`` along the direction; the member within reach that is
    best aligned (more than the cosine of the largest angle; ties to the lowest
    id) gives the next direction, with the sign that goes on; without one the
    half-trace ends before that point. The seed is idx 0, points behind it are
    negative. Seeds that are no members, or not indexed, and polylines shorter
    than ``min_length_mm`` are left out.
    """
    cos_max, step = math.cos(math.radians(params.max_angle_deg)), params.step_mm
    reach, steps = max(SEARCH_STEPS * step, SEARCH_MIN_MM), math.ceil(params.max_length_mm / step)
    pool = materialize(index.join(members.select("fixel_id").distinct(), "fixel_id", "left_semi").select("fixel_id", "px", "py", "pz", "dx", "dy", "dz"), "trace-pool")
    start = seeds.select("sid", "fixel_id").join(pool, "fixel_id")
    points = start.select("sid", F.lit(0).alias("idx"), *[F.col(f"p{c}").alias(c) for c in "xyz"])
    signs = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    state = start.select("sid", signs, *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"], *[F.col(f"d{c}").alias(f"u{c}") for c in "xyz"])
    state = materialize(state.select("sid", "sign", "qx", "qy", "qz", *[(F.col("sign") * F.col(f"u{c}")).alias(f"u{c}") for c in "xyz"]), "trace")
    cells = pool.where(_placed("p") & _placed("d"))
    cells = materialize(_copied(cells, vec("p"), 2 * reach * (1 + 1e-9), reach * (1 + 1e-9), _CELL), "trace-cells")
    crowds = materialize(cells.groupBy(*_CELL).agg(F.ceil(F.count("*") / POINTS).alias("np")).where("np > 1"), "trace-crowds")
    for n in range(1, steps + 1):
        ahead = state.select("sid", "sign", *[(F.col(f"q{c}") + step * F.col(f"u{c}")).alias(f"q{c}") for c in "xyz"], "ux", "uy", "uz")
        moved = _aligned(ahead, cells, crowds, reach, cos_max)
        flip = F.when(F.col("best.cosine") >= 0, 1).otherwise(-1)
        state = materialize(moved.select("sid", "sign", "qx", "qy", "qz", *[(flip * F.col(f"best.d{c}")).alias(f"u{c}") for c in "xyz"]), "trace")
        state.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the step
        if state.isEmpty():
            break
        points = points.unionByName(state.select("sid", (F.col("sign") * n).alias("idx"), *[F.col(f"q{c}").alias(c) for c in "xyz"]))
    long = polyline_lengths(points).where(F.col("length") >= params.min_length_mm)
    return points.join(long.select("sid"), "sid", "left_semi")


def _aligned(probes: DataFrame, cells: DataFrame, crowds: DataFrame, reach: float, cos_max: float) -> DataFrame:
    """(sid, sign, qx..qz, best): for each probe with a point within reach, the best aligned of those (cosine, dx, dy, dz).

    Points are copied to the cells that they are in reach of, probes are not;
    crowded cells are cut by salts on both sides, and each part meets each.
    """
    side = 2 * reach * (1 + 1e-9)
    placed = probes.where(_placed("q") & _placed("u")).select("*", *[F.floor(q / F.lit(side)).alias(c) for q, c in zip(vec("q"), _CELL, strict=True)])
    many = placed.groupBy(*_CELL).agg(F.ceil(F.count("*") / PROBES).alias("nq")).join(crowds, _CELL, "left")
    many = materialize(many.select(*_CELL, "nq", F.coalesce("np", F.lit(1)).alias("np")), "trace-cuts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(many, _CELL).withColumn("__sq", F.pmod(F.xxhash64("sid", "sign"), "nq")).withColumn("__sp", every("np")).drop("nq", "np")
    right = cells.join(many, _CELL).withColumn("__sp", F.pmod(F.xxhash64("fixel_id"), "np")).withColumn("__sq", every("nq")).drop("nq", "np")
    by, types = [*_CELL, "__sq", "__sp"], dict(probes.dtypes)
    schema = f"sid {types['sid']}, sign int, qx double, qy double, qz double, cosine double, fixel_id {dict(cells.dtypes)['fixel_id']}, dx double, dy double, dz double"
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(reach, cos_max), schema)
    choice = F.max_by(F.struct("cosine", "dx", "dy", "dz"), F.struct(F.abs("cosine"), -F.col("fixel_id"))).alias("best")
    return met.groupBy("sid", "sign", "qx", "qy", "qz").agg(choice)


def _best(reach: float, cos_max: float):
    """The best aligned point within reach of each probe, ties to the lowest id.

    Probes are taken by cells of their directions. Points of unit direction are
    looked at within a narrow angle of the cell first; only probes whose best
    point lies beyond it are compared with all that the largest angle allows.
    """

    def compare(q: np.ndarray, u: np.ndarray, p: np.ndarray, d: np.ndarray, rows: np.ndarray, at: np.ndarray, best: np.ndarray, cosine: np.ndarray) -> None:
        step = max(1, _PAIRS // max(1, len(at)))
        for s in range(0, len(rows) if len(at) else 0, step):
            r = rows[s : s + step]
            # summed in the order in which SQL does, so that ties and edges fall alike
            cos = u[r, :1] * d[at, 0] + u[r, 1:2] * d[at, 1] + u[r, 2:] * d[at, 2]
            gaps = [q[r, c : c + 1] - p[at, c] for c in range(3)]
            size = np.where(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= reach * reach, np.abs(cos), -1.0)
            first = size.argmax(1)
            row = np.arange(len(r))
            good = size[row, first] > cos_max
            best[r[good]], cosine[r[good]] = at[first[good]], cos[row[good], first[good]]

    def run(probes: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("fixel_id")
        q, u, p, d = (_columns(t, f"{a}x {a}y {a}z") for t, a in ((probes, "q"), (probes, "u"), (points, "p"), (points, "d")))
        best, cosine = np.full(len(q), -1), np.zeros(len(q))
        units = all((np.abs(np.square(x).sum(1) - 1) < 1e-9).all() for x in (u, d))
        if len(q) and len(p) and not units:
            compare(q, u, p, d, np.arange(len(q)), np.arange(len(p)), best, cosine)
        elif len(q) and len(p):
            axis = np.abs(u).argmax(1)
            folded = u * np.sign(u[np.arange(len(u)), axis])[:, None]
            _, cell = np.unique(np.floor(folded / TURN).astype(np.int64), axis=0, return_inverse=True)
            order = np.argsort(cell.ravel(), kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(cell.ravel()[order])) + 1):
                middle = folded[rows].mean(0)
                middle /= np.sqrt(np.square(middle).sum())
                wide = float(np.arccos(np.clip(folded[rows] @ middle, -1, 1)).max())
                to_middle = np.abs(d @ middle)
                for angle in (NARROW, math.acos(cos_max)):
                    around = np.flatnonzero(to_middle >= math.cos(min(wide + angle, math.pi / 2)) - 1e-6)
                    compare(q, u, p, d, rows, around, best, cosine)
                    rows = rows[np.abs(cosine[rows]) <= math.cos(angle) + 1e-6]
                    if not len(rows):
                        break
        hit = np.flatnonzero(best >= 0)
        mine, other = probes.select(["sid", "sign", "qx", "qy", "qz"]).take(pa.array(hit)), points.select(["fixel_id", "dx", "dy", "dz"]).take(pa.array(best[hit]))
        return pa.table([*mine.columns, pa.array(cosine[hit]), *other.columns], names=[*mine.column_names, "cosine", *other.column_names])

    return run
