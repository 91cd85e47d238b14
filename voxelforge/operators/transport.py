"""Parallel-transport arcs: frames, propagators, walking and arc likelihoods.

All candidates of all seeds are scored together: where their samples lie in the
start frame is a small table, samples are rows, support is one range join and a
sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import cross, normalize, vec
from ..schema import CURVATURE_EPS, TransportParams
from ..tables import materialize
from .spatial import support_parts

FRAME = [f"{a}{c}" for a in ("q", "u", "v", "w") for c in "xyz"]
COEFFICIENTS = [f"a{i}" for i in range(9)]


def propagator(k1: float, k2: float, t: float) -> list[float]:
    """Coefficients of the new position, tangent and second normal after an arc of length t."""
    if abs(k1) < CURVATURE_EPS and abs(k2) < CURVATURE_EPS:
        return [t, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    k1, k2 = (CURVATURE_EPS if abs(k) < CURVATURE_EPS else k for k in (k1, k2))
    square = k1 * k1 + k2 * k2
    k = math.sqrt(square)
    s, c = math.sin(k * t), math.cos(k * t)
    return [s / k, k1 * (1 - c) / square, k2 * (1 - c) / square, c, k1 * s / k, k2 * s / k, -k2 * s / k, k1 * k2 * (c - 1) / square, (k1 * k1 + k2 * k2 * c) / square]


def curvature_grid(params: TransportParams) -> list[tuple[float, float]]:
    n = max(params.n_k_samples, 1)
    if n == 1:
        return [(0.0, 0.0)]
    ks = [-params.k_max + 2 * params.k_max / (n - 1) * i for i in range(n)]
    return [(a, b) for a in ks for b in ks]


def probe_step(params: TransportParams) -> float:
    q = max(params.probe_quality, 1)
    return params.probe_length_mm / (q - 1) if q > 1 else 0.0


def propagator_table(spark: SparkSession, params: TransportParams, step: float | None = None) -> DataFrame:
    """(cand, k1, k2, a0..a8): n_k_samples squared rows, made on the driver."""
    step = probe_step(params) if step is None else step
    rows = [(i, a, b, *propagator(a, b, step)) for i, (a, b) in enumerate(curvature_grid(params))]
    return spark.createDataFrame(rows, "cand int, k1 double, k2 double, " + ", ".join(f"{c} double" for c in COEFFICIENTS))


def frames(fixels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the frame of each fixel: position q, tangent u, normals v and w."""
    t = vec("d")
    seed = [F.when(F.abs(t[0]) < 0.9, x).otherwise(y) for x, y in ((F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0)))]
    first = fixels.select(*keep, *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"], *[F.col(f"d{c}").alias(f"u{c}") for c in "xyz"], *[x.alias(f"v{c}") for x, c in zip(normalize(cross(seed, t)), "xyz", strict=True)])
    return first.select("*", *[x.alias(f"w{c}") for x, c in zip(cross(vec("u"), vec("v")), "xyz", strict=True)])


def walk(df: DataFrame, coefficients: list[Column] | None = None) -> DataFrame:
    """Advance every frame by one step of its propagator (columns a0..a8), keeping it orthonormal."""
    a = [F.col(c) for c in COEFFICIENTS] if coefficients is None else coefficients
    q, u, v, w = (vec(x) for x in "quvw")
    combine = lambda k: [a[k] * u[i] + a[k + 1] * v[i] + a[k + 2] * w[i] for i in range(3)]
    rest = [c for c in df.columns if c not in FRAME]
    names = lambda x: [f"{x}{c}" for c in "xyz"]
    moved = df.select(*rest, *[(p + d).alias(n) for p, d, n in zip(q, combine(0), names("q"), strict=True)], *[x.alias(n) for x, n in zip(normalize(combine(3)), names("u"), strict=True)], *[x.alias(n) for x, n in zip(combine(6), names("r"), strict=True)])
    turned = moved.select(*rest, *names("q"), *names("u"), *[x.alias(n) for x, n in zip(normalize(cross(vec("r"), vec("u"))), names("v"), strict=True)])
    return turned.select("*", *[x.alias(n) for x, n in zip(cross(vec("u"), vec("v")), names("w"), strict=True)])


def fan(samples: DataFrame, params: TransportParams) -> DataFrame:
    """Points that stand for a sample: itself, or ``probe_count`` points on a circle around its tangent."""
    n, r = params.probe_count, params.probe_radius_mm
    if n <= 1 or r <= 0:
        return samples.withColumn("fan", F.lit(0))
    rows = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(r * math.cos(2 * math.pi * j / n)).alias("c"), F.lit(r * math.sin(2 * math.pi * j / n)).alias("s")) for j in range(n)])
    out = samples.withColumn("__f", F.explode(rows))
    rest = [c for c in samples.columns if c not in ("qx", "qy", "qz")]
    return out.select(*rest, F.col("__f.j").alias("fan"), *[(F.col(f"q{c}") + F.col("__f.c") * F.col(f"v{c}") + F.col("__f.s") * F.col(f"w{c}")).alias(f"q{c}") for c in "xyz"])


Support = Callable[[DataFrame, list[str]], DataFrame]


def arc_table(spark: SparkSession, params: TransportParams) -> DataFrame:
    """(cand, k1, k2, s, m0..m11): where sample s of each candidate is, and its frame, seen from the start frame.

    Walking with constant curvature commutes with rotation, so it is done once,
    from the unit frame, on the driver; the start itself is candidate -1.
    """
    step, rows = probe_step(params), [(-1, 0.0, 0.0, 0, *[0.0] * 3, *np.eye(3).ravel().tolist())]
    for cand, (k1, k2) in enumerate(curvature_grid(params)):
        a, p, f = np.array(propagator(k1, k2, step)).reshape(3, 3), np.zeros(3), np.eye(3)
        for s in range(1, max(params.probe_quality, 1)):
            p = p + a[0] @ f
            t, r = _unit(a[1] @ f), a[2] @ f
            n = _unit(np.cross(r, t))
            f = np.stack([t, n, np.cross(t, n)])
            rows.append((cand, k1, k2, s, *p.tolist(), *f.ravel().tolist()))
    return spark.createDataFrame(rows, "cand int, k1 double, k2 double, s int, " + ", ".join(f"m{i} double" for i in range(12)))


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n > 1e-9 else v


def arc_samples(start: DataFrame, params: TransportParams, key: str) -> DataFrame:
    """(key, cand, s, frame) for the start (cand -1, shared by all candidates) and every later sample: one projection."""
    met = start.select(key, *FRAME).crossJoin(F.broadcast(arc_table(start.sparkSession, params)))
    axes = [vec(x) for x in "uvw"]
    turned = lambda n, c: sum((F.col(f"m{n + m}") * axes[m][c] for m in range(1, 3)), F.col(f"m{n}") * axes[0][c])
    cols = [(F.col(f"q{x}") + turned(0, c)).alias(f"q{x}") for c, x in enumerate("xyz")]
    cols += [turned(3 * g, c).alias(f"{name}{x}") for g, name in ((1, "u"), (2, "v"), (3, "w")) for c, x in enumerate("xyz")]
    return met.select(key, "cand", "s", *cols)


def arc_likelihoods(start: DataFrame, params: TransportParams, support: Support, key: str) -> DataFrame:
    """(key, cand, likelihood) for every start frame and curvature pair.

    ``support`` maps samples (keys, frame) to (keys, support), one row or several
    to be summed; it is the place to plug in other scores. The first sample is the same for all candidates of a
    frame and is scored once.
    """
    n = params.probe_count if params.probe_count > 1 and params.probe_radius_mm > 0 else 1
    keys = [key, "cand", "s", "fan"]
    scored = support(fan(arc_samples(start, params, key), params), keys).groupBy(key, "cand").agg((F.sum("support") / n).alias("total"))
    begin = scored.where("cand < 0").select(key, F.col("total").alias("begin"))
    cands = start.sparkSession.range(len(curvature_grid(params))).select(F.col("id").cast("int").alias("cand"))
    every = start.select(key).crossJoin(F.broadcast(cands))
    out = every.join(begin, key, "left").join(scored.where("cand >= 0"), [key, "cand"], "left")
    return out.select(key, "cand", (F.coalesce("begin", F.lit(0.0)) + F.coalesce("total", F.lit(0.0))).alias("likelihood"))


def fixel_support(index: DataFrame, params: TransportParams) -> Support:
    return lambda samples, keys: support_parts(samples, index, params.support_radius_mm, params.angular_power, keys)


def best_arcs(seeds: DataFrame, index: DataFrame, params: TransportParams, support: Support | None = None) -> DataFrame:
    """(fixel_id, likelihood): the best of all curvature pairs for each seed fixel, at least 0 if there are several."""
    arcs = arc_likelihoods(materialize(frames(seeds, ["fixel_id"]), "frames"), params, support or fixel_support(index, params), "fixel_id")
    best = F.max("likelihood")
    if max(params.n_k_samples, 1) > 1:
        best = F.greatest(F.lit(0.0), best)
    return arcs.groupBy("fixel_id").agg(best.alias("likelihood"))
