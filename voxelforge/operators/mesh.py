"""Triangle-mesh operators: normals, smoothing, components, subsets, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cross, dot, normalize, vec
from ..schema import Mesh
from ..tables import materialize
from .components import numbered_components, ordered_ids


def corners(vertex: DataFrame, triangle: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Triangles with the columns of their three vertices, prefixed a, b and c."""
    cols = cols or ["x", "y", "z"]
    out = triangle.select("tid", "a", "b", "c")
    for corner in "abc":
        side = vertex.select(F.col("vid").alias(corner), *[F.col(c).alias(f"{corner}{c}") for c in cols])
        out = out.join(side, corner)
    return out


def _face(prefixes: str = "abc") -> list[Column]:
    a, b, c = (vec(p) for p in prefixes)
    return cross([q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)])


def vertex_normals(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): area-weighted mean of the face normals; 0 for vertices without a face."""
    faces = corners(vertex, triangle).select(F.explode(F.array("a", "b", "c")).alias("vid"), *[f.alias(f"s{c}") for f, c in zip(_face(), "xyz", strict=True)])
    sums = faces.groupBy("vid").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"])
    joined = vertex.select("vid").join(sums, "vid", "left").na.fill(0.0, ["sx", "sy", "sz"])
    return joined.select("vid", *[n.alias(f"n{c}") for n, c in zip(normalize(vec("s")), "xyz", strict=True)])


def with_normals(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    return vertex.select("vid", "x", "y", "z").join(vertex_normals(vertex, triangle), "vid")


def volume(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """One row (volume): of the closed surface, from signed tetrahedra."""
    det = dot(vec("a"), cross(vec("b"), vec("c")))
    return corners(vertex, triangle).agg(F.abs(F.sum(det) / 6).alias("volume"))


def one_ring(triangle: DataFrame) -> DataFrame:
    """(u, v), distinct: the vertices that share an edge with u."""
    pairs = F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "ba", "bc", "cb", "ca", "ac")])).alias("e")
    return triangle.select(pairs).select("e.u", "e.v").where("u != v").distinct()


def laplacian(vertex: DataFrame, ring: DataFrame, factor: float) -> DataFrame:
    """Move every vertex by ``factor`` towards the mean of its ring; those without one stay."""
    mean = ring.join(vertex.select(F.col("vid").alias("v"), "x", "y", "z"), "v").groupBy("u").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    joined = vertex.select("vid", "x", "y", "z").join(mean, F.col("vid") == F.col("u"), "left")
    return joined.select("vid", *[(F.col(c) + F.lit(float(factor)) * F.coalesce(F.col(f"m{c}") - F.col(c), F.lit(0.0))).alias(c) for c in "xyz"])


def taubin(vertex: DataFrame, triangle: DataFrame, lam: float, mu: float, iterations: int) -> DataFrame:
    """(vid, x, y, z) after pairs of a shrinking and a widening pass."""
    out = vertex.select("vid", "x", "y", "z")
    if iterations:
        ring = materialize(one_ring(triangle), "ring")
    for n in range(iterations):
        out = laplacian(laplacian(out, ring, lam), ring, mu)
        if n + 1 < iterations:
            out = materialize(out, "taubin")
    return out


def mesh_components(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """(vid, label): components numbered from 1 by lowest vertex, 0 for vertices without a triangle.

    Triangles with a corner that is no vertex are ignored.
    """
    known = triangle
    for corner in "abc":
        known = known.join(vertex.select(F.col("vid").alias(corner)), corner, "left_semi")
    used = known.select(F.explode(F.array("a", "b", "c")).alias("node")).distinct()
    edges = known.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))).alias("e")).select("e.u", "e.v")
    labels = numbered_components(used, edges)
    return vertex.select("vid").join(labels.withColumnRenamed("node", "vid"), "vid", "left").select("vid", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def subset(vertex: DataFrame, triangle: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen triangles (tid), their vertices, renumbered from 0 in their old order; old_vid and old_tid are kept."""
    kept = materialize(triangle.join(chosen.select("tid"), "tid", "left_semi"), "subset")
    ids = kept.select(F.explode(F.array("a", "b", "c")).alias("old_vid")).distinct()
    numbers = materialize(ordered_ids(ids, ["old_vid"], "vid"), "numbers")
    out_v = vertex.withColumnRenamed("vid", "old_vid").join(numbers, "old_vid")
    out_t = kept
    for corner in "abc":
        out_t = out_t.join(numbers.select(F.col("old_vid").alias(corner), F.col("vid").alias(f"new_{corner}")), corner).drop(corner).withColumnRenamed(f"new_{corner}", corner)
    out_t = ordered_ids(out_t.withColumnRenamed("tid", "old_tid"), ["old_tid"], "tid")
    return out_v.select("vid", *[c for c in out_v.columns if c != "vid"]), out_t.select("tid", "old_tid", "a", "b", "c")


def majority_side(triangle: DataFrame, sides: DataFrame) -> DataFrame:
    """(tid, side): the side (vid, side in 1, 2) that at least two of a triangle's vertices are on."""
    votes = triangle.select("tid", F.explode(F.array("a", "b", "c")).alias("vid")).join(sides, "vid").groupBy("tid", "side").agg(F.count("*").alias("n"))
    return votes.where((F.col("n") >= 2) & (F.col("side") > 0)).select("tid", "side")


def split_by_x_sign(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """(tid, a, b, c, hemi): triangles wholly at x < 0 are lh, wholly at x >= 0 rh; mixed ones are dropped."""
    x = [F.col(f"{c}x") for c in "abc"]
    left, right = (x[0] < 0) & (x[1] < 0) & (x[2] < 0), (x[0] >= 0) & (x[1] >= 0) & (x[2] >= 0)
    return corners(vertex, triangle, ["x"]).withColumn("hemi", F.when(left, "lh").when(right, "rh")).where("hemi is not null").select("tid", "a", "b", "c", "hemi")


def visualisation_pair(vertex: DataFrame, thickness: float) -> DataFrame:
    """The vertices with an outer partner (pial_x..z) against the inward normal."""
    return vertex.select("vid", "x", "y", "z", *[(F.col(c) - F.lit(float(thickness)) * F.col(f"n{c}")).alias(f"pial_{c}") for c in "xyz"])


def hemispheres(mesh: Mesh, sides: DataFrame) -> dict[str, Mesh]:
    """Submeshes of the sides 1 (lh) and 2 (rh) by majority of the vertices; border vertices are in both."""
    chosen = materialize(majority_side(mesh.triangle, sides), "sides")
    return {name: Mesh(*subset(mesh.vertex, mesh.triangle, chosen.where(F.col("side") == side))) for name, side in (("lh", 1), ("rh", 2))}
