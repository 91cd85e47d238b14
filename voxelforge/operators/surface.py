"""Iso-surfaces of voxel fields as joins, the field pipelines, shrink-wrapping and hemisphere splits."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import apply_affine, dot, flat_index, in_grid, mesh_jitter, vec
from ..schema import MIN_CLEANUP_VOXELS, OUTSIDE_ATTENUATION, SECOND_HEMISPHERE_SHARE, Dataset, Grid, Mesh, ShrinkWrapParams, SurfaceParams, VoxelField
from ..tables import materialize
from . import grid as G
from .components import ordered_ids
from .mesh import hemispheres, mesh_components, subset, taubin, vertex_normals, with_normals
from .reduce import diagnostics, otsu_threshold, primary_peak_qa, reduce_dpf, require_same_keys

log = logging.getLogger(__name__)


def to_field(voxel: DataFrame, values: DataFrame, grid: Grid) -> DataFrame:
    """Per-voxel values (voxel_idx, value) on the grid; zeros are left out."""
    at = flat_index(F.col("i"), F.col("j"), F.col("k"), grid.dims)
    return voxel.join(values, "voxel_idx").where("value != 0").select(at.alias("flat"), "i", "j", "k", "value")


def mask_otsu(ds: Dataset, factor: float = 1.0) -> DataFrame:
    """(voxel_idx, flat, i, j, k) of voxels whose primary peak exceeds ``factor`` times Otsu's threshold."""
    qa = primary_peak_qa(ds.voxel, ds.fixel)
    iso = factor * otsu_threshold(qa)
    at = flat_index(F.col("i"), F.col("j"), F.col("k"), ds.grid.dims)
    return ds.voxel.join(qa.where(F.col("value") > F.lit(iso)), "voxel_idx").select("voxel_idx", at.alias("flat"), "i", "j", "k")


def _smoothed(voxel: DataFrame, values: DataFrame, grid: Grid, factor: float, iterations: int) -> VoxelField:
    """Otsu on the raw field, then smoothing of the field only."""
    raw = materialize(to_field(voxel, values, grid), "raw-field")
    otsu = otsu_threshold(raw)
    return VoxelField(G.mean_filter(raw, grid, iterations), grid, factor * otsu)


def field_otsu(ds: Dataset, factor: float = 1.0, iterations: int = 1) -> VoxelField:
    """Field of the primary peaks; its iso is ``factor`` times Otsu's threshold. Logs diagnostics."""
    qa = materialize(primary_peak_qa(ds.voxel, ds.fixel), "qa")
    out = _smoothed(ds.voxel, qa, ds.grid, factor, iterations)
    if log.isEnabledFor(logging.INFO):
        log.info("%s", diagnostics(qa, out.iso, out.iso / factor if factor else 0.0).first())
    return out


def field_from_dpf(ds: Dataset, name: str, how: str = "max", factor: float = 1.0, iterations: int = 1) -> VoxelField:
    return _smoothed(ds.voxel, reduce_dpf(ds.voxel, ds.fixel, ds.dpf[name], how), ds.grid, factor, iterations)


def field_from_dpv(ds: Dataset, name: str, factor: float = 1.0, iterations: int = 1) -> VoxelField:
    """From a per-voxel array; every voxel must have exactly one value."""
    require_same_keys(ds.voxel, ds.dpv[name], "voxel_idx")
    return _smoothed(ds.voxel, ds.dpv[name].select("voxel_idx", F.col("value").cast("double").alias("value")), ds.grid, factor, iterations)


def corner_offset(c: int) -> tuple[int, int, int]:
    return c & 1, c >> 1 & 1, c >> 2 & 1


@lru_cache
def cube_faces() -> list[list[int]]:
    """The corners of the six faces of a cell, counter-clockwise seen from outside."""
    out = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        ring = [0, 1 << u, 1 << u | 1 << v, 1 << v]
        out += [ring[::-1], [c | 1 << axis for c in ring]]
    return out


@lru_cache
def cell_triangles(case: int) -> list[tuple[tuple[int, int], ...]]:
    """Triangles of a cell as triples of crossed edges (lower corner, upper corner); bit c of ``case``: corner c is inside.

    On every face each run of inside corners is cut off by one segment, directed
    from the edge where the run is entered to the edge where it is left, so
    neighbouring cells agree on their common face. The segments close to loops,
    which are fanned. Triangles face so that (b - a) x (c - a) points inside.
    """
    follow: dict[tuple[int, int], tuple[int, int]] = {}
    for ring in cube_faces():
        inside = [case >> c & 1 for c in ring]
        edges = [tuple(sorted((ring[m], ring[(m + 1) % 4]))) for m in range(4)]
        for m in range(4):
            if not inside[m] and inside[(m + 1) % 4]:  # entered on edge m; left on the next edge that leaves
                n = m + 1
                while not (inside[n % 4] and not inside[(n + 1) % 4]):
                    n += 1
                follow[edges[m]] = edges[n % 4]
    out, left = [], set(follow)
    while left:
        loop = [min(left)]
        while (nxt := follow[loop[-1]]) != loop[0]:
            loop.append(nxt)
        left -= set(loop)
        out += [(loop[0], loop[m + 1], loop[m]) for m in range(1, len(loop) - 1)]
    return out


def triangle_table(spark: SparkSession) -> DataFrame:
    """(case, n, e): triangles of the 256 cases, edges coded as lower corner * 8 + upper corner."""
    rows = [(case, n, [p * 8 + q for p, q in tri]) for case in range(256) for n, tri in enumerate(cell_triangles(case))]
    return spark.createDataFrame(rows, "case int, n int, e array<int>")


def marching_cubes(field: DataFrame, grid: Grid, iso: float) -> tuple[DataFrame, DataFrame]:
    """Welded iso-surface in voxel coordinates: vertex(vid, x, y, z), triangle(tid, a, b, c).

    Voxels above iso mark their eight cells; only cells that are partly inside
    fetch all corners. A vertex is named by the lattice edge it lies on (or the
    corner, if the surface runs through it), so welding compares integers.
    Vertices are numbered in the order of those names.
    """
    spark, dims = field.sparkSession, grid.dims
    shifts = [tuple(-d for d in corner_offset(c)) for c in range(8)]
    cells = Grid((dims[0] - 1, dims[1] - 1, dims[2] - 1))
    in_cells = lambda: in_grid(F.col("i"), F.col("j"), F.col("k"), cells.dims)
    touched = field.where(F.col("value") > F.lit(float(iso))).select("i", "j", "k", G.offsets(shifts))
    touched = touched.select((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k"), F.pow(F.lit(2), F.col("o.n")).cast("int").alias("bit"))
    active = touched.where(in_cells()).groupBy("i", "j", "k").agg(F.sum("bit").cast("int").alias("case")).where("case < 255")
    corner = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), *[F.lit(d).alias(n) for d, n in zip(corner_offset(c), "abd", strict=True)]) for c in range(8)])).alias("o")
    at = flat_index(F.col("i") + F.col("o.a"), F.col("j") + F.col("o.b"), F.col("k") + F.col("o.d"), dims)
    values = active.select("i", "j", "k", "case", corner).select("i", "j", "k", "case", F.col("o.c").alias("c"), at.alias("flat")).join(field.select("flat", "value"), "flat", "left")
    value = F.coalesce("value", F.lit(0.0))
    whole = values.groupBy("i", "j", "k", "case").agg(*[F.max(F.when(F.col("c") == c, value)).alias(f"v{c}") for c in range(8)])
    soup = whole.join(F.broadcast(triangle_table(spark)), "case")
    v = F.array(*[F.col(f"v{c}") for c in range(8)])
    soup = soup.select("i", "j", "k", "n", v.alias("v"), F.posexplode("e").alias("m", "edge"))
    low, high = F.floor(F.col("edge") / 8).cast("int"), (F.col("edge") % 8).cast("int")
    soup = soup.withColumn("p", low).withColumn("d", F.log2((high - low).cast("double")).cast("int"))
    va, vb = F.element_at("v", F.col("p") + 1), F.element_at("v", high + 1)
    t = (F.lit(float(iso)) - va) / (vb - va)
    bit = lambda n: F.shiftright(F.col("p"), n).bitwiseAND(F.lit(1))
    soup = soup.select("i", "j", "k", "n", "m", "d", t.alias("t"), *[(F.col(c) + bit(n)).alias(f"l{c}") for n, c in enumerate("ijk")])
    whole_step = F.when(F.col("t") >= 1, 1).otherwise(0)
    name = flat_index(*[F.col(f"l{c}") + F.when(F.col("d") == n, whole_step).otherwise(0) for n, c in enumerate("ijk")], dims) * 4 + F.when((F.col("t") <= 0) | (F.col("t") >= 1), 0).otherwise(F.col("d") + 1)
    place = [(F.col(f"l{c}") + F.when(F.col("d") == n, F.col("t")).otherwise(F.lit(0.0))).alias(x) for n, (c, x) in enumerate(zip("ijk", "xyz", strict=True))]
    soup = materialize(soup.select("i", "j", "k", "n", "m", name.alias("name"), *place), "soup")
    points = soup.groupBy("name").agg(*[F.min(c).alias(c) for c in "xyz"])
    vertex = materialize(ordered_ids(points, ["name"], "vid"), "vertices")
    flat = soup.groupBy("i", "j", "k", "n").agg(*[F.max(F.when(F.col("m") == m, F.col("name"))).alias(f"k{c}") for m, c in enumerate("abc")])
    flat = flat.where("ka != kb and kb != kc and ka != kc")
    for c in "abc":
        flat = flat.join(vertex.select(F.col("name").alias(f"k{c}"), F.col("vid").alias(c)), f"k{c}")
    triangle = ordered_ids(flat.select("i", "j", "k", "n", "a", "b", "c"), ["i", "j", "k", "n"], "tid")
    return vertex.select("vid", "x", "y", "z"), materialize(triangle.select("tid", "a", "b", "c"), "triangles")


def clean_mask(mask: DataFrame, grid: Grid, smallest: int) -> DataFrame:
    """Drop small components, then fill holes (all background but its largest component)."""
    kept = materialize(G.drop_small(mask, grid, max(smallest, MIN_CLEANUP_VOXELS)), "kept")
    return G.negate(materialize(G.keep_largest(G.negate(kept, grid), grid), "outside"), grid)


def _to_world(vertex: DataFrame, grid: Grid, jitter: bool) -> DataFrame:
    world = apply_affine(grid.affine, vec(""))
    if jitter:
        world = [w + j for w, j in zip(world, mesh_jitter(F.col("vid")), strict=True)]
    return vertex.select("vid", *[w.alias(c) for w, c in zip(world, "xyz", strict=True)])


def surface_from_field(wm: VoxelField, params: SurfaceParams = SurfaceParams(), *, jitter: bool = True) -> Mesh | None:
    """Cleaned, welded and smoothed iso-surface with inward normals; None if nothing is left at some step."""
    grid, iso = wm.grid, wm.iso
    if min(grid.dims) < 2:
        return None
    mask = materialize(G.above(wm.field, iso), "above")
    if not params.morph_cleanup and params.min_component_voxels > 1:
        mask = materialize(G.drop_small(mask, grid, params.min_component_voxels), "above")
    if mask.count() < params.min_mask_voxels:
        return None
    if params.morph_cleanup:
        clean = clean_mask(mask, grid, params.min_component_voxels).select("flat", F.lit(True).alias("m"))
        soft = wm.field.join(clean, "flat", "left").select("flat", "i", "j", "k", F.when(F.col("m"), F.col("value")).otherwise(F.col("value") * OUTSIDE_ATTENUATION).alias("value"))
        scalar = G.mean_filter(soft, grid, 1)
    else:
        scalar = wm.field.join(mask.select("flat"), "flat", "left_semi")
    vertex, triangle = marching_cubes(materialize(scalar, "density"), grid, iso)
    if triangle.isEmpty():
        return None
    vertex = _to_world(vertex, grid, jitter)
    if params.min_mesh_vertices > 1:
        labels = materialize(mesh_components(vertex, triangle), "mesh-labels")
        large = labels.where("label > 0").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_mesh_vertices)
        kept = labels.join(large, "label", "left_semi").select(F.col("vid").alias("a"))
        vertex, triangle = subset(vertex, triangle, triangle.join(kept, "a", "left_semi"))
        if triangle.isEmpty():
            return None
    vertex = taubin(vertex, triangle, params.taubin_lambda, params.taubin_mu, params.mesh_smooth_iters)
    vertex = materialize(vertex, "smooth")
    return Mesh(with_normals(vertex, triangle), triangle.select("tid", "a", "b", "c"))


def surface_from_mask(mask: DataFrame, grid: Grid, params: SurfaceParams = SurfaceParams(), *, jitter: bool = True) -> Mesh | None:
    """Surface of a 0/1 mask at 0.5 with an outer partner (pial_x..z) at ``pial_offset_mm`` along the normal."""
    if min(grid.dims) < 2 or mask.count() < params.min_mask_voxels:
        return None
    vertex, triangle = marching_cubes(mask.withColumn("value", F.lit(1.0)), grid, 0.5)
    if triangle.isEmpty():
        return None
    placed = with_normals(materialize(_to_world(vertex, grid, jitter), "placed"), triangle)
    return Mesh(placed.select("*", *[(F.col(c) + F.lit(float(params.pial_offset_mm)) * F.col(f"n{c}")).alias(f"pial_{c}") for c in "xyz"]), triangle)


def sample_trilinear(points: DataFrame, field: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, q): the field at voxel coordinates (vx, vy, vz); corners off the grid are left out of the weights."""
    base = points.select(*keys, *[F.col(f"v{c}") for c in "xyz"], *[F.floor(f"v{c}").alias(f"b{c}") for c in "xyz"])
    corner = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(corner_offset(c), "xyz", strict=True)]) for c in range(8)])).alias("o")
    spread = base.select("*", corner)
    weight = F.lit(1.0)
    for c in "xyz":
        part = F.col(f"v{c}") - F.col(f"b{c}")
        weight = weight * F.when(F.col(f"o.{c}") == 1, part).otherwise(1 - part)
    at = [F.col(f"b{c}") + F.col(f"o.{c}") for c in "xyz"]
    spread = spread.select(*keys, weight.alias("w"), *[a.alias(n) for a, n in zip(at, "ijk", strict=True)]).where(in_grid(F.col("i"), F.col("j"), F.col("k"), grid.dims))
    met = spread.select(*keys, "w", flat_index(F.col("i"), F.col("j"), F.col("k"), grid.dims).alias("flat")).join(field.select("flat", "value"), "flat", "left")
    sums = met.groupBy(*keys).agg(F.sum("w").alias("__w"), F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("__s"))
    return points.select(*keys).join(sums, keys, "left").select(*keys, F.when(F.col("__w") > 1e-9, F.col("__s") / F.col("__w")).otherwise(F.lit(0.0)).alias("q"))


def _in_voxels(points: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    return points.select(*keys, *[v.alias(f"v{c}") for v, c in zip(apply_affine(grid.inverse(), vec("")), "xyz", strict=True)])


#: Rows of vertices, triangles and field, and cells of the grid, that one task may hold to shrink-wrap a mesh by itself.
ONE_TASK_ROWS, ONE_TASK_CELLS = 2_000_000, 16_000_000


def shrink_wrap(mesh: Mesh, wm: VoxelField, params: ShrinkWrapParams = ShrinkWrapParams(), *, one_task_rows: int = ONE_TASK_ROWS) -> Mesh:
    """Move vertices inward, up to half-way to where the field first reaches the target; those without a crossing hold.

    A mesh and field of at most ``one_task_rows`` rows are one task, which does
    all iterations; larger ones take joins, some of them for each iteration.
    """
    triangle = materialize(mesh.triangle.select("tid", "a", "b", "c"), "wrap-triangles")
    vertex, field = materialize(mesh.vertex.select("vid", "x", "y", "z"), "wrap-vertices"), materialize(wm.field, "wrap-field")
    rows = vertex.count() + triangle.count() + field.count()
    wrapped = _wrap_in_one_task if rows <= one_task_rows and wm.grid.size <= ONE_TASK_CELLS else _wrap_by_joins
    return Mesh(with_normals(materialize(wrapped(vertex, triangle, field, wm.grid, params), "wrapped"), triangle), triangle)


def _wrap_by_joins(vertex: DataFrame, triangle: DataFrame, field: DataFrame, grid: Grid, params: ShrinkWrapParams) -> DataFrame:
    steps = math.ceil(params.max_search_mm / params.step_mm)
    for n in range(1, params.n_iters + 1):
        normals = materialize(vertex.join(vertex_normals(vertex, triangle), "vid"), "wrap-normals")
        free = normals.where(dot(vec("n"), vec("n")) >= 1e-6)
        rays = free.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("s"))
        rays = rays.select("vid", "s", *[(F.col(c) + F.col("s") * params.step_mm * F.col(f"n{c}")).alias(c) for c in "xyz"])
        reached = sample_trilinear(_in_voxels(rays, grid, ["vid", "s"]), field, grid, ["vid", "s"]).where(F.col("q") >= params.target_iso)
        first = reached.groupBy("vid").agg(F.min("s").alias("s")).where("s > 0")
        go = F.greatest(F.least(F.col("s") * params.step_mm * 0.5, F.lit(params.step_mm)), F.lit(params.step_mm * 0.25))
        moved = normals.join(first.select("vid", go.alias("go")), "vid", "left").withColumn("go", F.coalesce("go", F.lit(0.0)))
        moved = materialize(moved.select("vid", *[(F.col(c) + F.col("go") * F.col(f"n{c}")).alias(c) for c in "xyz"], "go"), "wrap")
        largest, count = moved.agg(F.max("go"), F.count_if(F.col("go") > 1e-6)).first()
        vertex = moved.select("vid", "x", "y", "z")
        if params.smooth_every and n % params.smooth_every == 0:
            vertex = materialize(taubin(vertex, triangle, params.taubin_lambda, params.taubin_mu, 1), "wrap-smooth")
        log.info("shrink-wrap %d: %d vertices moved, at most %.3f mm", n, count, largest or 0.0)
        if (largest or 0.0) < params.convergence_eps_mm:
            break
    return vertex


def _wrap_in_one_task(vertex: DataFrame, triangle: DataFrame, field: DataFrame, grid: Grid, params: ShrinkWrapParams) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = vertex.select(F.lit(0).alias("kind"), F.col("vid").alias("a"), zero.alias("b"), zero.alias("c"), "x", "y", "z")
    rows = rows.unionByName(triangle.select(F.lit(1).alias("kind"), "a", "b", "c", *[F.lit(0.0).alias(c) for c in "xyz"]))
    rows = rows.unionByName(field.select(F.lit(2).alias("kind"), F.col("flat").alias("a"), zero.alias("b"), zero.alias("c"), F.col("value").alias("x"), *[F.lit(0.0).alias(c) for c in "yz"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one task has all rows, and a mesh has some
        kind = table.column("kind").to_numpy()
        number = np.stack([table.column(c).to_numpy() for c in "abc"], 1)
        place = np.stack([table.column(c).to_numpy() for c in "xyz"], 1)
        order = np.argsort(number[kind == 0, 0], kind="stable")
        vid, at = number[kind == 0, 0][order], place[kind == 0][order]
        volume = np.zeros(grid.size)
        volume[number[kind == 2, 0]] = place[kind == 2, 0]
        at = _wrap(at, np.searchsorted(vid, number[kind == 1]), volume.reshape(grid.dims), grid.inverse(), params)
        yield pa.RecordBatch.from_arrays([pa.array(vid), *[pa.array(at[:, c]) for c in range(3)]], names=["vid", "x", "y", "z"])

    return rows.coalesce(1).mapInArrow(run, "vid long, x double, y double, z double")


def _wrap(at: np.ndarray, tri: np.ndarray, volume: np.ndarray, inverse: np.ndarray, params: ShrinkWrapParams) -> np.ndarray:
    """All iterations on arrays: positions, corners as rows of them, the dense field."""
    steps, step = math.ceil(params.max_search_mm / params.step_mm), params.step_mm
    ring = np.unique(np.concatenate([tri[:, [p, q]] for p, q in ((0, 1), (1, 0), (1, 2), (2, 1), (2, 0), (0, 2))]), axis=0)
    ring = ring[ring[:, 0] != ring[:, 1]]
    mates = np.bincount(ring[:, 0], minlength=len(at))[:, None]

    def gathered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, c], len(at)) for c in range(3)], 1)

    def towards_ring(x: np.ndarray, factor: float) -> np.ndarray:
        mean = gathered(ring[:, 0], x[ring[:, 1]]) / np.maximum(mates, 1)
        return np.where(mates > 0, x + factor * (mean - x), x)

    def sampled(x: np.ndarray) -> np.ndarray:
        v = x @ inverse[:3, :3].T + inverse[:3, 3]
        base = np.floor(v)
        part, base = v - base, base.astype(np.int64)
        total, weight = np.zeros(len(x)), np.zeros(len(x))
        for corner in range(8):
            shift = np.array(corner_offset(corner))
            w, c = np.where(shift == 1, part, 1 - part).prod(1), base + shift
            inside = ((c >= 0) & (c < volume.shape)).all(1)
            c = np.where(inside[:, None], c, 0)
            total += np.where(inside, w * volume[c[:, 0], c[:, 1], c[:, 2]], 0.0)
            weight += np.where(inside, w, 0.0)
        return np.where(weight > 1e-9, total / np.where(weight > 1e-9, weight, 1.0), 0.0)

    for n in range(1, params.n_iters + 1):
        a, b, c = (at[tri[:, k]] for k in range(3))
        face = np.cross(b - a, c - a)
        normal = sum(gathered(tri[:, k], face) for k in range(3))
        length = np.sqrt(np.square(normal).sum(1, keepdims=True))
        normal = np.where(length > 1e-9, normal / np.where(length > 1e-9, length, 1.0), normal)
        open_, go = np.flatnonzero(np.square(normal).sum(1) >= 1e-6), np.zeros(len(at))
        for s in range(steps + 1):
            hit = sampled(at[open_] + s * step * normal[open_]) >= params.target_iso
            go[open_[hit]] = max(min(s * step * 0.5, step), step * 0.25) if s else 0.0
            open_ = open_[~hit]
        at = at + go[:, None] * normal
        if params.smooth_every and n % params.smooth_every == 0:
            at = towards_ring(towards_ring(at, params.taubin_lambda), params.taubin_mu)
        if go.max(initial=0.0) < params.convergence_eps_mm:
            break
    return at


def vertex_sides(mesh: Mesh, wm: VoxelField, erode_iterations: int, midline_slab_mm: float = 0.0) -> DataFrame:
    """(vid, side): 1 left, 2 right, from the two largest components of the eroded mask, else from the sign of x."""
    grid = wm.grid
    mask = materialize(G.above(wm.field, wm.iso), "split-above")
    a = grid.affine[0]
    x_of = F.lit(a[0]) * (F.col("i") + 0.5) + F.lit(a[1]) * (F.col("j") + 0.5) + F.lit(a[2]) * (F.col("k") + 0.5) + F.lit(a[3])
    core = mask.where(F.abs(x_of) >= midline_slab_mm) if midline_slab_mm > 0 else mask
    labels = materialize(G.components(G.erode(core, grid, erode_iterations), grid), "split-labels")
    top = G.component_sizes(labels).orderBy(F.desc("count"), "label").limit(2).collect()
    by_sign = F.when(F.col("x") < 0, 1).otherwise(2)
    if len(top) < 2 or top[1]["count"] < SECOND_HEMISPHERE_SHARE * top[0]["count"]:
        return mesh.vertex.select("vid", by_sign.alias("side"))
    seeds = labels.select("flat", F.when(F.col("label") == top[0]["label"], 1).when(F.col("label") == top[1]["label"], 2).otherwise(0).alias("label"))
    spread = materialize(G.with_ijk(G.propagate_labels(seeds, mask, grid).select("flat", "label"), grid), "split-spread")
    means = {r["label"]: r["m"] for r in spread.groupBy("label").agg(F.avg(x_of).alias("m")).collect()}
    left = 1 if means.get(1, 0.0) < means.get(2, 0.0) else 2
    voxels = _in_voxels(mesh.vertex, grid, ["vid", "x"])
    # halves are rounded away from zero
    nearest = [F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.signum(f"v{c}") * F.floor(F.abs(f"v{c}") + 0.5)).cast("int"))) for c, n in zip("xyz", grid.dims, strict=True)]
    around = [(0, 0, 0), *[s for s in G.CUBE if s != (0, 0, 0)]]  # the voxel itself, then the others in order
    at = voxels.select("vid", "x", *[v.alias(c) for v, c in zip(nearest, "ijk", strict=True)])
    looked = G.scatter(at, grid, around, ["vid"]).join(spread.select("flat", "label"), "flat")
    best = looked.groupBy("vid").agg(F.min_by("label", "n").alias("label"))
    side = F.when(F.col("label").isNull(), by_sign).when(F.col("label") == left, 1).otherwise(2)
    return mesh.vertex.select("vid", "x").join(best, "vid", "left").select("vid", side.alias("side"))


def split_hemispheres(mesh: Mesh, wm: VoxelField, erode_iterations: int, midline_slab_mm: float = 0.0) -> dict[str, Mesh]:
    return hemispheres(mesh, materialize(vertex_sides(mesh, wm, erode_iterations, midline_slab_mm), "vertex-sides"))
