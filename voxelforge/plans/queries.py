"""One query for each operator over the derived views; floats are rounded for comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import fixel_jitter, fixel_jitter_hash, mesh_jitter
from ..operators import grid as G
from ..operators import index as X
from ..operators import mesh as M
from ..operators import reduce as R
from ..operators import spatial as S
from ..operators import surface as U
from ..operators import trace as T
from ..operators import transport as P
from ..schema import Mesh, ShrinkWrapParams, SurfaceParams, TraceParams, TransportParams, VoxelField
from ..sources import dataset as D
from ..sources import nifti
from ..tables import materialize, new_path
from . import views as V

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero as zero."""
    return df.select(*[(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _dpf_query(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = V.dataset(spark, sf_dir)
        return rounded(R.reduce_dpf(ds.voxel, ds.fixel, ds.dpf["quantity"], how))

    run.__name__ = f"voxel_reduce_{how}"
    run.__doc__ = f"Per-voxel {how} of a per-fixel scalar."
    return query(run)


for _how in ("max", "sum", "mean"):
    _dpf_query(_how)


@query
def primary_peak_first_vs_max(spark, sf_dir):
    ds = V.dataset(spark, sf_dir)
    qa = R.primary_peak_qa(ds.voxel, ds.fixel).withColumnRenamed("value", "max_amp")
    return rounded(qa.join(R.first_peak(ds.fixel), "voxel_idx", "left"), 9)


@query
def otsu_threshold(spark, sf_dir):
    ds = V.dataset(spark, sf_dir)
    return rounded(R.otsu_bins(R.primary_peak_qa(ds.voxel, ds.fixel)).select(F.col("bin").cast("long").alias("bin"), "threshold"))


@query
def qa_diagnostics(spark, sf_dir):
    ds = V.dataset(spark, sf_dir)
    qa = materialize(R.primary_peak_qa(ds.voxel, ds.fixel), "qa")
    t = R.otsu_threshold(qa)
    return rounded(R.diagnostics(qa, t, t))


@query
def wm_mask(spark, sf_dir):
    return U.mask_otsu(V.dataset(spark, sf_dir)).select("voxel_idx", "i", "j", "k")


@query
def field_otsu(spark, sf_dir):
    wm = U.field_otsu(V.dataset(spark, sf_dir))
    return rounded(wm.field.select("flat", "value", F.lit(wm.iso).alias("iso")), 9)


@query
def field_from_dpf(spark, sf_dir):
    wm = U.field_from_dpf(V.dataset(spark, sf_dir), "quantity", "mean", 0.5, 1)
    return rounded(wm.field.select("flat", "value", F.lit(wm.iso).alias("iso")))


@query
def field_from_dpv(spark, sf_dir):
    wm = U.field_from_dpv(V.dataset(spark, sf_dir), "totalprice", 1.0, 0)
    return rounded(wm.field.select("flat", "value", F.lit(wm.iso).alias("iso")))


def _built(index: X.FixelIndex) -> DataFrame:
    return rounded(index.fixels.select("fixel_id", "voxel_idx", "px", "py", "pz", "dx", "dy", "dz", F.col("amplitude").alias("amp_norm")))


@query
def fixels_build(spark, sf_dir):
    return _built(X.build(V.fixel(spark, sf_dir)))


@query
def fixels_threshold(spark, sf_dir):
    return _built(X.build_threshold(V.fixel(spark, sf_dir), 0.4))


@query
def fixels_otsu(spark, sf_dir):
    return _built(X.build_otsu(V.fixel(spark, sf_dir), 1.0))


@query
def fixels_qa_otsu(spark, sf_dir):
    return _built(X.build_qa_otsu(V.fixel(spark, sf_dir), 1.0))


@query
def fixels_qa_threshold(spark, sf_dir):
    return _built(X.build_qa_threshold(V.fixel(spark, sf_dir), 0.4))


@query
def fixels_voxel_filtered(spark, sf_dir):
    good = V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("voxel_idx"))
    return _built(X.build_voxel_filtered(V.fixel(spark, sf_dir), good))


@query
def fixel_jitter_hashes(spark, sf_dir):
    ids = V.lines(spark, sf_dir).select("fixel_id")
    hashes = [fixel_jitter_hash(F.col("fixel_id"), s).alias(f"h{n}") for n, s in enumerate((0x1F1F1F1F, 0x2A2A2A2A, 0x3B3B3B3B))]
    return rounded(ids.select("fixel_id", *hashes, *[j.alias(f"j{c}") for j, c in zip(fixel_jitter(F.col("fixel_id")), "xyz", strict=True)]), 9)


@query
def mesh_jitter_hashes(spark, sf_dir):
    ids = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vid"))
    return ids.select("vid", *[j.alias(f"j{c}") for j, c in zip(mesh_jitter(F.col("vid")), "xyz", strict=True)])


def _synthetic(spark, sf_dir, jitter: bool = True) -> X.FixelIndex:
    return X.from_handles(V.synthetic(spark, sf_dir), jitter=jitter)


@query
def synthetic_from_handles(spark, sf_dir):
    return _built(_synthetic(spark, sf_dir))


@query
def lookup_contains(spark, sf_dir):
    fixel = V.fixel(spark, sf_dir)
    index = X.build_threshold(fixel, 0.4)
    return index.flag(fixel.select("fixel_id")).select("fixel_id", "present", F.lit(index.count()).alias("n_kept"), F.lit(index.nb_peaks).alias("nb_peaks"))


@query
def range_neighbours(spark, sf_dir):
    return rounded(S.neighbours_within(_synthetic(spark, sf_dir).fixels, 3.0))


@query
def nearest_16(spark, sf_dir):
    return rounded(S.nearest(_synthetic(spark, sf_dir).fixels).select("a", "b", "d2"))


@query
def median_nn(spark, sf_dir):
    d = S.median_neighbour_distance(_synthetic(spark, sf_dir).fixels)
    return rounded(spark.createDataFrame([(d,)], "distance double"))


@query
def data_support(spark, sf_dir):
    fixels = X.build(V.fixel(spark, sf_dir)).fixels
    samples = fixels.select("fixel_id", *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"], *[F.col(f"d{c}").alias(f"u{c}") for c in "xyz"])
    return rounded(S.data_support(samples, fixels, 2.5, 4, ["fixel_id"]))


@query
def ptt_propagator_grid(spark, sf_dir):
    return rounded(P.propagator_table(spark, TransportParams()).select("k1", "k2", *P.COEFFICIENTS), 9)


@query
def ptt_frames(spark, sf_dir):
    return rounded(P.frames(_synthetic(spark, sf_dir).fixels, ["fixel_id"]))


@query
def ptt_walk(spark, sf_dir):
    start = P.frames(_synthetic(spark, sf_dir).fixels, ["fixel_id"])
    step = [F.lit(x) for x in P.propagator(0.1, -0.05, 1.25)]
    return rounded(P.walk(start, step))


# a radius of 2.5 would put the seed itself exactly on the edge of the third sample
@query
def arc_likelihood_straight(spark, sf_dir):
    fixels = _synthetic(spark, sf_dir).fixels
    return rounded(P.best_arcs(fixels, fixels, TransportParams(support_radius_mm=2.4, n_k_samples=1)))


@query
def best_arc_likelihood(spark, sf_dir):
    fixels = _synthetic(spark, sf_dir).fixels
    return rounded(P.best_arcs(fixels, fixels, TransportParams(support_radius_mm=2.4)))


@query
def fanned_probe(spark, sf_dir):
    fixels = _synthetic(spark, sf_dir).fixels
    return rounded(P.best_arcs(fixels, fixels, TransportParams(support_radius_mm=2.4, n_k_samples=1, probe_radius_mm=1.0, probe_count=6)))


@query
def capture_visited(spark, sf_dir):
    """Fixels of the lineitem field near a diagonal path through the grid."""
    points = spark.range(200).select(*[(F.col("id") * step).alias(f"q{c}") for c, step in zip("xyz", (0.11, 0.2, 0.19), strict=True)], *[F.lit(1 / math.sqrt(3)).alias(f"u{c}") for c in "xyz"])
    return S.capture_visited(points, X.build(V.fixel(spark, sf_dir)).fixels, 2.0, 0.7)


@query
def polyline_length(spark, sf_dir):
    return rounded(T.polyline_lengths(V.polylines(spark, sf_dir)))


TRACE = TraceParams(step_mm=1.7, max_length_mm=8.0, min_length_mm=5.0, max_angle_deg=45.0)


@query
def trace_streamlines(spark, sf_dir):
    """From every fixel through the fixels of the bundles 0 to 4."""
    fixels = _synthetic(spark, sf_dir).fixels
    members = V.synthetic(spark, sf_dir).where("bundle < 5").select("fixel_id")
    seeds = fixels.select(F.col("fixel_id").alias("sid"), "fixel_id")
    return rounded(T.trace_within(fixels, members, seeds, TRACE).withColumn("idx", F.col("idx").cast("long")))


@query
def trace_all_bundles(spark, sf_dir):
    """From every fixel through all fixels, with the tracer's defaults."""
    fixels = _synthetic(spark, sf_dir).fixels
    seeds = fixels.select(F.col("fixel_id").alias("sid"), "fixel_id")
    return rounded(T.trace_within(fixels, fixels.select("fixel_id"), seeds).withColumn("idx", F.col("idx").cast("long")))


def _mean(n: int):
    def run(spark, sf_dir):
        return rounded(G.mean_filter(V.price_field(spark, sf_dir), V.grid(spark, sf_dir), n).select("flat", "value"), 9)

    run.__name__ = f"mean_filter_{n}"
    return query(run)


_mean(1)
_mean(3)


@query
def erode_1(spark, sf_dir):
    return G.erode(V.price_mask(spark, sf_dir), V.grid(spark, sf_dir)).select("flat")


@query
def dilate_1(spark, sf_dir):
    return G.dilate(V.price_mask(spark, sf_dir), V.grid(spark, sf_dir)).select("flat")


@query
def majority_27(spark, sf_dir):
    return G.majority(V.price_mask(spark, sf_dir), V.grid(spark, sf_dir)).select("flat")


@query
def negate_mask(spark, sf_dir):
    return G.negate(V.price_mask(spark, sf_dir), V.grid(spark, sf_dir)).select("flat")


def _sparse(spark, sf_dir) -> DataFrame:
    """A mask with a component that spans the grid and many small ones: o_totalprice above 300000."""
    return V.price_field(spark, sf_dir).where("value > 3.0").select("flat", "i", "j", "k")


@query
def voxel_components(spark, sf_dir):
    return G.components(_sparse(spark, sf_dir), V.grid(spark, sf_dir))


@query
def component_sizes(spark, sf_dir):
    g = V.grid(spark, sf_dir)
    return G.component_sizes(G.components(_sparse(spark, sf_dir), g), g)


@query
def drop_small(spark, sf_dir):
    return G.drop_small(_sparse(spark, sf_dir), V.grid(spark, sf_dir), 5).select("flat")


@query
def keep_largest(spark, sf_dir):
    return G.keep_largest(_sparse(spark, sf_dir), V.grid(spark, sf_dir)).select("flat")


@query
def propagate_labels(spark, sf_dir):
    """The first and the last voxel of the mask spread through it."""
    mask = V.price_mask(spark, sf_dir)
    ends = mask.agg(F.min("flat").alias("a"), F.max("flat").alias("b"))
    seeds = ends.select(F.explode(F.array(F.struct(F.col("a").alias("flat"), F.lit(1).alias("label")), F.struct(F.col("b").alias("flat"), F.lit(2).alias("label")))).alias("s")).select("s.flat", "s.label")
    return G.propagate_labels(seeds, mask, V.grid(spark, sf_dir)).select("flat", F.col("label").cast("long").alias("label"), F.col("level").cast("long").alias("level"))


def _mesh(spark, sf_dir) -> Mesh:
    return Mesh(V.mesh_vertex(spark, sf_dir), V.mesh_triangle(spark, sf_dir))


@query
def mesh_components(spark, sf_dir):
    m = _mesh(spark, sf_dir)
    return M.mesh_components(m.vertex, m.triangle)


@query
def one_ring(spark, sf_dir):
    return M.one_ring(V.mesh_triangle(spark, sf_dir))


@query
def taubin_1(spark, sf_dir):
    m = _mesh(spark, sf_dir)
    return rounded(M.taubin(m.vertex, m.triangle, 0.5, -0.53, 1), 3)


@query
def vertex_normals(spark, sf_dir):
    m = _mesh(spark, sf_dir)
    return rounded(M.vertex_normals(m.vertex, m.triangle))


@query
def mesh_volume(spark, sf_dir):
    m = _mesh(spark, sf_dir)
    return rounded(M.volume(m.vertex, m.triangle), 3)


@query
def split_x_sign(spark, sf_dir):
    m = _mesh(spark, sf_dir)
    return M.split_by_x_sign(m.vertex, m.triangle)


@query
def subset_mesh(spark, sf_dir):
    """Majority side of each triangle by the parity of price, and the right side renumbered."""
    m = _mesh(spark, sf_dir)
    sides = m.vertex.select("vid", F.when(F.col("z") > 1.5, 2).otherwise(1).alias("side"))
    _, triangle = M.subset(m.vertex, m.triangle, M.majority_side(m.triangle, sides).where("side = 2"))
    return triangle.select(*[F.col(c).cast("long").alias(c) for c in ("tid", "old_tid", "a", "b", "c")])


@query
def visualisation_pair(spark, sf_dir):
    m = _mesh(spark, sf_dir)
    return rounded(M.visualisation_pair(M.with_normals(m.vertex, m.triangle), 2.0), 9)


@query
def trilinear_sample(spark, sf_dir):
    points = V.synthetic(spark, sf_dir).select("fixel_id", *[(F.col(f"p{c}") + 8.0).alias(f"v{c}") for c in "xyz"])
    return rounded(U.sample_trilinear(points, V.price_field(spark, sf_dir), V.grid(spark, sf_dir), ["fixel_id"]))


def _phantom(spark, sf_dir) -> VoxelField:
    """A ball around the middle of the grid, roughened by the prices."""
    g = V.grid(spark, sf_dir)
    gap = [F.col(c) - (n - 1) / 2 for c, n in zip("ijk", g.dims, strict=True)]
    value = F.greatest(F.lit(0.0), 12.0 - F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) + F.col("value") / 10)
    return VoxelField(materialize(V.price_field(spark, sf_dir).withColumn("value", value), "phantom"), g, 4.0)


@query
def surface_from_mask(spark, sf_dir):
    mesh = U.surface_from_mask(V.price_mask(spark, sf_dir), V.grid(spark, sf_dir), SurfaceParams())
    return rounded(mesh.vertex)


def _surface(spark, sf_dir) -> tuple[Mesh, VoxelField]:
    wm = _phantom(spark, sf_dir)
    return U.surface_from_field(wm, SurfaceParams(min_mesh_vertices=50)), wm


@query
def surface_from_field(spark, sf_dir):
    return rounded(_surface(spark, sf_dir)[0].vertex)


@query
def weld(spark, sf_dir):
    """Counts of the welded surface: vertices, triangles and edges, of which each joins two triangles or is at the border."""
    vertex, triangle = U.marching_cubes(V.price_field(spark, sf_dir), V.grid(spark, sf_dir), 1.5)
    edges = triangle.select(F.explode(F.array(*[F.array_sort(F.array(p, q)) for p, q in ("ab", "bc", "ca")])).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    counts = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 2).alias("inner_edges"), F.max("n").alias("most"))
    return counts.crossJoin(vertex.agg(F.count("*").alias("vertices"))).crossJoin(triangle.agg(F.count("*").alias("triangles")))


@query
def shrink_wrap(spark, sf_dir):
    mesh, wm = _surface(spark, sf_dir)
    return rounded(U.shrink_wrap(mesh, wm, ShrinkWrapParams(target_iso=5.0)).vertex)


@query
def split_hemispheres(spark, sf_dir):
    mesh, wm = _surface(spark, sf_dir)
    halves = U.split_hemispheres(mesh, wm, 1)
    return rounded(halves["lh"].vertex.withColumn("hemi", F.lit("lh")).unionByName(halves["rh"].vertex.withColumn("hemi", F.lit("rh"))))


@query
def write_roundtrip_dpf(spark, sf_dir):
    path = new_path(spark, "dataset")
    D.write_dataset(V.dataset(spark, sf_dir), path)
    D.write_dpf(V.lines(spark, sf_dir).select("fixel_id", F.col("l_linenumber").alias("value")), path, "line", "u8")
    D.write_dpf(V.lines(spark, sf_dir).select("fixel_id", F.col("l_quantity").alias("value")), path, "quantity", "f32")
    ds = D.open_dataset(spark, path)
    return ds.dpf["line"].select("fixel_id", F.col("value").cast("long").alias("line")).join(ds.dpf["quantity"].select("fixel_id", F.col("value").cast("double").alias("quantity")), "fixel_id")


@query
def write_roundtrip_dpv(spark, sf_dir):
    path = new_path(spark, "dataset")
    cust = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("voxel_idx"), F.col("o_custkey").alias("value"))
    D.write_dpv(cust, path, "customer", "u32")
    D.write_dpv(cust.withColumn("value", F.col("value") % 1000), path, "customer16", "u16")
    read = lambda n: spark.read.parquet(f"{path}/dpv/{n}").select("voxel_idx", F.col("value").cast("long").alias(n))
    return read("customer").join(read("customer16"), "voxel_idx")


@query
def write_roundtrip_group(spark, sf_dir):
    path = new_path(spark, "dataset")
    orders = V.table(spark, sf_dir, "orders")
    for status in ("F", "O", "O"):
        D.write_voxel_group(orders.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("voxel_idx")), path, f"status_{status}")
    return spark.read.parquet(f"{path}/groups").select("voxel_idx", "group_name")


@query
def streamlines_roundtrip(spark, sf_dir):
    path = new_path(spark, "lines")
    D.write_streamlines(V.polylines(spark, sf_dir), path)
    back = D.read_streamlines(spark, path)
    return rounded(back.select("sid", F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in "xyz"]), 3)


@query
def nifti_roundtrip(spark, sf_dir):
    """A volume of 1 + customer modulo 1000, written to a file in the shared folder and read back."""
    values = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("voxel_idx"), (F.col("o_custkey") % 1000 + 1).alias("value"))
    path = new_path(spark, "volume") + ".nii.gz"
    nifti.write_u16(values, V.voxel(spark, sf_dir), V.grid(spark, sf_dir), path)
    return nifti.read_u16(spark, path)[0].select("i", "j", "k", F.col("value").cast("long").alias("value"))


@query
def catalog(spark, sf_dir):
    path = new_path(spark, "dataset")
    D.write_dataset(V.dataset(spark, sf_dir), path)
    return D.catalog(D.open_dataset(spark, path), spark)


