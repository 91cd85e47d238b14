"""Core operators against known values and brute force."""

import gzip
import itertools
import math
import random
import struct
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelforge.functions.vector import fixel_jitter, mesh_jitter
from voxelforge.operators import grid as G
from voxelforge.operators import index as X
from voxelforge.operators import mesh as M
from voxelforge.operators import reduce as R
from voxelforge.operators import spatial as S
from voxelforge.operators import surface as U
from voxelforge.operators import trace as T
from voxelforge.operators import transport as P
from voxelforge.operators.components import connected_components, numbered_components
from voxelforge.schema import Dataset, Grid, Mesh, ShrinkWrapParams, SurfaceParams, TraceParams, TransportParams, VoxelField
from voxelforge.sources import dataset as D
from voxelforge.sources import nifti
from voxelforge.tables import shared_dir


def handles(spark, positions, directions, amplitudes=None):
    rows = [(i, *map(float, p), *map(float, d), *([float(amplitudes[i])] if amplitudes else [])) for i, (p, d) in enumerate(zip(positions, directions, strict=True))]
    cols = "fixel_id long, px double, py double, pz double, dx double, dy double, dz double" + (", amplitude double" if amplitudes else "")
    return spark.createDataFrame(rows, cols)


def mask_of(spark, grid, cells):
    flat = [(i * grid.dims[1] + j) * grid.dims[2] + k for i, j, k in cells]
    return spark.createDataFrame([(f, i, j, k) for f, (i, j, k) in zip(flat, cells, strict=True)], "flat long, i int, j int, k int")


def line(spark, bits):
    grid = Grid((len(bits), 1, 1))
    return mask_of(spark, grid, [(i, 0, 0) for i, b in enumerate(bits) if b]), grid


def flats(df):
    return sorted(r["flat"] for r in df.select("flat").collect())


def ball(center, radius, dims):
    return [c for c in itertools.product(*map(range, dims)) if sum((x + 0.5 - m) ** 2 for x, m in zip(c, center, strict=True)) <= radius**2]


def test_from_handles(spark):
    index = X.from_handles(handles(spark, [(0, 0, 0), (2, 0, 0), (10, 0, 0)], [(5, 0, 0), (0, 3, 0), (0, 0, 1)]))
    assert index.nb_peaks == index.count() == 3
    h = index.handle(1)
    assert (h["dx"], h["dy"], h["dz"]) == (0, 1, 0)
    assert all(abs(h[f"p{c}"] - v) <= 0.005 for c, v in zip("xyz", (2, 0, 0), strict=True))
    near = S.neighbours_within(index.fixels, 3.0).where("a = 0").collect()
    assert sorted(r["b"] for r in near) == [0, 1]
    with pytest.raises(KeyError):
        index.handle(7)


def test_amplitudes_are_divided_by_the_upper_median(spark):
    index = X.from_handles(handles(spark, [(0, 0, 0), (5, 0, 0), (10, 0, 0)], [(1, 0, 0)] * 3, [2, 4, 8]))
    assert [r["amplitude"] for r in index.handles().collect()] == [0.5, 1, 2]
    four = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "x double")
    assert R.upper_median(four, "x") == 4
    assert R.upper_median(four.where("x > 9"), "x") is None


def test_upper_median_narrows_down(spark, monkeypatch):
    monkeypatch.setattr(R, "SELECT_ROWS", 10)
    values = [random.Random(1).choice([1.0, 2.5, 1e6, -3.0, 7.25, random.Random(i).random()]) for i in range(501)]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), float("inf")]], "x double")
    assert R.upper_median(df, "x") == sorted(values)[501 // 2]


def test_jitter_hashes(spark):
    ids = spark.createDataFrame([(0,), (1,), (2,), (1000,)], "id long")
    got = {r[0]: r[1:] for r in ids.select("id", *fixel_jitter(F.col("id"))).collect()}
    assert np.allclose(got[0], [0.00075826] * 3, atol=1e-8)
    assert np.allclose(got[1], [-0.00140634, 0.00351140, -0.00166944], atol=1e-8)
    assert np.allclose(got[1000], [-0.00291521, -0.00292435, 0.00292035], atol=1e-8)
    got = {r[0]: r[1:] for r in ids.select("id", *mesh_jitter(F.col("id"))).collect()}
    assert np.allclose(got[0], [-0.01] * 3)
    assert np.allclose(got[2], [0.00236053, -0.00999725, -0.00039490], atol=1e-8)


def test_reductions_and_missing_values(spark):
    voxel = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 0, 0)], "voxel_idx long, i int, j int, k int")
    nan = float("nan")
    values = spark.createDataFrame([(0, nan), (0, 1.0), (1, -1.0), (1, -2.0), (3, 2.0), (3, 4.0)], "voxel_idx long, value double")
    get = lambda how: [r["value"] for r in R.reduce_to_voxel(voxel, values, how).orderBy("voxel_idx").collect()]
    assert get("max") == [1, 0, 0, 4]
    s, m = get("sum"), get("mean")
    assert math.isnan(s[0]) and s[1:] == [-3, 0, 6] and math.isnan(m[0]) and m[1:] == [-1.5, 0, 3]
    with pytest.raises(ValueError):
        get("median")
    fixel = spark.createDataFrame([(0, 0), (1, 0)], "fixel_id long, voxel_idx long")
    with pytest.raises(ValueError):
        R.reduce_dpf(voxel, fixel, spark.createDataFrame([(0, 1.0)], "fixel_id long, value double"), "max")


def test_otsu(spark):
    two = spark.createDataFrame([(0.1,)] * 100 + [(1.0,)] * 100, "value double")
    assert R.otsu_threshold(two) == pytest.approx(0.1015625)
    same = spark.createDataFrame([(1.0,)] * 10, "value double")
    assert R.otsu_threshold(same) == 0.0
    assert R.otsu_threshold(same.where("value > 2")) == 0.0


def test_filters_keep_or_drop_missing_amplitudes(spark):
    nan = float("nan")
    rows = [(0, 0, 0, nan), (1, 0, 1, 5.0), (2, 1, 0, 1.0), (3, 2, 0, 5.0), (4, 2, 1, 0.1)]
    fixel = spark.createDataFrame([(a, v, p, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, x) for a, v, p, x in rows], "fixel_id long, voxel_idx long, peak_no int, px double, py double, pz double, dx double, dy double, dz double, amplitude double")
    kept = lambda i: [r["fixel_id"] for r in i.handles().collect()]
    assert kept(X.build_threshold(fixel, 2.0)) == [0, 1, 3]
    assert 0 not in kept(X.build_otsu(fixel))
    assert kept(X.build_qa_threshold(fixel, 2.0)) == [3, 4]
    assert kept(X.build_qa_threshold(fixel, 1.0)) == [2, 3, 4]
    assert X.build_qa_threshold(fixel, 1.0).nb_peaks == 5
    bare = fixel.withColumn("amplitude", F.lit(None).cast("double"))
    for index in (X.build_otsu(bare), X.build_qa_otsu(bare), X.build_qa_threshold(bare, 1.0)):
        assert index.count() == index.nb_peaks == 5 and index.threshold is None


def test_range_join_and_nearest_match_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(120, 3)) * 4
    index = X.from_handles(handles(spark, pts, [(1, 0, 0)] * 120), jitter=False)
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    got = {(r["a"], r["b"]) for r in S.neighbours_within(index.fixels, 2.0).collect()}
    assert got == {(a, b) for a in range(120) for b in range(120) if d2[a, b] <= 4}
    near = S.nearest(index.fixels, 5).groupBy("a").agg(F.sort_array(F.collect_list("d2")).alias("d")).collect()
    assert len(near) == 120
    for r in near:
        assert np.allclose(r["d"], np.sort(d2[r["a"]])[:5])
    first = np.sort(np.sqrt(np.sort(d2, 1)[:, 1]))
    assert S.median_neighbour_distance(index.fixels) == pytest.approx(first[60])


@pytest.mark.parametrize(("power", "group"), [(4, 50_000), (3, 20), (2, 7)])
def test_support_matches_brute_force(spark, power, group):
    rng = np.random.default_rng(8)
    pts, dirs, amps = rng.normal(size=(150, 3)) * 3, rng.normal(size=(150, 3)), rng.random(150).tolist()
    pts[3:9] = pts[2]  # ties
    amps[5] = float("nan")
    index = X.from_handles(handles(spark, pts, dirs, amps), jitter=False).fixels
    samples = index.select("fixel_id", *[F.col(f"p{c}").alias(f"q{c}") for c in "xyz"], *[F.col(f"d{c}").alias(f"u{c}") for c in "xyz"])
    lost = samples.where("fixel_id = 0").select((F.col("fixel_id") - 1).alias("fixel_id"), F.lit(None).cast("double").alias("qx"), "qy", "qz", "ux", "uy", "uz")
    parts = S.support_parts(samples.unionByName(lost), index, 2.5, power, ["fixel_id"], group=group, point_group=3 * group)
    got = {r["fixel_id"]: r["s"] for r in parts.groupBy("fixel_id").agg(F.sum("support").alias("s")).collect()}
    assert got.pop(-1) == 0
    rows = index.orderBy("fixel_id").collect()
    d = np.array([[r[f"d{c}"] for c in "xyz"] for r in rows])
    a = np.nan_to_num(np.array([r["amplitude"] for r in rows]), nan=1.0)
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= 2.5**2
    want = (near * np.abs(d @ d.T) ** power * a).sum(1)
    assert [got[i] for i in range(150)] == pytest.approx(want.tolist())


def test_propagator_and_frames(spark):
    assert P.propagator(0, 0, 2.5) == [2.5, 0, 0, 1, 0, 0, 0, 0, 1]
    assert P.propagator(-5e-5, 0.1, 1) == P.propagator(1e-4, 0.1, 1)
    index = X.from_handles(handles(spark, [(0, 0, 0), (1, 1, 1)], [(0, 0, 1), (1, 0.1, 0)]))
    for r in P.walk(P.frames(index.fixels, ["fixel_id"]), [F.lit(x) for x in P.propagator(0.1, -0.2, 1.0)]).collect():
        f = np.array([[r[f"{a}{c}"] for c in "xyz"] for a in "uvw"])
        assert np.allclose(f @ f.T, np.eye(3), atol=1e-9)


def test_arcs_equal_a_walk_in_numpy(spark):
    rng = np.random.default_rng(5)
    pts, dirs, amps = rng.normal(size=(40, 3)) * 3, rng.normal(size=(40, 3)), rng.random(40) + 0.5
    index = X.from_handles(handles(spark, pts, dirs, amps.tolist()), jitter=False).fixels
    params = TransportParams(n_k_samples=3, probe_radius_mm=0.7, probe_count=3)
    got = {r["fixel_id"]: r["likelihood"] for r in P.best_arcs(index, index, params).collect()}
    rows = index.orderBy("fixel_id").collect()
    p = np.array([[r[f"p{c}"] for c in "xyz"] for r in rows])
    d = np.array([[r[f"d{c}"] for c in "xyz"] for r in rows])
    a = np.array([r["amplitude"] for r in rows])

    def support(q, f):
        out = 0.0
        for j in range(3):
            th = 2 * math.pi * j / 3
            x = q + 0.7 * (math.cos(th) * f[1] + math.sin(th) * f[2])
            near = ((p - x) ** 2).sum(1) <= params.support_radius_mm**2
            out += (np.abs(d[near] @ f[0]) ** 4 * a[near]).sum()
        return out / 3

    for i in (0, 7, 39):
        seed = np.array([1.0, 0, 0]) if abs(d[i][0]) < 0.9 else np.array([0, 1.0, 0])
        n1 = np.cross(seed, d[i])
        n1 /= np.linalg.norm(n1)
        best = 0.0
        for k1, k2 in itertools.product((-0.2, 0.0, 0.2), repeat=2):
            q, f = p[i].copy(), np.stack([d[i], n1, np.cross(d[i], n1)])
            total = support(q, f)
            for _ in range(4):
                m = np.array(P.propagator(k1, k2, 1.25)).reshape(3, 3)
                q = q + m[0] @ f
                t, raw = m[1] @ f, m[2] @ f
                t = t / np.linalg.norm(t)
                n = np.cross(raw, t)
                n = n / np.linalg.norm(n)
                f = np.stack([t, n, np.cross(t, n)])
                total += support(q, f)
            best = max(best, total)
        assert got[i] == pytest.approx(best)


def test_tracer_on_a_straight_line(spark):
    n = 12
    index = X.from_handles(handles(spark, [(1.7 * i, 0, 0) for i in range(n)], [(1, 0, 0)] * n), jitter=False).fixels
    seeds = spark.createDataFrame([(5, 5), (99, 99)], "sid long, fixel_id long")
    out = T.trace_within(index, index.select("fixel_id"), seeds, TraceParams(max_length_mm=40.0)).orderBy("idx").collect()
    x = [r["x"] for r in out]
    assert {r["sid"] for r in out} == {5}
    assert np.allclose(np.diff(x), 1.7)
    # goes on while a member is within 4.25 of the next point
    assert max(x) == pytest.approx(1.7 * (n - 1) + 3.4) and min(x) == pytest.approx(-3.4)
    assert T.trace_within(index, index.select("fixel_id").where("fixel_id < 0"), seeds).isEmpty()


def test_best_aligned_points_leave_cells_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    unit = lambda n: (x := rng.normal(size=(n, 3))) / np.sqrt((x * x).sum(1))[:, None]
    p, d, q, u = rng.normal(size=(400, 3)) * 4, unit(400), rng.normal(size=(300, 3)) * 4, unit(300)
    d[7], d[3], u[:5] = d[9], -d[9], d[9]  # ties, of either sign
    points = pa.table([pa.array(np.arange(400)), *map(pa.array, [*p.T, *d.T])], names=["fixel_id", "px", "py", "pz", "dx", "dy", "dz"])
    probes = pa.table([pa.array(np.arange(300)), pa.array(np.ones(300, np.int32)), *map(pa.array, [*q.T, *u.T])], names=["sid", "sign", "qx", "qy", "qz", "ux", "uy", "uz"])
    for scale in (1.0, 1.001):  # unit directions and others
        near = ((q[:, None] - p) ** 2).sum(2) <= 9
        cos = np.where(near, np.abs(u[:, :1] * d[:, 0] + u[:, 1:2] * d[:, 1] + u[:, 2:] * d[:, 2]) * scale, -1)
        table = points.drop(["dx", "dy", "dz"])
        for c, x in zip("xyz", d.T, strict=True):
            table = table.append_column(f"d{c}", pa.array(x * scale))
        got = T._best(3.0, 0.8)(probes, table).to_pydict()
        assert dict(zip(got["sid"], got["fixel_id"], strict=True)) == {i: int(cos[i].argmax()) for i in range(300) if cos[i].max() > 0.8}


def test_tracing_with_cells_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    d = rng.normal(size=(150, 3))
    index = X.from_handles(handles(spark, (rng.normal(size=(150, 3)) * 3).tolist(), d.tolist()), jitter=False).fixels
    seeds = index.select(F.col("fixel_id").alias("sid"), "fixel_id")
    run = lambda: sorted(map(tuple, T.trace_within(index, index.select("fixel_id"), seeds, TraceParams(max_length_mm=3.4, min_length_mm=1.0)).collect()))
    whole = run()
    assert whole
    monkeypatch.setattr(T, "PROBES", 40)  # cells in parts
    monkeypatch.setattr(T, "POINTS", 30)
    assert run() == whole


def test_mean_filter(spark):
    grid = Grid((5, 1, 1))
    field = spark.createDataFrame([(3, 3, 0, 0, 1.0), (4, 4, 0, 0, 1.0)], "flat long, i int, j int, k int, value double")
    got = {r["flat"]: r["value"] for r in G.mean_filter(field, grid, 1).collect()}
    assert got == pytest.approx({2: 1 / 27, 3: 2 / 27, 4: 2 / 27})
    assert G.mean_filter(field, grid, 0).count() == 2


def test_components_and_small_ones(spark):
    mask, grid = line(spark, [1, 0, 1, 0, 1])
    assert sorted((r["flat"], r["label"]) for r in G.components(mask, grid).collect()) == [(0, 1), (2, 2), (4, 3)]
    mask, grid = line(spark, [1, 1, 0, 1, 0])
    assert flats(G.drop_small(mask, grid, 2)) == [0, 1]
    assert flats(G.keep_largest(mask, grid)) == [0, 1]
    sizes = {r["label"]: r["count"] for r in G.component_sizes(G.components(mask, grid), grid).collect()}
    assert sizes == {0: 2, 1: 2, 2: 1}


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    n = 200
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(i, i + 1) for i in range(20, 60)]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    roots = sorted({root(i) for i in range(n)})
    links = spark.createDataFrame(edges, "u long, v long")
    got = numbered_components(spark.range(n).select(F.col("id").alias("node")), links).collect()
    assert {r["node"]: r["label"] for r in got} == {i: roots.index(root(i)) + 1 for i in range(n)}
    stars, one = ({tuple(r) for r in connected_components(links, one_task=limit).collect()} for limit in (0, 1000))
    assert stars == one == {(i, root(i)) for i in {x for e in edges for x in e if e[0] != e[1]}}


def test_erosion_breaks_a_bridge(spark):
    grid = Grid((7, 3, 3))
    cells = [c for c in itertools.product(range(7), range(3), range(3)) if c[0] in (0, 1, 5, 6) or c[1:] == (1, 1)]
    mask = mask_of(spark, grid, cells)
    assert G.components(mask, grid).select("label").distinct().count() == 1 and mask.count() == 39
    assert sorted((r["i"], r["j"], r["k"]) for r in G.erode(mask, grid).collect()) == [(1, 1, 1), (5, 1, 1)]
    cube = mask_of(spark, Grid((10, 10, 10)), list(itertools.product(range(2, 8), repeat=3)))
    assert G.erode(cube, Grid((10, 10, 10))).count() == 64
    assert G.dilate(cube, Grid((10, 10, 10))).count() == 216 + 6 * 36
    assert G.negate(cube, Grid((10, 10, 10))).count() == 1000 - 216


def test_labels_spread_in_queue_order(spark):
    mask, grid = line(spark, [1] * 5)
    seeds = spark.createDataFrame([(0, 1), (4, 2)], "flat long, label int")
    got = {r["flat"]: r["label"] for r in G.propagate_labels(seeds, mask, grid).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}


def test_labels_spread_like_a_queue_in_a_random_mask(spark):
    rng, dims = random.Random(6), (6, 5, 4)
    grid = Grid(dims)
    cells = [c for c in itertools.product(*map(range, dims)) if rng.random() < 0.75]
    mask = mask_of(spark, grid, cells)
    flat = lambda c: (c[0] * dims[1] + c[1]) * dims[2] + c[2]
    seeds = {flat(c): 1 + n % 2 for n, c in enumerate(rng.sample(cells, 6))}
    want, queue, known = {}, [c for c in sorted(cells, key=flat) if flat(c) in seeds], {flat(c): c for c in cells}
    for c in queue:
        want[flat(c)] = seeds[flat(c)]
    for c in queue:
        for s in G.SIX:
            n = flat(m) if all(0 <= (m := tuple(a + b for a, b in zip(c, s, strict=True)))[x] < dims[x] for x in range(3)) else -1
            if n in known and n not in want:
                want[n] = want[flat(c)]
                queue.append(known[n])
    df = spark.createDataFrame(list(seeds.items()), "flat long, label int")
    assert {r["flat"]: r["label"] for r in G.propagate_labels(df, mask, grid).collect()} == want
    # a wave that crosses several blocks, and ties at their borders
    assert {r["flat"]: r["label"] for r in G.propagate_labels(df, mask, grid, reach=2).collect()} == want


def test_labels_spread_far_in_few_rounds(spark, monkeypatch):
    mask, grid = line(spark, [1] * 2000)
    seeds = spark.createDataFrame([(0, 1), (1999, 2)], "flat long, label int")
    want, rounds, ordered = {n: (1, n) if n < 1000 else (2, 1999 - n) for n in range(2000)}, [], G.ordered_ids
    monkeypatch.setattr(G, "ordered_ids", lambda *a: rounds.append(1) or ordered(*a))
    for cells, most in ((1 << 22, 0), (1200, 2)):  # in one block; in blocks of 400
        monkeypatch.setattr(G, "BLOCK_CELLS", cells)
        assert {r["flat"]: (r["label"], r["level"]) for r in G.propagate_labels(seeds, mask, grid).collect()} == want
        assert len(rounds) <= most
    assert G.widest_reach((15_000, 25, 24), 1 << 22) == 2330 and G.widest_reach((1000, 1000, 1000), 1 << 22) == 53


def test_mesh_components_and_empty_vertices(spark):
    tri = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5), (2, 5, 6, 99)], "tid long, a long, b long, c long")
    vertex = spark.range(8).select(F.col("id").alias("vid"), *[F.lit(0.0).alias(c) for c in "xyz"])
    got = [r["label"] for r in M.mesh_components(vertex, tri).orderBy("vid").collect()]
    assert got == [1, 1, 1, 2, 2, 2, 0, 0]


def test_taubin_keeps_a_plane(spark):
    vertex = spark.createDataFrame([(i, float(i % 3), float(i // 3), 0.1 * (-1) ** i) for i in range(6)], "vid long, x double, y double, z double")
    tri = spark.createDataFrame([(0, 0, 1, 3), (1, 1, 4, 3), (2, 1, 2, 4), (3, 2, 5, 4), (4, 0, 4, 5)], "tid long, a long, b long, c long")
    z = M.taubin(vertex, tri, 0.5, -0.53, 3).agg(F.avg("z")).first()[0]
    assert abs(z) < 0.1


@pytest.mark.parametrize("case", range(256))
def test_every_cell_case_has_closed_oriented_loops(case):
    edges = {tuple(sorted((a, a ^ 1 << d))) for a in range(8) for d in range(3)}
    crossed = {e for e in edges if (case >> e[0] & 1) != (case >> e[1] & 1)}
    tris = U.cell_triangles(case)
    assert {e for t in tris for e in t} == crossed
    for t in tris:
        assert len(set(t)) == 3


def phantom(spark, dims, cells):
    grid = Grid(dims, ((1.0, 0, 0, -dims[0] / 2), (0, 1.0, 0, -dims[1] / 2), (0, 0, 1.0, -dims[2] / 2), (0, 0, 0, 1.0)))
    field = mask_of(spark, grid, cells).withColumn("value", F.lit(1.0))
    return VoxelField(field, grid, 0.5)


def test_surface_of_a_ball(spark):
    wm = phantom(spark, (20, 20, 20), ball((10, 10, 10), 6, (20, 20, 20)))
    mesh = U.surface_from_field(wm, SurfaceParams(min_mask_voxels=10, min_mesh_vertices=0, mesh_smooth_iters=0, morph_cleanup=False, min_component_voxels=0))
    edges = mesh.triangle.select(F.explode(F.array(*[F.array_sort(F.array(p, q)) for p, q in ("ab", "bc", "ca")])).alias("e")).groupBy("e").count()
    assert edges.where("count != 2").isEmpty()  # closed
    volume = M.volume(mesh.vertex, mesh.triangle).first()[0]
    assert volume == pytest.approx(4 / 3 * math.pi * 6**3, rel=0.08)
    # normals point to the middle of the ball, which is at voxel 9.5
    cos = mesh.vertex.select(((F.lit(-0.5) - F.col("x")) * F.col("nx") + (F.lit(-0.5) - F.col("y")) * F.col("ny") + (F.lit(-0.5) - F.col("z")) * F.col("nz")).alias("d"), F.sqrt((F.col("x") + 0.5) ** 2 + (F.col("y") + 0.5) ** 2 + (F.col("z") + 0.5) ** 2).alias("r"))
    assert cos.agg(F.avg(F.col("d") / F.col("r"))).first()[0] > 0.85


def test_surface_of_a_cube_and_of_nothing(spark):
    grid = Grid((10, 10, 10))
    cube = mask_of(spark, grid, list(itertools.product(range(2, 8), repeat=3)))
    mesh = U.surface_from_mask(cube, grid, SurfaceParams(min_mask_voxels=10))
    assert mesh.triangle.count() > 0
    assert mesh.vertex.where("pial_x != x or pial_y != y or pial_z != z").count() > 0
    assert U.surface_from_mask(cube.limit(0), grid, SurfaceParams()) is None


@pytest.mark.parametrize("bridged", [False, True])
def test_hemispheres_are_split_by_components(spark, bridged):
    dims = (32, 16, 16)
    cells = set(ball((8, 8, 8), 6, dims)) | set(ball((24, 8, 8), 6, dims))
    assert len(cells) == 1824
    if bridged:
        cells |= set(itertools.product(range(8, 24), (7, 8), (7, 8)))
        assert len(cells) == 1840
    wm = phantom(spark, dims, sorted(cells))
    mesh = U.surface_from_field(wm, SurfaceParams(min_mesh_vertices=0, mesh_smooth_iters=0, morph_cleanup=False))
    halves = U.split_hemispheres(mesh, wm, 1)
    x = {k: h.vertex.agg(F.avg("x")).first()[0] for k, h in halves.items()}
    assert x["lh"] < 0 < x["rh"]
    assert halves["lh"].triangle.count() + halves["rh"].triangle.count() == mesh.triangle.count()


def test_x_sign_split_and_subset(spark):
    vertex = spark.createDataFrame([(i, float(i - 2), 0.0, 0.0) for i in range(6)], "vid long, x double, y double, z double")
    tri = spark.createDataFrame([(0, 0, 1, 0), (1, 1, 2, 3), (2, 3, 4, 5)], "tid long, a long, b long, c long")
    got = {r["tid"]: r["hemi"] for r in M.split_by_x_sign(vertex, tri).collect()}
    assert got == {0: "lh", 2: "rh"}
    v, t = M.subset(vertex, tri, tri.where("tid = 2"))
    assert [(r["vid"], r["old_vid"]) for r in v.orderBy("vid").collect()] == [(0, 3), (1, 4), (2, 5)]
    assert tuple(t.first()[c] for c in ("tid", "old_tid", "a", "b", "c")) == (0, 2, 0, 1, 2)


def test_trilinear_drops_corners_off_the_grid(spark):
    grid = Grid((2, 2, 2))
    field = spark.createDataFrame([(0, 0, 0, 0, 8.0)], "flat long, i int, j int, k int, value double")
    points = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, -0.5, 0.0, 0.0), (2, 9.0, 9.0, 9.0)], "id long, vx double, vy double, vz double")
    got = {r["id"]: r["q"] for r in U.sample_trilinear(points, field, grid, ["id"]).collect()}
    assert got == pytest.approx({0: 1.0, 1: 8.0, 2: 0.0})


def test_shrink_wrap_moves_inward(spark):
    dims = (16, 16, 16)
    wm = phantom(spark, dims, ball((8, 8, 8), 5, dims))
    mesh = U.surface_from_field(wm, SurfaceParams(min_mask_voxels=10, min_mesh_vertices=0, mesh_smooth_iters=0, morph_cleanup=False, min_component_voxels=0))
    out = U.shrink_wrap(mesh, VoxelField(wm.field, wm.grid, 0.5), ShrinkWrapParams(target_iso=0.9, n_iters=1, smooth_every=0))
    assert M.volume(out.vertex, out.triangle).first()[0] < M.volume(mesh.vertex, mesh.triangle).first()[0]


def test_shrink_wrap_by_joins_equals_one_task(spark):
    dims = (16, 16, 16)
    wm = phantom(spark, dims, ball((8, 8, 8), 5, dims))
    mesh = U.surface_from_field(wm, SurfaceParams(min_mask_voxels=10, min_mesh_vertices=0, mesh_smooth_iters=0, morph_cleanup=False, min_component_voxels=0))
    params = ShrinkWrapParams(target_iso=0.9, n_iters=2, smooth_every=2)
    place = lambda m: np.array([[r[c] for c in ("x", "y", "z")] for r in m.vertex.orderBy("vid").collect()])
    assert np.allclose(place(U.shrink_wrap(mesh, wm, params)), place(U.shrink_wrap(mesh, wm, params, one_task_rows=0)))


def test_components_that_span_blocks(spark):
    rng, dims = random.Random(2), (9, 8, 7)
    grid = Grid(dims)
    cells = {c for c in itertools.product(*map(range, dims)) if rng.random() < 0.35}
    flat = lambda c: (c[0] * dims[1] + c[1]) * dims[2] + c[2]
    want, label = {}, 0
    for c in sorted(cells, key=flat):
        if c not in want:
            label += 1
            todo = [c]
            while todo:
                x = todo.pop()
                if x in cells and x not in want:
                    want[x] = label
                    todo += [tuple(a + b for a, b in zip(x, s, strict=True)) for s in G.SIX]
    for side in (2, 4, 64):
        got = G.components(mask_of(spark, grid, sorted(cells)), grid, side=side).collect()
        assert {r["flat"]: r["label"] for r in got} == {flat(c): n for c, n in want.items()}


def small_dataset(spark):
    voxel = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 1, 0), (2, 2, 0, 1)], "voxel_idx long, i int, j int, k int")
    fixel = spark.createDataFrame([(n, n // 2, n % 2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, float(n)) for n in range(6)], "fixel_id long, voxel_idx long, peak_no int, px double, py double, pz double, dx double, dy double, dz double, amplitude double")
    return Dataset(Grid((3, 2, 2), ((2.0, 0, 0, -3.0), (0, 2.0, 0, 1.0), (0, 0, 2.0, 0.5), (0, 0, 0, 1.0))), voxel, fixel)


def test_dataset_round_trip_and_appends(spark, tmp_path):
    ds, path = small_dataset(spark), f"file://{tmp_path}/ds"
    D.write_dataset(ds, path)
    values = ds.fixel.select("fixel_id", (F.col("fixel_id") * 40).alias("value"))
    D.write_dpf(values, path, "score", "u8")
    D.write_dpf(values.withColumn("value", F.col("value") + 1), path, "score", "u8")
    with pytest.raises(Exception, match="out of range"):
        D.write_dpf(values.withColumn("value", F.col("value") + 200), path, "bad", "u8")
    with pytest.raises(ValueError):
        D.write_dpf(values, path, "bad", "u64")
    for name, ids in (("a", [0, 1]), ("b", [2]), ("a", [1])):
        D.write_voxel_group(spark.createDataFrame([(i,) for i in ids], "voxel_idx long"), path, name)
    back = D.open_dataset(spark, path)
    assert back.grid == ds.grid and back.fixel.count() == 6
    assert sorted(r["value"] for r in back.dpf["score"].collect()) == [1, 41, 81, 121, 161, 201]
    assert sorted((r["group_name"], r["voxel_idx"]) for r in back.groups.collect()) == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in D.catalog(back, spark).collect()] == [("dpf", "score")]


def test_archive_appends(spark, tmp_path):
    import zipfile

    path = str(tmp_path / f"ds{D.ARCHIVE_SUFFIX}")
    values = spark.createDataFrame([(0, 1.5), (1, 2.5)], "voxel_idx long, value double")
    D.write_dpv(values, path, "x", "f32")
    D.write_dpv(values, path, "y", "f32")
    D.write_dpv(values.withColumn("value", F.col("value") + 1), path, "x", "f32")
    assert len(zipfile.ZipFile(path).namelist()) == 2
    folder = D.unpack(path, str(tmp_path / "open"))
    assert sorted(r["value"] for r in spark.read.parquet(f"file://{folder}/dpv/x").collect()) == [2.5, 3.5]
    with pytest.raises(ValueError):
        D.write_dpv(values, str(tmp_path / "ds.zip"), "x", "f32")


@pytest.mark.parametrize("name", ["v.nii", "v.nii.gz"])
def test_nifti(spark, tmp_path, name):
    ds, path = small_dataset(spark), str(tmp_path / name)
    values = spark.createDataFrame([(0, 7), (1, 0), (2, 65535)], "voxel_idx long, value int")
    nifti.write_u16(values, ds.voxel, ds.grid, path)
    back, grid = nifti.read_u16(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == [(0, 0, 0, 7), (2, 0, 1, 65535)]
    assert grid.dims == ds.grid.dims and np.allclose(grid.affine, ds.grid.affine)
    head = nifti.build_header(ds.grid)
    assert struct.unpack_from("<hh", head, 252) == (1, 0) and head[344:348] == b"n+1\0"
    with pytest.raises(ValueError):
        nifti.write_u16(values.limit(1), ds.voxel, ds.grid, path)


@pytest.mark.parametrize("name", ["v.nii", "v.nii.gz"])
def test_nifti_of_several_slabs(spark, tmp_path, name):
    nx, ny, nz = 1500, 1000, 3
    grid = Grid((nx, ny, nz), tuple(tuple(float(i == j) for j in range(4)) for i in range(4)))
    at = [(0, 0, 0), (5, 7, 0), (75, 699, 0), (76, 699, 0), (1499, 999, 2)]  # the last place of the first slab and the first of the second
    voxel = spark.createDataFrame([(n, *p) for n, p in enumerate(at)], "voxel_idx long, i int, j int, k int")
    values = spark.createDataFrame([(n, n + 1) for n in range(len(at))], "voxel_idx long, value int")
    path = f"file://{tmp_path}/new/{name}"
    nifti.write_u16(values, voxel, grid, path)
    back, again = nifti.read_u16(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted((*p, n + 1) for n, p in enumerate(at)) and again.dims == grid.dims
    data = (tmp_path / "new" / name).read_bytes()
    assert len(gzip.decompress(data) if name.endswith("gz") else data) == 352 + 2 * nx * ny * nz
    nifti.write_u16(values.limit(0), voxel.limit(0), grid, path)
    assert nifti.read_u16(spark, path)[0].isEmpty()
    with pytest.raises(Exception, match="out of range"):
        nifti.write_u16(values.withColumn("value", F.col("value") + 65535), voxel, grid, path)


def test_shared_folder_must_be_named_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,512]")))


def test_dpv_field_needs_every_voxel(spark):
    ds = small_dataset(spark)
    ds.dpv["x"] = spark.createDataFrame([(0, 1.0)], "voxel_idx long, value double")
    with pytest.raises(ValueError):
        U.field_from_dpv(ds, "x")


def test_visited_and_pair(spark):
    index = X.from_handles(handles(spark, [(0, 0, 0), (1, 0, 0), (50, 0, 0)], [(1, 0, 0), (0, 1, 0), (1, 0, 0)])).fixels
    path = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "qx double, qy double, qz double, ux double, uy double, uz double")
    assert [r["fixel_id"] for r in S.capture_visited(path, index, 3.0, 0.9).collect()] == [0]
    vertex = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double, nx double, ny double, nz double")
    assert M.visualisation_pair(vertex, 2.0).first()["pial_z"] == -1.0
    assert Mesh(vertex, vertex).vertex is vertex
