"""Data model: grids, parameters with their defaults, and the dataset of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the algorithms
POSITION_DIR_OFFSET = 0.01
JITTER_MM = 0.005
MESH_JITTER_MM = 0.02
CURVATURE_EPS = 1e-4
OTSU_BINS = 256
OUTSIDE_ATTENUATION = 0.2
MIN_CLEANUP_VOXELS = 50
SECOND_HEMISPHERE_SHARE = 0.05

FIXEL = T.StructType([T.StructField("fixel_id", T.LongType(), False), T.StructField("voxel_idx", T.LongType(), False), T.StructField("peak_no", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("px", "py", "pz", "dx", "dy", "dz", "amplitude")]])
VOXEL = T.StructType([T.StructField("voxel_idx", T.LongType(), False), *[T.StructField(c, T.IntegerType()) for c in "ijk"]])
FIELD = T.StructType([T.StructField("flat", T.LongType(), False), *[T.StructField(c, T.IntegerType()) for c in "ijk"], T.StructField("value", T.DoubleType())])


@dataclass(frozen=True)
class Grid:
    """Dimensions and the row-major voxel-to-world affine; flat = (i * ny + j) * nz + k."""

    dims: tuple[int, int, int]
    affine: tuple[tuple[float, ...], ...] = tuple(tuple(float(x) for x in row) for row in np.eye(4))

    @property
    def size(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    def inverse(self) -> np.ndarray:
        """World to voxel; a singular affine inverts to the identity."""
        a = np.array(self.affine)
        return np.eye(4) if abs(np.linalg.det(a)) < 1e-300 else np.linalg.inv(a)


@dataclass(frozen=True)
class TransportParams:
    probe_length_mm: float = 5.0
    probe_quality: int = 5
    support_radius_mm: float = 2.5
    angular_power: int = 4
    k_max: float = 0.2
    n_k_samples: int = 5
    probe_radius_mm: float = 0.0
    probe_count: int = 1


@dataclass(frozen=True)
class TraceParams:
    step_mm: float = 1.7
    max_length_mm: float = 250.0
    min_length_mm: float = 5.0
    max_angle_deg: float = 30.0


@dataclass(frozen=True)
class SurfaceParams:
    pial_offset_mm: float = 2.0
    min_mask_voxels: int = 100
    min_component_voxels: int = 200
    min_mesh_vertices: int = 500
    mesh_smooth_iters: int = 2
    taubin_lambda: float = 0.5
    taubin_mu: float = -0.53
    morph_cleanup: bool = True


@dataclass(frozen=True)
class ShrinkWrapParams:
    target_iso: float = 0.0
    n_iters: int = 50
    step_mm: float = 0.5
    max_search_mm: float = 8.0
    smooth_every: int = 5
    taubin_lambda: float = 0.5
    taubin_mu: float = -0.53
    convergence_eps_mm: float = 0.05


@dataclass
class Dataset:
    """A grid with its masked voxels, fixels, named per-fixel and per-voxel scalars and voxel groups."""

    grid: Grid
    voxel: DataFrame
    fixel: DataFrame
    dpf: dict[str, DataFrame] = field(default_factory=dict)
    dpv: dict[str, DataFrame] = field(default_factory=dict)
    groups: DataFrame | None = None


@dataclass
class VoxelField:
    """A sparse scalar field (absent voxels are 0), its grid and iso value."""

    field: DataFrame
    grid: Grid
    iso: float


@dataclass
class Mesh:
    """vertex(vid, x, y, z, nx, ny, nz) and triangle(tid, a, b, c); normals point inward."""

    vertex: DataFrame
    triangle: DataFrame
