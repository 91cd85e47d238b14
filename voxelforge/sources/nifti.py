"""NIfTI-1 volumes of unsigned 16-bit voxels.

A volume is one file, on a path that driver and executors share. Tasks turn
voxels into slabs of bytes in file order, and back; the driver only strings the
slabs together. A compressed file can't be entered midway: one task reads it.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from contextlib import nullcontext
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reduce import require_same_keys
from ..schema import Grid

# Fixed values of the format
HEADER_BYTES, DATA_OFFSET, UINT16, UNITS_MM = 348, 352, 512, 2
SCANNER = 1

#: Voxels of a slab.
SLAB = 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pafs.LocalFileSystem(), path)


def _input(path: str):
    fs, name = _open(path)
    stream = fs.open_input_file(name)
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream


def build_header(grid: Grid) -> bytes:
    """348 bytes and no extension; voxel sizes are column norms, the rotation is in the quaternion, code scanner; rows filled, code 0."""
    a = np.array(grid.affine)
    sizes = np.sqrt((a[:3, :3] ** 2).sum(0))
    sizes[sizes == 0] = 1.0
    r = a[:3, :3] / sizes
    qfac = 1.0
    if np.linalg.det(r) < 0:
        qfac, r = -1.0, r * np.array([1, 1, -1])
    b, c, d = _quaternion(r)
    out = bytearray(DATA_OFFSET)
    struct.pack_into("<i", out, 0, HEADER_BYTES)
    struct.pack_into("<8h", out, 40, 3, *grid.dims, 1, 1, 1, 1)
    struct.pack_into("<hh", out, 70, UINT16, 16)
    struct.pack_into("<8f", out, 76, qfac, *sizes, 0, 0, 0, 0)
    struct.pack_into("<f", out, 108, DATA_OFFSET)
    struct.pack_into("<ff", out, 112, 1.0, 0.0)
    struct.pack_into("<b", out, 123, UNITS_MM)
    struct.pack_into("<hh", out, 252, SCANNER, 0)
    struct.pack_into("<6f", out, 256, b, c, d, *a[:3, 3])
    struct.pack_into("<12f", out, 280, *a[:3].ravel())
    out[344:348] = b"n+1\0"
    return bytes(out)


def _quaternion(r: np.ndarray) -> tuple[float, float, float]:
    """Vector part of the unit quaternion of a rotation, with a scalar part that is not negative."""
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0],
        [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r.trace()],
    ]) / 3
    _, vectors = np.linalg.eigh(k)
    x, y, z, w = vectors[:, -1]
    s = -1.0 if w < 0 else 1.0
    return float(x * s), float(y * s), float(z * s)


def write_u16(values: DataFrame, voxel: DataFrame, grid: Grid, path: str) -> None:
    """Write (voxel_idx, value) to ``.nii`` or ``.nii.gz``, 0 elsewhere. Every voxel must have one value.

    Slabs are made by tasks and arrive in file order, a partition at a time, so the driver holds no volume.
    """
    require_same_keys(voxel, values, "voxel_idx")
    nx, ny, _ = grid.dims
    at = F.col("i").cast("long") + F.col("j").cast("long") * nx + F.col("k").cast("long") * nx * ny
    rows = voxel.join(values, "voxel_idx").where("value != 0").select(at.alias("at"), F.col("value").cast("int").alias("value"))
    slabs = rows.withColumn("slab", F.floor(F.col("at") / SLAB)).groupBy("slab").applyInArrow(_slab, "slab long, data binary").orderBy("slab")
    fs, name = _open(path)
    fs.create_dir(name.rpartition("/")[0] or ".", recursive=True)
    with fs.open_output_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb") if path.endswith(".gz") else nullcontext(raw) as out:
        out.write(build_header(grid))
        done, empty = 0, bytes(2 * SLAB)
        last = -(-grid.size // SLAB) - 1
        for r in slabs.toLocalIterator():
            for _ in range(done, r["slab"]):
                out.write(empty)
            done = r["slab"] + 1
            out.write(r["data"] if r["slab"] < last else r["data"][: 2 * (grid.size - SLAB * last)])
        for n in range(done, last + 1):
            out.write(empty if n < last else empty[: 2 * (grid.size - SLAB * last)])


def _slab(rows: pa.Table) -> pa.Table:
    """The bytes of one slab from its voxels that are not 0."""
    value, n = rows.column("value").to_numpy(), rows.column("slab")[0].as_py()
    if value.min() < 0 or value.max() > 0xFFFF:
        raise ValueError("value out of range of u16")
    data = np.zeros(SLAB, "<u2")
    data[rows.column("at").to_numpy() - n * SLAB] = value
    return pa.table({"slab": pa.array([n], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})


def read_u16(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """(i, j, k, value) of the voxels that are not 0, and the grid. Slabs are read by tasks when the rows are asked for."""
    with _input(path) as f:
        head = f.read(DATA_OFFSET)
    dims = struct.unpack_from("<8h", head, 40)[1:4]
    rows = struct.unpack_from("<12f", head, 280)
    begin, size = int(struct.unpack_from("<f", head, 108)[0]), int(np.prod(dims, dtype=np.int64))
    packed, n = path.endswith(".gz"), -(-size // SLAB)

    def slabs(wanted: Iterator[int]) -> Iterator[pa.RecordBatch]:
        with _input(path) as f:
            for slab in wanted:
                f.seek(begin + 2 * SLAB * slab)
                data = np.frombuffer(f.read(2 * min(SLAB, size - SLAB * slab)), "<u2")
                at = np.flatnonzero(data)
                yield pa.RecordBatch.from_arrays([pa.array(at + SLAB * slab), pa.array(data[at].astype(np.int32))], names=["at", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids of slabs ascend within a task, so a compressed file is read once
        return slabs(s for batch in batches for s in batch.column("id").to_pylist())

    parts = 1 if packed else max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, n, 1, parts).mapInArrow(run, "at long, value int")
    nx, ny, _ = dims
    k = F.floor(F.col("at") / (nx * ny))
    place = [F.col("at") % nx, F.floor(F.col("at") / nx) % ny, k]
    affine = (*[tuple(float(x) for x in rows[4 * n : 4 * n + 4]) for n in range(3)], (0.0, 0.0, 0.0, 1.0))
    return found.select(*[c.cast("int").alias(a) for c, a in zip(place, "ijk", strict=True)], "value"), Grid(tuple(int(d) for d in dims), affine)
