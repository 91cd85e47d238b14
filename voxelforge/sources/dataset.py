"""Datasets as folders of Parquet tables.

Layout: header/ (one row), voxel/, fixel/, dpf/<name>/ (fixel_id, value),
dpv/<name>/ (voxel_idx, value), groups/ (voxel_idx, by group_name),
streamlines/ and streamline_groups/. Appending one array writes only its folder.
A single-file archive (suffix ARCHIVE_SUFFIX) holds the same tree, zipped.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FIXEL, VOXEL, Dataset, Grid

ARCHIVE_SUFFIX = ".vxd"
# Types of the arrays that can be appended, and what they are stored as
DTYPES = {"u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "f32": T.FloatType()}
LIMITS = {"u8": (1 << 8) - 1, "u16": (1 << 16) - 1, "u32": (1 << 32) - 1}


def is_archive(path: str) -> bool:
    """By suffix, case-sensitive."""
    return PurePosixPath(path).suffix == ARCHIVE_SUFFIX


def _list(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path of any file system that Spark reaches; none if it isn't there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())


def write_dataset(ds: Dataset, path: str) -> None:
    spark = ds.voxel.sparkSession
    head = [(*ds.grid.dims, *[float(x) for row in ds.grid.affine for x in row])]
    schema = "nx int, ny int, nz int, " + ", ".join(f"a{i}{j} double" for i in range(4) for j in range(4))
    spark.createDataFrame(head, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    ds.voxel.write.mode("overwrite").parquet(f"{path}/voxel")
    ds.fixel.write.mode("overwrite").parquet(f"{path}/fixel")
    for kind, arrays in (("dpf", ds.dpf), ("dpv", ds.dpv)):
        for name, df in arrays.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
    if ds.groups is not None:
        ds.groups.write.mode("overwrite").partitionBy("group_name").parquet(f"{path}/groups")


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    h = spark.read.parquet(f"{path}/header").first()
    grid = Grid((h["nx"], h["ny"], h["nz"]), tuple(tuple(h[f"a{i}{j}"] for j in range(4)) for i in range(4)))
    arrays = {kind: {n: spark.read.parquet(f"{path}/{kind}/{n}") for n in _list(spark, f"{path}/{kind}")} for kind in ("dpf", "dpv")}
    groups = spark.read.parquet(f"{path}/groups") if _list(spark, f"{path}/groups") else None
    return Dataset(grid, spark.read.schema(VOXEL).parquet(f"{path}/voxel"), spark.read.schema(FIXEL).parquet(f"{path}/fixel"), arrays["dpf"], arrays["dpv"], groups)


def catalog(ds: Dataset, spark: SparkSession) -> DataFrame:
    """(kind, name): the per-voxel arrays, then the per-fixel arrays."""
    rows = [("dpv", n) for n in sorted(ds.dpv)] + [("dpf", n) for n in sorted(ds.dpf)]
    return spark.createDataFrame(rows, "kind string, name string")


def _typed(values: DataFrame, key: str, dtype: str) -> DataFrame:
    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype {dtype!r}; one of {sorted(DTYPES)}")
    v = F.col("value")
    if dtype in LIMITS:
        # checked before anything is overwritten
        if not values.where(v.isNull() | ~v.between(0, LIMITS[dtype])).isEmpty():
            raise ValueError(f"value out of range of {dtype}")
    return values.select(F.col(key).cast("long").alias(key), v.cast(DTYPES[dtype]).alias("value"))


def _append(df: DataFrame, path: str, inner: str, partition: str | None = None) -> None:
    """Overwrite one folder of a dataset, in a directory or in an archive; nothing else is rewritten there."""
    if not is_archive(path):
        if PurePosixPath(path).suffix:
            raise ValueError(f"expected a dataset directory or a {ARCHIVE_SUFFIX} archive: {path}")
        writer = df.write.mode("overwrite")
        if partition:
            writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{path}/{inner}")
        return
    # an archive is one local file: its new members are written beside it and swapped in
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(path))) as tmp:
        writer = df.coalesce(1).write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"file://{tmp}/new")
        fresh = {}
        for d, _, names in os.walk(f"{tmp}/new"):
            for n in names:
                if n.endswith(".parquet"):
                    fresh[f"{inner}/{os.path.relpath(f'{d}/{n}', f'{tmp}/new')}"] = f"{d}/{n}"
        replaced = {os.path.dirname(n) for n in fresh}
        with zipfile.ZipFile(f"{tmp}/all", "w", zipfile.ZIP_DEFLATED) as out:
            if os.path.exists(path):
                with zipfile.ZipFile(path) as old:
                    for m in old.infolist():
                        if os.path.dirname(m.filename) not in replaced:
                            with old.open(m) as src, out.open(m.filename, "w") as dst:
                                shutil.copyfileobj(src, dst)
            for name, file in fresh.items():
                out.write(file, name)
        os.replace(f"{tmp}/all", path)


def unpack(path: str, folder: str) -> str:
    """Extract an archive to a folder that can be opened."""
    with zipfile.ZipFile(path) as z:
        z.extractall(folder)
    return folder


def write_dpf(values: DataFrame, path: str, name: str, dtype: str) -> None:
    """Append or overwrite a per-fixel array (fixel_id, value) of type u8, u16, u32 or f32."""
    _append(_typed(values, "fixel_id", dtype), path, f"dpf/{name}")


def write_dpv(values: DataFrame, path: str, name: str, dtype: str) -> None:
    """Append or overwrite a per-voxel array (voxel_idx, value)."""
    _append(_typed(values, "voxel_idx", dtype), path, f"dpv/{name}")


def write_voxel_group(voxels: DataFrame, path: str, name: str) -> None:
    """Append or overwrite one named group of voxels (voxel_idx); other groups stay."""
    _append(voxels.select(F.col("voxel_idx").cast("long").alias("voxel_idx"), F.lit(name).alias("group_name")), path, "groups", "group_name")


def write_streamlines(points: DataFrame, path: str, groups: DataFrame | None = None) -> None:
    """Polylines (sid, idx, x, y, z) as a row each with an array of points, and groups (name, sid)."""
    lines = points.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z"))).alias("p"))
    lines.select("sid", F.transform("p", lambda p: F.struct(*[p[c].cast("float").alias(c) for c in "xyz"])).alias("points")).write.mode("overwrite").parquet(f"{path}/streamlines")
    if groups is not None:
        groups.write.mode("overwrite").parquet(f"{path}/streamline_groups")


def read_streamlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/streamlines").select("sid", F.posexplode("points").alias("idx", "p")).select("sid", "idx", *[F.col(f"p.{c}").alias(c) for c in "xyz"])
