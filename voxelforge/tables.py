"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in the driver (local tests) a
    temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="voxelforge-"))
    return _fallback[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxelforge/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and let Spark drop the shuffle files of finished jobs."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            if "/voxelforge/" in folder.toString():
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
