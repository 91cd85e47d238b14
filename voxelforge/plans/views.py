"""The data model derived from the relational test tables, so that every operator has data with an SQL twin.

orders are voxels of an nx x 25 x 24 grid, lineitems their fixels; embeddings
are a synthetic fixel field; orders also form a lattice mesh and, by customer,
polylines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.surface import to_field
from ..schema import Dataset, Grid

SPACING = 1.7
NY, NZ = 25, 24
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The plane x = 0 cuts the grid in half."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    nx = (-1 if last is None else last) // (NY * NZ) + 1
    return Grid((nx, NY, NZ), ((SPACING, 0.0, 0.0, -SPACING * nx / 2), (0.0, SPACING, 0.0, 0.0), (0.0, 0.0, SPACING, 0.0), (0.0, 0.0, 0.0, 1.0)))


def voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("voxel_idx")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("voxel_idx"))
    return rows.select(v, F.floor(v / (NY * NZ)).cast("int").alias("i"), (F.floor(v / NZ) % NY).cast("int").alias("j"), (v % NZ).cast("int").alias("k"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the fixel's number within its voxel and its id."""
    w = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = table(spark, sf_dir, "lineitem").withColumn("peak_no", F.row_number().over(w) - 1)
    return rows.withColumn("fixel_id", F.col("l_orderkey") * 64 + F.col("peak_no"))


def fixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    v = F.col("l_orderkey")
    z = 2.0 * ((F.col("l_partkey") % 201) / 200.0) - 1.0
    phi = 6.283185307179586 * (F.col("l_suppkey") % 100) / 100.0
    ring = F.sqrt(F.greatest(1.0 - z * z, F.lit(0.0)))
    x0 = g.affine[0][3]
    return lines(spark, sf_dir).select(
        "fixel_id", v.alias("voxel_idx"), "peak_no",
        (SPACING * F.floor(v / (NY * NZ)) + x0).alias("px"), (SPACING * (F.floor(v / NZ) % NY)).alias("py"), (SPACING * (v % NZ)).alias("pz"),
        (ring * F.cos(phi)).alias("dx"), (ring * F.sin(phi)).alias("dy"), z.alias("dz"), (F.col("l_extendedprice") / 100000.0).alias("amplitude"),
    )


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    scalars = {n: lines(spark, sf_dir).select("fixel_id", F.col(f"l_{n}").alias("value")) for n in ("quantity", "discount")}
    price = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("voxel_idx"), F.col("o_totalprice").alias("value"))
    return Dataset(grid(spark, sf_dir), voxel(spark, sf_dir), fixel(spark, sf_dir), scalars, {"totalprice": price})


def price_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_totalprice / 1e5 as a voxel field."""
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("voxel_idx"), (F.col("o_totalprice") / 100000.0).alias("value"))
    return to_field(voxel(spark, sf_dir), values, grid(spark, sf_dir))


def price_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with o_totalprice above 150000."""
    return price_field(spark, sf_dir).where("value > 1.5").select("flat", "i", "j", "k")


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles from embeddings: positions, directions, amplitudes and a bundle."""
    e = F.col("embedding")
    at = lambda n, scale=1.0: e[n - 1].cast("double") * scale
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("fixel_id"), at(1, 20.0).alias("px"), at(2, 20.0).alias("py"), at(3, 20.0).alias("pz"),
        at(4).alias("dx"), at(5).alias("dy"), at(6).alias("dz"), F.abs(at(7)).alias("amplitude"), F.col("label").alias("bundle"),
    )


def mesh_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(v.alias("vid"), (F.floor(v / NZ) - 100.25).alias("x"), (v % NZ).cast("double").alias("y"), (F.col("o_totalprice") / 100000.0).alias("z"))


def mesh_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for each cell of the lattice; every 40th row of cells is left out."""
    v = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    last = orders.agg(F.max(v).alias("last"))
    cells = orders.where((v % NZ < NZ - 1) & (F.floor(v / NZ) % 40 != 39)).crossJoin(F.broadcast(last)).where(v + NZ + 1 <= F.col("last"))
    pair = F.explode(F.array(F.struct((2 * v).alias("tid"), v.alias("a"), (v + NZ).alias("b"), (v + 1).alias("c")), F.struct((2 * v + 1).alias("tid"), (v + 1).alias("a"), (v + NZ).alias("b"), (v + NZ + 1).alias("c"))))
    return cells.select(pair.alias("t")).select("t.tid", "t.a", "t.b", "t.c")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per order, by customer in order of date, on the grid."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), (F.row_number().over(w) - 1).alias("idx"), (SPACING * F.floor(v / (NY * NZ))).alias("x"), (SPACING * (F.floor(v / NZ) % NY)).alias("y"), (SPACING * (v % NZ)).alias("z"))
