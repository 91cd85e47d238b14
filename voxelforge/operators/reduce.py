"""Grouped reductions, exact order statistics and Otsu thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import OTSU_BINS

#: Rows from which the exact selection stops narrowing and sorts what is left.
SELECT_ROWS = 100_000
_BINS = 1024


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def reduce_to_voxel(voxel: DataFrame, values: DataFrame, how: str) -> DataFrame:
    """(voxel_idx, value): max, sum or mean of ``values`` (voxel_idx, value) per voxel; voxels without values give 0.

    max starts from 0 and ignores NaN; sum and mean let NaN through.
    """
    x = F.col("value")
    agg = {"max": F.greatest(F.lit(0.0), F.max(F.when(~F.isnan(x), x))), "sum": F.sum(x), "mean": F.avg(x)}
    if how not in agg:
        raise ValueError(f"unknown reduction {how!r}; one of {sorted(agg)}")
    per_voxel = values.groupBy("voxel_idx").agg(agg[how].alias("value"))
    return voxel.select("voxel_idx").join(per_voxel, "voxel_idx", "left").select("voxel_idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def reduce_dpf(voxel: DataFrame, fixel: DataFrame, dpf: DataFrame, how: str) -> DataFrame:
    """Reduce a per-fixel scalar (fixel_id, value); every fixel must have exactly one value."""
    require_same_keys(fixel, dpf, "fixel_id")
    return reduce_to_voxel(voxel, fixel.select("fixel_id", "voxel_idx").join(dpf, "fixel_id").select("voxel_idx", F.col("value").cast("double").alias("value")), how)


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise ValueError unless both sides have the same keys, each once."""
    both = left.groupBy(key).agg(F.count("*").alias("n")).join(right.groupBy(key).agg(F.count("*").alias("m")), key, "full")
    bad = both.where((F.coalesce("n", F.lit(0)) != 1) | (F.coalesce("m", F.lit(0)) != 1)).count()
    if bad:
        raise ValueError(f"length mismatch: {bad} {key}s have no value or more than one")


def primary_peak_qa(voxel: DataFrame, fixel: DataFrame) -> DataFrame:
    """Largest amplitude of each voxel."""
    return reduce_to_voxel(voxel, fixel.select("voxel_idx", F.coalesce(F.col("amplitude"), F.lit(float("nan"))).alias("value")), "max")


def first_peak(fixel: DataFrame) -> DataFrame:
    """(voxel_idx, first_amp): the amplitude of the lowest peak of each voxel."""
    return fixel.groupBy("voxel_idx").agg(F.min_by("amplitude", F.struct("peak_no", "fixel_id")).alias("first_amp"))


def upper_median(df: DataFrame, col: str) -> float | None:
    """The element at n // 2 of the sorted finite values; None if there are none.

    Histograms narrow down the range until few rows are left to be sorted, so no
    task ever holds all values.
    """
    x = df.where(finite(F.col(col))).select(F.col(col).cast("double").alias("x"))
    n, lo, hi = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = n // 2
    while n > SELECT_ROWS and lo < hi:
        width = (hi - lo) / _BINS
        if width <= 0 or lo + width == lo:
            break
        inside = x.where(F.col("x").between(lo, hi))
        part = F.least(F.floor((F.col("x") - lo) / F.lit(width)), F.lit(_BINS - 1))
        bins = sorted(inside.groupBy(part.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        for b in bins:
            if rank < b["n"]:
                same = (n, lo, hi) == (b["n"], b["lo"], b["hi"])
                n, lo, hi = b["n"], b["lo"], b["hi"]
                break
            rank -= b["n"]
        if same:
            break
    if lo == hi:
        return float(lo)
    return float(x.where(F.col("x").between(lo, hi)).orderBy("x").offset(rank).limit(1).first()["x"])


def otsu_bins(values: DataFrame, col: str = "value") -> DataFrame:
    """(bin, threshold) of the best cut: one row, bin -1 and threshold 0.0 if there is none.

    Positive values fall into OTSU_BINS bins up to the largest; the between-class
    variance uses bin centres; the lowest of equal cuts wins; its upper edge is
    the threshold.
    """
    pos = values.where((F.col(col) > 0) & ~F.isnan(F.col(col))).select(F.col(col).cast("double").alias("v"))
    top = pos.agg((F.max("v") / F.lit(float(OTSU_BINS))).alias("bw"))
    binned = pos.crossJoin(F.broadcast(top)).groupBy(F.least(F.floor(F.col("v") / F.col("bw")), F.lit(OTSU_BINS - 1)).alias("bin"), "bw").agg(F.count("*").alias("c"))
    run, all_ = W.orderBy("bin"), W.partitionBy()
    mass = F.col("c") * (F.col("bin") + F.lit(0.5)) * F.col("bw")
    h = binned.select("bin", "bw", F.sum("c").over(run).alias("wb"), F.sum("c").over(all_).alias("n"), F.sum(mass).over(run).alias("sb"), F.sum(mass).over(all_).alias("st"))
    gap = F.col("sb") / F.col("wb") - (F.col("st") - F.col("sb")) / (F.col("n") - F.col("wb"))
    var = F.col("wb").cast("double") * (F.col("n") - F.col("wb")).cast("double") * gap * gap
    best = h.where("wb < n").select("bin", ((F.col("bin") + 1) * F.col("bw")).alias("threshold"), var.alias("var")).where("var > 0").orderBy(F.desc("var"), "bin").limit(1)
    return best.agg(F.coalesce(F.max("bin"), F.lit(-1)).alias("bin"), F.coalesce(F.max("threshold"), F.lit(0.0)).alias("threshold"))


def otsu_threshold(values: DataFrame, col: str = "value") -> float:
    return float(otsu_bins(values, col).first()["threshold"])


def diagnostics(values: DataFrame, iso: float, otsu: float, col: str = "value") -> DataFrame:
    """One row: number of positive values, largest, mean of the positive ones, otsu, iso, number above iso."""
    v = F.col(col)
    n = F.count_if(v > 0)
    return values.agg(n.alias("n_pos"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"), (F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("mean_pos"), F.lit(otsu).alias("otsu"), F.lit(iso).alias("iso"), F.count_if(v > iso).alias("n_above"))
