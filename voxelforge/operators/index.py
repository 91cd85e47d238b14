"""The fixel index: oriented points with jittered positions and median-normalised amplitudes, filtered on the way in.

Filters are Columns, so they reach the scan; a threshold is one number fetched
from an aggregate. ``FixelIndex`` is a table and the number of fixels there were
before filtering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, fixel_jitter, normalize, vec
from ..schema import POSITION_DIR_OFFSET
from ..tables import materialize
from .reduce import finite, first_peak, otsu_threshold, upper_median

COLUMNS = ["fixel_id", "voxel_idx", "peak_no", "px", "py", "pz", "dx", "dy", "dz", "amplitude"]


@dataclass
class FixelIndex:
    fixels: DataFrame
    nb_peaks: int
    threshold: float | None = None

    def count(self) -> int:
        """Fixels that were kept."""
        return self.fixels.count()

    def is_empty(self) -> bool:
        return self.fixels.isEmpty()

    def contains(self, fixel_id: int) -> bool:
        return not self.find(fixel_id).isEmpty()

    def find(self, fixel_id: int) -> DataFrame:
        """The fixel's row, or none if it is out of range or was filtered."""
        return self.fixels.where(F.col("fixel_id") == fixel_id)

    def handle(self, fixel_id: int):
        """The fixel's row; KeyError if there is none."""
        row = self.find(fixel_id).first()
        if row is None:
            raise KeyError(fixel_id)
        return row

    def handles(self) -> DataFrame:
        """All fixels in order of id."""
        return self.fixels.orderBy("fixel_id")

    def flag(self, ids: DataFrame) -> DataFrame:
        """``ids`` (fixel_id) with ``present``."""
        return ids.join(self.fixels.select("fixel_id", F.lit(True).alias("p")), "fixel_id", "left").select(*ids.columns, F.coalesce("p", F.lit(False)).alias("present"))


def normalise_amplitudes(fixels: DataFrame) -> DataFrame:
    """Divide finite amplitudes by their upper median, unless it is not positive."""
    median = upper_median(fixels, "amplitude")
    if median is None or not 0 < median < float("inf"):
        return fixels
    a = F.col("amplitude")
    return fixels.withColumn("amplitude", F.when(finite(a), a / F.lit(median)).otherwise(a))


def place(fixel: DataFrame, jitter: bool = True) -> DataFrame:
    """Positions moved a little along the direction and by the id's jitter, so that no two coincide."""
    moved = [p + F.lit(POSITION_DIR_OFFSET) * d for p, d in zip(vec("p"), vec("d"), strict=True)]
    if jitter:
        moved = [p + j for p, j in zip(moved, fixel_jitter(F.col("fixel_id")), strict=True)]
    rest = [c for c in fixel.columns if c not in ("px", "py", "pz")]
    return fixel.select(*rest, *[m.alias(f"p{c}") for m, c in zip(moved, "xyz", strict=True)]).select(*[c for c in COLUMNS if c in fixel.columns])


def build(fixel: DataFrame, keep: Column | None = None, *, jitter: bool = True, nb_peaks: int | None = None, threshold: float | None = None) -> FixelIndex:
    """All fixels for which ``keep`` (on fixel_id and amplitude) holds; the median is taken over these.

    The placed fixels are written once: the median and every query of the index read them.
    """
    n = fixel.count() if nb_peaks is None else nb_peaks
    kept = fixel if keep is None else fixel.where(keep)
    return FixelIndex(normalise_amplitudes(materialize(place(kept, jitter), "fixels")), n, threshold)


def build_threshold(fixel: DataFrame, threshold: float, **options) -> FixelIndex:
    """Amplitude at least the threshold, or not finite."""
    a = F.col("amplitude")
    return build(fixel, ~finite(a) | (a >= threshold), threshold=threshold, **options)


def _no_amplitudes(fixel: DataFrame) -> bool:
    return fixel.where("amplitude is not null").isEmpty()


def build_otsu(fixel: DataFrame, scale: float = 1.0, **options) -> FixelIndex:
    """Amplitude finite and at least ``scale`` times Otsu's threshold over all fixels; all fixels if none has an amplitude."""
    a = F.col("amplitude")
    if _no_amplitudes(fixel):
        return build(fixel, **options)
    t = scale * otsu_threshold(fixel, "amplitude")
    return build(fixel, finite(a) & (a >= t), threshold=t, **options)


def build_voxel_filtered(fixel: DataFrame, voxels: DataFrame, **options) -> FixelIndex:
    """Only fixels of the given voxels (voxel_idx)."""
    n = fixel.count()
    return build(fixel.join(voxels.select("voxel_idx").distinct(), "voxel_idx", "left_semi"), nb_peaks=n, **options)


def build_qa_threshold(fixel: DataFrame, threshold: float, **options) -> FixelIndex:
    """Only voxels whose first peak has a finite amplitude of at least the threshold; all fixels if none has an amplitude."""
    a = F.col("first_amp")
    if _no_amplitudes(fixel):
        return build(fixel, **options)
    return build_voxel_filtered(fixel, first_peak(fixel).where(finite(a) & (a >= threshold)), threshold=threshold, **options)


def build_qa_otsu(fixel: DataFrame, scale: float = 1.0, **options) -> FixelIndex:
    """As build_qa_threshold with ``scale`` times Otsu's threshold over the first peaks."""
    if _no_amplitudes(fixel):
        return build(fixel, **options)
    return build_qa_threshold(fixel, scale * otsu_threshold(first_peak(fixel), "first_amp"), **options)


def from_handles(points: DataFrame, *, jitter: bool = True) -> FixelIndex:
    """An index of synthetic fixels (fixel_id, px..pz, dx..dz[, amplitude]): unit directions, jitter, voxel_idx = id."""
    unit = normalize(vec("d"))
    moved = vec("p")
    if jitter:
        moved = [p + j for p, j in zip(moved, fixel_jitter(F.col("fixel_id")), strict=True)]
    amplitude = F.col("amplitude").cast("double") if "amplitude" in points.columns else F.lit(None).cast("double")
    rows = points.select("fixel_id", F.col("fixel_id").alias("voxel_idx"), F.lit(0).alias("peak_no"), *[m.alias(f"p{c}") for m, c in zip(moved, "xyz", strict=True)], *[u.alias(f"d{c}") for u, c in zip(unit, "xyz", strict=True)], amplitude.alias("amplitude"))
    return FixelIndex(normalise_amplitudes(materialize(rows, "fixels")), points.count())


def aligned(a: str, b: str) -> Column:
    """|cosine| of two unit vectors given by column prefix."""
    return F.abs(dot(vec(a), vec(b)))
