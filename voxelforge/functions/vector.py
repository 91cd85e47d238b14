"""Vector algebra, affine maps and jitter hashes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import JITTER_MM, MESH_JITTER_MM

Vec = Sequence[Column]


def vec(prefix: str, names: str = "xyz") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in names]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalize(v: Vec) -> list[Column]:
    """Unit vector; left as it is if no longer than 1e-9."""
    n = F.sqrt(dot(v, v))
    return [F.when(n > 1e-9, c / n).otherwise(c) for c in v]


def apply_affine(rows, v: Vec) -> list[Column]:
    """The first three rows of a 4x4 map, as literals, on a point."""
    return [v[0] * F.lit(float(r[0])) + v[1] * F.lit(float(r[1])) + v[2] * F.lit(float(r[2])) + F.lit(float(r[3])) for r in list(rows)[:3]]


def flat_index(i: Column, j: Column, k: Column, dims: Sequence[int]) -> Column:
    return (i.cast("long") * dims[1] + j) * dims[2] + k


def unflatten(flat: Column, dims: Sequence[int]) -> list[Column]:
    ny, nz = dims[1], dims[2]
    return [F.floor(flat / (ny * nz)).cast("int"), (F.floor(flat / nz) % ny).cast("int"), (flat % nz).cast("int")]


def in_grid(i: Column, j: Column, k: Column, dims: Sequence[int]) -> Column:
    return (i >= 0) & (i < dims[0]) & (j >= 0) & (j < dims[1]) & (k >= 0) & (k < dims[2])


_WORD = 1 << 32


def _times_mod32(x: Column, c: int) -> Column:
    """x * c modulo 2**32 without overflowing a long: in halves of 16 bits."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16)
    return (low * F.lit(c) + F.shiftleft((high * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)) % _WORD


def fixel_jitter_hash(fixel_id: Column, seed: int) -> Column:
    x = _times_mod32(fixel_id.cast("long") % _WORD, seed) + F.lit(0x9E3779B9)
    x = x % _WORD
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = _times_mod32(x, 0x85EBCA6B)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 13))


# Hash seeds of the three axes
FIXEL_JITTER_SEEDS = (0x1F1F1F1F, 0x2A2A2A2A, 0x3B3B3B3B)
MESH_JITTER_FACTORS = ((2654435761, 17), (40503, 13), (2246822519, 11))


def fixel_jitter(fixel_id: Column) -> list[Column]:
    """Deterministic offsets within JITTER_MM on each axis, from the id."""
    return [(fixel_jitter_hash(fixel_id, s) / F.lit(float(_WORD)) * 2 - 1) * JITTER_MM for s in FIXEL_JITTER_SEEDS]


def mesh_jitter(vid: Column) -> list[Column]:
    """Offsets within half of MESH_JITTER_MM on each axis; ids below 3.4e9."""
    out = []
    for factor, shift in MESH_JITTER_FACTORS:
        bits = F.shiftrightunsigned(vid.cast("long") * F.lit(factor), shift).bitwiseAND(F.lit(0xFFFF))
        out.append((bits / F.lit(65536.0) - 0.5) * MESH_JITTER_MM)
    return out
