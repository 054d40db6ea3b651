"""The ball filter: voxels whose neighbourhood is bright enough under a fuzzy ball."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kernel is drawn this many times finer and averaged.
FINE = 7


@lru_cache(maxsize=50)
def ball_kernel(xy: int, z: int) -> np.ndarray:
    """Integer weights (z, y, x), in parts of FINE cubed. The radius follows the xy size on all axes."""
    radius = FINE * xy / 2
    centre = [np.floor(FINE * n / 2) for n in (z, xy, xy)]
    grid = np.indices((FINE * z, FINE * xy, FINE * xy))
    inside = sum((g - c) ** 2 for g, c in zip(grid, centre)) <= radius**2
    return inside.reshape(z, FINE, xy, FINE, xy, FINE).sum((1, 3, 5))


def sphere(radius: int) -> list[tuple[int, int, int]]:
    """Offsets within a ball, in natural order."""
    span = range(-radius, radius + 1)
    return [(z, y, x) for z in span for y in span for x in span if z * z + y * y + x * x <= radius * radius]


def offsets(kernel: np.ndarray) -> list[tuple[int, int, int, int]]:
    """From a bright voxel to each place that it counts for, with its weight (the operation is a correlation)."""
    kz, ky, kx = kernel.shape
    centre = (kz // 2, (ky - 1) // 2, (kx - 1) // 2)
    return [(centre[0] - z, centre[1] - y, centre[2] - x, int(w)) for (z, y, x), w in np.ndenumerate(kernel) if w]


def _table(rows: list[tuple]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("dz", "dy", "dx", "w"), r))) for r in rows))


def sent(bright: DataFrame, kernel: np.ndarray, offset: bool = False) -> DataFrame:
    """z, y, x of every place that a bright voxel counts for, and its weight w there; if asked for, the offset dz, dy, dx too."""
    rows = bright.select("z", "y", "x", F.explode(_table(offsets(kernel))).alias("k"))
    steps = [F.col(f"k.d{a}").alias(f"d{a}") for a in "zyx"] if offset else []
    return rows.select(*((F.col(a) + F.col(f"k.d{a}")).alias(a) for a in "zyx"), F.col("k.w").alias("w"), *steps)


def valid(shape: tuple[int, int, int], kernel: np.ndarray) -> dict[str, tuple[int, int]]:
    """First and last place on each axis where the whole ball lies inside the volume."""
    kz, ky, kx = kernel.shape
    if shape[1] < ky or shape[2] < kx:
        raise ValueError("planes are smaller than the ball")
    first = (kz // 2, (ky - 1) // 2, (kx - 1) // 2)
    return {a: (f, f + n - k) for a, f, n, k in zip("zyx", first, shape, kernel.shape)}


def overlap(bright: DataFrame, shape: tuple[int, int, int], xy: int, z: int) -> DataFrame:
    """z, y, x and the ball's integer overlap with the bright voxels, where the whole ball lies inside the volume and the
    overlap is not 0. Bright voxels are few, so each sends its weight to its neighbours; sums combine before the shuffle."""
    kernel = ball_kernel(xy, z)
    at = sent(bright, kernel)
    for a, (first, last) in valid(shape, kernel).items():
        at = at.where(F.col(a).between(first, last))
    return at.groupBy("z", "y", "x").agg(F.sum("w").alias("overlap"))


def marks(bright: DataFrame, shape: tuple[int, int, int], xy: int, z: int, fraction: Fraction, tiles: DataFrame | None = None, tile: int = 0) -> DataFrame:
    """Voxels whose overlap exceeds `fraction` of the ball, and that lie in an inside tile if tiles are given.
    All bright voxels are as given: marks do not feed back. Integers keep ties exact."""
    return marked(overlap(bright, shape, xy, z), fraction * int(ball_kernel(xy, z).sum()), tiles, tile)


def marked(overlaps: DataFrame, limit: Fraction, tiles: DataFrame | None = None, tile: int = 0) -> DataFrame:
    """z, y, x of the overlaps beyond the limit, inside the tiles if given."""
    found = overlaps.where(F.col("overlap") * limit.denominator > limit.numerator).select("z", "y", "x")
    if tiles is None:
        return found
    keyed = found.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    return keyed.join(tiles.where("inside").select("z", "ty", "tx"), ["z", "ty", "tx"], "left_semi").select("z", "y", "x")
