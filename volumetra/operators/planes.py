"""Operators within a plane: statistics, tiles, stencils and thresholds.

Volumes are rows z, y, x, v (0-based, dense). Statistics of planes and tiles are grouped aggregates, combined before
the shuffle, and are joined back on their keys; Spark broadcasts them only if they prove small at run time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = ["z"]


def plane_range(voxels: DataFrame, start: int, end: int) -> DataFrame:
    """Planes start..end, end excluded; a negative end means all."""
    rows = voxels.where(F.col("z") >= start)
    return rows if end < 0 else rows.where(F.col("z") < end)


def misshapen(voxels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """z and message of each plane that is not dense or not of that shape, by one aggregate; none, if all is well."""
    h, w = shape
    seen = voxels.groupBy("z").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.count("v").alias("known"))
    fits = (F.col("y0") == 0) & (F.col("x0") == 0) & (F.col("y1") == h - 1) & (F.col("x1") == w - 1) & (F.col("n") == h * w) & (F.col("known") == h * w)
    said = F.format_string("rows %d to %d, columns %d to %d, %d pixels, %d of them known; expected %d x %d", "y0", "y1", "x0", "x1", "n", "known", F.lit(h), F.lit(w))
    return seen.where(~F.coalesce(fits, F.lit(False))).select("z", said.alias("message"))


def plane_stats(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("z").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.stddev_samp("v").alias("v_std"))


def normalise(voxels: DataFrame, most: float, flip: bool = True) -> DataFrame:
    """Each plane to 0..most; with flip, of the negated values. A plane whose largest shifted value is 0 is divided by 1."""
    e = -F.col("v") if flip else F.col("v")
    rows = voxels.withColumn("v", e.cast("double"))
    limits = rows.groupBy("z").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    span = F.col("high") - F.col("low")
    return rows.join(limits, "z").select("z", "y", "x", ((F.col("v") - F.col("low")) / F.when(span == 0, 1.0).otherwise(span) * most).alias("v"))


def global_threshold(voxels: DataFrame, sds: float) -> DataFrame:
    """Rows brighter than their plane's mean plus `sds` sample standard deviations. A row for each plane is broadcast, so no
    voxel is shuffled to its plane."""
    stats = voxels.groupBy("z").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return voxels.join(F.broadcast(stats), "z").where(F.col("v") > F.col("m") + sds * F.col("s")).select("z", "y", "x", "v")


@dataclass(frozen=True)
class Tiling:
    """Tiles with half overlap along an axis of n pixels."""

    n: int
    size: int

    @property
    def step(self) -> int:
        return self.size // 2

    @property
    def count(self) -> int:
        return max(self.n // self.step - 1, 1)

    @property
    def left(self) -> int:
        return self.n % self.step

    def tiles(self, at: Column) -> Column:
        """Every tile that holds the pixel."""
        if self.count < 2:
            return F.array(F.lit(0))
        k = F.floor((at - self.left // 2) / self.step)
        return F.filter(F.array(k - 1, k), lambda t: (t >= 0) & (t < self.count) & (at >= self.left // 2))

    def own(self, at: Column) -> Column:
        """The tile whose threshold the pixel is held to."""
        if self.count < 2:
            return F.lit(0).cast("long")
        return F.least(F.greatest(F.floor((at + (self.step - self.left) // 2) / self.step) - 1, F.lit(0)), F.lit(self.count - 1)).cast("long")


def tiled_threshold(voxels: DataFrame, shape: tuple[int, int], tile: int, sds: float, tile_sds: float) -> DataFrame:
    """Rows over both the plane's and their tile's threshold. Tiles of under 2 pixels, or planes with a single tile, leave the plane's alone."""
    bright = global_threshold(voxels, sds)
    if tile < 2:
        return bright
    ty, tx = Tiling(shape[0], tile), Tiling(shape[1], tile)
    if ty.count < 2 and tx.count < 2:
        return bright
    dealt = voxels.withColumn("ty", F.explode(ty.tiles(F.col("y")))).withColumn("tx", F.explode(tx.tiles(F.col("x"))))
    stats = dealt.groupBy("z", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return bright.withColumn("ty", ty.own(F.col("y"))).withColumn("tx", tx.own(F.col("x"))).join(stats, ["z", "ty", "tx"]).where(F.col("v") > F.col("m") + tile_sds * F.col("s")).select("z", "y", "x", "v")


def corner_stats(voxels: DataFrame, tile: int) -> DataFrame:
    """Mean and population deviation of the tile in each plane's corner."""
    return voxels.where((F.col("y") < tile) & (F.col("x") < tile)).groupBy("z").agg(F.avg("v").alias("corner_mean"), F.stddev_pop("v").alias("corner_std"))


def tile_means(voxels: DataFrame, shape: tuple[int, int], tile: int) -> DataFrame:
    """Means of whole tiles."""
    whole = voxels.where((F.col("y") < shape[0] // tile * tile) & (F.col("x") < shape[1] // tile * tile))
    return whole.groupBy("z", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(F.avg("v").alias("tile_mean"))


def bright_tiles(voxels: DataFrame, shape: tuple[int, int], tile: int) -> DataFrame:
    """z, ty, tx and inside, for whole tiles; planes smaller than a tile have none."""
    return tile_means(voxels, shape, tile).join(corner_stats(voxels, tile), "z").select("z", "ty", "tx", (F.col("tile_mean") >= F.col("corner_mean") + 2 * F.col("corner_std") + 1).alias("inside"))


def laplacian(voxels: DataFrame) -> DataFrame:
    """4-neighbour Laplacian, edges replicated. Neighbours are rows of the same line, so each window is one line."""
    line, column = Window.partitionBy("z", "y").orderBy("x"), Window.partitionBy("z", "x").orderBy("y")
    near = [F.coalesce(f("v").over(w), F.col("v")) for w in (line, column) for f in (F.lag, F.lead)]
    return voxels.select("z", "y", "x", (near[0] + near[1] + near[2] + near[3] - 4 * F.col("v")).alias("v"))


def median3(voxels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """3x3 median; what lies outside the plane counts as 0."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    rows = voxels.select("z", "y", "x", "v", F.explode(steps).alias("dy")).select("z", "y", "x", "v", "dy", F.explode(steps).alias("dx"))
    dealt = rows.select("z", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    inside = dealt.where(F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1))
    nine = inside.groupBy("z", "y", "x").agg(F.collect_list("v").alias("near"))
    padded = F.concat("near", F.array_repeat(F.lit(0).cast(voxels.schema["v"].dataType), 9))
    return nine.select("z", "y", "x", F.element_at(F.sort_array(F.slice(padded, 1, 9)), 5).alias("v"))


def gaussian_weights(sigma: float) -> list[float]:
    radius = round(4 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _reflect(at: Column, n: int) -> Column:
    """Index in 0..n-1 under symmetric reflection (d c b a | a b c d | d c b a)."""
    k = F.pmod(at, F.lit(2 * n))
    return F.when(k < n, k).otherwise(2 * n - 1 - k)


def gaussian(voxels: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    """Separable Gaussian, first along y, then along x. Lines travel as arrays, so each pass is one shuffle of the volume."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2

    def along(rows: DataFrame, axis: str, other: str, n: int) -> DataFrame:
        lines = rows.groupBy("z", other).agg(F.sort_array(F.collect_list(F.struct(axis, "v"))).alias("line"))
        at = lambda i, k: F.get(F.col("line"), _reflect(i + (k - radius), n).cast("int"))["v"]
        smooth = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: sum((at(i, k) * w for k, w in enumerate(weights)), F.lit(0.0)))
        return lines.select("z", other, F.posexplode(smooth).alias(axis, "v")).withColumn(axis, F.col(axis).cast("long"))

    return along(along(voxels, "y", "x", shape[0]), "x", "y", shape[1]).select("z", "y", "x", "v")


def flipped_peaks(part: np.ndarray, sigma: float) -> np.ndarray:
    """Median, Gaussian and negated Laplacian of a plane, or of a part of one whose borders with the rest do not count."""
    p = np.pad(part, 1)
    out = np.median(np.stack([p[i : i + part.shape[0], j : j + part.shape[1]] for i in range(3) for j in range(3)]), 0)
    weights = np.array(gaussian_weights(sigma))
    radius = len(weights) // 2
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.arange(-radius, n + radius) % (2 * n)
        wide = np.take(out, np.where(at < n, at, 2 * n - 1 - at), axis)
        out = sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(weights))
    e = np.pad(out, 1, mode="edge")
    return 4 * out - (e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:])


def enhance_plane(plane: np.ndarray, sigma: float, most: float) -> np.ndarray:
    """Median, Gaussian, Laplacian, flipped normalisation of one plane."""
    flipped = flipped_peaks(plane, sigma)
    flipped = flipped - flipped.min()
    return flipped / (flipped.max() or 1.0) * most


def with_border(voxels: DataFrame, shape: tuple[int, int], size: int, border: int) -> DataFrame:
    """voxels, once for each tile (ty, tx) of that size that they lie in or within `border` of."""
    near = lambda a, n: F.explode(F.sequence(F.greatest(F.floor((F.col(a) - border) / size), F.lit(0)), F.least(F.floor((F.col(a) + border) / size), F.lit((n - 1) // size).cast("long"))))
    return voxels.select("z", "y", "x", "v", near("y", shape[0]).alias("ty")).select("*", near("x", shape[1]).alias("tx"))


def enhance(voxels: DataFrame, shape: tuple[int, int], sigma: float, most: float, size: int = 512) -> DataFrame:
    """Peak enhancement. Each task has a tile of a plane and as much around it as the three stencils reach, so that planes
    may be of any size; the smallest and largest value of a plane, which normalise it, are an aggregate behind that."""
    border = 2 + len(gaussian_weights(sigma)) // 2
    size = max(size, border)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = [max(0, int(k) * size - border) for k in key[1:]]
        high = [min(n, (int(k) + 1) * size + border) for k, n in zip(key[1:], shape)]
        part = np.zeros([b - a for a, b in zip(low, high)])
        part[pdf["y"] - low[0], pdf["x"] - low[1]] = pdf["v"]
        own = [slice(int(k) * size - a, min((int(k) + 1) * size, n) - a) for k, a, n in zip(key[1:], low, shape)]
        peaks = flipped_peaks(part, sigma)[*own]
        y, x = np.indices(peaks.shape)
        return pd.DataFrame({"z": int(key[0]), "y": y.ravel() + own[0].start + low[0], "x": x.ravel() + own[1].start + low[1], "v": peaks.ravel()})

    peaks = with_border(voxels, shape, size, border).groupBy("z", "ty", "tx").applyInPandas(run, "z long, y long, x long, v double")
    return normalise(peaks, most, flip=False)


def bin_mean_2d(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """Means of blocks; blocks over the edge are filled with zeros."""
    return voxels.groupBy("z", F.floor(F.col("y") / height).alias("by"), F.floor(F.col("x") / width).alias("bx")).agg((F.sum("v") / (height * width)).alias("v"))


def bin_mean_3d(voxels: DataFrame, shape: tuple[int, int, int], bins: tuple[int, int, int]) -> DataFrame:
    if any(n % b for n, b in zip(shape, bins)):
        raise ValueError("bins have to tile the volume")
    return voxels.groupBy(*(F.floor(F.col(a) / b).alias(f"b{a}") for a, b in zip("zyx", bins))).agg(F.avg("v").alias("v"))


def crop_centre(voxels: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    y, x = ((n - m) // 2 for n, m in zip(shape, to))
    rows = voxels.where(F.col("y").between(y, y + to[0] - 1) & F.col("x").between(x, x + to[1] - 1))
    return rows.select("z", (F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "v")


def pad_centre(voxels: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Widen planes by repeating their edges; an odd pad has its extra line behind. Only edge rows are multiplied."""

    def targets(axis: str, n: int, m: int) -> Column:
        before = (m - n) // 2
        at = F.col(axis) + before
        first = F.when(F.col(axis) == 0, F.lit(0).cast("long")).otherwise(at)
        last = F.when(F.col(axis) == n - 1, F.lit(m - 1).cast("long")).otherwise(at)
        return F.explode(F.sequence(first, last))

    return voxels.select("z", targets("y", shape[0], to[0]).alias("y"), "x", "v").select("z", "y", targets("x", shape[1], to[1]).alias("x"), "v")


def in_sphere(voxels: DataFrame, centre: dict[str, float], radius: dict[str, float]) -> DataFrame:
    """Voxels in an ellipsoid, its surface included."""
    return voxels.where(sum((F.pow((F.col(a) - c) / radius[a], F.lit(2)) for a, c in centre.items()), F.lit(0.0)) <= 1)


def sampled_stats(voxels: DataFrame, planes: int, sampled: int) -> DataFrame:
    """Mean and sample deviation over every step-th plane."""
    step = max(1, planes // sampled)
    return voxels.where(F.col("z") % step == 0).agg(F.avg("v").alias("v_mean"), F.stddev_samp("v").alias("v_std"))
