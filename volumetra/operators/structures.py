"""Measuring, triage and splitting of structures."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators.ball import ball_kernel, sphere
from volumetra.operators.components import label_points

#: Codes of point types. The artifact's is a choice of this library.
UNKNOWN, NO_CELL, CELL, ARTIFACT = 1, 1, 2, -1


def even_round(total: Column, count: Column) -> Column:
    """total / count of integers >= 0, rounded half to even in integers."""
    low, twice = F.floor(total / count), 2 * (total % count)
    up = (twice > count) | ((twice == count) & (low % 2 == 1))
    return (low + up.cast("long")).cast("long")


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("sid").agg(F.count("*").alias("volume"))


def centres(labelled: DataFrame) -> DataFrame:
    """sid, x, y, z and volume: the mean position, rounded half to even."""
    n = F.count("*")
    return labelled.groupBy("sid").agg(*(even_round(F.sum(a), n).alias(a) for a in "xyz"), n.alias("volume"))


def boxes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("sid").agg(*(e for a in "xyz" for e in (F.min(a).alias(f"min_{a}"), (F.max(a) - F.min(a) + 1).alias(f"size_{a}"))))


def point_lists(labelled: DataFrame, most: int = 100_000) -> DataFrame:
    """sid, part and points (an array of x, y, z in raster order) of each structure. A structure of more than `most` voxels
    comes in several parts of about that many, so that no task gathers one of any size."""
    counted = sizes(labelled).select("sid", F.ceil(F.col("volume") / most).alias("_parts"))
    dealt = labelled.join(counted, "sid").withColumn("part", F.pmod(F.xxhash64("z", "y", "x"), F.col("_parts")))
    ordered = F.array_sort(F.collect_list(F.struct("z", "y", "x")))
    return dealt.groupBy("sid", "part").agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("points"))


def triage(volume: Column, cell_below: float, cluster_below: float, names=("cell", "needs_split", "artifact")) -> Column:
    return F.when(volume < cell_below, names[0]).when(volume < cluster_below, names[1]).otherwise(names[2])


def non_zero_min(v: Column, most: int) -> Column:
    return F.coalesce(F.min(F.nullif(v, F.lit(0))), F.lit(most))


def erode(bright: np.ndarray, kernel: np.ndarray, limit: Fraction) -> np.ndarray:
    """One ball filter round over a whole local volume: voxels under a full ball whose overlap exceeds the limit."""
    out = np.zeros_like(bright)
    kz, ky, kx = kernel.shape
    shape = [n - k + 1 for n, k in zip(bright.shape, kernel.shape)]
    if min(shape) < 1:
        return out
    total = np.zeros(shape, np.int64)
    for (z, y, x), w in np.ndenumerate(kernel):
        total += int(w) * bright[z : z + shape[0], y : y + shape[1], x : x + shape[2]]
    z, y, x = kz // 2, (ky - 1) // 2, (kx - 1) // 2
    out[z : z + shape[0], y : y + shape[1], x : x + shape[2]] = total * limit.denominator > limit.numerator
    return out


def split_points(points: np.ndarray, ball: tuple[int, int], fraction: Fraction, rounds: int, correct: bool = False) -> np.ndarray:
    """Centres (x, y, z) that a structure's voxels (x, y, z) fall into: those of the first erosion round with the most
    pieces, if more than one. Unless `correct`, they carry the padding's shift, as the original method's results do."""
    xy, z = ball
    pad = xy // 2
    low = points.min(0)
    grid = np.zeros([int(n) + 1 + 2 * pad for n in (points.max(0) - low)][::-1], bool)
    local = points - low + pad
    grid[local[:, 2], local[:, 1], local[:, 0]] = True
    kernel = ball_kernel(xy, z)
    limit = fraction * int(kernel.sum())
    best = np.rint(points.mean(0)).astype(np.int64)[None]
    for _ in range(rounds):
        grid = erode(grid, kernel, limit)
        at = np.argwhere(grid)
        if not len(at):
            break
        label = label_points(at[:, 0], at[:, 1], at[:, 2], np.arange(len(at)))
        found = [np.rint(at[label == k].mean(0))[::-1] for k in np.unique(label)]
        if len(found) > len(best):
            best = np.array(found, np.int64) + low - (pad if correct else 0)
    return best


def split_or_error(labelled: DataFrame, ball: tuple[int, int], fraction: Fraction, rounds: int, correct: bool = False, split: Callable[..., np.ndarray] = split_points) -> DataFrame:
    """sid, x, y, z and error of the centres of each structure; a structure that cannot be split gives one row with its
    error and no place, and costs the others nothing. Structures to split are bounded by the largest cluster size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = split(pdf[["x", "y", "z"]].to_numpy(), ball, fraction, rounds, correct=correct)
            rows = {"x": out[:, 0], "y": out[:, 1], "z": out[:, 2], "error": None}
        except Exception as e:
            rows = {"x": [None], "y": [None], "z": [None], "error": [f"{type(e).__name__}: {e}"]}
        frame = pd.DataFrame(rows).astype({"x": "Int64", "y": "Int64", "z": "Int64"})
        return frame.assign(sid=pdf["sid"].iloc[0])[["sid", "x", "y", "z", "error"]]

    return labelled.groupBy("sid").applyInPandas(run, "sid long, x long, y long, z long, error string")


def split_structures(labelled: DataFrame, ball: tuple[int, int], fraction: Fraction, rounds: int, correct: bool = False) -> DataFrame:
    """sid, x, y and z of the centres of each structure; one that cannot be split fails the job, with its sid."""
    rows = split_or_error(labelled, ball, fraction, rounds, correct)
    broken = F.raise_error(F.concat(F.lit("structure "), F.col("sid").cast("string"), F.lit(": "), F.col("error"))).cast("long")
    return rows.select("sid", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("x")).alias("x"), "y", "z")


def stamped(points: DataFrame, shape: tuple[int, int, int], radius: int) -> DataFrame:
    """z, y, x and idx of a ball around each point (idx, x, y, z, whole numbers); of balls that overlap, the smallest idx
    shows. Balls that do not lie in the volume as a whole are left out. Only the balls' voxels are rows."""
    inside = points
    for a, n in zip("zyx", shape):
        inside = inside.where(F.col(a).between(radius, n - 1 - radius))
    steps = F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"d{a}") for a, v in zip("zyx", at))) for at in sphere(radius)))
    each = inside.select("idx", "z", "y", "x", F.explode(steps).alias("s"))
    return each.groupBy(*((F.col(a) + F.col(f"s.d{a}")).cast("long").alias(a) for a in "zyx")).agg(F.min("idx").alias("idx"))
