"""The ball filter with marks that count as bright for the planes behind them.

Planes come in batches, in order. A batch is filtered together with the depth of the ball before it, all as it stood when
the batch began; then its marks join the bright voxels that later batches see. So a plane's marks rest on all planes
before it, while within a plane they rest on what lies a ball's radius away for each batch in between. That bounds what
tiles have to know: a slab of batches is folded in one job, each task a tile with a border of that width, and only the
bright voxels and marks of the last planes go on to the next slab, as a table.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators.ball import ball_kernel, valid
from volumetra.operators.components import step_folder

#: Planes of a slab and edge of a tile, about.
SLAB, TILE = 16, 256
MARKED, CARRIED = 0, 1
FOUND = "kind int, z long, y long, x long"


def fold(bright: np.ndarray, kernel: np.ndarray, limit: Fraction, ends: list[int], begin: int = 0, inside: np.ndarray | None = None) -> np.ndarray:
    """Marks of the planes from `begin` on, batch after batch (each ends where `ends` says); they are set in `bright` too."""
    kz, ky, kx = kernel.shape
    h, w = bright.shape[1] - ky + 1, bright.shape[2] - kx + 1
    marks = np.zeros_like(bright)
    for end in ends:
        low = max(0, begin - kz + 1)
        begin, n = end, end - low - kz + 1
        if min(n, h, w) < 1:
            continue
        total = np.zeros((n, h, w), np.int32)
        for (z, y, x), weight in np.ndenumerate(kernel):
            if weight:
                total += np.int32(weight) * bright[low + z : low + z + n, y : y + h, x : x + w]
        z, y, x = low + kz // 2, (ky - 1) // 2, (kx - 1) // 2
        own = (slice(z, z + n), slice(y, y + h), slice(x, x + w))
        over = total.astype(np.int64) * limit.denominator > limit.numerator
        if inside is not None:
            over &= inside[own]
        marks[own] |= over
        bright[own] |= over
    return marks


def _near(low: Column, high: Column, border: int, size: int, n: int) -> Column:
    """The tiles of an axis of n that hold any of low..high within their border."""
    return F.explode(F.sequence(F.greatest(F.floor((low - border) / size), F.lit(0)), F.least(F.floor((high + border) / size), F.lit((n - 1) // size).cast("long"))))


def folded(bright: DataFrame, shape: tuple[int, int, int], xy: int, z: int, fraction: Fraction, begin: int, end: int, batch: int, tiles: DataFrame | None = None, tile: int = 0, size: int = TILE) -> DataFrame:
    """kind, z, y, x of one slab, planes begin..end: what is marked, and what the next slab has to know. bright: the slab's
    bright voxels and what was carried from the planes before it. tiles, if given, keep marks to those that are inside."""
    kernel = ball_kernel(xy, z)
    _, h, w = shape
    valid(shape, kernel)
    limit, first = fraction * int(kernel.sum()), max(0, begin - z + 1)
    ends = [min(k + batch, end) - first for k in range(begin, end, batch)]
    border = len(ends) * (xy // 2)
    size = max(size, border)
    edge = lambda k, n: (max(0, k * size - border), min(n, (k + 1) * size + border))

    def run(key: tuple, rows: pd.DataFrame, mask: pd.DataFrame | None = None) -> pd.DataFrame:
        (y0, y1), (x0, x1) = edge(int(key[0]), h), edge(int(key[1]), w)
        grid = np.zeros((end - first, y1 - y0, x1 - x0), bool)
        grid[rows["z"] - first, rows["y"] - y0, rows["x"] - x0] = True
        inside = None
        if mask is not None:
            inside = np.zeros_like(grid)
            for p, ty, tx in zip(mask["z"], mask["ty"], mask["tx"]):
                inside[p - first, max(0, ty * tile - y0) : max(0, (ty + 1) * tile - y0), max(0, tx * tile - x0) : max(0, (tx + 1) * tile - x0)] = True
        marks = fold(grid, kernel, limit, ends, begin - first, inside)
        own = (slice(int(key[0]) * size - y0, (int(key[0]) + 1) * size - y0), slice(int(key[1]) * size - x0, (int(key[1]) + 1) * size - x0))
        out = []
        for kind, found, plane in ((MARKED, marks, 0), (CARRIED, grid[max(0, end - first - z + 1) :], max(0, end - first - z + 1))):
            at = np.argwhere(found[:, own[0], own[1]])
            out.append(pd.DataFrame({"kind": np.int32(kind), "z": at[:, 0] + plane + first, "y": at[:, 1] + own[0].start + y0, "x": at[:, 2] + own[1].start + x0}))
        return pd.concat(out)

    keys = ("by", "bx")
    dealt = bright.where(F.col("z") < end).select("z", "y", "x", _near(F.col("y"), F.col("y"), border, size, h).alias("by")).select("*", _near(F.col("x"), F.col("x"), border, size, w).alias("bx")).groupBy(*keys)
    if tiles is None:
        return dealt.applyInPandas(lambda key, rows: run(key, rows), FOUND)
    wide = lambda c, n: _near(F.col(c) * tile, F.least(F.col(c) * tile + tile, F.lit(n)) - 1, border, size, n)
    mask = tiles.where(F.col("inside") & F.col("z").between(first, end - 1)).select("z", "ty", "tx", wide("ty", h).alias("by")).select("*", wide("tx", w).alias("bx"))
    empty = pd.DataFrame({"kind": np.zeros(0, np.int32), **{a: np.zeros(0, np.int64) for a in "zyx"}})
    return dealt.cogroup(mask.groupBy(*keys)).applyInPandas(lambda key, rows, mask: run(key, rows, mask) if len(rows) else empty, FOUND)


def marks(bright: DataFrame, shape: tuple[int, int, int], xy: int, z: int, fraction: Fraction, tiles: DataFrame | None = None, tile: int = 0, batch: int = 1, slab: int = SLAB, size: int = TILE) -> DataFrame:
    """z, y, x of the marks, as `ball.marks`, but with marks that feed back after each batch of planes. With a batch of all
    planes both agree. There is a job for each slab, as a slab has to wait for the one before it."""
    spark, folder = bright.sparkSession, step_folder(bright.sparkSession)
    slab, carried = max(1, slab // batch) * batch, None
    for begin in range(0, shape[0], slab):
        end = min(begin + slab, shape[0])
        rows = bright.where(F.col("z").between(begin, end - 1)).select("z", "y", "x")
        found = folded(rows if carried is None else rows.unionByName(carried), shape, xy, z, fraction, begin, end, batch, tiles, tile, size)
        found.write.parquet(f"{folder}/marks/slab={begin}")
        carried = spark.read.schema(FOUND).parquet(f"{folder}/marks/slab={begin}").where(F.col("kind") == CARRIED).select("z", "y", "x")
    return spark.read.schema(FOUND).parquet(f"{folder}/marks/slab=*").where(F.col("kind") == MARKED).select("z", "y", "x")
