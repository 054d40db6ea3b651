"""Detection on planes that arrive in order of z.

The plane number is the event time, one second a plane. What a bright voxel counts for is a streaming aggregate on
plane, row and column; its watermark lies as far back as the ball is deep, so that a plane of overlaps comes out as soon
as its last neighbour is in, and the state holds only the planes that the ball still reaches. State is spread by key, so
no task gathers a plane.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.operators import ball
from volumetra.operators.planes import enhance_plane

#: Event time of plane 0, in seconds: the first watermark is 0, and what lies before it would count as late.
ORIGIN = 1 << 20
#: Rows of a plane that stay together when a stream's bright voxels are dealt to tasks.
TOGETHER = 16
PLANES_SCHEMA = "z long, h int, w int, data binary"
BRIGHT_SCHEMA = "z long, y long, x long"


def bright_voxels(planes: DataFrame, sigma: float, most: float, sds: float) -> DataFrame:
    """z, y, x of the bright voxels of planes given as rows z, h, w, data (float64, row after row). Each plane is enhanced
    and held to its mean plus `sds` sample deviations by itself, so there is no state; the plan is the same for a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for z, h, w, data in zip(frame["z"], frame["h"], frame["w"], frame["data"]):
                peaks = enhance_plane(np.clip(np.frombuffer(data, "<f8").reshape(h, w), 0, most), sigma, most)
                y, x = np.nonzero(peaks > peaks.mean() + sds * peaks.std(ddof=1)) if peaks.size > 1 else ((), ())
                yield pd.DataFrame({"z": np.full(len(y), z, np.int64), "y": np.asarray(y, np.int64), "x": np.asarray(x, np.int64)})

    return planes.select("z", "h", "w", "data").mapInPandas(run, BRIGHT_SCHEMA)


def overlap(bright: DataFrame, shape: tuple[int, int, int], xy: int, z: int, late: int = 0) -> DataFrame:
    """As `ball.overlap`, of a stream of bright voxels, in append mode. A plane may come up to `late` planes after a later
    one; what comes after that is dropped, as by any watermark. The last planes need a `closing` row behind them. A plane may
    come as one file, so its rows are dealt to all cores before its voxels are sent to their neighbours."""
    kernel = ball.ball_kernel(xy, z)
    limits = ball.valid(shape, kernel)
    dealt = bright.repartition(bright.sparkSession.sparkContext.defaultParallelism, "z", F.floor(F.col("y") / TOGETHER))
    at = ball.sent(dealt, kernel).select(F.timestamp_seconds(F.col("z") + ORIGIN).alias("at"), "y", "x", "w")
    timed = at.withWatermark("at", f"{z - 1 + late} seconds")
    for a in "yx":
        timed = timed.where(F.col(a).between(*limits[a]))
    # the event time itself is compared, so that this filter stays behind the watermark, which a closing row moves
    inside = timed.where(F.col("at").between(*(F.timestamp_seconds(F.lit(n + ORIGIN)) for n in limits["z"])))
    return inside.groupBy("at", "y", "x").agg(F.sum("w").alias("overlap")).select((F.unix_seconds("at") - ORIGIN).alias("z"), "y", "x", "overlap")


def marks(bright: DataFrame, shape: tuple[int, int, int], xy: int, z: int, fraction: Fraction, tiles: DataFrame | None = None, tile: int = 0, late: int = 0) -> DataFrame:
    """As `ball.marks`, of a stream; the inside tiles, if given, are a table and not a stream."""
    return ball.marked(overlap(bright, shape, xy, z, late), fraction * int(ball.ball_kernel(xy, z).sum()), tiles, tile)


def closing(shape: tuple[int, int, int], xy: int, z: int, late: int = 0) -> tuple[int, int, int]:
    """A voxel (z, y, x) so far behind the volume that it counts for nothing, and that lets all planes before it out."""
    return shape[0] + 2 * z + late, shape[1] // 2, shape[2] // 2
