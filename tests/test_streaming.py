"""Streams of planes against the same operators on whole volumes."""

from fractions import Fraction

import numpy as np
import pytest

from volumetra.operators import ball, planes
from volumetra.streaming import planes as streaming

SHAPE, XY, Z = (9, 24, 20), 3, 3


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(3).integers(0, 90, SHAPE).astype(np.float64)


def voxel_rows(spark, at):
    return spark.createDataFrame([tuple(map(int, r)) for r in at], streaming.BRIGHT_SCHEMA)


def arrive(spark, folder, at, order):
    """A file for each plane, in the order given, and the closing voxel."""
    for z in order:
        voxel_rows(spark, at[at[:, 0] == z]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(streaming.BRIGHT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(stream, tmp_path, name):
    spark = stream.sparkSession
    out = str(tmp_path / f"{name}-out")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    assert not query.isActive
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect())


@pytest.mark.parametrize("late", [0, 2])
def test_stream_gives_what_the_batch_gives(spark, volume, tmp_path, late):
    at = np.argwhere(volume > 60)
    order = [z ^ 1 if z < 8 else z for z in range(SHAPE[0])] if late else range(SHAPE[0])
    end = streaming.closing(SHAPE, XY, Z, late)
    stream = arrive(spark, str(tmp_path / "in"), np.vstack([at, end]), [*order, end[0]])
    tiles = spark.createDataFrame([(z, y, x, (z + y + x) % 3 > 0) for z in range(SHAPE[0]) for y in range(3) for x in range(3)], "z long, ty long, tx long, inside boolean")
    whole = voxel_rows(spark, at)
    want = sorted(tuple(r) for r in ball.overlap(whole, SHAPE, XY, Z).collect())
    assert want and finish(streaming.overlap(stream, SHAPE, XY, Z, late), tmp_path, "overlap") == want
    ratio = Fraction(2, 5)
    want = sorted(tuple(r) for r in ball.marks(whole, SHAPE, XY, Z, ratio, tiles, 8).collect())
    assert want and finish(streaming.marks(stream, SHAPE, XY, Z, ratio, tiles, 8, late), tmp_path, "marks") == want


def test_bright_voxels(spark, volume):
    rows = [(z, SHAPE[1], SHAPE[2], p.astype("<f8").tobytes()) for z, p in enumerate(volume)]
    got = streaming.bright_voxels(spark.createDataFrame(rows, streaming.PLANES_SCHEMA), 1.6, 80, 1.0).collect()
    voxels = spark.createDataFrame([(*map(int, i), float(min(v, 80))) for i, v in np.ndenumerate(volume)], "z long, y long, x long, v double")
    want = planes.global_threshold(planes.enhance(voxels, SHAPE[1:], 1.6, 80), 1.0).select("z", "y", "x").collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_plane_in_one_file_is_sent_by_all_tasks(spark, volume):
    at = np.argwhere(volume > 80)
    rows = voxel_rows(spark, at).coalesce(1)
    found = streaming.overlap(rows, SHAPE, XY, Z)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ball.overlap(rows, SHAPE, XY, Z).collect()))


def test_threshold_shuffles_no_voxels(spark, volume):
    rows = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(volume)], "z long, y long, x long, v double")
    found = planes.global_threshold(rows, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    bright = volume > volume.mean((1, 2), keepdims=True) + volume.std((1, 2), ddof=1, keepdims=True)
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(map(tuple, np.argwhere(bright).tolist()))
