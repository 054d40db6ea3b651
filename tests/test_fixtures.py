"""Known inputs with known results: thresholds, tiles, components, cubes and batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volumetra.functions.dtypes import max_exact
from volumetra.operators import ball, components, cubes, planes, points, structures
from volumetra.plans.detection import channel_cubes, detect
from volumetra.settings import DetectionSettings


def rows(spark, volume):
    z, y, x = (i.ravel() for i in np.indices(volume.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "v": volume.ravel().astype(float)}))


def spots(shape, *places):
    """A plane with squares (first row and column, value) of 5 x 5 pixels."""
    out = np.zeros((1, *shape))
    for at, value in places:
        out[0, at : at + 5, at : at + 5] = value
    return out


def enhanced(spark, plane):
    s = DetectionSettings(voxel_sizes=(1.0, 1.0, 1.0), soma_diameter_um=5)
    return planes.enhance(rows(spark, plane), plane.shape[1:], s.sigma, s.clip_value)


@pytest.mark.parametrize("places,bounds", [
    ([(23, 10)], {1: (20, 30), 50: (0, 0)}),
    ([(13, 5), (33, 20)], {0.1: (40, 60), 2: (20, 35), 50: (0, 0)}),
])
def test_global_threshold_of_spots(spark, places, bounds):
    peaks = enhanced(spark, spots((50, 50), *places)).cache()
    for sds, (low, high) in bounds.items():
        assert low <= planes.global_threshold(peaks, sds).count() <= high


def test_tiled_threshold_of_spots(spark):
    peaks = enhanced(spark, spots((50, 50), (3, 5), (43, 20))).cache()
    for (sds, tile_sds), (low, high) in {(2, 2): (0, 0), (2, -2): (20, 35), (0, -2): (40, 60)}.items():
        assert low <= planes.tiled_threshold(peaks, (50, 50), 5, sds, tile_sds).count() <= high
    assert 20 <= planes.tiled_threshold(peaks, (50, 50), 1, 2, 2).count() <= 35  # tiles of a pixel are none


@pytest.mark.parametrize("shape", [(50, 23), (23, 50), (25, 25), (57, 57)])
def test_tiled_threshold_of_odd_shapes(spark, shape):
    peaks = enhanced(spark, spots(shape, (3, 5)))
    assert 20 <= planes.tiled_threshold(peaks, shape, 25, 1, 1).count() <= 30


def test_ball_offsets():
    for depth, (first, remaining) in zip(range(1, 7), [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 2)]):
        low, high = ball.valid((20, 9, 9), ball.ball_kernel(3, depth))["z"]
        assert (low, 19 - high) == (first, remaining)


@pytest.mark.parametrize("depth,z", [(5, [1, 2, 3]), (2, [])])
def test_planes_that_a_ball_can_judge(spark, depth, z):
    """All voxels bright: every plane that the whole ball fits around is marked, and no other; too few planes are no error."""
    bright = rows(spark, np.ones((depth, 12, 12))).select("z", "y", "x")
    found = ball.marks(bright, (depth, 12, 12), 3, 3, ball.Fraction(3, 5))
    assert sorted(r.z for r in found.select("z").distinct().collect()) == z
    assert detect(rows(spark, np.zeros((depth, 50, 50))), (depth, 50, 50), DetectionSettings()).count() == 0


@pytest.mark.parametrize("n", [30, 64])
def test_checkerboard(spark, n):
    at = np.argwhere(np.add.outer(np.arange(2 * n), np.arange(n)) % 2 == 0)
    board = spark.createDataFrame(pd.DataFrame({"z": 0, "y": at[:, 0], "x": at[:, 1]}))
    found = components.connected_components(board, (1, 2 * n, n), tile=16)
    assert found.count() == found.select("sid").distinct().count() == n * n


# Pixels (z, y, x) of a volume of 2 x 2 x 3, and the components that they make.
TABLE = [
    ([], []),
    ([(0, 0, 0), (0, 0, 1)], [[(0, 0, 0), (0, 0, 1)]]),
    ([(0, 0, 0), (0, 1, 0)], [[(0, 0, 0), (0, 1, 0)]]),
    ([(0, 0, 0), (1, 0, 0)], [[(0, 0, 0), (1, 0, 0)]]),
    ([(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0)], [[(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0)]]),
    ([(0, 1, 1), (1, 0, 1), (1, 1, 0), (1, 1, 1)], [[(0, 1, 1), (1, 0, 1), (1, 1, 0), (1, 1, 1)]]),  # merged by the last voxel
    ([(0, 0, 1), (1, 0, 0), (1, 0, 1)], [[(0, 0, 1), (1, 0, 0), (1, 0, 1)]]),
    ([(0, 0, 0), (0, 0, 2)], [[(0, 0, 0)], [(0, 0, 2)]]),
    ([(0, 0, 0), (1, 1, 1)], [[(0, 0, 0)], [(1, 1, 1)]]),  # diagonals do not connect
]


@pytest.mark.parametrize("slab", [1, 2])
def test_components_by_table(spark, slab):
    """All rows of the table side by side in one volume, three columns apart."""
    moved = [(z, y, x + 6 * k) for k, (pixels, _) in enumerate(TABLE) for z, y, x in pixels]
    groups: dict = {}
    for r in components.connected_components(spark.createDataFrame(moved, "z long, y long, x long"), (2, 2, 6 * len(TABLE)), slab, tile=4).collect():
        groups.setdefault(r.sid, []).append((r.z, r.y, r.x))
    want = [sorted((z, y, x + 6 * k) for z, y, x in part) for k, (_, parts) in enumerate(TABLE) for part in parts]
    assert sorted(map(sorted, groups.values())) == sorted(want)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64"])
def test_smallest_value_over_zero(spark, dtype):
    table = spark.createDataFrame([(0, v) for v in range(10)] + [(1, 0)] * 5, "k int, v long")
    got = {r.k: r.v for r in table.groupBy("k").agg(structures.non_zero_min(F.col("v"), max_exact(dtype)).alias("v")).collect()}
    assert got == {0: 1, 1: max_exact(dtype)}


def test_centre_of_a_cross(spark):
    cross = [(1, 1, 1), (0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2)]
    got = structures.centres(spark.createDataFrame([(0, *c) for c in cross], "sid long, z long, y long, x long")).first()
    assert (got.x, got.y, got.z, got.volume) == (1, 1, 1, 7)


def test_cuboid_ranges(spark):
    one = spark.createDataFrame([(10.0,)], "p double")
    for axis in "xyz":
        assert one.select(cubes.cube_start(F.col("p"), 10, axis)).first()[0] == 5
    with pytest.raises(ValueError):
        cubes.cube_start(F.col("p"), 10, "m")


@pytest.mark.parametrize("places,z", [([(5, 15, 15), (3, 15, 15), (27, 15, 15)], 10), ([(10, 15, 15), (6, 15, 15), (24, 15, 15)], 20)])
def test_only_full_cubes(spark, places, z):
    """With a network of twice the voxel size along x, its cubes are twice as long in the data."""
    given = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "idx long, x double, y double, z double")
    long = cubes.data_voxels(10, z / 10, 1.0)
    assert long == z
    full = cubes.full_only(cubes.bounds(given, dict(z=10, y=10, x=long)), dict(z=30, y=30, x=30))
    assert [r.idx for r in full.collect()] == [0]


def test_cube_contents(spark):
    """Two channels of counted voxels, against slices of the array."""
    volume = (np.arange(20 * 20 * 30 * 2) + 7).reshape(20, 20, 30, 2).astype(np.uint16)  # x, y, z, channel
    given = spark.createDataFrame([(0, 5.0, 5.0, 10.0), (1, 10.0, 10.0, 20.0)], "idx long, x double, y double, z double")
    channels = [rows(spark, np.moveaxis(volume[..., c], (0, 1, 2), (2, 1, 0))) for c in (0, 1)]
    got = np.zeros((2, 2, 5, 3, 3))
    for r in channel_cubes(given, channels, (30, 20, 20), (5, 3, 3)).collect():
        got[r.idx, r.channel, r.dz, r.dy, r.dx] = r.v
    for k, (x, y, z) in enumerate([(5, 5, 10), (10, 10, 20)]):
        x0, y0, z0 = round(x - 1.5), round(y - 1.5), z - 2
        want = volume[x0 : x0 + 3, y0 : y0 + 3, z0 : z0 + 5]
        assert all((got[k, c] == np.moveaxis(want[..., c], (0, 1, 2), (2, 1, 0))).all() for c in (0, 1))


@pytest.mark.parametrize("size,batches,last", [(1, 12, [11]), (4, 3, [8, 9, 10, 11]), (5, 3, [10, 11])])
def test_batches_of_twelve(spark, size, batches, last):
    given = spark.createDataFrame([(k, 0.0, float(k % 3)) for k in range(12)], "idx long, z double, y double")
    got = points.batches(given, "z", size).toPandas()
    assert got["batch"].nunique() == batches == points.batch_count(12, size) and sorted(got[got["batch"] == batches - 1]["idx"]) == last
    assert points.batches(given, "y", size).toPandas().sort_values("position")["y"].is_monotonic_increasing


@pytest.mark.parametrize("to", [(8, 8, 8), (30, 15, 15), (17, 30, 8)])
def test_blocks_stay_where_they_are(spark, to):
    """A bright block of a cube of 15 x 15 x 17, resampled along each axis."""
    cube = np.zeros((17, 15, 15))
    cube[6:11, 5:10, 5:10] = 100
    at = np.argwhere(cube >= 0)
    table = spark.createDataFrame(pd.DataFrame(at, columns=["dz", "dy", "dx"]).assign(idx=0, v=cube.ravel()))
    got = np.zeros(to)
    for r in cubes.resample(table, cube.shape, to).collect():
        got[r.tz, r.ty, r.tx] = r.v
    assert np.allclose(got, cubes.resample_array(cube, to))
    centre = tuple(int((c + 0.5) * m / n) for c, m, n in zip((8, 7, 7), to, cube.shape))
    assert got[centre] > 25 and got[0, 0, 0] < 25 and got[-1, -1, -1] < 25


def test_normalised_channels(spark):
    volumes = [np.where(np.indices((6, 8, 10)).sum(0) % 2, mean + std, mean - std).astype(float) for mean, std in ((222, 20), (555, 5))]
    given = spark.createDataFrame([(0, 5.0, 4.0, 3.0)], "idx long, x double, y double, z double")
    got = channel_cubes(given, [rows(spark, v) for v in volumes], (6, 8, 10), (4, 4, 4), [(222.0, 20.0), (555.0, 5.0)])
    for r in got.groupBy("channel").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect():
        assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_sampled_mean_and_deviation(spark):
    got = planes.sampled_stats(rows(spark, np.random.default_rng(1).normal(100, 10, (10, 10, 10))), 10, 5).first()
    assert 90 < got.v_mean < 110 and 8 < got.v_std < 12


def test_tiles_of_small_planes(spark):
    for shape, want in {(1, 1): 0, (2, 1): 0, (22, 33): 6}.items():  # whole tiles of 10 pixels; smaller planes have none
        assert planes.bright_tiles(rows(spark, np.ones((1, *shape))), shape, 10).count() == want
