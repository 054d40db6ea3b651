"""Synthetic volumes with known cells, through whole plans."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from volumetra.operators import planes, structures
from volumetra.plans.detection import detect, detect_with_errors
from volumetra.settings import DetectionSettings
from volumetra.sources.volumes import spheres


def sphere(shape, centre, radius):
    z, y, x = np.indices(shape)
    return (x - centre[0]) ** 2 + (y - centre[1]) ** 2 + (z - centre[2]) ** 2 <= radius**2


def rows(spark, volume):
    z, y, x = (i.ravel() for i in np.indices(volume.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "v": volume.ravel().astype(float)}))


def found(spark, volume, **settings):
    s = DetectionSettings(n_sds_above_mean_thresh=1.0, **settings)
    return sorted(tuple(r) for r in detect(rows(spark, volume), volume.shape, s).select("x", "y", "z", "type").collect())


@pytest.mark.parametrize("dtype", ["uint16", "int16", "float32"])
def test_single_spot(spark, dtype):
    volume = np.where(sphere((20, 50, 50), (25, 25, 10), 2), 100.0, 0.0)
    if dtype == "int16":
        volume -= 50
    assert found(spark, volume, dtype=dtype) == [(25, 25, 10, structures.UNKNOWN)]


def test_overlapping_spheres_are_split(spark):
    centres = [(30, 50, 10), (39, 50, 10), (48, 50, 10), (57, 50, 10)]
    volume = np.zeros((20, 100, 100))
    for c in centres:
        volume[sphere(volume.shape, c, 5)] = 100
    got = found(spark, volume, dtype="float32")
    assert len(got) == 4 and {g[3] for g in got} == {structures.UNKNOWN}
    assert all(np.linalg.norm(np.subtract(g[:3], c)) <= 3 for g, c in zip(got, centres))


def test_oversized_block_is_one_artifact(spark):
    volume = np.zeros((15, 100, 100))
    volume[6:12, 40:66, 40:66] = 1000
    assert found(spark, volume, dtype="float32", soma_diameter_um=20, max_cluster_size_um3=2000 * 5 * 2 * 2) == [(52, 52, 8, structures.ARTIFACT)]


@pytest.mark.parametrize("shape", [(5, 100, 30), (5, 30, 100)])
def test_planes_smaller_than_the_ball(spark, shape):
    with pytest.raises(ValueError):
        found(spark, np.zeros(shape), voxel_sizes=(1.0, 1.0, 1.0), ball_xy_size_um=50)


def test_two_balls_are_split_with_the_known_shift():
    inside = np.zeros((30, 20, 20), bool)
    for c in ((9, 10, 10), (19, 10, 10)):
        x, y, z = np.indices(inside.shape)
        inside |= (x - c[0]) ** 2 + (y - c[1]) ** 2 + (z - c[2]) ** 2 <= 25
    got = structures.split_points(np.argwhere(inside), (3, 3), Fraction(4, 5), 10)
    assert sorted(map(tuple, got.tolist())) == [(10, 11, 11), (20, 11, 11)]


@pytest.mark.parametrize("size", [512, 9, 5])
def test_enhancement_does_not_hang_on_tiles(spark, size):
    """Tiles smaller than the stencils' reach, and planes narrower than it, against whole planes."""
    r = np.random.default_rng(6)
    for shape, sigma in (((2, 31, 22), 0.9), ((2, 3, 40), 1.6)):
        volume = r.integers(0, 500, shape).astype(float)
        got = np.zeros(shape)
        for row in planes.enhance(rows(spark, volume), shape[1:], sigma, 1000.0, size).collect():
            got[row.z, row.y, row.x] = row.v
        assert np.allclose(got, [planes.enhance_plane(p, sigma, 1000.0) for p in volume], atol=1e-9)


def test_marks_that_feed_back(spark):
    """Through the whole plan: a batch of all planes gives what no feedback gives."""
    volume = np.where(sphere((20, 50, 50), (25, 25, 10), 2), 100.0, 0.0)
    volume += np.random.default_rng(1).integers(0, 3, volume.shape)
    plain = found(spark, volume)
    assert plain and found(spark, volume, z_feedback=True, batch_size=20) == plain
    assert found(spark, volume, z_feedback=True)


def test_enhanced_planes_are_composed_of_the_checked_stencils(spark):
    """The pandas path against median, Gaussian, Laplacian and normalisation, each of which SQL checks."""
    volume = np.random.default_rng(4).integers(0, 500, (2, 12, 15)).astype(float)
    table, shape = rows(spark, volume), volume.shape[1:]
    want = planes.normalise(planes.laplacian(planes.gaussian(planes.median3(table, shape), shape, 0.9)), 1000.0)
    got = {(r.z, r.y, r.x): r.v for r in planes.enhance(table, shape, 0.9, 1000.0).collect()}
    assert all(abs(got[r.z, r.y, r.x] - r.v) < 1e-6 for r in want.collect()) and len(got) == volume.size


def test_eight_spots_with_defaults(spark):
    """One voxel of the largest value, blurred, at each of eight places of a true cube."""
    volume = np.zeros((100, 100, 100))
    volume[np.ix_((25, 75), (25, 75), (25, 75))] = 65535
    weights = np.array(planes.gaussian_weights(2.0))
    for axis in range(3):
        volume = sum(w * np.roll(volume, k - 8, axis) for k, w in enumerate(weights))
    got = [tuple(r) for r in detect(rows(spark, volume.astype(np.uint16)), volume.shape, DetectionSettings()).select("x", "y", "z").collect()]
    assert len(got) == 8 and all(min(abs(v - c) for c in (25, 75)) <= 1 for g in got for v in g)


def test_spheres_of_the_source(spark):
    table = spheres(spark, (9, 12, 12), 2, [(4, 5, 4), (8, 6, 4)], 7.0)
    got = np.zeros((9, 12, 12))
    for r in table.collect():
        got[r.z, r.y, r.x] = r.v
    assert (got == 7.0 * (sphere(got.shape, (4, 5, 4), 2) | sphere(got.shape, (8, 6, 4), 2))).all()


def broken_for_some(points, ball, fraction, n, correct=False):
    if points[:, 0].min() < 40:
        raise ValueError("no kernel fits")
    return structures.split_points(points, ball, fraction, n, correct=correct)


def test_errors_cost_their_structure_only(spark):
    volume = np.zeros((20, 100, 100))
    for c in ((30, 20, 10), (39, 20, 10), (60, 70, 10), (69, 70, 10)):
        volume[sphere(volume.shape, c, 5)] = 100
    s = DetectionSettings(dtype="float32", n_sds_above_mean_thresh=1.0)
    want = found(spark, volume, dtype="float32")
    points, errors = detect_with_errors(rows(spark, volume), volume.shape, s, broken_for_some)
    assert sorted(tuple(r) for r in points.select("x", "y", "z", "type").collect()) == [w for w in want if w[0] > 50]
    assert [r.error for r in errors.collect()] == ["ValueError: no kernel fits"]
    points, errors = detect_with_errors(rows(spark, volume), volume.shape, s)
    assert points.count() == len(want) == 4 and errors.count() == 0


def test_a_structure_that_fails_names_itself(spark):
    table = spark.createDataFrame([(17, 3, 4, 5)], "sid long, x long, y long, z long")
    with pytest.raises(Exception, match="structure 17: TypeError"):
        structures.split_structures(table, (3, 3), None, 3).collect()


def test_plane_shapes(spark):
    volume = np.ones((4, 3, 5))
    table = rows(spark, volume).where("NOT (z = 1 AND x = 2 AND y = 1) AND NOT (z = 3 AND x = 4)")
    bad = {r.z: r.message for r in planes.misshapen(table, (3, 5)).collect()}
    assert set(bad) == {1, 3} and bad[1] == "rows 0 to 2, columns 0 to 4, 14 pixels, 14 of them known; expected 3 x 5"
    assert planes.misshapen(rows(spark, volume), (3, 5)).count() == 0
