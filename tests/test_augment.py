"""Augmentation of cubes: exact transforms, draws, and the Spark form against one array at a time."""

import numpy as np
import pandas as pd
import pytest

from volumetra.operators.augment import Augmentation, affine, augment_array, augmented, gathered, packed_block

CUBE = np.random.default_rng(1).integers(0, 100, (7, 7, 7)).astype(float)


def matrix(**how):
    return Augmentation(likelihood=1.1, **how).chosen(0, 1)[1]


def test_identity_and_turns():
    assert np.allclose(affine(CUBE, matrix(scale={"z": 1.0})), CUBE)
    for axis, plane in (("z", (2, 1)), ("y", (0, 2)), ("x", (1, 0))):
        once = affine(CUBE, matrix(rotate={axis: np.pi / 2}))
        assert np.allclose(once, np.rot90(CUBE, 1, plane)), axis
        assert np.allclose(affine(CUBE, matrix(rotate={axis: np.pi})), np.rot90(CUBE, 2, plane))
        assert np.allclose(affine(once, matrix(rotate={axis: -np.pi / 2})), CUBE)


def test_translation_and_scale():
    got = affine(CUBE, matrix(translate={"z": 2 / 7, "x": -1 / 7}))
    assert np.allclose(got[2:, :, :-1], CUBE[:-2, :, 1:]) and np.allclose(got[0], got[2]) and np.allclose(got[:, :, -1], got[:, :, -2])
    ramp = np.broadcast_to(np.arange(7.0), (7, 7, 7))
    assert np.allclose(affine(ramp, matrix(scale={"x": 2.0}))[3, 3], 3 + (np.arange(7) - 3) / 2)
    assert np.allclose(affine(ramp, matrix(scale={"x": 0.5}))[3, 3], np.clip(3 + (np.arange(7) - 3) * 2, 0, 6))
    # contents turn first and move afterwards
    both = affine(CUBE, matrix(translate={"y": 1 / 7}, rotate={"z": np.pi / 2}))
    assert np.allclose(both, affine(np.rot90(CUBE, 1, (2, 1)), matrix(translate={"y": 1 / 7})))


def test_unequal_sizes_come_back():
    cube = np.random.default_rng(2).normal(size=(3, 8, 5))
    assert affine(cube, matrix(rotate={"z": 0.3})).shape == cube.shape
    smooth = np.add.outer(np.add.outer(np.arange(4.0), np.arange(8.0)), np.arange(4.0))
    assert np.abs(affine(smooth, matrix(scale={"z": 1.0})) - smooth)[1:-1, 1:-1, 1:-1].max() < 1e-9


def test_gather_between_voxels():
    at = np.random.default_rng(3).uniform(-1, 7, (3, 50))
    for k in range(50):
        z, y, x = np.clip(at[:, k], 0, 6)
        want = sum(w * CUBE[min(i, 6), min(j, 6), min(m, 6)] for i, a in ((int(z), 1 - z % 1), (int(z) + 1, z % 1)) for j, b in ((int(y), 1 - y % 1), (int(y) + 1, y % 1)) for m, c in ((int(x), 1 - x % 1), (int(x) + 1, x % 1)) for w in [a * b * c])
        assert np.isclose(gathered(CUBE, at)[k], want)


def test_draws():
    how = Augmentation(likelihood=0.3, flip=("z", "x"), rotate={"y": (0.1, 0.5)}, translate={"x": (-0.2, 0.2)}, seed=9)
    drawn = [how.chosen(1, k) for k in range(3000)]
    assert all(abs(np.mean([a in f for f, _ in drawn]) - 0.3) < 0.03 for a in "zx") and abs(np.mean([m is not None for _, m in drawn]) - 0.3) < 0.03
    again = [how.chosen(1, k) for k in range(3000)]
    assert all(f == g and (m is n is None or (m == n).all()) for (f, m), (g, n) in zip(drawn, again))
    assert [f for f, _ in drawn] != [how.chosen(2, k)[0] for k in range(3000)]
    angles = [np.arccos(m[0, 0]) for _, m in drawn if m is not None]
    assert min(angles) >= 0.1 and max(angles) <= 0.5 and np.ptp(angles) > 0.3
    with pytest.raises(ValueError):
        Augmentation(flip=("c",))


@pytest.mark.parametrize("channels", [1, 2])
def test_through_spark(spark, channels):
    r = np.random.default_rng(5)
    cubes = r.integers(0, 50, (40, channels, 3, 5, 4)).astype(float)
    at = np.argwhere(cubes > 4)  # some voxels have no row
    cubes[cubes <= 4] = 0
    table = pd.DataFrame(at, columns=["idx", "channel", "dz", "dy", "dx"]).assign(v=cubes[tuple(at.T)])
    how = Augmentation(likelihood=0.6, flip=("y",), rotate={"z": (-1.0, 1.0)}, scale={"x": (0.8, 1.2)}, seed=3)
    frame = spark.createDataFrame(table if channels > 1 else table.drop(columns="channel")).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    got = np.zeros(cubes.shape)
    rows = augmented(frame, (3, 5, 4), how, 7, channels).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for x in rows:
        got[x.idx, x.channel if channels > 1 else 0, x.dz, x.dy, x.dx] = x.v
    want = [[augment_array(c, how, 7, k) for c in cube] for k, cube in enumerate(cubes)]
    assert len(rows) == cubes.size and np.allclose(got, want) and not np.allclose(got, cubes)


def test_small_cubes_are_changed_many_at_once():
    assert packed_block((5, 5, 5), 1, 32) == 1048
    assert packed_block((50, 50, 20), 2, 32) == 32
