"""Operators that go from plane to plane: marks that feed back, and structures labelled as planes arrive."""

import os
from fractions import Fraction

import numpy as np
import pytest

from volumetra.operators import ball, components, feedback, structures
from volumetra.streaming import ordered

SHAPE, XY, Z, RATIO = (11, 22, 19), 3, 3, Fraction(3, 5)


def sequential(bright, kernel, limit, batch, inside=None):
    """Plane after plane, one place at a time, as a buffer of planes would be walked."""
    (n, h, w), (kz, ky, kx) = bright.shape, kernel.shape
    seen, marks = bright.copy(), np.zeros_like(bright)
    for begin in range(0, n, batch):
        end, low = min(n, begin + batch), max(0, begin - kz + 1)
        before = seen.copy()
        for z in range(low, end - kz + 1):
            for y in range(h - ky + 1):
                for x in range(w - kx + 1):
                    at = (z + kz // 2, y + (ky - 1) // 2, x + (kx - 1) // 2)
                    if (kernel * before[z : z + kz, y : y + ky, x : x + kx]).sum() > limit and (inside is None or inside[at]):
                        marks[at] = seen[at] = True
    return marks


@pytest.fixture(scope="module")
def bright():
    return np.random.default_rng(7).random(SHAPE) < 0.55


def voxels(spark, mask):
    return spark.createDataFrame([tuple(map(int, r)) for r in np.argwhere(mask)], ordered.ARRIVED)


def places(df):
    return sorted(tuple(r) for r in df.select("z", "y", "x").collect())


def where(mask):
    return sorted(map(tuple, np.argwhere(mask).tolist()))


@pytest.mark.parametrize("xy,z", [(3, 3), (4, 2), (5, 4)])
@pytest.mark.parametrize("batch", [1, 2, 4, 11])
def test_fold_is_the_sequential_model(bright, xy, z, batch):
    kernel = ball.ball_kernel(xy, z)
    limit = RATIO * int(kernel.sum())
    ends = [min(k + batch, SHAPE[0]) for k in range(0, SHAPE[0], batch)]
    want = sequential(bright, kernel, limit, batch)
    assert want.any() and (feedback.fold(bright.copy(), kernel, limit, ends) == want).all()


def test_more_feedback_marks_more(bright):
    kernel = ball.ball_kernel(XY, Z)
    counts = [sequential(bright, kernel, RATIO * int(kernel.sum()), b).sum() for b in (1, 2, 4, 11)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


@pytest.mark.parametrize("batch,slab,size", [(1, 3, 5), (1, 16, 256), (2, 4, 8), (4, 4, 7), (11, 16, 6)])
def test_tiles_and_slabs_do_not_matter(spark, bright, batch, slab, size):
    mask = np.random.default_rng(2).random((SHAPE[0], 3, 3)) < 0.7
    inside = np.repeat(np.repeat(mask, 8, 1), 8, 2)[:, : SHAPE[1], : SHAPE[2]]
    tiles = spark.createDataFrame([(z, y, x, bool(v)) for (z, y, x), v in np.ndenumerate(mask)], "z long, ty long, tx long, inside boolean")
    kernel = ball.ball_kernel(XY, Z)
    limit = RATIO * int(kernel.sum())
    got = feedback.marks(voxels(spark, bright), SHAPE, XY, Z, RATIO, tiles, 8, batch, slab, size)
    assert places(got) == where(sequential(bright, kernel, limit, batch, inside))
    if batch == 11:
        assert places(got) == places(ball.marks(voxels(spark, bright), SHAPE, XY, Z, RATIO, tiles, 8))
    if slab == 3:
        assert places(feedback.marks(voxels(spark, bright), SHAPE, XY, Z, RATIO, None, 0, batch, slab, size)) == where(sequential(bright, kernel, limit, batch))


def stream(spark, folder, mask, order, many=1):
    """Files that each hold one plane and its closing row, in the order given."""
    for k, z in enumerate(order):
        rows = [(z, int(y), int(x)) for y, x in np.argwhere(mask[z])] + [(z, None, None)]
        spark.createDataFrame(rows, ordered.ARRIVED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(ordered.ARRIVED).option("maxFilesPerTrigger", many).parquet(f"{folder}/in")


@pytest.mark.parametrize("batch,order,many", [(1, range(11), 4), (2, [1, 0, 3, 2, 5, 4, 9, 8, 7, 6, 10], 3), (4, [10, *range(10), 3], 5)])
def test_feedback_of_a_stream(spark, tmp_path, bright, batch, order, many):
    kernel = ball.ball_kernel(XY, Z)
    fed = ordered.feedback_marks(str(tmp_path), SHAPE, XY, Z, RATIO, batch=batch, size=9)
    seen = []
    fed.on_plane = seen.append
    fed.run(stream(spark, tmp_path, bright, order, many))
    assert seen == list(range(SHAPE[0]))  # each plane once, in order
    assert places(fed.result(spark, "marks")) == where(sequential(bright, kernel, RATIO * int(kernel.sum()), batch))


def forks(shape):
    """Noise, and branches that meet only in late planes, or in the last."""
    mask = np.random.default_rng(5).random(shape) < 0.22
    mask[:, 2:9:2, 2] = True
    mask[shape[0] // 2, 2:5, 2] = mask[-2, 4:9, 2] = True
    mask[:, 12, 3] = mask[:, 12, 9] = mask[-1, 12, 3:10] = True
    return mask


def test_structures_of_a_stream(spark, tmp_path):
    mask = forks(SHAPE)
    found = ordered.labelled_structures(str(tmp_path), SHAPE, slab=2, tile=8)
    order = [1, 0, 2, 4, 3, 5, 6, 7, 10, 8, 9]
    steps = lambda: {n for n in os.listdir("/tmp/checkpoints") if n.startswith("step-")} if os.path.isdir("/tmp/checkpoints") else set()
    before = steps()
    found.run(stream(spark, tmp_path, mask, order, 3))
    assert steps() == before and len(os.listdir(tmp_path / "state")) == 2  # no table of a micro-batch stays but the last states
    want = components.connected_components(voxels(spark, mask), SHAPE)
    labels = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, ordered.whole(found, spark).collect())) == labels
    centres = structures.centres(want).select("sid", "x", "y", "z", "volume")
    assert sorted(map(tuple, found.result(spark, "structures").collect())) == sorted(map(tuple, centres.collect()))
    assert found.result(spark, "aliases").count() >= 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """State is read from the batch before and written under the batch's number."""
    mask, seen = forks((4, 14, 12)), []
    found = ordered.labelled_structures(str(tmp_path), (4, 14, 12), slab=2, tile=8)
    for batch, planes in enumerate(([0], [2], [1, 3])):
        rows = spark.createDataFrame([(z, int(y), int(x)) for z in planes for y, x in np.argwhere(mask[z])] + [(z, None, None) for z in planes], ordered.ARRIVED)
        for _ in range(2):
            found(rows, batch)
            seen.append(sorted(map(tuple, found.result(spark, "voxels").collect())))
        assert seen[-1] == seen[-2]
    assert len(seen[-1]) == mask.sum()
    assert found.result(spark, "structures").count() == components.connected_components(voxels(spark, mask), (4, 14, 12)).select("sid").distinct().count()
