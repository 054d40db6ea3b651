"""Residual networks against plain loops, and classification through Spark against the same arrays in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volumetra.operators import augment, cubes, scoring
from volumetra.operators import points as points_of
from volumetra.operators.cubes import resample_array
from volumetra.operators.resnet import Arrays, ResidualNetwork, chosen_model, model_files
from volumetra.plans import detection
from volumetra.plans.detection import classify

SMALL = dict(depth="18-layer", shape=(16, 16, 9, 2), features=4)


def network(seed=3, **described):
    described = SMALL | described
    weights = ResidualNetwork("", **described).initial(seed)
    draw = np.random.default_rng(seed)
    for k, w in weights.items():  # a normalisation that does something
        if not k.endswith("kernel"):
            weights[k] = draw.uniform(0.5, 1.5, w.shape).astype(np.float32)
    return ResidualNetwork(weights, **described)


def test_convolution_and_pooling_by_loops():
    draw = np.random.default_rng(0)
    x, kernel = draw.normal(size=(2, 7, 6, 5, 3)), draw.normal(size=(3, 3, 1, 3, 4))
    got = Arrays(3, {"c/kernel": kernel}).conv(x, "c", 4, (3, 3, 1), 2, 1)
    padded = np.pad(x, [(0, 0), (1, 1), (1, 1), (1, 1), (0, 0)])
    assert got.shape == (2, 4, 3, 4, 4)
    for at in np.ndindex(*got.shape[:4]):
        n, i, j, k = at
        assert np.allclose(got[at], np.einsum("abcd,abcde->e", padded[n, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3, 2 * k : 2 * k + 1], kernel))
    pooled = Arrays(3, {}).pool(x, (3, 3, 2), 2)
    assert pooled.shape == (2, 3, 2, 2, 3) and pooled[1, 2, 1, 1, 0] == x[1, 4:7, 2:5, 2:4, 0].max()


@pytest.mark.parametrize("depth, last", [("18-layer", 512), ("34-layer", 512), ("50-layer", 2048), ("101-layer", 2048), ("152-layer", 2048)])
@pytest.mark.parametrize("channels", [1, 2])
def test_shapes_of_the_default_network(depth, last, channels):
    needed = ResidualNetwork("", depth=depth, shape=(50, 50, 20, channels)).needed()
    assert needed["conv1/kernel"] == (7, 7, 3, channels, 64)
    assert needed["conv1_bn/gamma"] == (12,) and needed["resunit2_block0_bn_a/gamma"] == (6,)  # along z, not by feature
    assert needed["fully_connected/kernel"] == (last, 2)
    assert "resunit3_block0_shortcut_conv/kernel" in needed and "resunit3_block1_shortcut_conv/kernel" not in needed


def test_networks_for_planes():
    model = network(shape=(32, 32, 1))
    p = model.score(np.random.default_rng(2).normal(size=(3, 1, 32, 32, 1)))
    assert p.shape == (3, 2) and np.allclose(p.sum(1), 1)
    assert model.needed()["conv1_bn/gamma"] == (16,)
    with pytest.raises(ValueError):
        model.score(np.zeros((1, 2, 32, 32, 1)))


def test_scores_do_not_hang_on_the_block():
    x = np.random.default_rng(3).normal(size=(5, 9, 16, 16, 2))
    whole, parts = network(block=32).score(x), network(block=2).score(x)
    assert np.allclose(whole, parts, atol=1e-5) and np.ptp(whole[:, 0]) > 0


def test_weights_must_be_there_and_fit(spark, tmp_path):
    with pytest.raises(OSError):
        ResidualNetwork.from_file(spark, None, **SMALL)
    path = str(tmp_path / "small_net.npz")
    np.savez(path, **network().weights)
    with pytest.raises(ValueError):
        ResidualNetwork.from_file(spark, path, **SMALL | {"depth": "34-layer"})
    with pytest.raises(ValueError):
        ResidualNetwork({}, **SMALL)
    with pytest.raises(ValueError):
        ResidualNetwork("", shape=(50, 2))
    x = np.random.default_rng(4).normal(size=(2, 9, 16, 16, 2))
    assert np.allclose(ResidualNetwork.from_file(spark, path, **SMALL).load().score(x), network().score(x))


def test_choice_of_models():
    assert chosen_model("resnet50_tv", False) == "resnet50_1ch"
    assert chosen_model("resnet50_tv", True) == "resnet50_tv" and chosen_model("resnet50_all", False) == "resnet50_all"
    assert model_files("m.h5", None) == (None, "m.h5") and model_files("m.keras", "w.h5") == ("m.keras", "w.h5")


def rows(spark, volume):
    z, y, x = (i.ravel() for i in np.indices(volume.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "v": volume.ravel().astype(float)}))


def test_two_channels_through_a_network_from_a_file(spark, tmp_path):
    """Batches smaller and larger than a cube, against the same cubes cut in numpy; a cube over the edge is left out."""
    draw = np.random.default_rng(5)
    volumes = [draw.integers(0, 200, (8, 20, 20)).astype(float) for _ in range(2)]
    path = str(tmp_path / "two_channels.npz")
    np.savez(path, **network().weights)
    model = ResidualNetwork.from_file(spark, path, **SMALL)
    places = [(k, float(draw.integers(4, 16)), float(draw.integers(4, 16)), float(draw.integers(2, 6))) for k in range(12)] + [(12, 1.0, 10.0, 4.0)]
    points = spark.createDataFrame(places, "idx long, x double, y double, z double").withColumn("type", F.lit(1))
    norms = [(v[[0, 4]].mean(), v[[0, 4]].std(ddof=1)) for v in volumes]
    want = {}
    for k, x, y, z in places[:-1]:
        at = tuple(slice(int(s), int(s) + n) for s, n in ((z - 2, 4), (y - 3, 6), (x - 3, 6)))
        cube = np.stack([resample_array(((v[at] - m) / s).astype(np.float32), (9, 16, 16)) for v, (m, s) in zip(volumes, norms)], -1)
        want[k] = int(network().score(cube[None]).argmax()) + 1
    assert set(want.values()) == {1, 2}
    for size in ("50", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = classify(points, [rows(spark, v) for v in volumes], (8, 20, 20), (4, 6, 6), (9, 16, 16), model, norm_planes=2)
        assert {r.idx: r.type for r in got.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        classify(points, [rows(spark, volumes[0])], (8, 20, 20), (4, 6, 6), (9, 16, 16), model)


def test_sparse_cubes_and_none(spark):
    """Voxels that have no row are 0; an empty table gives no scores."""
    w = np.arange(8.0)
    scorer = scoring.LinearSoftmax(np.stack([w, -w], 1), np.array([-2.5, 2.5]))
    cubes = spark.createDataFrame([(1, 0, 0, 1, 1.0), (1, 0, 1, 0, 1.0), (2, 0, 0, 1, 1.0), (None, 0, 0, 0, 1.0)], "idx long, dz long, dy long, dx long, v double")
    kind = scoring.predicted_type(F.col("p")).alias("type")
    got = scoring.predictions(cubes, (2, 2, 2), scorer, block=1).select("idx", kind)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2)]
    assert scoring.predictions(cubes.where("false"), (2, 2, 2), scorer).count() == 0


def _many_points(spark):
    """Forty points at three places, one without an idx, and a volume to cut their cubes from."""
    rows = [(None if k == 39 else k, *[(5.0, 5.0, 3.0), (6.0, 5.0, 3.0), (9.0, 8.0, 2.0)][k % 3]) for k in range(40)]
    voxels = spark.range(7 * 16 * 16).selectExpr("id div 256 AS z", "id div 16 % 16 AS y", "id % 16 AS x", "id * 37 % 101 AS v")
    return spark.createDataFrame(rows, "idx long, x double, y double, z double"), voxels


def test_cubes_of_a_place_are_cut_and_scored_once(spark, monkeypatch):
    points, voxels = _many_points(spark)
    seen, real = [], scoring.predictions
    monkeypatch.setattr(scoring, "predictions", lambda each, *how: seen.append(each.count()) or real(each, *how))
    w = np.linspace(-1, 1, 75) ** 3
    got = detection.classify(points, [voxels], (7, 16, 16), (3, 5, 5), (3, 5, 5), scoring.LinearSoftmax(np.stack([w, -w], 1), np.zeros(2)), [(50, 10)])
    bounded = cubes.full_only(cubes.bounds(points, dict(z=3, y=5, x=5)), dict(z=7, y=16, x=16))
    each = cubes.extract(bounded, voxels.withColumn("v", (F.col("v") - 50) / 10.0))
    want = scoring.join_back(points, real(each, (3, 5, 5), scoring.LinearSoftmax(np.stack([w, -w], 1), np.zeros(2))))
    assert seen == [3 * 75] and got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 39


def test_rows_of_places_reach_every_point(spark):
    points, voxels = _many_points(spark)
    bounded = cubes.full_only(cubes.bounds(points, dict(z=3, y=5, x=5)), dict(z=7, y=16, x=16))
    placed, places = cubes.shared(bounded, (7, 16, 16))
    assert places.count() == 3
    got, want = cubes.spread(cubes.extract(places, voxels), placed), cubes.extract(bounded, voxels)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_points_of_a_crowded_place_go_to_several_tasks(spark, monkeypatch):
    points, voxels = _many_points(spark)
    points = points.unionByName(points.where("x = 5").withColumn("idx", F.col("idx") + 100))
    bounded = cubes.full_only(cubes.bounds(points, dict(z=3, y=5, x=5)), dict(z=7, y=16, x=16))
    monkeypatch.setattr(cubes, "CROWD", 10, raising=False)
    placed, places = cubes.shared(bounded, (7, 16, 16))
    keys = placed.groupBy("place").count().collect()
    assert sorted(r.idx for r in places.collect()) == sorted(r.place for r in keys) and places.count() == 3 + 2 + 2
    assert max(r["count"] for r in keys) < 20 and sum(r["count"] for r in keys) == bounded.count()
    got, want = cubes.spread(cubes.extract(places, voxels), placed), cubes.extract(bounded, voxels)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.rdd.getNumPartitions() == 4  # a task for each partition, though all points are a few bytes


def test_points_of_one_place_are_augmented_each_in_its_way(spark):
    points, voxels = _many_points(spark)
    bounded = cubes.full_only(cubes.bounds(points, dict(z=3, y=5, x=5)), dict(z=7, y=16, x=16))
    placed, places = cubes.shared(bounded, (7, 16, 16))
    how = augment.Augmentation(likelihood=0.6, flip=("x", "z"), rotate={"z": (0.1, 2.0)}, scale={"y": 0.8}, seed=3)
    got = augment.augmented(cubes.extract(places, voxels), (3, 5, 5), how, placed=placed)
    want = augment.augmented(cubes.extract(bounded, voxels), (3, 5, 5), how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 39 * 75
    block = np.random.default_rng(0).random((9, 2, 5, 5, 5)).astype(np.float32)
    each = [[augment.augment_array(c.astype(np.float64), how, 1, k) for c in one] for k, one in enumerate(block)]
    assert np.array_equal(augment.augment_block(np.arange(9), block, how, 1), np.array(each))


def test_equal_points_and_truths_are_matched_once(spark):
    rows = spark.range(300).selectExpr("id % 2 AS x", "0L AS y", "0L AS z")
    found = points_of.matched(rows, rows.where("x = 0"), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 0, 0), (1, 0, 0)]
    assert plan[plan.index("Join") :].count("Aggregate") == 2  # both sides lose their copies before they meet
