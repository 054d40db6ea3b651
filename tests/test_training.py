"""Training sets out of folders, fitted scorers, and helpers on points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volumetra.operators import points, scoring, structures, training
from volumetra.plans.detection import channel_cubes, classify, classify_plane
from volumetra.sources import files
from volumetra.sources.training import definitions, training_set, wanted_positions


@pytest.fixture()
def folders(tmp_path):
    """Three folders of cubes, two files of cells, and two definition files."""
    def touch(folder, *names):
        (tmp_path / folder).mkdir(exist_ok=True)
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")

    cube = lambda k, c: files.cube_name(k, 2 * k, 3 * k, c)
    touch("cells", *(cube(k, c) for k in (2, 10, 1) for c in (0, 1)), "notes.txt", "pCellz9y9x9Ch2.tif")
    touch("junk", *(cube(k, 0) for k in (4, 5, 6, 7)), cube(5, 1))
    touch("more", "PCELLZ3Y2X1CH1.TIF", "other_ch1.tif", "other_Ch0.tif")
    markers = "".join(f"<Marker><MarkerX>{k}</MarkerX><MarkerY>{2 * k}</MarkerY><MarkerZ>{3 * k}</MarkerZ></Marker>" for k in (5, 7, 70))
    (tmp_path / "junk.xml").write_text(f"<CellCounter_Marker_File><Marker_Data><Marker_Type><Type>1</Type>{markers}</Marker_Type></Marker_Data></CellCounter_Marker_File>")
    one = [{"cube_dir": f"{tmp_path}/cells", "cell_def": "''", "type": "cell", "signal_channel": 0, "bg_channel": 1, "signal_mean": 10.5, "signal_std": 2, "bg_mean": 3, "bg_std": 4}]
    two = [{"cube_dir": f"{tmp_path}/junk/", "cell_def": f"{tmp_path}/junk.xml", "type": "no_cell", "signal_channel": 0, "bg_channel": 1}, {"cube_dir": f"{tmp_path}/more", "cell_def": "", "type": "cell", "signal_channel": 1, "bg_channel": -1}, {"cube_dir": f"{tmp_path}/junk", "cell_def": f"{tmp_path}/picked", "type": "cell", "signal_channel": 0, "bg_channel": -1}]
    touch("picked", cube(4, 0), cube(6, 0), cube(60, 0))
    (tmp_path / "a.yml").write_text("# first\n" + files.training_text(one))
    (tmp_path / "b.yml").write_text("other:\n- x: 1\n" + files.training_text(two))
    return tmp_path, cube


def test_training_set(spark, folders):
    root, cube = folders
    defined = definitions(spark, [str(root / "a.yml"), f"file://{root}/b.yml"])
    assert [(r.definition, r.type, r.signal_mean) for r in defined.orderBy("definition").collect()] == [(0, "cell", 10.5), (1, "no_cell", None), (2, "cell", None), (3, "cell", None)]
    rows = training_set(spark, defined).orderBy("definition", "place").collect()
    name = lambda p: p.rsplit("/", 1)[1]
    assert [(r.definition, name(r.file), r.label, r.type, r.complete) for r in rows] == [
        *((0, cube(k, 0), "cell", 2, True) for k in (1, 2, 10)),
        (1, cube(5, 0), "no_cell", 1, True), (1, cube(7, 0), "no_cell", 1, False),
        (2, "PCELLZ3Y2X1CH1.TIF", "cell", 2, True), (2, "other_ch1.tif", "cell", 2, True),
        (3, cube(4, 0), "cell", 2, True), (3, cube(6, 0), "cell", 2, True),
    ]
    assert [(c.channel, name(c.path), c["mean"], c["std"]) for c in rows[0].channels] == [(0, cube(1, 0), 10.5, 2.0), (1, cube(1, 1), 3.0, 4.0)]
    assert [c.channel for c in rows[4].channels] == [0] and [c["mean"] for c in rows[3].channels] == [None, None]
    where = {tuple(r) for r in wanted_positions(spark, defined.collect()).collect()}
    assert where == {(1, 3 * k, 2 * k, k) for k in (5, 7, 70)} | {(3, 3 * k, 2 * k, k) for k in (4, 6, 60)}
    with pytest.raises(ValueError):
        training_set(spark, defined.withColumn("type", F.lit("other")))
    assert training_set(spark, defined.limit(0)).columns == training_set(spark, defined).columns


def test_listings(spark, folders):
    root, _ = folders
    found = {r["name"]: r["files"] for r in files.subfolders(spark, str(root)).collect()}
    assert found == {"cells": 8, "junk": 5, "more": 3, "picked": 3}
    assert files.list_files(spark, str(root), "*.xml").count() == 1
    assert all(r.length == 1 for r in files.list_files(spark, f"file://{root}/cells").collect())


def rows(spark, volume):
    z, y, x = (i.ravel() for i in np.indices(volume.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "v": volume.ravel().astype(float)}))


def test_a_fitted_scorer(spark):
    """Blobs against noise: weights learnt on one side of a split tell the other side's cubes apart, through the whole plan."""
    r = np.random.default_rng(4)
    volume = r.normal(100, 10, (12, 120, 120))
    places = [(k, int(x), int(y), int(z)) for k, (x, y, z) in enumerate(zip(r.integers(4, 116, 500), r.integers(4, 116, 500), r.integers(2, 10, 500)))]
    blobs = set()
    for k, x, y, z in places:
        if k % 3 == 0:
            volume[z, y, x] += 120
            blobs.add((x, y, z))
    given = spark.createDataFrame([(k, float(x), float(y), float(z), 2 if (x, y, z) in blobs else 1) for k, x, y, z in places], "idx long, x double, y double, z double, type int")
    near = dict(shape=volume.shape, cube=(3, 5, 5), norms=[(100.0, 10.0)])
    fitted = training.fit(channel_cubes(given, [rows(spark, volume)], **near), given, (3, 5, 5), test_share=0.4, seed=2)
    assert fitted.weights.shape == (75, 2)
    typed = {r.idx: r.type for r in classify(given.drop("type").withColumn("type", F.lit(0)), [rows(spark, volume)], volume.shape, (3, 5, 5), (3, 5, 5), fitted, near["norms"]).collect()}
    test = given.where(points.held_out(F.col("idx"), 0.4, 2)).collect()
    assert len(test) > 100 and np.mean([typed[r.idx] == r.type for r in test if r.idx in typed]) > 0.9


def test_features_stand_as_scorers_see_them(spark):
    cubes = np.random.default_rng(3).normal(size=(5, 2, 2, 3, 4)).astype(np.float32)
    at = np.argwhere(np.ones(cubes.shape))
    table = spark.createDataFrame(pd.DataFrame(at, columns=["idx", "channel", "dz", "dy", "dx"]).assign(v=cubes.ravel().astype(float))).repartition(2)
    got = {r.idx: np.array(r.features) for r in training.features(table, (2, 3, 4), channels=2).collect()}
    w = np.random.default_rng(1).normal(size=(48, 3))
    scores = {r.idx: r.p for r in scoring.predictions(table, (2, 3, 4), scoring.LinearSoftmax(w, np.zeros(3)), channels=2).collect()}
    for k, f in got.items():
        e = np.exp(f @ w - (f @ w).max())
        assert np.allclose(scores[k], e / e.sum())


def test_planes_are_rescaled_in_their_plane_only(spark):
    """2-D data whose pixels are twice as large as the network's."""
    plane = np.random.default_rng(5).integers(0, 9, (20, 30)).astype(float)
    y, x = (i.ravel() for i in np.indices(plane.shape))
    voxels = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "v": plane.ravel()}))
    given = spark.createDataFrame([(0, 10.0, 10.0), (1, 0.0, 10.0), (2, 20.0, 9.0)], "idx long, x double, y double").withColumn("type", F.lit(1))
    seen = classify_plane(given, [voxels], (20, 30), (2.0, 2.0), ((6, 6), (7.0, 1.0, 1.0)), Total())
    got = {r.idx: r.type for r in seen.collect()}
    want = {}
    for k, px, py in ((0, 10, 10), (2, 20, 9)):
        y0, x0 = round(py - 1.5), round(px - 1.5)
        part = plane[y0 : y0 + 3, x0 : x0 + 3]
        want[k] = 1 + int(part.sum() > 36)
    assert got == want and "z" not in seen.columns


class Total:
    """Type 2 if a cube of one plane, twice as wide as it was, is brighter than 4 on the mean."""

    channels = 1

    def load(self):
        return self

    def score(self, batch):
        assert batch.shape[1:] == (1, 6, 6, 1)
        total = batch.mean((1, 2, 3, 4))
        return np.stack([total <= 4, total > 4], 1).astype(float)


@pytest.mark.parametrize("seed", [None, 3])
def test_batches_of_one_axis_value(spark, seed):
    """Points of a single plane fill several tasks, and are numbered through all of them."""
    table = spark.range(5000).select(F.col("id").alias("idx"), F.lit(0.0).alias("z"), (F.col("id") % 7).alias("x")).repartition(5)
    got = points.batches(table, "z", 64, seed).toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(5000)) and (got["batch"] == got["position"] // 64).all()
    assert sorted(got["idx"]) == list(range(5000)) and (got["idx"].is_monotonic_increasing) == (seed is None)
    assert points.batch_count(5000, 64) == got["batch"].nunique() == 79
    by = points.batches(table, "x", 64, seed).toPandas().sort_values("position")
    assert by["x"].is_monotonic_increasing and by["position"].tolist() == list(range(5000))
    assert points.batches(table.limit(0), "z", 64, seed).count() == 0


def test_orders_of_axes(spark):
    assert points.axis_order("xyz", "zyx") == [2, 1, 0] and points.axis_order("zyxc", "cyxz") == [3, 1, 2, 0]
    for bad in ("zy", "zyy", "abc"):
        with pytest.raises(ValueError):
            points.axis_order("xyz", bad)
    table = spark.createDataFrame([(1, 2, 3, 1), (4, 5, 6, 2)], "x int, y int, z int, type int")
    layer = points.as_layer(table, 2)
    assert layer.columns == ["a0", "a1", "a2"] and [tuple(r) for r in layer.collect()] == [(6, 5, 4)]
    assert [tuple(r) for r in points.from_layer(layer, 2).collect()] == [(4, 5, 6, 2)]
    assert points.as_layer(table, 7).count() == 0 and points.appended(points.as_layer(table, 1), layer).count() == 2
    assert [points.near_planes(at, 100, 30) for at in (2, 50, 95)] == [(0, 17), (35, 65), (80, 100)]
    got = points.common(table.select("x"), spark.createDataFrame([(4,), (4,), (1,), (9,)], "x int"))
    assert [r.x for r in got.collect()] == [1, 4]


def test_stamped_balls(spark):
    table = spark.createDataFrame([(7, 5, 5, 5), (3, 7, 5, 5), (1, 1, 5, 5), (9, 13, 5, 5)], "idx long, x long, y long, z long")
    got = {(r.z, r.y, r.x): r.idx for r in structures.stamped(table, (11, 11, 15), 2).collect()}
    grid = np.indices((11, 11, 15))
    want = {}
    for idx, x in ((7, 5), (3, 7)):  # the smaller id last; the others reach over the edge
        for at in np.argwhere((grid[0] - 5) ** 2 + (grid[1] - 5) ** 2 + (grid[2] - x) ** 2 <= 4):
            want[tuple(at.tolist())] = idx
    assert got == want


def test_point_lists(spark):
    """A large structure comes in parts; together they are its voxels."""
    at = [(7, z, y, x) for z in range(4) for y in range(5) for x in range(6)] + [(9, 1, 9, 9), (9, 1, 9, 8)]
    table = spark.createDataFrame(at, "sid long, z long, y long, x long").repartition(3)
    got: dict = {}
    for r in structures.point_lists(table, 50).collect():
        assert len(r.points) <= 60 and [(p.z, p.y, p.x) for p in r.points] == sorted((p.z, p.y, p.x) for p in r.points)
        got.setdefault(r.sid, []).append(r.points)
    assert len(got[7]) == 3 and [tuple(p) for p in got[9][0]] == [(8, 9, 1), (9, 9, 1)]
    assert sorted((7, p.z, p.y, p.x) for part in got[7] for p in part) == at[:120]


def test_random_signs(spark):
    signs = [r[0] for r in spark.range(4000).select(points.random_sign(F.col("id"), 3)).collect()]
    assert set(signs) == {1, -1} and abs(sum(signs)) < 250
    assert signs == [r[0] for r in spark.range(4000).repartition(3).orderBy("id").select(points.random_sign(F.col("id"), 3)).collect()]
