"""Files that volumes, cubes and points come in and go out as."""

import os
import struct

import numpy as np
import pytest

from volumetra.functions import dtypes
from volumetra.operators import cubes
from volumetra.settings import DetectionSettings, bins_of, check_volume, learning_rate, plane_name, readable_bytes
from volumetra.sources import files


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "uint32", "int16", "float32", "float64"])
def test_tiff_round_trip(dtype):
    stack = np.random.default_rng(1).integers(0, 100, (3, 5, 7)).astype(dtype)
    for k, plane in enumerate(files.decode_tiff(files.encode_stack(stack))):
        assert plane.dtype == dtype and (plane == stack[k]).all()
    assert (files.decode_tiff(files.encode_tiff(stack[0]))[0] == stack[0]).all()


def test_big_endian_tiff_of_several_strips():
    plane = np.arange(12, dtype=">u2").reshape(4, 3)
    tags = [(256, 4, 1, 3), (257, 4, 1, 4), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 200), (277, 3, 1, 1 << 16), (278, 4, 1, 2), (279, 4, 2, 208)]
    head = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0)
    data = head.ljust(200, b"\0") + struct.pack(">IIII", 300, 400, 12, 12)
    data = data.ljust(300, b"\0") + plane[:2].tobytes()
    data = data.ljust(400, b"\0") + plane[2:].tobytes()
    assert (files.decode_tiff(data)[0] == plane).all()
    with pytest.raises(ValueError):
        files.decode_tiff(b"no image at all")


def test_planes_come_in_natural_order(spark, tmp_path):
    for name, v in (("p2.tif", 2), ("p10.tif", 10), ("p1.tif", 1)):
        (tmp_path / name).write_bytes(files.encode_tiff(np.full((2, 3), v, np.uint16)))
    got = files.read_planes(spark, str(tmp_path)).groupBy("z").agg({"v": "max", "x": "count"}).orderBy("z").collect()
    assert [(r.z, r["max(v)"], r["count(x)"]) for r in got] == [(0, 1.0, 6), (1, 2.0, 6), (2, 10.0, 6)]


def test_cubes_written_and_read_by_channel(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(k, 2 * k, 3 * k, c, [2, 3, 4], r.integers(0, 60_000, 24).astype(float).tolist()) for k in (1, 2, 10) for c in (1, 2) if (k, c) != (10, 2)]
    schema = "x long, y long, z long, channel int, shape array<int>, cube array<double>"
    files.write_cubes(spark.createDataFrame(rows, schema), str(tmp_path), compression="lzw")
    names = set(os.listdir(tmp_path))
    assert names == {files.cube_name(k, 2 * k, 3 * k, c) for k, _, _, c, *_ in rows} and "pCellz3y2x1Ch1.tif" in names
    found = files.channel_files(spark, str(tmp_path), [1, 2])
    listed = found.orderBy("place").collect()
    assert [x.file.rsplit("/", 1)[1] for x in listed] == [files.cube_name(k, 2 * k, 3 * k, 1) for k in (1, 2, 10)]
    assert [x.complete for x in listed] == [True, True, False]
    got = {}
    for v in files.read_cubes(found.where("complete")).collect():
        got.setdefault((v.file.rsplit("/", 1)[1], v.channel), np.zeros((2, 3, 4)))[v.dz, v.dy, v.dx] = v.v
    want = {(files.cube_name(k, 2 * k, 3 * k, 1), c): np.array(cube).reshape(2, 3, 4) for k, _, _, c, _, cube in rows if k < 10}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def test_cells_and_structures(spark, tmp_path):
    points = [(1.0, 2.0, 3.0, 2), (4.5, 5.0, 6.0, 2), (7.0, 8.0, 9.0, 1)]
    files.write_cells(spark.createDataFrame(points, "x double, y double, z double, type int"), str(tmp_path / "cells"))
    assert sorted(tuple(r) for r in files.read_cells(spark, str(tmp_path / "cells")).collect()) == sorted(points)
    one = [(1, 1, 2, 3, 9, "cell")]
    files.write_structures(spark.createDataFrame(one, "id long, x long, y long, z long, volume long, volume_type string"), str(tmp_path / "structures"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "structures"))
    assert back.columns == ["id", "x", "y", "z", "volume", "volume_type"] and [tuple(r) for r in back.collect()] == one


def test_training_sets(spark):
    rows = [{"cube_dir": "/a/b", "cell_def": "", "type": "cell", "signal_channel": 1, "bg_channel": -1, "signal_mean": 1.5}, {"cube_dir": "/c", "cell_def": "x.xml", "type": "no_cell", "signal_channel": 0, "bg_channel": 2}]
    got = files.read_training(spark, "# made by hand\n" + files.training_text(rows)).collect()
    assert [{k: v for k, v in r.asDict().items() if v is not None} for r in got] == rows


def test_settings():
    assert (dtypes.max_exact("uint16"), dtypes.min_exact("int8"), dtypes.min_exact("uint8"), dtypes.max_exact("float32")) == (65535, -128, 0, 2**23)
    kinds = {"uint8": "float32", "uint16": "float32", "int8": "float32", "int16": "float32", "float32": "float32", "uint32": "float64", "int32": "float64", "float64": "float64"}
    assert {k: dtypes.filtering_dtype(k) for k in kinds} == kinds
    for bad in ("int64", "uint64", "text"):
        with pytest.raises(TypeError):
            check_volume(bad, (1, 1, 1))
    for shape in ((5,), (5, 5), (5, 5, 5, 5)):
        with pytest.raises(ValueError):
            check_volume("uint16", shape)
    s = DetectionSettings()
    assert (s.soma_diameter, s.ball_xy, s.ball_z, s.tile, s.clip_value) == (8, 3, 3, 16, 65533)
    with pytest.raises(ValueError):
        DetectionSettings.from_dict({"nothing": 1})
    assert DetectionSettings.from_dict({"soma_diameter_um": 20}).soma_diameter == 10
    assert bins_of((100, 1000, 5000), (12, 12, 12)) == (8, 83, 416) and bins_of({"x": 20, "y": 200}, {"x": 8, "y": 8}) == {"x": 2, "y": 25}
    assert readable_bytes(12_300) == "12.3 KB" and plane_name(2, 6) == "plane_0002"
    assert learning_rate(5, 1e-3, (3, 5), 0.1) == pytest.approx(1e-5)
    assert cubes.data_voxels(50, 1.0, 2.0) == 25
    for axes in (1, 4):
        with pytest.raises(ValueError):
            cubes.promoted((1.0,) * axes, (1.0, 1.0, 1.0))
    assert cubes.promoted((2.0, 3.0), (5.0, 1.0, 1.0)) == ((1.0, 2.0, 3.0), (1.0, 1.0, 1.0))
