"""TIFF stacks as a data source, and files that are written whole or not at all."""

import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from volumetra.operators import components, planes
from volumetra.sources import files, stacks, tiff


@given(st.one_of(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=30).map(lambda r: b"".join(bytes([v]) * n for v, n in r))))
@settings(max_examples=150, deadline=None)
def test_codecs_are_lossless(data):
    assert tiff.from_lzw(tiff.to_lzw(data)) == data and tiff.from_packbits(tiff.to_packbits(data)) == data


def test_codecs_on_long_data_and_known_codes():
    r = random.Random(1)
    for data in (bytes(r.choices(range(256), k=40_000)), bytes(r.choices(b"ab", k=40_000)), b"\0" * 70_000):
        assert tiff.from_lzw(tiff.to_lzw(data)) == data and tiff.from_packbits(tiff.to_packbits(data)) == data
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # nine bits each
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.to_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed and tiff.from_lzw(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    known = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.from_packbits(known) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    with pytest.raises(ValueError):
        tiff.from_lzw(bytes([0x80, 0x7F, 0xFF, 0xFF]))


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32"])
def test_strips_and_differences(compression, dtype):
    stack = np.random.default_rng(1).integers(0, 100, (3, 11, 7)).astype(dtype)
    for rows in (0, 1, 4, 30):
        for differences in {False, dtype != "float32"}:
            got = tiff.decode_tiff(tiff.encode_stack(stack, compression, rows, differences))
            assert all(p.dtype == dtype for p in got) and (np.array(got) == stack).all()


def test_big_offsets():
    plane = np.arange(12, dtype=">u2").reshape(4, 3)
    tags = [(256, 4, 1, 3 << 32), (257, 4, 1, 4 << 32), (258, 3, 1, 16 << 48), (259, 3, 1, 1 << 48), (273, 16, 1, 300), (277, 3, 1, 1 << 48), (278, 4, 1, 4 << 32), (279, 16, 1, 24)]
    data = b"MM\0+\0\x08\0\0" + struct.pack(">QQ", 16, len(tags)) + b"".join(struct.pack(">HHQQ", *t) for t in tags) + struct.pack(">Q", 0)
    assert (tiff.decode_tiff(data.ljust(300, b"\0") + plane.tobytes())[0] == plane).all()


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(3).integers(0, 5000, (9, 12, 10)).astype(np.uint16)


def write_some(folder, stack):
    """Files of 1, 3, 2 and 3 planes, whose names sort naturally, and something that is no image."""
    os.makedirs(folder, exist_ok=True)
    for name, part, how in (("p1.tif", stack[:1], {}), ("p2.tif", stack[1:4], dict(compression="lzw", rows=5)), ("p10.tif", stack[4:6], dict(compression="packbits", differences=True)), ("p11.tif", stack[6:], dict(compression="deflate", rows=1))):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(tiff.encode_stack(part, **how))
    with open(f"{folder}/notes.txt", "w") as f:
        f.write("no image")


def array(rows, shape):
    out = np.full(shape, -1.0)
    for r in rows:
        out[r.z, r.y, r.x] = r.v
    return out


def test_stack_of_several_planes_a_file(spark, tmp_path, stack):
    write_some(tmp_path, stack)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert (array(files.read_planes(spark, path).collect(), stack.shape) == stack).all()
    assert (array(files.read_planes(spark, f"{tmp_path}/p2.tif").collect(), (3, 12, 10)) == stack[1:4]).all()
    (tmp_path / "none").mkdir()
    assert files.read_planes(spark, str(tmp_path / "none")).count() == 0


def test_only_wanted_planes_are_read(spark, tmp_path, stack):
    """By the plan: there is a partition for each plane that the filter leaves."""
    write_some(tmp_path, stack)
    rows = files.read_planes(spark, str(tmp_path), each=1)
    assert rows.rdd.getNumPartitions() == 9
    for condition, left in ((F.col("z").between(2, 4), [2, 3, 4]), (F.col("z") == 7, [7]), (F.col("z").isin(1, 8), [1, 8]), ((F.col("z") > 6) & (F.col("y") == 3), [7, 8]), (F.col("z") < 1, [0])):
        some = rows.where(condition)
        assert some.rdd.getNumPartitions() == len(left)
        assert sorted({r.z for r in some.collect()}) == left
    chosen = planes.plane_range(rows, 3, 6)
    assert chosen.rdd.getNumPartitions() == 3 and (array(chosen.collect(), stack.shape)[3:6] == stack[3:6]).all()
    assert rows.where((F.col("z") == 3) & (F.col("v") < 0)).count() == 0


def test_reader_holds_a_strip(tmp_path, stack):
    write_some(tmp_path, stack)
    reader = stacks.StackReader({"path": str(tmp_path), "pattern": "p11.tif"})
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert set(sizes) == {10} and sum(sizes) == 3 * 120


def voxels(spark, stack):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(stack)], "z long, y long, x long, v double")


def test_planes_written_and_read(spark, tmp_path, stack):
    folder = str(tmp_path / "planes")
    stacks.write_planes(voxels(spark, stack), stack.shape, folder, compression="lzw")
    assert sorted(os.listdir(folder)) == [f"plane_{k:04d}.tif" for k in range(1, 10)]
    assert (array(files.read_planes(spark, folder).collect(), stack.shape) == stack).all()
    stacks.write_planes(voxels(spark, stack).where("z < 2").withColumn("v", F.col("v") - 100), stack.shape, folder, "uint8")
    got = tiff.decode_tiff(open(f"{folder}/plane_0001.tif", "rb").read())[0]
    assert (got == np.clip(stack[0].astype(int) - 100, 0, 255)).all() and len(os.listdir(folder)) == 9


def test_stages(spark, tmp_path, stack):
    v = voxels(spark, stack).where("z < 3")
    bright = planes.global_threshold(v, 1.0).select("z", "y", "x")
    labelled = components.connected_components(bright, stack.shape).withColumn("v", F.col("sid") + 1)
    stacks.write_stages({"raw": v, "bright": bright, "struct_id": labelled}, (3, 12, 10), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["bright", "raw", "struct_id"]
    got = {n: array(files.read_planes(spark, str(tmp_path / "out" / n)).collect(), (3, 12, 10)) for n in ("raw", "bright", "struct_id")}
    assert (got["raw"] == stack[:3]).all() and got["bright"].sum() == bright.count() and ((got["struct_id"] > 0) == (got["bright"] > 0)).all()


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "files")
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        stacks.write_files(rows, folder)
    assert not os.path.exists(folder) or all(n.startswith("_aside-") for n in os.listdir(folder))  # a task that was still running
    stacks.write_files(rows.where("id < 37"), folder)
    assert sorted(n for n in os.listdir(folder) if n[0] != "_") == sorted(f"f{k}" for k in range(37))


def test_cells_of_one_type_in_several_elements(spark, tmp_path):
    points = [(float(k % 7), float(k), 1.0, 2 if k % 10 else 1) for k in range(500)] * 2
    files.write_cells(spark.createDataFrame(points, "x double, y double, z double, type int"), str(tmp_path / "cells"), most=50)
    text = "".join(open(tmp_path / "cells" / f).read() for f in os.listdir(tmp_path / "cells") if f.startswith("part"))
    assert text.count("<Marker_Type>") > 12
    assert sorted(tuple(r) for r in files.read_cells(spark, str(tmp_path / "cells")).collect()) == sorted(points)
