"""Files that volumes and points come in: TIFF planes, cells as XML, structures as CSV, training sets as YAML."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators.points import natural_key
from volumetra.sources.stacks import read_planes, write_files
from volumetra.sources.tiff import decode_tiff, encode_stack, encode_tiff

__all__ = ["decode_tiff", "encode_stack", "encode_tiff", "read_planes"]

CELLS_SCHEMA = "Type int, Marker array<struct<MarkerX: double, MarkerY: double, MarkerZ: double>>"


def list_channel_files(spark: SparkSession, path: str) -> DataFrame:
    """path and channel of files that end in ch<n>.tif, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(F.lower("path").rlike(r"ch\d+\.tif$")).select("path", F.regexp_extract(F.lower("path"), r"ch(\d+)\.tif$", 1).cast("int").alias("channel"))


def channel_files(spark: SparkSession, path: str, channels: list[int]) -> DataFrame:
    """file, channels (an array of channel and path) and complete, a row for each cube that has a file of the first of
    `channels`, in natural order of `place`; complete says whether it has one of every channel."""
    found = list_channel_files(spark, path).where(F.col("channel").isin(channels)).withColumn("cube", F.regexp_replace(F.lower("path"), r"ch\d+\.tif$", ""))
    every = found.groupBy("cube").agg(F.array_sort(F.collect_set(F.struct("channel", "path"))).alias("channels"))
    first = F.filter("channels", lambda c: c["channel"] == channels[0])
    rows = every.where(F.size(first) > 0).withColumn("file", first[0]["path"])
    return rows.select("file", "channels", (F.size("channels") == len(set(channels))).alias("complete"), natural_key(F.col("file")).alias("place"))


def read_cubes(files: DataFrame) -> DataFrame:
    """file, channel and the cube (dz, dy, dx, v) of channel_files(): each file is read and decoded in the task that has it."""
    spark = files.sparkSession
    each = files.select("file", F.explode("channels").alias("c")).select("file", F.col("c.channel").alias("channel"), F.col("c.path").alias("path"))
    paths = [r.path for r in each.select(F.regexp_replace("path", "[^/]*$", "").alias("path")).distinct().collect()]  # folders
    data = spark.read.format("binaryFile").load(paths).select("path", "content") if paths else spark.createDataFrame([], "path string, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, channel, content in zip(*(b[c].to_pylist() for c in ("file", "channel", "content"))):
                cube = np.stack(decode_tiff(content))
                z, y, x = (i.ravel() for i in np.indices(cube.shape))
                yield pa.RecordBatch.from_arrays([pa.array([file] * cube.size), pa.array([channel] * cube.size, pa.int32()), *(pa.array(i) for i in (z, y, x)), pa.array(cube.ravel().astype(np.float64))], ["file", "channel", "dz", "dy", "dx", "v"])

    return each.join(data, "path").select("file", "channel", "content").mapInArrow(run, "file string, channel int, dz long, dy long, dx long, v double")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below a folder, whose contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


def subfolders(spark: SparkSession, path: str) -> DataFrame:
    """Names of the folders in a folder that hold files, at any depth, and how many."""
    root = F.regexp_replace(F.lit(path), "^file:/+", "/")
    rest = F.substring(F.regexp_replace("path", "^file:/+", "/"), F.length(F.regexp_replace(root, "/+$", "")) + 2, 1 << 20)
    return list_files(spark, path).select(F.regexp_extract(rest, "^([^/]+)/", 1).alias("name")).where("name != ''").groupBy("name").agg(F.count("*").alias("files"))


def cube_name(x: int, y: int, z: int, channel: int) -> str:
    return f"pCellz{z}y{y}x{x}Ch{channel}.tif"


def write_cubes(cubes: DataFrame, folder: str, dtype: str = "uint16", **how) -> None:
    """Write each cube (x, y, z, channel, shape and cube: values in z, y, x order) as a TIFF file of its own, all or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                content = encode_stack(np.array(row["cube"]).reshape(row["shape"]).astype(dtype), **how)
                yield pa.RecordBatch.from_arrays([pa.array([cube_name(row["x"], row["y"], row["z"], row["channel"])]), pa.array([content], pa.binary())], ["name", "content"])

    write_files(cubes.select("x", "y", "z", "channel", "shape", "cube").mapInArrow(run, "name string, content binary"), folder)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and type of a cells file."""
    rows = spark.read.format("xml").option("rowTag", "Marker_Type").schema(CELLS_SCHEMA).load(path)
    return rows.select("Type", F.explode("Marker").alias("m")).select(F.col("m.MarkerX").alias("x"), F.col("m.MarkerY").alias("y"), F.col("m.MarkerZ").alias("z"), F.col("Type").alias("type"))


def write_cells(points: DataFrame, path: str, most: int = 10_000) -> None:
    """Points as XML, at most about `most` in an element; an element for a type may stand several times, which readers of
    the format add up. No task has to hold all points of a type."""
    each = F.struct(*(F.col(a).alias(f"Marker{a.upper()}") for a in "xyz"))
    sizes = points.groupBy("type").agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = points.join(F.broadcast(sizes), "type").withColumn("_part", F.pmod(F.xxhash64("x", "y", "z", F.monotonically_increasing_id()), F.col("_parts")))
    rows = dealt.groupBy(F.col("type").alias("Type"), "_part").agg(F.collect_list(each).alias("Marker")).drop("_part")
    rows.write.format("xml").option("rootTag", "Marker_Data").option("rowTag", "Marker_Type").save(path)


def write_structures(rows: DataFrame, path: str) -> None:
    rows.select("id", "x", "y", "z", "volume", "volume_type").write.option("header", True).csv(path)


def training_rows(text: str) -> list[dict[str, str]]:
    """The `data` list of a training file: flat mappings of names to scalars, as text."""
    rows: list[dict] = []
    inside = False
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip():
            continue
        if not body[0].isspace() and not body.startswith("-"):
            inside = body.rstrip(":").strip() == "data"
            continue
        if inside:
            item = body.strip()
            if item.startswith("-"):
                rows.append({})
                item = item[1:].strip()
            if item:
                name, _, value = item.partition(":")
                rows[-1][name.strip()] = value.strip().strip("'\"")
    return rows


TRAINING_KINDS = {"cube_dir": "string", "cell_def": "string", "type": "string", "signal_channel": "int", "bg_channel": "int", "signal_mean": "double", "signal_std": "double", "bg_mean": "double", "bg_std": "double"}


def training_table(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    """The items as a table, numbered by definition."""
    raw = spark.createDataFrame([(k, *(r.get(c) for c in TRAINING_KINDS)) for k, r in enumerate(rows)], "definition long, " + ", ".join(f"{k} string" for k in TRAINING_KINDS))
    return raw.select("definition", *(F.col(k).cast(t).alias(k) for k, t in TRAINING_KINDS.items()))


def read_training(spark: SparkSession, text: str) -> DataFrame:
    return training_table(spark, training_rows(text)).drop("definition")


def training_text(rows: list[dict]) -> str:
    return "data:\n" + "".join("- " + "  ".join(f"{k}: {v}\n" for k, v in sorted(r.items())) for r in rows)
