"""Data sources of this library: stacks of TIFF planes to read, and files that are written whole or not at all.

Both find files by pyarrow's file systems, so a path may be a local one or a URI (file, s3, gs, hdfs).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from volumetra.settings import plane_name
from volumetra.sources.tiff import Layout, Page, encode_stack

VOXELS = "z long, y long, x long, v double"
#: Pixels that go to Spark together, and files looked at together by the driver.
TOGETHER, THREADS = 1 << 16, 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def natural(name: str) -> list:
    return [int(p) if p.isdigit() else p for p in re.findall(r"\d+|\D+", name)]


@dataclass
class Planes(InputPartition):
    """Planes of a stack: z, file and where the plane's directory is in it."""

    planes: list[tuple[int, str, int]]


class StackReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif*")
        self.each = int(options.get("planesPerPartition", 4))
        self.low, self.high, self.only = 0, float("inf"), None

    def pushFilters(self, filters):
        """Planes are chosen by comparisons of z with numbers; all other filters are Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("z",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, In):
                self.only = set(f.value) & (self.only if self.only is not None else set(f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Planes]:
        """Files in natural order of their names; z counts the planes of all of them. Only the links between directories
        are read here, of several files at a time."""
        system, root = located(self.path)
        info = system.get_file_info(root)
        found = system.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f.path for f in found if f.type == fs.FileType.File and (f is info or fnmatch(f.base_name, self.pattern))), key=lambda p: natural(p.rsplit("/", 1)[-1]))

        def pages(path: str) -> list[int]:
            with system.open_input_file(path) as f:
                return Layout.of(f).pages(f)

        with ThreadPoolExecutor(THREADS) as pool:
            every = [(path, at) for path, own in zip(files, pool.map(pages, files)) for at in own]
        wanted = [(z, path, at) for z, (path, at) in enumerate(every) if self.low <= z < self.high and (self.only is None or z in self.only)]
        return [Planes(wanted[k : k + self.each]) for k in range(0, len(wanted), self.each)] or [Planes([])]

    def read(self, partition: Planes) -> Iterator[pa.RecordBatch]:
        """A strip at a time is held."""
        system, _ = located(self.path)
        for z, path, at in partition.planes:
            with system.open_input_file(path) as f:
                for first, part in Page(f, Layout.of(f), at).parts(f):
                    rows = max(1, TOGETHER // max(1, part.shape[1]))
                    for k in range(0, len(part), rows):
                        some = part[k : k + rows]
                        y, x = np.indices(some.shape)
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.full(some.size, z), y.ravel() + first + k, x.ravel(), some.ravel().astype(np.float64))], ["z", "y", "x", "v"])


class Stack(DataSource):
    """z, y, x, v of a folder of TIFF files (or of one file). Options: pattern, planesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> StackReader:
        return StackReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Tasks write under names that nobody looks for; the driver moves the files of the tasks that count into place."""

    def __init__(self, path: str):
        self.path, self.aside = path, f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, root = located(self.path)
        system.create_dir(f"{root}/{self.aside}", recursive=True)
        out = []
        for row in iterator:
            name = f"{self.aside}/{uuid.uuid4().hex}"
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(bytes(row.content))
            out.append((name, row.name))
        return Written(out)

    def commit(self, messages) -> None:
        system, root = located(self.path)
        moves = [pair for m in messages if m is not None for pair in m.files]
        for folder in {name.rsplit("/", 1)[0] for _, name in moves if "/" in name}:
            system.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda pair: system.move(f"{root}/{pair[0]}", f"{root}/{pair[1]}"), moves))
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.aside}")


class Files(DataSource):
    """Rows name, content as files of a folder, all of them or none."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources known to it, and with filters handed to sources."""
    for source in (Stack, Files):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_planes(spark: SparkSession, path: str, pattern: str = "*.tif", each: int = 4) -> DataFrame:
    """z, y, x, v of a folder of TIFF files, or of one file; files may hold any number of planes. A filter on z decides
    which planes are read at all."""
    return registered(spark).read.format("tiff_stack").option("pattern", pattern).option("planesPerPartition", each).load(path)


def write_files(rows: DataFrame, folder: str) -> None:
    """name and content as files of the folder (names may hold a folder of their own). A task that fails or is killed, or a
    job that fails, puts no file into place; a task that ran on while its job failed may leave a folder _aside-..., which
    readers of Spark pass over."""
    registered(rows.sparkSession)
    rows.select("name", "content").write.format("whole_files").mode("append").save(folder)


def plane_files(voxels: DataFrame, shape: tuple[int, int, int], dtype: str, folder: str = "", **how) -> DataFrame:
    """name and content of a TIFF file for each plane, counted from 1; values are cut to what the type holds, and voxels
    without a row are 0. A file is a plane, so a task holds a plane."""
    kind = np.dtype(dtype)
    least, most = (np.iinfo(kind).min, np.iinfo(kind).max) if kind.kind in "iu" else (-np.inf, np.inf)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        plane = np.zeros(shape[1:], kind)
        plane[rows["y"].to_numpy(), rows["x"].to_numpy()] = np.clip(rows["v"].to_numpy().astype(np.float64), least, most).astype(kind)
        name = f"{folder}{'/' if folder else ''}{plane_name(key[0].as_py() + 1, shape[0])}.tif"
        return pa.table({"name": [name], "content": pa.array([encode_stack(plane[None], **how)], pa.binary())})

    return voxels.select("z", "y", "x", "v").groupBy("z").applyInArrow(run, "name string, content binary")


def write_planes(voxels: DataFrame, shape: tuple[int, int, int], folder: str, dtype: str = "uint16", **how) -> None:
    write_files(plane_files(voxels, shape, dtype, **how), folder)


def write_stages(stages: dict[str, DataFrame], shape: tuple[int, int, int], folder: str, dtype: str = "uint32") -> None:
    """A stack for each named stage (z, y, x and v, or without v where a row says that the voxel is set), in a folder of its
    name; all stages are committed together."""
    every = None
    for name, rows in stages.items():
        rows = rows if "v" in rows.columns else rows.withColumn("v", F.lit(1))
        files = plane_files(rows, shape, dtype, name)
        every = files if every is None else every.unionByName(files)
    if every is not None:
        write_files(every, folder)
