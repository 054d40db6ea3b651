"""Training sets: from definition files and folders of cubes to a row for each cube."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators.points import natural_key
from volumetra.operators.scoring import NAMES, labelled_type
from volumetra.sources import files

CUBE_NAME = r"pCellz(-?\d+)y(-?\d+)x(-?\d+)Ch\d+\.tif$"


def plain(path: Column) -> Column:
    """A local path as such, whether it is given as one or as a URI."""
    return F.regexp_replace(path, "^file:/+", "/")


def position(path: Column) -> list[Column]:
    """z, y and x that a cube's file name tells, or null."""
    return [F.try_to_number(F.nullif(F.regexp_extract(path, f"(?i){CUBE_NAME}", k), F.lit("")), F.lit("S99999999")).cast("long").alias(a) for k, a in enumerate("zyx", 1)]


def definitions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The `data` lists of definition files, one after another; definition numbers their items."""
    texts = {r.path: r.value for r in spark.read.text(paths, wholetext=True).select("value", plain(F.col("_metadata.file_path")).alias("path")).collect()}
    order = [p if p in texts else next(t for t in texts if t.endswith(p.removeprefix("file:").lstrip("/"))) for p in paths]
    rows = [r for p in order for r in files.training_rows(texts[p])]
    return files.training_table(spark, rows)


def wanted_positions(spark: SparkSession, defined: list) -> DataFrame:
    """definition, z, y and x of the cells that definitions with a cell_def name: a file of cells, or a folder of cubes."""
    out = spark.createDataFrame([], "definition long, z long, y long, x long")
    for d in defined:
        if not d.cell_def:
            continue
        if d.cell_def.lower().endswith(".xml"):
            cells = files.read_cells(spark, d.cell_def).select(*(F.bround(a).cast("long").alias(a) for a in "zyx"))
        else:
            cells = spark.read.format("binaryFile").load(d.cell_def).select(*position(F.col("path")))
        out = out.unionByName(cells.select(F.lit(d.definition).alias("definition"), "z", "y", "x"))
    return out.distinct()


def training_set(spark: SparkSession, defined: DataFrame) -> DataFrame:
    """definition, file, channels (an array of channel, path, mean and std, in the definition's order), label, type, complete
    (whether the folder has a file of every channel) and place (which sorts files naturally within a definition), a row for
    each cube that has a file of its definition's first channel. A definition with a cell_def takes only cubes whose place,
    by their names, is that of one of its cells. Only definitions, a few rows, reach the driver; files are listed, not read."""
    known = defined.collect()
    if bad := sorted({d.type for d in known if d.type is not None} - set(NAMES)):
        raise ValueError(f"unknown labels: {bad}")
    if not known:
        return spark.createDataFrame([], "definition long, file string, channels array<struct<channel:int,path:string,mean:double,std:double>>, label string, type int, complete boolean, place string")
    each = defined.select(
        "definition", "cell_def", F.regexp_replace(plain(F.col("cube_dir")), "/+$", "").alias("folder"), F.col("type").alias("label"), F.col("signal_channel").alias("first"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("n"), F.col("signal_channel").alias("channel"), F.col("signal_mean").alias("mean"), F.col("signal_std").alias("std")),
            F.struct(F.lit(1).alias("n"), F.when(F.col("bg_channel") >= 0, F.col("bg_channel")).alias("channel"), F.col("bg_mean").alias("mean"), F.col("bg_std").alias("std")),
        )).alias("c"),
    ).where("c.channel IS NOT NULL")
    sizes = each.groupBy("definition").agg(F.count("*").alias("wanted"))
    listed = spark.read.format("binaryFile").load(sorted({re.sub("^file:/+", "/", d.cube_dir).rstrip("/") for d in known})).select("path")  # each folder once
    listed = listed.select("path", F.regexp_replace(plain(F.col("path")), "/[^/]*$", "").alias("folder"), F.regexp_extract(F.lower("path"), r"ch(\d+)\.tif$", 1).alias("number"))
    listed = listed.where("number != ''").select("path", "folder", F.col("number").cast("int").alias("channel"), F.regexp_replace(F.lower("path"), r"ch\d+\.tif$", "").alias("cube"))
    met = listed.join(F.broadcast(each), (listed.folder == each.folder) & (listed.channel == F.col("c.channel")))
    entry = F.struct(F.col("c.n").alias("n"), F.col("c.channel").alias("channel"), "path", F.col("c.mean").alias("mean"), F.col("c.std").alias("std"))
    cubes = met.groupBy("definition", "cube").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.first("label").alias("label"), F.first("cell_def").alias("cell_def")).where("all[0].n = 0")
    cubes = cubes.join(F.broadcast(sizes), "definition").withColumn("file", F.col("all")[0]["path"])
    placed = cubes.select("*", *position(F.col("file")))
    free, bound = placed.where("coalesce(cell_def, '') = ''"), placed.where("cell_def != ''")
    chosen = free.unionByName(bound.join(wanted_positions(spark, known), ["definition", "z", "y", "x"], "left_semi").select(free.columns))
    channels = F.transform("all", lambda c: F.struct(c["channel"].alias("channel"), c["path"].alias("path"), c["mean"].alias("mean"), c["std"].alias("std")))
    return chosen.select("definition", "file", channels.alias("channels"), "label", labelled_type(F.col("label")).alias("type"), (F.size("all") == F.col("wanted")).alias("complete"), natural_key(F.col("file")).alias("place"))
