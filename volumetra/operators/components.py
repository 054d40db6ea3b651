"""6-connected components of sparse foreground voxels.

Slabs of planes, further cut into tiles, are labelled each in one task; labels that touch across a border become edges
of a much smaller graph, which is labelled by repeated minimum and label-of-label steps, every round written to the
shared folder so that a lost executor costs no more than a round.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge of a tile within a slab.
TILE = 512


_within = threading.local()


def step_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors share files; what is written there goes when the driver's JVM ends, or with the
    `scratch` that it is made in. Only a local session, as in tests, may leave spark.checkpoint.dir unset: it gets one below
    /tmp."""
    shared = getattr(_within, "folder", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or '/tmp/checkpoints').rstrip('/')}/step-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    if not getattr(_within, "folder", None):
        system.deleteOnExit(where)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, step folders lie in one folder that goes at its end: for work whose results are written elsewhere by then."""
    before, folder = getattr(_within, "folder", None), step_folder(spark)
    _within.folder = folder
    try:
        yield folder
    finally:
        _within.folder = before
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that driver and executors share."""
    path = f"{step_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_points(z: np.ndarray, y: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each voxel the smallest id of its component."""
    n = len(ids)
    parent = np.arange(n)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    if not n:
        return ids
    low = [a.min() for a in (z, y, x)]
    span = [int(a.max() - m) + 2 for a, m in zip((z, y, x), low)]
    place = ((z - low[0]) * span[1] + (y - low[1])) * span[2] + (x - low[2])
    by = np.argsort(place)
    sorted_place = place[by]
    for step in (1, span[2], span[1] * span[2]):
        at = np.minimum(np.searchsorted(sorted_place, place + step), n - 1)
        touch = np.flatnonzero(sorted_place[at] == place + step)
        for a, b in zip(touch.tolist(), by[at[touch]].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                if ids[ra] < ids[rb]:
                    parent[rb] = ra
                else:
                    parent[ra] = rb
    return ids[[find(k) for k in range(n)]]


def merge_labels(edges: DataFrame) -> DataFrame:
    """(u, v) -> (label, root): the smallest label of each component."""
    both = written(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = written(both.groupBy(F.col("u").alias("label")).agg(F.least("label", F.min("v")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("label").alias("v"), "root"), "v").groupBy(F.col("u").alias("label")).agg(F.min("root").alias("near"))
        low = labels.join(near, "label").select("label", "root", F.least("root", "near").alias("low"))
        far = labels.select(F.col("label").alias("low"), F.col("root").alias("far"))
        after = written(low.join(far, "low", "left").select("label", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("was")))
        labels = after.select("label", "root")
        if after.where("root != was").isEmpty():
            return labels


def connected_components(foreground: DataFrame, shape: tuple[int, int, int], slab: int = 16, tile: int = TILE) -> DataFrame:
    """z, y, x and sid: the raster index (z, y, x) of the component's first voxel."""
    _, h, w = shape
    rows = foreground.select("z", "y", "x", (F.col("z") * (h * w) + F.col("y") * w + F.col("x")).alias("vid"))
    keyed = rows.withColumn("bz", F.floor(F.col("z") / slab)).withColumn("by", F.floor(F.col("y") / tile)).withColumn("bx", F.floor(F.col("x") / tile))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = label_points(*(pdf[c].to_numpy() for c in ("z", "y", "x", "vid")))
        return pd.DataFrame({"z": pdf["z"], "y": pdf["y"], "x": pdf["x"], "vid": pdf["vid"], "label": label})

    local = written(keyed.groupBy("bz", "by", "bx").applyInPandas(run, "z long, y long, x long, vid long, label long"))
    borders = []
    for axis, step, size in (("z", h * w, slab), ("y", w, tile), ("x", 1, tile)):
        near = local.where(F.col(axis) % size == size - 1).select((F.col("vid") + step).alias("vid"), F.col(axis).alias("a"), F.col("label").alias("u"))
        far = local.where(F.col(axis) % size == 0).select("vid", F.col(axis).alias("b"), F.col("label").alias("v"))
        borders.append(near.join(far, "vid").where(F.col("b") == F.col("a") + 1).select("u", "v"))
    roots = merge_labels(borders[0].union(borders[1]).union(borders[2]).distinct())
    return local.join(roots, "label", "left").select("z", "y", "x", F.coalesce("root", "label").alias("sid"))
