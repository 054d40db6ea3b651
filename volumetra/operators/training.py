"""A scorer fitted on labelled cubes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.operators.cubes import in_blocks, resample_array
from volumetra.operators.points import held_out
from volumetra.operators.scoring import LinearSoftmax


def features(cubes: DataFrame, shape: tuple[int, int, int], to: tuple[int, int, int] | None = None, channels: int = 1, block: int = 32) -> DataFrame:
    """idx and features (array) of cubes (idx, dz, dy, dx, v, and channel if there are several), a value for each voxel and
    channel, in the order that scorers see them; resampled if asked for."""
    names = ["idx", *(["channel"] if channels > 1 else []), "dz", "dy", "dx", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for idx, cube in in_blocks(batches, shape, channels, block):
            if to is not None:
                cube = np.stack([[resample_array(c, to) for c in one] for one in cube])
            rows = np.moveaxis(cube, 1, -1).reshape(len(cube), -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(list(rows), pa.list_(pa.float64()))], ["idx", "features"])

    return cubes.where("idx IS NOT NULL").select(*names).repartition("idx").sortWithinPartitions("idx").mapInArrow(run, "idx long, features array<double>")


def fit(cubes: DataFrame, labels: DataFrame, shape: tuple[int, int, int], to: tuple[int, int, int] | None = None, channels: int = 1, test_share: float = 0.1, seed: int = 0, rounds: int = 50, penalty: float = 0.01, placed: DataFrame | None = None) -> LinearSoftmax:
    """A linear softmax scorer, by logistic regression over all cubes whose idx has a type (1, 2, ...) in labels and does not
    fall to the test side of `held_out`. Gradients are sums over partitions, aggregated as a tree; only weights, one for each
    feature and class, reach the driver. With placed (idx, place), cubes are those of places, each a row for every point there."""
    known = labels.where("type IS NOT NULL").select("idx", (F.col("type") - 1).cast("double").alias("label"))
    rows = features(cubes, shape, to, channels)
    if placed is not None:
        known, rows = known.join(placed.select("idx", "place"), "idx"), rows.withColumnRenamed("idx", "place")
    rows = rows.join(known, "idx" if placed is None else "place").where(~held_out(F.col("idx"), test_share, seed))
    table = rows.select(array_to_vector("features").alias("features"), "label")
    model = LogisticRegression(family="multinomial", maxIter=rounds, regParam=penalty, aggregationDepth=3).fit(table)
    return LinearSoftmax(model.coefficientMatrix.toArray().T, model.interceptVector.toArray())
