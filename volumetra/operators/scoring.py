"""Scoring cubes with a pluggable model, and joining the label back to its point."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators.cubes import in_blocks, resample_array
from volumetra.operators.structures import ARTIFACT, CELL, NO_CELL


class Scorer(Protocol):
    """Loaded once per task; scores a batch (n, z, y, x, channels) as class probabilities (n, classes)."""

    def load(self): ...

    def score(self, batch: np.ndarray) -> np.ndarray: ...


class LinearSoftmax:
    """A small model to run the plumbing with: softmax of x @ weights + bias."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def load(self):
        return self

    def score(self, batch: np.ndarray) -> np.ndarray:
        e = batch.reshape(len(batch), -1) @ self.weights + self.bias
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def predictions(cubes: DataFrame, shape: tuple[int, int, int], scorer: Scorer, to: tuple[int, int, int] | None = None, channels: int = 1, block: int = 32) -> DataFrame:
    """idx and p of cubes (idx, dz, dy, dx, v, and channel from 0 if there are several), resampled if asked for. Cubes stream
    through a task in order of idx, across Arrow batches; it holds `block` of them at a time. Voxels without a row are 0;
    rows without an idx belong to no cube."""
    names = ["idx", *(["channel"] if channels > 1 else []), "dz", "dy", "dx", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer.load()
        for idx, cube in in_blocks(batches, shape, channels, block):
            if to is not None:
                cube = np.stack([[resample_array(c, to) for c in one] for one in cube]).astype(np.float32)
            p = model.score(np.moveaxis(cube, 1, -1))
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(list(p.astype(np.float64)), pa.list_(pa.float64()))], ["idx", "p"])

    parts = int(cubes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a model may cost much for a few bytes of cube
    return cubes.where("idx IS NOT NULL").select(*names).repartition(parts, "idx").sortWithinPartitions("idx").mapInArrow(run, "idx long, p array<double>")


def predicted_type(p: Column) -> Column:
    """Index of the first largest, from 1."""
    return F.array_position(p, F.array_max(p)).cast("int")


def join_back(points: DataFrame, scores: DataFrame) -> DataFrame:
    """points that were scored, with their new type, by idx."""
    return points.drop("type").join(scores.select("idx", predicted_type(F.col("p")).alias("type")), "idx")


def one_hot(kind: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda k: (k == kind).cast("int"))


#: Names of types 1 and 2.
NAMES = ("no_cell", "cell")


def target(kind: Column, mode: str | None) -> Column:
    """What a model is trained towards: one-hot (None), "index" from 0, or "label"."""
    if mode is None:
        return one_hot(kind, len(NAMES))
    if mode == "index":
        return kind - 1
    if mode == "label":
        return F.element_at(F.array(*(F.lit(n) for n in NAMES)), kind)
    raise ValueError(f"unknown target {mode!r}")


def labelled_type(label: Column) -> Column:
    """Type of a cube by its label; without one it is an artifact."""
    return F.when(label == NAMES[1], CELL).when(label == NAMES[0], NO_CELL).otherwise(ARTIFACT)
