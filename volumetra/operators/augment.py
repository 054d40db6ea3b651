"""Random changes of cubes for training: flips, and an affine map with trilinear gathering.

What happens to a cube is drawn from hashes of seed, epoch, the cube's idx and the name of the draw, so a lost task draws
the same again, and no state goes from one cube to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volumetra.operators.cubes import dealt, in_blocks, resample_array

Range = float | tuple[float, float]

#: Voxels of small cubes that are changed together.
TOGETHER = 1 << 17


@dataclass(frozen=True, kw_only=True)
class Augmentation:
    """likelihood: of each flip and of the affine map as a whole. Axes are named z, y and x. translate: shares of the size by
    which contents move up the axis; scale: factors by which they grow; rotate: turns around the axis, in radians (around z
    from x to y, around y from z to x, around x from y to z). An interval means a value drawn from it."""

    likelihood: float = 0.1
    flip: tuple[str, ...] = ()
    translate: Mapping[str, Range] = field(default_factory=dict)
    scale: Mapping[str, Range] = field(default_factory=dict)
    rotate: Mapping[str, Range] = field(default_factory=dict)
    seed: int = 0

    def __post_init__(self):
        if bad := {*self.flip, *self.translate, *self.scale, *self.rotate} - set("zyx"):
            raise ValueError(f"unknown axes: {sorted(bad)}")

    def drawn(self, epoch: int, idx: int, name: str) -> float:
        """A number from 0 to 1, 1 excluded."""
        return int(md5(f"{self.seed}-{epoch}-{idx}-{name}".encode()).hexdigest()[:8], 16) / 2**32

    def chosen(self, epoch: int, idx: int) -> tuple[list[str], np.ndarray | None]:
        """The axes that are flipped, and the map from centred target to centred source places (3 x 4; the last column in
        shares of the size), or None."""
        flips = [a for a in self.flip if self.drawn(epoch, idx, f"flip {a}") < self.likelihood]
        if not (self.translate or self.scale or self.rotate) or self.drawn(epoch, idx, "affine") >= self.likelihood:
            return flips, None

        def value(name: str, ranges: Mapping[str, Range], axis: str, default: float) -> float:
            given = ranges.get(axis, default)
            if not isinstance(given, tuple):
                return given
            return given[0] + (given[1] - given[0]) * self.drawn(epoch, idx, f"{name} {axis}")

        back = np.diag([1 / value("scale", self.scale, a, 1.0) for a in "zyx"])
        move = np.array([value("translate", self.translate, a, 0.0) for a in "zyx"])
        turn = np.eye(3)
        for k, axis in enumerate("zyx"):
            angle = value("rotate", self.rotate, axis, 0.0)
            i, j = [(2, 1), (0, 2), (1, 0)][k]  # from the axis i to the axis j
            one = np.eye(3)
            one[i, i] = one[j, j] = np.cos(angle)
            one[j, i], one[i, j] = np.sin(angle), -np.sin(angle)
            turn = one @ turn
        return flips, np.column_stack([turn.T @ back, -turn.T @ move])


def gathered(cube: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Values of the cube (or of each of several, along axes before its own) at places (3, ...) between its voxels; outside, its
    border goes on."""
    top = np.array(cube.shape[-3:]).reshape(3, *[1] * (source.ndim - 1)) - 1
    at = np.clip(source, 0, top)
    low = np.floor(at).astype(int)
    part, high, out = at - low, np.minimum(low + 1, top), np.zeros((*cube.shape[:-3], *source.shape[1:]))
    for corner in product((0, 1), repeat=3):
        weight = np.prod([part[k] if c else 1 - part[k] for k, c in enumerate(corner)], axis=0)
        out += weight * cube[(..., *((high if c else low)[k] for k, c in enumerate(corner)))]
    return out


def affine(cube: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The cube (or each of several of equal sizes, along axes before their own) seen through the map, around its centre. A cube
    of unequal sizes is made a true cube first, and put back."""
    shape, n = cube.shape[-3:], max(cube.shape[-3:])
    whole = resample_array(cube, (n, n, n)) if min(shape) < n else cube
    target = np.indices(whole.shape[-3:]) - (n - 1) / 2
    source = np.einsum("ij,j...->i...", matrix[:, :3], target) + (n * matrix[:, 3] + (n - 1) / 2).reshape(3, 1, 1, 1)
    out = gathered(whole, source)
    return resample_array(out, shape) if min(shape) < n else out


def augment_array(cube: np.ndarray, how: Augmentation, epoch: int, idx: int) -> np.ndarray:
    """One channel of one cube; all channels of an idx are changed alike."""
    flips, matrix = how.chosen(epoch, idx)
    if matrix is not None:
        cube = affine(cube, matrix)
    return np.flip(cube, ["zyx".index(a) for a in flips]) if flips else cube


def augment_block(idx: np.ndarray, cube: np.ndarray, how: Augmentation, epoch: int) -> np.ndarray:
    """Cubes (n, channels, z, y, x) changed as `augment_array` changes each; those with the same changes go together."""
    out, alike = cube.astype(np.float64), {}
    for k, i in enumerate(idx.tolist()):
        flips, matrix = how.chosen(epoch, i)
        alike.setdefault((tuple(flips), matrix if matrix is None else matrix.tobytes()), []).append(k)
    for (flips, matrix), at in alike.items():
        some = out[at]
        if matrix is not None:
            m = np.frombuffer(matrix).reshape(3, 4)
            some = affine(some, m) if len(set(cube.shape[2:])) == 1 else np.stack([[affine(c, m) for c in one] for one in some])
        out[at] = np.flip(some, ["zyx".index(a) - 3 for a in flips]) if flips else some
    return out


def packed_block(shape: tuple[int, int, int], channels: int, block: int) -> int:
    """Cubes changed together: `block`, or more if they are small, so that a few array steps serve many of them."""
    return max(block, TOGETHER // (channels * int(np.prod(shape))))


def augmented(cubes: DataFrame, shape: tuple[int, int, int], how: Augmentation, epoch: int = 0, channels: int = 1, block: int = 32, placed: DataFrame | None = None) -> DataFrame:
    """cubes (idx, dz, dy, dx, v, and channel from 0 if there are several) as a training epoch sees them, dense. Voxels
    without a row are 0; rows without an idx belong to no cube. With placed (idx, place), cubes are those of places, and
    each point's copy of its place's cube, which goes to it as one array, is changed in its own way."""
    keys = ["idx", *(["channel"] if channels > 1 else []), "dz", "dy", "dx"]
    schema = ", ".join(f"{k} long" for k in keys) + ", v double"

    def changed(idx: np.ndarray, cube: np.ndarray) -> pa.RecordBatch:
        out = augment_block(idx, cube, how, epoch)
        place = np.indices(out.shape[1:])
        columns = [np.repeat(idx, out[0].size), *(np.tile(p.ravel(), len(idx)) for p in (place if channels > 1 else place[1:])), out.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*keys, "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for idx, cube in in_blocks(batches, shape, channels, block):
            yield changed(idx, cube)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for idx, cube in in_blocks(batches, shape, channels, block):
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(list(cube.reshape(len(cube), -1)), pa.list_(pa.float32()))], ["place", "cube"])

    def run_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = packed_block(shape, channels, block)
        for b in batches:
            for k in range(0, b.num_rows, many):
                part = b.slice(k, many)
                yield changed(part["idx"].to_numpy(), part["cube"].flatten().to_numpy().reshape(-1, channels, *shape))

    rows = cubes.where("idx IS NOT NULL").select(*keys, "v").repartition("idx").sortWithinPartitions("idx")
    if placed is None:
        return rows.mapInArrow(run, schema)
    packed = rows.mapInArrow(pack, "place long, cube array<float>")
    return dealt(placed.where("idx IS NOT NULL").select("idx", "place")).join(packed, "place").select("idx", "cube").mapInArrow(run_packed, schema)
