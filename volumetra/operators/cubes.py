"""Cubes around points: bounds, extraction, normalisation and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators.components import written
from volumetra.settings import check_rank

#: Cells of cubes up to which these are broadcast to the voxels, about 100 bytes each; beyond, both sides are shuffled.
FEW_CELLS = 200_000
#: Points of one place that go to one task; a place of more counts as several.
CROWD = 100_000


def data_voxels(n: int, network_um: float, data_um: float) -> int:
    return int(round(n * network_um / data_um))


def cube_start(at: Column, n: int, axis: str) -> Column:
    """x and y: half to even; z: towards 0."""
    if axis in ("x", "y"):
        return F.bround(at - n / 2).cast("long")
    if axis == "z":
        return (at - n // 2).cast("long")
    raise ValueError(f"unknown axis {axis}")


def bounds(points: DataFrame, cube: dict[str, int]) -> DataFrame:
    """points with start and end (excluded) of the cube on each axis."""
    out = points
    for a, n in cube.items():
        out = out.withColumn(f"{a}0", cube_start(F.col(a), n, a)).withColumn(f"{a}1", F.col(f"{a}0") + n)
    return out


def centre_inside(box: dict[str, tuple[Column, Column]]) -> Column:
    """Whether a point counts as inside: false only if it lies beyond the box on every axis."""
    beyond = [(F.col(a) < lo) | (F.col(a) >= hi) for a, (lo, hi) in box.items()]
    out = beyond[0]
    for b in beyond[1:]:
        out = out & b
    return ~out


def promoted(voxel_sizes: tuple[float, ...], network_sizes: tuple[float, ...]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Voxel sizes (z, y, x) of a single plane's data and network: z is 1 where it was left out, and the network's z is the
    data's, so that a cube of one plane is never rescaled in z."""
    for given in (voxel_sizes, network_sizes):
        check_rank(len(given))
    data, network = ((1.0, *s) if len(s) == 2 else tuple(s) for s in (voxel_sizes, network_sizes))
    return data, (data[0], *network[1:])


def full_only(bounded: DataFrame, shape: dict[str, int]) -> DataFrame:
    keep = None
    for a, n in shape.items():
        c = (F.col(f"{a}0") >= 0) & (F.col(f"{a}1") <= n)
        keep = c if keep is None else keep & c
    return bounded.where(keep)


def shared(bounded: DataFrame, shape: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Cubes that start at the same voxel are the same, however many points have them. bounded, whose cubes lie inside the
    volume, with a column place, the raster index of that voxel; and the places, each once, as points (idx: the place). A place
    of more than CROWD points is several, a volume's size apart, and its points are dealt to them by idx."""
    at = [f"{a}{k}" for a in "zyx" for k in (0, 1)]
    placed = bounded.withColumn("place", (F.col("z0") * shape[1] + F.col("y0")) * shape[2] + F.col("x0"))
    counts = written(placed.groupBy("place", *at).agg(F.ceil(F.count("*") / CROWD).alias("_deals")))
    crowds = counts.where("_deals > 1").select("place", "_deals")
    own = F.col("place") + F.coalesce(F.pmod(F.xxhash64("idx"), F.col("_deals")), F.lit(0)) * math.prod(shape)
    each = counts.select("place", *at, F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"))
    return placed.join(F.broadcast(crowds), "place", "left").withColumn("place", own).drop("_deals"), each.select((F.col("place") + F.col("_deal") * math.prod(shape)).alias("idx"), *at)


def dealt(placed: DataFrame) -> DataFrame:
    """placed by place, in as many tasks as shuffles have: the few bytes of a point become a cube, so that tasks sized by bytes
    would be few and long."""
    return placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place")


def spread(rows: DataFrame, placed: DataFrame, *keep: str) -> DataFrame:
    """rows (idx: a place) for each point of placed (idx, place), with its columns `keep`. The rows of a place travel as one
    list and are dealt out after the join, so nothing is shuffled for each voxel of each point."""
    lists = rows.groupBy(F.col("idx").alias("place")).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "idx"))).alias("_rows"))
    return dealt(placed.select("idx", "place", *keep)).join(lists, "place").select("idx", *keep, F.inline("_rows"))


def extract(bounded: DataFrame, voxels: DataFrame, tile: int = 64) -> DataFrame:
    """idx, dz, dy, dx and v: a range join, made one on keys. Each cube goes to the (plane, tile, tile) cells that it
    meets, and voxels to their own, so work follows the cubes and no plane is gathered. A column channel of voxels is kept."""
    channel = ["channel"] if "channel" in voxels.columns else []
    cells = bounded.select("idx", *(c for a in "zyx" for c in (f"{a}0", f"{a}1")), F.explode(F.sequence("z0", F.col("z1") - 1)).alias("z"))
    for a in "yx":
        cells = cells.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor((F.col(f"{a}1") - 1) / tile))))
    keyed = voxels.withColumn("cy", F.floor(F.col("y") / tile)).withColumn("cx", F.floor(F.col("x") / tile))
    near = keyed.join(F.broadcast(cells) if cells.count() <= FEW_CELLS else cells, ["z", "cy", "cx"])
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return near.where(inside).select("idx", *channel, *((F.col(a) - F.col(f"{a}0")).alias(f"d{a}") for a in "zyx"), "v")


def normalised(cubes: DataFrame, mean: float, std: float) -> DataFrame:
    return cubes.withColumn("v", (F.col("v") - mean) / std)


def normalised_by(cubes: DataFrame, norms: DataFrame, *by: str) -> DataFrame:
    """cubes with v normalised by the mean and std that norms has for their `by` columns, say file and channel."""
    return by_own_norms(with_norms(cubes, norms, *by))


def with_norms(rows: DataFrame, norms: DataFrame, *by: str) -> DataFrame:
    """rows (voxels, or points whose cubes come later) with _mean and _std."""
    return rows.join(norms.select(*by, F.col("mean").alias("_mean"), F.col("std").alias("_std")), list(by))


def by_own_norms(cubes: DataFrame) -> DataFrame:
    return cubes.withColumn("v", (F.col("v") - F.col("_mean")) / F.col("_std")).drop("_mean", "_std")


def _shares(n: int, m: int) -> Column:
    """For each source index, the target indices it counts for and its weights; pixel centres lie at half steps."""
    own: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for t in range(m):
        s = min(max((t + 0.5) * (n / m) - 0.5, 0.0), n - 1.0)
        low = int(s)
        for i, w in ((low, 1 - (s - low)), (min(low + 1, n - 1), s - low)):
            if w:
                own[i].append((t, w))
    pair = lambda t, w: F.struct(F.lit(t).cast("long").alias("t"), F.lit(w).alias("w"))
    return F.array(*(F.array(*(pair(t, w) for t, w in x)) if x else F.filter(F.array(pair(0, 0.0)), lambda _: F.lit(False)) for x in own))


def resample(cubes: DataFrame, shape: tuple[int, int, int], to: tuple[int, int, int]) -> DataFrame:
    """Trilinear: each voxel sends its weighted value to the targets near it, one axis after another; sums are combined
    before they are shuffled, and there is no join."""
    rows, keys = cubes, ["idx", "dz", "dy", "dx"]
    for a, n, m in zip("zyx", shape, to):
        sent = rows.select(*keys, "v", F.explode(F.get(_shares(n, m), F.col(f"d{a}").cast("int"))).alias("k"))
        sent = sent.select(*(F.col("k.t").alias(f"t{a}") if c == f"d{a}" else F.col(c) for c in keys), (F.col("v") * F.col("k.w")).alias("v"))
        keys = [f"t{a}" if c == f"d{a}" else c for c in keys]
        rows = sent.groupBy(*keys).agg(F.sum("v").alias("v"))
    return rows


def resample_array(cube: np.ndarray, to: tuple[int, int, int]) -> np.ndarray:
    """The same on one array, axis by axis."""
    for axis, m in enumerate(to):
        n = cube.shape[axis]
        s = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
        low = np.floor(s).astype(int)
        part = (s - low).reshape([-1 if k == axis else 1 for k in range(3)])
        cube = np.take(cube, low, axis) * (1 - part) + np.take(cube, np.minimum(low + 1, n - 1), axis) * part
    return cube


def flip(cubes: DataFrame, axis: str, size: int) -> DataFrame:
    return cubes.withColumn(f"d{axis}", size - 1 - F.col(f"d{axis}"))


def in_blocks(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int], channels: int = 1, block: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """idx and dense cubes (n, channels, z, y, x) out of rows in order of idx, whole cubes only, across batches; `block` cubes
    are held at a time. Voxels without a row are 0."""
    names = ["idx", *(["channel"] if channels > 1 else []), "dz", "dy", "dx", "v"]

    def dense(idx: np.ndarray, *rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
        ends = np.r_[first[1:], len(idx)]
        for k in range(0, len(first), block):
            part, n = slice(first[k], ends[min(k + block, len(ends)) - 1]), min(block, len(first) - k)
            cube = np.zeros((n, channels, *shape), np.float32)
            place = np.repeat(np.arange(n), (ends - first)[k : k + n])
            cube[(place, rest[0][part] if channels > 1 else 0, *(i[part] for i in rest[-4:-1]))] = rest[-1][part]
            yield idx[first[k : k + n]], cube

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = [b[c].to_numpy(zero_copy_only=False) for c in names]
        last = np.searchsorted(new[0], new[0][-1])  # rows from here on may go on in the next batch
        if last or (held and held[-1][0][-1] != new[0][0]):
            whole = [np.concatenate(c) for c in zip(*held, [c[:last] for c in new])]
            if len(whole[0]):
                yield from dense(*whole)
            held = []
        held.append([c[last:] for c in new])
    if held:
        yield from dense(*(np.concatenate(c) for c in zip(*held)))
