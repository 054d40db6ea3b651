"""Operators on points and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators.components import written


def natural_key(name: Column, width: int = 12) -> Column:
    """Sorts as the text with its numbers compared as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def channel_path(path: Column, channel: Column) -> Column:
    """The same file of another channel, for one-digit channels."""
    return F.concat(F.substr(path, F.lit(1), F.length(path) - 5), channel.cast("string"), F.lit(".tif"))


def duplicates(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).count().where("count > 1").select(*by)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def all_equal(value: str) -> Column:
    """Aggregate: at most one value; true over no rows."""
    return F.min(value).eqNullSafe(F.max(value))


def matched(points: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """Points with a truth point within `tolerance` on every axis, each once. Both sides meet in cells of that size, so the join
    is on keys; equal rows go beforehand, so a point meets no more truth points than its cells have places."""
    size = tolerance + 1
    cells = [F.explode(F.sequence(F.floor((F.col(a) - tolerance) / size), F.floor((F.col(a) + tolerance) / size))) for a in "xyz"]
    near = points.distinct()
    for a, c in zip("xyz", cells):
        near = near.withColumn(f"c{a}", c)
    far = truth.select(*(F.col(a).alias(f"t{a}") for a in "xyz"), *(F.floor(F.col(a) / size).alias(f"c{a}") for a in "xyz")).distinct()
    close = [F.abs(F.col(a) - F.col(f"t{a}")) <= tolerance for a in "xyz"]
    return near.join(far, ["cx", "cy", "cz"]).where(close[0] & close[1] & close[2]).select(*points.columns).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def held_out(key: Column, share: float, seed: int) -> Column:
    """Whether a row goes to the test side of a random split: the same for a key whenever it is asked."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return drawn < share * 2**32


def random_sign(key: Column, seed: int) -> Column:
    """1 or -1, each for half of the keys, the same for a key whenever it is asked."""
    return F.when(held_out(key, 0.5, seed), 1).otherwise(-1)


def batches(points: DataFrame, axis: str, size: int, seed: int | None = None) -> DataFrame:
    """Points in order of axis, then idx (with a seed, shuffled within equal values, another way for each seed, say the
    epoch), in batches of `size`. Points are range-sorted and written; a point's place is its place in its range plus the
    rows of the ranges before, so that equal axis values may fill any number of tasks (planes promoted to z = 0 do)."""
    drawn = [] if seed is None else [F.md5(F.concat(F.lit(f"{seed}-"), F.col("idx").cast("string")).cast("binary"))]
    order = [F.col(axis), *drawn, F.col("idx")]
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order)
    # Rows of a partition are numbered one by one from a multiple of 2 ** 33.
    rows = written(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").count().collect()  # one number a task
    base, bases = 0, []
    for r in sorted(counts, key=lambda r: r["_range"]):
        bases.append((r["_range"], base))
        base += r["count"]
    known = points.sparkSession.createDataFrame(bases, "_range long, _base long")
    placed = rows.join(F.broadcast(known), "_range").withColumn("position", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.withColumn("batch", F.floor(F.col("position") / size)).drop("_at", "_range", "_base")


def batch_count(points: int, size: int) -> int:
    """Batches of `size` that points fill, the last one in part."""
    return -(-points // size)


def common(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Rows that stand in both, once each, sorted."""
    return a.intersect(b).orderBy(*(by or a.columns))


def axis_order(given: str, wanted: str) -> list[int]:
    """Where the wanted axes stand among the given ones, say of "zyx" among "xyz"."""
    if sorted(given) != sorted(wanted) or len(set(given)) != len(given):
        raise ValueError(f"{wanted!r} is no order of {given!r}")
    return [given.index(a) for a in wanted]


def as_layer(points: DataFrame, kind: int | None = None, given: str = "xyz", wanted: str = "zyx") -> DataFrame:
    """Positions of the points of a type as columns a0, a1, a2 in the order of a viewer's axes; points of no such type give
    an empty table of three columns."""
    rows = points if kind is None else points.where(F.col("type") == kind)
    return rows.select(*(F.col(given[k]).alias(f"a{n}") for n, k in enumerate(axis_order(given, wanted))))


def from_layer(layer: DataFrame, kind: int, given: str = "xyz", wanted: str = "zyx") -> DataFrame:
    """The way back: points of one type."""
    return layer.select(*(F.col(f"a{wanted.index(a)}").alias(a) for a in given), F.lit(kind).alias("type"))


def appended(layer: DataFrame, selected: DataFrame) -> DataFrame:
    """A layer's rows and those selected from another one behind them."""
    return layer.unionByName(selected)


def near_planes(current: int, planes: int, wanted: int) -> tuple[int, int]:
    """First plane and end of a window of `wanted` planes around the current one, cut to the volume."""
    start = int(current - wanted // 2)
    return max(0, start), min(planes, start + wanted)
