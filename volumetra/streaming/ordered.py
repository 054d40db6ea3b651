"""Operators whose answer for a plane rests on the planes before it, on planes that arrive in any order.

A micro-batch holds voxels and, for each plane that is complete, a row without y and x. What cannot be used yet, because a
plane before it is missing, waits in a table; the rest goes to a step in order of z, with the tables that the step left
last time. All of this is written to the shared folder under the micro-batch's number and nothing is kept elsewhere, so a
micro-batch that is run again finds the same state and writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.operators import ball, components, feedback, structures
from volumetra.operators.ball import valid

ARRIVED = "z long, y long, x long"

#: From (rows of planes begin..end, begin, end, tables left before) to tables: those named in `state` come back next time.
Step = Callable[[DataFrame, int, int, dict[str, DataFrame]], dict[str, DataFrame]]


class Ordered:
    """For foreachBatch: gives `step` all planes that are complete up to a whole number of `group` planes (or to the last of
    `planes`), each once. Planes that come again are left out."""

    def __init__(self, folder: str, planes: int, step: Step, state: dict[str, str], out: dict[str, str], group: int = 1):
        self.folder, self.planes, self.step, self.state, self.out, self.group = folder.rstrip("/"), planes, step, state, out, group
        self.on_plane: Callable[[int], None] | None = None  # called on the driver for each plane, once its step is written

    def _at(self, batch: int, name: str) -> str:
        return f"{self.folder}/state/{batch}/{name}"

    def __call__(self, arrived: DataFrame, batch: int) -> None:
        with components.scratch(arrived.sparkSession):  # a stream may run for long: nothing is left behind but state and outputs
            self._take(arrived, batch)

    def _take(self, arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        kept = {**self.state, "waiting": ARRIVED}
        if batch:
            before = {n: spark.read.schema(s).parquet(self._at(batch - 1, n)) for n, s in kept.items()}
            begin = spark.read.schema("next long").parquet(self._at(batch - 1, "next")).first()[0]
        else:
            before, begin = {n: spark.createDataFrame([], s) for n, s in kept.items()}, 0
        rows = arrived.select("z", "y", "x").where(F.col("z") >= begin).unionByName(before.pop("waiting"))
        rows.write.mode("overwrite").parquet(self._at(batch, "rows"))
        rows = spark.read.schema(ARRIVED).parquet(self._at(batch, "rows"))
        whole, end = {r.z for r in rows.where("y IS NULL").select("z").distinct().collect()}, begin  # a few plane numbers
        while end in whole:
            end += 1
        end = end if end >= self.planes else begin + (end - begin) // self.group * self.group
        tables = before
        if end > begin:
            tables = self.step(rows.where((F.col("z") < end) & F.col("y").isNotNull()).distinct(), begin, end, before)
        for name in self.out:
            if name in tables and end > begin:
                tables[name].write.mode("overwrite").parquet(f"{self.folder}/out/{name}/batch={batch}")
        for name in self.state:
            tables[name].write.mode("overwrite").parquet(self._at(batch, name))
        rows.where(F.col("z") >= end).write.mode("overwrite").parquet(self._at(batch, "waiting"))
        spark.createDataFrame([(end,)], "next long").coalesce(1).write.mode("overwrite").parquet(self._at(batch, "next"))
        if self.on_plane:
            for z in range(begin, end):
                self.on_plane(z)
        if batch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/{batch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def run(self, stream: DataFrame, **trigger) -> None:
        """Feed the stream through until its source has no more (or as `trigger` says)."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/log").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()

    def result(self, spark: SparkSession, name: str) -> DataFrame:
        """All rows of an output so far."""
        schema = self.out[name]
        rows = spark.read.option("recursiveFileLookup", "true").schema(schema)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/out/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return rows.parquet(f"{self.folder}/out/{name}") if there else spark.createDataFrame([], schema)


def feedback_marks(folder: str, shape: tuple[int, int, int], xy: int, z: int, fraction: Fraction, tiles: DataFrame | None = None, tile: int = 0, batch: int = 1, size: int = feedback.TILE) -> Ordered:
    """As `feedback.marks`, on a stream; its output is `marks`. State is what was bright or marked in the last planes that
    the ball still reaches."""
    valid(shape, ball.ball_kernel(xy, z))

    def step(rows: DataFrame, begin: int, end: int, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        found = components.written(feedback.folded(rows.unionByName(state["carried"]), shape, xy, z, fraction, begin, end, batch, tiles, tile, size))
        of = lambda kind: found.where(F.col("kind") == kind).select("z", "y", "x")
        return {"marks": of(feedback.MARKED), "carried": of(feedback.CARRIED)}

    return Ordered(folder, shape[0], step, {"carried": ARRIVED}, {"marks": ARRIVED}, batch)


OPEN = "sid long, x long, y long, z long, volume long"


def labelled_structures(folder: str, shape: tuple[int, int, int], slab: int = 16, tile: int = components.TILE) -> Ordered:
    """Connected components of a stream of foreground voxels. Outputs: `voxels` (z, y, x and the label known by then),
    `aliases` (labels that later proved to be part of another structure) and `structures` (sid, centre and volume, let out
    as soon as no voxel of the last plane is theirs). State: the labels of the last plane's voxels, and sums of the
    structures that these still hold open; both are bounded by one plane. `whole` puts voxels and aliases together."""
    _, h, w = shape

    def step(rows: DataFrame, begin: int, end: int, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        local = components.written(components.connected_components(rows, shape, slab, tile))
        edge = state["frontier"].select("y", "x", F.col("sid").alias("v"))
        touching = local.where(F.col("z") == begin).join(edge, ["y", "x"]).select(F.col("sid").alias("u"), "v").distinct()
        roots = components.merge_labels(touching).withColumnRenamed("label", "sid")
        renamed = lambda t: t.join(roots, "sid", "left").withColumn("sid", F.coalesce("root", "sid")).drop("root")
        voxels = components.written(renamed(local).select("z", "y", "x", "sid"))
        sums = [F.sum(c).alias(c) for c in ("x", "y", "z", "volume")]
        every = renamed(state["open"]).select("sid", "x", "y", "z", "volume").unionByName(voxels.select("sid", "x", "y", "z", F.lit(1).cast("long").alias("volume")))
        totals = components.written(every.groupBy("sid").agg(*sums))
        frontier = voxels.where(F.col("z") == end - 1).select("y", "x", "sid")
        held = frontier.select("sid").distinct() if end < shape[0] else frontier.select("sid").where("false")
        closed = totals.join(held, "sid", "left_anti").select("sid", *(structures.even_round(F.col(a), F.col("volume")).alias(a) for a in "xyz"), "volume")
        aliases = state["open"].select("sid").join(roots, "sid").where("sid != root").select("sid", "root")
        return {"voxels": voxels, "aliases": aliases, "structures": closed, "frontier": frontier, "open": totals.join(held, "sid", "left_semi")}

    return Ordered(folder, shape[0], step, {"frontier": "y long, x long, sid long", "open": OPEN}, {"voxels": "z long, y long, x long, sid long", "aliases": "sid long, root long", "structures": OPEN})


def whole(found: Ordered, spark: SparkSession) -> DataFrame:
    """z, y, x and sid of all voxels that labelled_structures() has seen, by what it knows now: aliases are chased to their end."""
    known = components.merge_labels(found.result(spark, "aliases").select(F.col("sid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("label", "sid")
    return found.result(spark, "voxels").join(known, "sid", "left").select("z", "y", "x", F.coalesce("root", "sid").alias("sid"))
