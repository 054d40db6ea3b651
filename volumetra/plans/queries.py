"""Registered queries on volumes derived from the driver's tables, each with an independent SQL form where there is one."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.functions.dtypes import clip, convert, detection_code
from volumetra.operators import augment, ball, components, cubes, feedback, planes, points, resnet, scoring, structures, training
from volumetra.plans.detection import channel_places, classify, classify_places, detect
from volumetra.plans.detection import classify_plane as plane_plan
from volumetra.settings import DetectionSettings
from volumetra.sources import stacks
from volumetra.sources.volumes import dense
from volumetra.streaming import ordered
from volumetra.streaming import planes as streaming

#: Planes of the volumes, edge of their planes for small tables, and rows of lineitem for each such square.
PLANES, EDGE, ROWS = 7, 64, 60_000
K, K_SPOT, RATIO = 1.0, 1.5, Fraction(3, 5)

E = "(SELECT e FROM dim)"
DIM = f"dim AS MATERIALIZED (SELECT {EDGE} * GREATEST(1, CAST(FLOOR(SQRT(COUNT(*) / {ROWS}.0)) AS BIGINT)) AS e FROM lineitem)"
ACROSS = f"(SELECT unnest(range({E})) AS range)"
VOXELS = f"""vox AS MATERIALIZED (SELECT g.z, g.y, g.x, COALESCE(h.v, 0) AS v
  FROM (SELECT a.range AS z, b.range AS y, c.range AS x FROM range(7) a, {ACROSS} b, {ACROSS} c) g
  LEFT JOIN (SELECT CAST(l_linenumber - 1 AS BIGINT) AS z, l_orderkey % {E} AS y, l_partkey % {E} AS x, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3) h
  ON g.z = h.z AND g.y = h.y AND g.x = h.x)"""
VOX = f"{DIM}, {VOXELS}"
SPOT = VOX + f", spot AS MATERIALIZED (SELECT z, y, x, CAST(v * (GREATEST(0, 24 - ABS(y * 64 // {E} - 36)) * GREATEST(0, 24 - ABS(x * 64 // {E} - 36))) // 64 AS BIGINT) AS v FROM vox)"


def bright_sql(table: str, k: float, name: str) -> str:
    return f"{name} AS (SELECT v.z, v.y, v.x, v.v FROM {table} v JOIN (SELECT z, AVG(v) AS m, STDDEV_SAMP(v) AS s FROM {table} GROUP BY z) t ON v.z = t.z WHERE v.v > t.m + {k} * t.s)"


def components_sql(table: str) -> str:
    """Needs WITH RECURSIVE; gives comp(z, y, x, sid)."""
    return f"""vid AS MATERIALIZED (SELECT z * e * e + y * e + x AS id, z, y, x, e FROM {table}, dim),
  adj AS MATERIALIZED (SELECT a.id AS u, b.id AS w FROM vid a JOIN (SELECT *, unnest([1, -1, e, -e, e * e, -e * e]) AS step FROM vid) b ON a.id = b.id + b.step AND ABS(a.z - b.z) + ABS(a.y - b.y) + ABS(a.x - b.x) = 1),
  reach(id, r) AS (SELECT id, id FROM vid UNION SELECT adj.w, reach.r FROM reach JOIN adj ON reach.id = adj.u WHERE reach.r < adj.w),
  comp AS (SELECT vid.z, vid.y, vid.x, t.sid FROM vid JOIN (SELECT id, MIN(r) AS sid FROM reach GROUP BY id) t ON vid.id = t.id)"""


KERNEL = """fine AS (SELECT a.range AS z, b.range AS y, c.range AS x FROM range(21) a, range(21) b, range(21) c),
  kernel AS (SELECT z // 7 AS kz, y // 7 AS ky, x // 7 AS kx, COUNT(*) FILTER (WHERE (z-10)*(z-10) + (y-10)*(y-10) + (x-10)*(x-10) <= 10.5*10.5) AS w FROM fine GROUP BY 1, 2, 3)"""
OVERLAP = SPOT + ", " + bright_sql("spot", K_SPOT, "bright") + ", " + KERNEL + f""",
  overlap AS (SELECT b.z - kz + 1 AS z, b.y - ky + 1 AS y, b.x - kx + 1 AS x, CAST(SUM(w) AS BIGINT) AS overlap FROM bright b, kernel WHERE w > 0 GROUP BY 1, 2, 3
              HAVING b.z - kz + 1 BETWEEN 1 AND 5 AND b.y - ky + 1 BETWEEN 1 AND {E} - 2 AND b.x - kx + 1 BETWEEN 1 AND {E} - 2)"""
TILES = "tile AS (SELECT t.z, t.ty, t.tx, t.a >= c.m + 2 * c.s + 1 AS inside FROM (SELECT z, y // 8 AS ty, x // 8 AS tx, AVG(v) AS a FROM spot GROUP BY 1, 2, 3) t JOIN (SELECT z, AVG(v) AS m, STDDEV_POP(v) AS s FROM spot WHERE y < 8 AND x < 8 GROUP BY z) c ON t.z = c.z)"
MARKS = OVERLAP + ", " + TILES + ", marks AS (SELECT o.z, o.y, o.x FROM overlap o JOIN tile ON tile.z = o.z AND tile.ty = o.y // 8 AND tile.tx = o.x // 8 AND inside WHERE 5 * overlap > 3 * (SELECT SUM(w) FROM kernel))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """Of the volumes below: their planes grow with the table that they come from."""
    edge = EDGE * max(1, math.isqrt(read(spark, sf_dir, "lineitem").count() // ROWS))
    return PLANES, edge, edge


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = shape(spark, sf_dir)
    e = whole[1]
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("z"), (F.col("l_orderkey") % e).alias("y"), (F.col("l_partkey") % e).alias("x"), F.col("l_quantity").alias("v"))
    return dense(rows, whole)


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shape(spark, sf_dir)[1]
    near = [F.greatest(F.lit(0), 24 - F.abs(F.floor(F.col(a) * 64 / e) - 36)) for a in "yx"]
    weight = near[0] * near[1]
    return vox(spark, sf_dir).withColumn("v", F.floor(F.col("v") * weight / 64))


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.global_threshold(vox(spark, sf_dir), K).select("z", "y", "x")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(foreground(spark, sf_dir), shape(spark, sf_dir), slab=2, tile=32)


def spot_bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.global_threshold(spot(spark, sf_dir), K_SPOT).select("z", "y", "x")


def spot_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = planes.bright_tiles(spot(spark, sf_dir), shape(spark, sf_dir)[1:], 8)
    return ball.marks(spot_bright(spark, sf_dir), shape(spark, sf_dir), 3, 3, RATIO, tiles, 8)


def spot_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(spot_marks(spark, sf_dir), shape(spark, sf_dir), slab=2, tile=32)


def some_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("o_orderkey"), shape(spark, sf_dir)[1]
    return read(spark, sf_dir, "orders").select(k.alias("idx"), (k * 7 % e).cast("double").alias("x"), (k * 13 % e).cast("double").alias("y"), (F.col("o_custkey") % 7).cast("double").alias("z"), (k % 2 + 1).cast("int").alias("type"))


POINTS = f"{DIM}, pts AS (SELECT o_orderkey AS idx, CAST(o_orderkey * 7 % {E} AS DOUBLE) AS x, CAST(o_orderkey * 13 % {E} AS DOUBLE) AS y, CAST(o_custkey % 7 AS DOUBLE) AS z, CAST(o_orderkey % 2 + 1 AS INT) AS type FROM orders)"
BOUNDS = POINTS + ", b AS (SELECT *, CAST(ROUND_EVEN(x - 2.5, 0) AS BIGINT) AS x0, CAST(ROUND_EVEN(y - 2.5, 0) AS BIGINT) AS y0, CAST(TRUNC(z - 1) AS BIGINT) AS z0 FROM pts), bb AS (SELECT *, x0 + 5 AS x1, y0 + 5 AS y1, z0 + 3 AS z1 FROM b)"
FULL = BOUNDS + f", full_ AS (SELECT * FROM bb WHERE x0 >= 0 AND x1 <= {E} AND y0 >= 0 AND y1 <= {E} AND z0 >= 0 AND z1 <= 7)"
CUBE = dict(z=3, y=5, x=5)


def whole(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return dict(zip("zyx", shape(spark, sf_dir)))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {VOX} SELECT z, MIN(v) AS v_min, MAX(v) AS v_max, ROUND(AVG(v), 6) AS v_mean, ROUND(STDDEV_SAMP(v), 6) AS v_std FROM vox GROUP BY z")
def plane_stats(spark, sf):
    s = planes.plane_stats(vox(spark, sf))
    return s.select("z", "v_min", "v_max", F.round("v_mean", 6).alias("v_mean"), F.round("v_std", 6).alias("v_std"))


@query(f"WITH {VOX} SELECT v.z, y, x, ROUND((h - v) / (CASE WHEN h = l THEN 1.0 ELSE CAST(h - l AS DOUBLE) END) * 65533, 4) AS v FROM vox v JOIN (SELECT z, MAX(v) AS h, MIN(v) AS l FROM vox GROUP BY z) t ON v.z = t.z")
def plane_minmax_normalize(spark, sf):
    return planes.normalise(vox(spark, sf), 65533).withColumn("v", F.round("v", 4))


@query(f"WITH {VOX} SELECT z, y, x, CAST(GREATEST(0, LEAST(v - 20, 60)) AS DOUBLE) AS v FROM vox")
def clip_values(spark, sf):
    return vox(spark, sf).withColumn("v", clip(F.col("v") - 20, 60))


@query(f"WITH {VOX} SELECT z, y, x, ROUND(v / 4294967295.0 * 8388608, 9) AS v FROM vox")
def dtype_scale(spark, sf):
    return vox(spark, sf).withColumn("v", F.round(convert(F.col("v"), "uint32", "float32"), 9))


@query(f"WITH {VOX}, {bright_sql('vox', K, 'b')} SELECT z, y, x, v FROM b")
def plane_threshold(spark, sf):
    return planes.global_threshold(vox(spark, sf), K)


@query(f"WITH {VOX}, {bright_sql('vox', K, 'b')} SELECT v.z, v.y, v.x, b.z IS NOT NULL AS marked, CASE WHEN b.z IS NULL THEN CAST(0 AS VARCHAR) ELSE '18446744073709551615' END AS code FROM vox v LEFT JOIN b ON v.z = b.z AND v.y = b.y AND v.x = b.x")
def mark_planes(spark, sf):
    v = vox(spark, sf)
    marked = planes.global_threshold(v, K).select("z", "y", "x", F.lit(True).alias("m"))
    rows = v.select("z", "y", "x").join(marked, ["z", "y", "x"], "left").withColumn("marked", F.coalesce("m", F.lit(False)))
    return rows.select("z", "y", "x", "marked", detection_code(F.col("marked")).cast("string").alias("code"))


@query(f"WITH {SPOT} SELECT z, ROUND(AVG(v), 6) AS corner_mean, ROUND(STDDEV_POP(v), 6) AS corner_std FROM spot WHERE y < 16 AND x < 16 GROUP BY z")
def corner_tile_stats(spark, sf):
    s = planes.corner_stats(spot(spark, sf), 16)
    return s.select("z", F.round("corner_mean", 6).alias("corner_mean"), F.round("corner_std", 6).alias("corner_std"))


@query(f"WITH {SPOT} SELECT z, y // 12 AS ty, x // 12 AS tx, ROUND(AVG(v), 6) AS tile_mean FROM spot WHERE y < {E} // 12 * 12 AND x < {E} // 12 * 12 GROUP BY 1, 2, 3")
def tile_means(spark, sf):
    return planes.tile_means(spot(spark, sf), shape(spark, sf)[1:], 12).withColumn("tile_mean", F.round("tile_mean", 6))


@query(f"WITH {SPOT}, {TILES} SELECT * FROM tile")
def bright_tile_mask(spark, sf):
    return planes.bright_tiles(spot(spark, sf), shape(spark, sf)[1:], 8)


@query(f"""WITH {SPOT}, {bright_sql('spot', 0.5, 'b')},
  lay AS (SELECT e // 5 - 1 AS n, e % 5 // 2 AS off, (5 - e % 5) // 2 AS lead FROM dim),
  axis AS (SELECT p.range AS p, t.t AS t, LEAST(GREATEST((p.range + lead) // 5 - 1, 0), n - 1) AS own FROM {ACROSS} p, lay, (SELECT unnest(range((SELECT n FROM lay))) AS t) t WHERE p.range BETWEEN off + t.t * 5 AND off + 9 + t.t * 5 OR t.t = LEAST(GREATEST((p.range + lead) // 5 - 1, 0), n - 1)),
  holds AS (SELECT p, t FROM axis, lay WHERE p BETWEEN off + t * 5 AND off + 9 + t * 5), mine AS (SELECT DISTINCT p, own FROM axis),
  st AS (SELECT z, a.t AS ty, c.t AS tx, AVG(v) AS m, STDDEV_SAMP(v) AS s FROM spot JOIN holds a ON a.p = y JOIN holds c ON c.p = x GROUP BY 1, 2, 3)
  SELECT b.z, b.y, b.x, b.v FROM b JOIN mine q ON q.p = b.y JOIN mine r ON r.p = b.x JOIN st ON b.z = st.z AND st.ty = q.own AND st.tx = r.own WHERE b.v > st.m + 0.5 * st.s""")
def tiled_threshold(spark, sf):
    return planes.tiled_threshold(spot(spark, sf), shape(spark, sf)[1:], 10, 0.5, 0.5)


@query(f"""WITH {VOX} SELECT a.z, a.y, a.x, COALESCE(n.v, a.v) + COALESCE(s.v, a.v) + COALESCE(w.v, a.v) + COALESCE(e.v, a.v) - 4 * a.v AS v FROM vox a
  LEFT JOIN vox n ON n.z = a.z AND n.y = a.y - 1 AND n.x = a.x LEFT JOIN vox s ON s.z = a.z AND s.y = a.y + 1 AND s.x = a.x
  LEFT JOIN vox w ON w.z = a.z AND w.y = a.y AND w.x = a.x - 1 LEFT JOIN vox e ON e.z = a.z AND e.y = a.y AND e.x = a.x + 1""")
def laplacian(spark, sf):
    return planes.laplacian(vox(spark, sf))


@query(f"""WITH {VOX}, o AS (SELECT a.range - 1 AS d, b.range - 1 AS e FROM range(3) a, range(3) b)
  SELECT z, y, x, CAST(list_sort(list(n))[5] AS BIGINT) AS v FROM (SELECT a.z, a.y, a.x, COALESCE(b.v, 0) AS n FROM vox a CROSS JOIN o LEFT JOIN vox b ON b.z = a.z AND b.y = a.y + d AND b.x = a.x + e) GROUP BY 1, 2, 3""")
def median3x3(spark, sf):
    return planes.median3(vox(spark, sf), shape(spark, sf)[1:])


@query(f"""WITH {VOX}, wt AS (SELECT k.range - 4 AS k, EXP(-0.5 * ((k.range - 4) / 1.0) ** 2) AS w FROM range(9) k), ww AS (SELECT k, w / (SELECT SUM(w) FROM wt) AS w FROM wt),
  refl AS (SELECT p.range AS p, k, CASE WHEN (p.range + k + 2 * {E}) % (2 * {E}) < {E} THEN (p.range + k + 2 * {E}) % (2 * {E}) ELSE 2 * {E} - 1 - (p.range + k + 2 * {E}) % (2 * {E}) END AS q, w FROM {ACROSS} p, ww),
  g AS (SELECT z, refl.p AS y, x, SUM(w * v) AS v FROM vox JOIN refl ON vox.y = refl.q GROUP BY 1, 2, 3)
  SELECT z, y, refl.p AS x, ROUND(SUM(w * v), 6) AS v FROM g JOIN refl ON g.x = refl.q GROUP BY 1, 2, 3""")
def gaussian_separable(spark, sf):
    return planes.gaussian(vox(spark, sf), shape(spark, sf)[1:], 1.0).withColumn("v", F.round("v", 6))


_ENHANCED = f"""WITH {VOX}, o AS (SELECT a.range - 1 AS d, b.range - 1 AS e FROM range(3) a, range(3) b),
  med AS MATERIALIZED (SELECT z, y, x, list_sort(list(n))[5] AS v FROM (SELECT a.z, a.y, a.x, COALESCE(b.v, 0) AS n FROM vox a CROSS JOIN o LEFT JOIN vox b ON b.z = a.z AND b.y = a.y + d AND b.x = a.x + e) GROUP BY 1, 2, 3),
  wt AS (SELECT k.range - 6 AS k, EXP(-0.5 * ((k.range - 6) / 1.6) ** 2) AS w FROM range(13) k), ww AS (SELECT k, w / (SELECT SUM(w) FROM wt) AS w FROM wt),
  refl AS (SELECT p.range AS p, k, CASE WHEN (p.range + k + 2 * {E}) % (2 * {E}) < {E} THEN (p.range + k + 2 * {E}) % (2 * {E}) ELSE 2 * {E} - 1 - (p.range + k + 2 * {E}) % (2 * {E}) END AS q, w FROM {ACROSS} p, ww),
  g AS MATERIALIZED (SELECT z, refl.p AS y, x, SUM(w * v) AS v FROM med JOIN refl ON med.y = refl.q GROUP BY 1, 2, 3),
  s AS MATERIALIZED (SELECT z, y, refl.p AS x, SUM(w * v) AS v FROM g JOIN refl ON g.x = refl.q GROUP BY 1, 2, 3),
  l AS (SELECT a.z, a.y, a.x, 4 * a.v - COALESCE(n.v, a.v) - COALESCE(t.v, a.v) - COALESCE(w.v, a.v) - COALESCE(e.v, a.v) AS v FROM s a
    LEFT JOIN s n ON n.z = a.z AND n.y = a.y - 1 AND n.x = a.x LEFT JOIN s t ON t.z = a.z AND t.y = a.y + 1 AND t.x = a.x
    LEFT JOIN s w ON w.z = a.z AND w.y = a.y AND w.x = a.x - 1 LEFT JOIN s e ON e.z = a.z AND e.y = a.y AND e.x = a.x + 1)
  SELECT l.z, y, x, ROUND((v - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 65533, 2) AS v FROM l JOIN (SELECT z, MIN(v) AS lo, MAX(v) AS hi FROM l GROUP BY z) m ON l.z = m.z"""


@query(_ENHANCED)
def peak_enhance(spark, sf):
    return planes.enhance(vox(spark, sf), shape(spark, sf)[1:], 1.6, 65533, 24).withColumn("v", F.round("v", 2))


@query(f"""WITH {SPOT}, {bright_sql("spot", K_SPOT, "bright")}, {KERNEL}
  SELECT 1 - kz AS dz, 1 - ky AS dy, 1 - kx AS dx, w, COUNT(*) AS n FROM bright b, kernel WHERE w > 0 AND b.z + 1 - kz BETWEEN 1 AND 5 AND b.y + 1 - ky BETWEEN 1 AND {E} - 2 AND b.x + 1 - kx BETWEEN 1 AND {E} - 2 GROUP BY ALL""")
def ball_kernel(spark, sf):
    """The kernel's weights by their offsets, and how many bright voxels count somewhere in the volume by each."""
    at = ball.sent(spot_bright(spark, sf), ball.ball_kernel(3, 3), offset=True)
    for a, (first, last) in ball.valid(shape(spark, sf), ball.ball_kernel(3, 3)).items():
        at = at.where(F.col(a).between(first, last))
    return at.groupBy("dz", "dy", "dx", "w").agg(F.count("*").alias("n"))


@query(f"WITH {OVERLAP} SELECT * FROM overlap")
def ball_overlap(spark, sf):
    return ball.overlap(spot_bright(spark, sf), shape(spark, sf), 3, 3)


@query(f"WITH {OVERLAP} SELECT * FROM overlap")
def ball_overlap_stream(spark, sf):
    """The same from a stream: planes arrive one after another, and a closing voxel lets the last ones out."""
    folder = components.step_folder(spark)
    bright = components.written(spot_bright(spark, sf))
    end = spark.createDataFrame([streaming.closing(shape(spark, sf), 3, 3)], streaming.BRIGHT_SCHEMA)
    for plane in (*(bright.where(F.col("z") == z) for z in range(PLANES)), end):
        plane.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(streaming.BRIGHT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = streaming.overlap(arriving, shape(spark, sf), 3, 3)
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query(f"WITH {MARKS} SELECT * FROM marks")
def ball_marks(spark, sf):
    return spot_marks(spark, sf)


def feedback_sql(batches: list[list[int]]) -> str:
    """Marks of the planes that each batch can judge, which later batches see as bright."""
    steps = ["f0 AS (SELECT z, y, x FROM bright)"]
    for k, judged in enumerate(batches):
        own = f"SELECT b.z - kz + 1 AS z, b.y - ky + 1 AS y, b.x - kx + 1 AS x, SUM(w) AS w FROM f{k} b, kernel WHERE w > 0 AND b.z - kz + 1 BETWEEN {judged[0]} AND {judged[-1]} GROUP BY 1, 2, 3"
        steps.append(f"k{k} AS MATERIALIZED (SELECT o.z, o.y, o.x FROM ({own}) o JOIN tile ON tile.z = o.z AND tile.ty = o.y // 8 AND tile.tx = o.x // 8 AND inside WHERE o.y BETWEEN 1 AND {E} - 2 AND o.x BETWEEN 1 AND {E} - 2 AND 5 * o.w > 3 * (SELECT SUM(w) FROM kernel))")
        steps.append(f"f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION SELECT * FROM k{k})")
    return f"WITH {OVERLAP}, {TILES}, " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(len(batches)))


@query(feedback_sql([[1], [2], [3], [4], [5]]))
def ball_feedback(spark, sf):
    """Marks that count as bright for the planes behind them, plane after plane."""
    tiles = planes.bright_tiles(spot(spark, sf), shape(spark, sf)[1:], 8)
    return feedback.marks(components.written(spot_bright(spark, sf)), shape(spark, sf), 3, 3, RATIO, tiles, 8, slab=3, size=24)


def arriving(bright: DataFrame, folder: str) -> DataFrame:
    """A stream of the voxels and of a row for each plane that is whole, two files at a time."""
    ends = bright.sparkSession.range(PLANES).select(F.col("id").alias("z"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("long").alias("x"))
    bright.unionByName(ends).repartitionByRange(PLANES, "z").write.parquet(f"{folder}/in")
    return bright.sparkSession.readStream.schema(ordered.ARRIVED).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


@query(feedback_sql([[1, 2], [3, 4], [5]]))
def ball_feedback_stream(spark, sf):
    """The same in batches of two planes, from a stream."""
    folder = components.step_folder(spark)
    tiles = components.written(planes.bright_tiles(spot(spark, sf), shape(spark, sf)[1:], 8))
    fed = ordered.feedback_marks(folder, shape(spark, sf), 3, 3, RATIO, tiles, 8, batch=2, size=24)
    fed.run(arriving(spot_bright(spark, sf), folder))
    return fed.result(spark, "marks")


def _labelled_stream(spark, sf) -> ordered.Ordered:
    folder = components.step_folder(spark)
    found = ordered.labelled_structures(folder, shape(spark, sf), slab=2, tile=32)
    found.run(arriving(foreground(spark, sf), folder))
    return found


@query(f"WITH RECURSIVE {VOX}, {bright_sql('vox', K, 'b')}, {components_sql('b')} SELECT * FROM comp")
def components_stream(spark, sf):
    return ordered.whole(_labelled_stream(spark, sf), spark)


@query(f"WITH RECURSIVE {VOX}, {bright_sql('vox', K, 'b')}, {components_sql('b')} SELECT sid, CAST(ROUND_EVEN(AVG(x), 0) AS BIGINT) AS x, CAST(ROUND_EVEN(AVG(y), 0) AS BIGINT) AS y, CAST(ROUND_EVEN(AVG(z), 0) AS BIGINT) AS z, COUNT(*) AS volume FROM comp GROUP BY sid")
def structures_stream(spark, sf):
    """Centres and volumes of structures, let out once no later plane can add to them."""
    return _labelled_stream(spark, sf).result(spark, "structures")


@query(f"WITH RECURSIVE {VOX}, {bright_sql('vox', K, 'b')}, {components_sql('b')} SELECT * FROM comp")
def connected_components(spark, sf):
    return labelled(spark, sf)


@query(f"WITH RECURSIVE {VOX}, {bright_sql('vox', K, 'b')}, {components_sql('b')} SELECT sid, COUNT(*) AS volume FROM comp GROUP BY sid")
def structure_sizes(spark, sf):
    return structures.sizes(labelled(spark, sf))


_CENTRES = "SELECT sid, CAST(ROUND_EVEN(AVG(x), 0) AS BIGINT) AS x, CAST(ROUND_EVEN(AVG(y), 0) AS BIGINT) AS y, CAST(ROUND_EVEN(AVG(z), 0) AS BIGINT) AS z, COUNT(*) AS volume FROM comp GROUP BY sid"


@query(f"WITH RECURSIVE {VOX}, {bright_sql('vox', K, 'b')}, {components_sql('b')} {_CENTRES}")
def structure_centres(spark, sf):
    return structures.centres(labelled(spark, sf))


@query(f"WITH RECURSIVE {MARKS}, {components_sql('marks')} SELECT sid, COUNT(*) AS volume, CASE WHEN COUNT(*) < 8 THEN 'cell' WHEN COUNT(*) < 100 THEN 'needs_split' ELSE 'artifact' END AS kind FROM comp GROUP BY sid")
def structure_triage(spark, sf):
    return structures.sizes(spot_labelled(spark, sf)).withColumn("kind", structures.triage(F.col("volume"), 8, 100))


@query(f"WITH RECURSIVE {MARKS}, {components_sql('marks')} SELECT z, y, x, CASE WHEN n < 8 THEN 'maybe_cell' WHEN n < 100 THEN 'needs_split' ELSE 'too_big' END AS name FROM (SELECT *, COUNT(*) OVER (PARTITION BY sid) AS n FROM comp)")
def struct_type_map(spark, sf):
    rows = components.written(spot_labelled(spark, sf))
    named = structures.sizes(rows).select("sid", structures.triage(F.col("volume"), 8, 100, ("maybe_cell", "needs_split", "too_big")).alias("name"))
    return rows.join(named, "sid").select("z", "y", "x", "name")


@query(f"WITH RECURSIVE {VOX}, {bright_sql('vox', K, 'b')}, {components_sql('b')} SELECT sid, MIN(x) AS min_x, MAX(x) - MIN(x) + 1 AS size_x, MIN(y) AS min_y, MAX(y) - MIN(y) + 1 AS size_y, MIN(z) AS min_z, MAX(z) - MIN(z) + 1 AS size_z FROM comp GROUP BY sid")
def structure_bbox(spark, sf):
    return structures.boxes(labelled(spark, sf))


@query()
def split_structures(spark, sf):
    rows = components.written(spot_labelled(spark, sf))
    large = structures.sizes(rows).where(F.col("volume").between(8, 99)).select("sid")
    return structures.split_structures(rows.join(large, "sid", "left_semi"), (3, 3), Fraction(2, 5), 10)


@query()
def detect_pipeline(spark, sf):
    s = DetectionSettings(dtype="uint16", n_sds_above_mean_thresh=1, soma_diameter_um=8, voxel_sizes=(5, 2, 2), slab_planes=4)
    return detect(spot(spark, sf), shape(spark, sf), s)


@query(f"WITH {BOUNDS} SELECT idx, x0, x1, y0, y1, z0, z1 FROM bb")
def cuboid_bounds(spark, sf):
    return cubes.bounds(some_points(spark, sf), CUBE).select("idx", "x0", "x1", "y0", "y1", "z0", "z1")


@query(f"WITH {FULL} SELECT idx, x, y, z, type FROM full_")
def full_cuboid_filter(spark, sf):
    return cubes.full_only(cubes.bounds(some_points(spark, sf), CUBE), whole(spark, sf)).select("idx", "x", "y", "z", "type")


def _places(spark, sf, cube=CUBE) -> tuple[DataFrame, DataFrame]:
    """Points with a whole cube, by place, and the cubes of the places."""
    placed, places = cubes.shared(cubes.full_only(cubes.bounds(some_points(spark, sf), cube), whole(spark, sf)), shape(spark, sf))
    return placed, cubes.extract(places, vox(spark, sf), 16)


def _cubes(spark, sf) -> DataFrame:
    placed, each = _places(spark, sf)
    return cubes.spread(each, placed)


_CUBES = FULL + ", " + VOXELS + ", cube AS (SELECT idx, v.z - z0 AS dz, v.y - y0 AS dy, v.x - x0 AS dx, v FROM full_ f JOIN vox v ON v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1)"


@query(f"WITH {_CUBES} SELECT idx, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS total FROM cube GROUP BY idx")
def cube_extract_sum(spark, sf):
    return _cubes(spark, sf).groupBy("idx").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {_CUBES} SELECT idx, dz, dy, dx, ROUND((v - 20) / 8.0, 6) AS v FROM cube")
def channel_normalize(spark, sf):
    return cubes.normalised(_cubes(spark, sf), 20, 8).withColumn("v", F.round("v", 6))


@query(f"WITH {_CUBES} SELECT idx, dz, dy, 4 - dx AS dx, v FROM cube")
def flip_axis(spark, sf):
    return cubes.flip(_cubes(spark, sf), "x", 5)


_FIVE = dict(z=5, y=5, x=5)
_DRAWN = "CAST('0x' || substr(md5('4-2-' || idx || '-{}'), 1, 8) AS BIGINT) < 0.5 * 4294967296"


@query(f"""WITH {POINTS}, {VOXELS}, f AS (SELECT idx, CAST(ROUND_EVEN(x - 2.5, 0) AS BIGINT) AS x0, CAST(ROUND_EVEN(y - 2.5, 0) AS BIGINT) AS y0, CAST(z - 2 AS BIGINT) AS z0, {_DRAWN.format('affine')} AS moved, {_DRAWN.format('flip x')} AS flipped FROM pts),
  g AS (SELECT *, a.range AS dz, b.range AS dy, c.range AS dx, CASE WHEN flipped THEN 4 - c.range ELSE c.range END AS ox FROM f, range(5) a, range(5) b, range(5) c WHERE x0 BETWEEN 0 AND {E} - 5 AND y0 BETWEEN 0 AND {E} - 5 AND z0 BETWEEN 0 AND 2),
  s AS (SELECT *, CASE WHEN moved THEN LEAST(GREATEST(dz - 1, 0), 4) ELSE dz END AS sz, CASE WHEN moved THEN 4 - ox ELSE dy END AS sy, CASE WHEN moved THEN dy ELSE ox END AS sx FROM g)
  SELECT idx, dz, dy, dx, CAST(v AS DOUBLE) AS v FROM s JOIN vox ON vox.z = z0 + sz AND vox.y = y0 + sy AND vox.x = x0 + sx""")
def augment_cubes(spark, sf):
    """A quarter turn around z with a step of one voxel along z, and a flip along x, each of about half of the cubes."""
    how = augment.Augmentation(likelihood=0.5, flip=("x",), rotate={"z": np.pi / 2}, translate={"z": 0.2}, seed=4)
    placed, each = _places(spark, sf, _FIVE)
    return augment.augmented(each, (5, 5, 5), how, epoch=2, placed=placed).withColumn("v", F.round("v", 6))


@query(f"""WITH {_CUBES}, ax AS (SELECT 'z' AS a, t.range AS t, LEAST(GREATEST((t.range + 0.5) * 3 / 6.0 - 0.5, 0), 2) AS s, 2 AS top FROM range(6) t UNION ALL SELECT 'p', t.range, LEAST(GREATEST((t.range + 0.5) * 5 / 8.0 - 0.5, 0), 4), 4 FROM range(8) t),
  cr AS (SELECT a, t, CAST(FLOOR(s) AS BIGINT) AS i, 1 - (s - FLOOR(s)) AS w FROM ax UNION ALL SELECT a, t, CAST(LEAST(FLOOR(s) + 1, top) AS BIGINT), s - FLOOR(s) FROM ax)
  SELECT idx, cz.t AS tz, cy.t AS ty, cx.t AS tx, ROUND(SUM(cz.w * cy.w * cx.w * v), 6) AS v FROM cube JOIN cr cz ON cz.a = 'z' AND cz.i = dz JOIN cr cy ON cy.a = 'p' AND cy.i = dy JOIN cr cx ON cx.a = 'p' AND cx.i = dx
  GROUP BY 1, 2, 3, 4""")
def trilinear_resample(spark, sf):
    placed, each = _places(spark, sf)
    return cubes.spread(cubes.resample(each, (3, 5, 5), (6, 8, 8)).withColumn("v", F.round("v", 6)), placed)


@query(f"WITH {POINTS} SELECT idx, position, position // 32 AS batch FROM (SELECT idx, ROW_NUMBER() OVER (ORDER BY z, idx) - 1 AS position FROM pts)")
def batch_assignment(spark, sf):
    return points.batches(some_points(spark, sf), "z", 32).select("idx", "position", "batch")


@query(f"WITH {VOX} SELECT ROUND(AVG(v), 6) AS v_mean, ROUND(STDDEV_SAMP(v), 6) AS v_std FROM vox WHERE z % 2 = 0")
def channel_stats_sampled(spark, sf):
    s = planes.sampled_stats(vox(spark, sf), 7, 3)
    return s.select(F.round("v_mean", 6).alias("v_mean"), F.round("v_std", 6).alias("v_std"))


def _scores(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("p"))


@query("SELECT vec_id AS idx, CAST(list_position(embedding, list_max(embedding)) AS INT) AS type FROM embeddings")
def argmax_classify(spark, sf):
    return _scores(spark, sf).select("idx", scoring.predicted_type(F.col("p")).alias("type"))


@query(f"WITH {POINTS} SELECT idx, x, y, z, CAST(list_position(embedding, list_max(embedding)) AS INT) AS type FROM pts JOIN embeddings ON vec_id = idx")
def predictions_join_back(spark, sf):
    return scoring.join_back(some_points(spark, sf), _scores(spark, sf))


@query()
def classify_points(spark, sf):
    w = np.stack([np.linspace(-1, 1, 75), np.linspace(1, -1, 75)], 1)
    return classify(some_points(spark, sf), [vox(spark, sf)], shape(spark, sf), (3, 5, 5), (3, 5, 5), scoring.LinearSoftmax(w, np.zeros(2)), [(20, 8)])


@query(f"""WITH {FULL}, {VOXELS}, e AS (SELECT idx, SUM((k - 37) * (a - 20) / 8.0 + (40 - k) * (b - 16) / 4.0) AS e
  FROM (SELECT idx, (v.z - z0) * 25 + (v.y - y0) * 5 + v.x - x0 AS k, v.v AS a, u.v AS b FROM full_ f JOIN vox v ON v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1 JOIN vox u ON u.z = v.z AND u.y = v.x AND u.x = v.y) GROUP BY idx)
  SELECT idx, x, y, z, CASE WHEN e >= 0 THEN 1 ELSE 2 END AS type FROM pts JOIN e USING (idx)""")
def classify_two_channels(spark, sf):
    """Signal and background (its transpose), with whole-numbered weights, so that scores are exact."""
    signal, k = components.written(vox(spark, sf)), np.arange(75)
    background = signal.select("z", F.col("x").alias("y"), F.col("y").alias("x"), "v")
    w = np.stack([k - 37, 40 - k], 1).ravel().astype(float)
    return classify(some_points(spark, sf), [signal, background], shape(spark, sf), (3, 5, 5), (3, 5, 5), scoring.LinearSoftmax(np.stack([w, -w], 1), np.zeros(2)), [(20, 8), (16, 4)])


@query(f"""WITH {POINTS}, {VOXELS}, f AS (SELECT idx, CAST(ROUND_EVEN(x - 2.5, 0) AS BIGINT) AS x0, CAST(ROUND_EVEN(y - 2.5, 0) AS BIGINT) AS y0 FROM pts),
  e AS (SELECT idx, SUM(((y - y0) * 5 + x - x0 - 12) * (v - 20)) AS e FROM (SELECT * FROM f WHERE x0 BETWEEN 0 AND {E} - 5 AND y0 BETWEEN 0 AND {E} - 5) g JOIN vox v ON v.z = 3 AND v.y >= y0 AND v.y < y0 + 5 AND v.x >= x0 AND v.x < x0 + 5 GROUP BY idx)
  SELECT idx, x, y, CASE WHEN e >= 0 THEN 1 ELSE 2 END AS type FROM pts JOIN e USING (idx)""")
def classify_plane(spark, sf):
    """2-D points and one plane of voxels, with whole-numbered weights, so that scores are exact."""
    plane = vox(spark, sf).where("z = 3").select("y", "x", "v")
    w = np.arange(25.0) - 12
    scorer = scoring.LinearSoftmax(np.stack([w, -w], 1), np.zeros(2))
    return plane_plan(some_points(spark, sf).drop("z"), [plane], shape(spark, sf)[1:], (2.0, 2.0), ((5, 5), (5.0, 2.0, 2.0)), scorer, norms=[(20, 1)])


@query()
def classify_fitted(spark, sf):
    """Weights fitted on labels (whether a cube is brighter than most), then all points typed by them."""
    placed, given = channel_places(some_points(spark, sf), [vox(spark, sf)], shape(spark, sf), (3, 5, 5), [(20, 8)])
    given = components.written(given)
    totals = placed.join(given.groupBy(F.col("idx").alias("place")).agg(F.sum("v").alias("total")), "place").select("idx", "total")
    labels = totals.join(F.broadcast(totals.agg(F.avg("total").alias("mean")))).select("idx", F.when(F.col("total") > F.col("mean"), 2).otherwise(1).alias("type"))
    fitted = training.fit(given, labels, (3, 5, 5), test_share=0.2, seed=1, placed=placed)
    return classify_places(placed, given, (3, 5, 5), (3, 5, 5), fitted)


@query()
def classify_residual(spark, sf):
    """Cubes resampled to 24 x 24 x 12 and scored by an untrained residual network; its labels mean nothing."""
    described = dict(depth="18-layer", shape=(24, 24, 12, 1), features=2)
    model = resnet.ResidualNetwork(resnet.ResidualNetwork("", **described).initial(), **described)
    return classify(some_points(spark, sf), [vox(spark, sf)], shape(spark, sf), (3, 5, 5), (12, 24, 24), model, norm_planes=3)


@query(f"WITH {_CUBES} SELECT idx, dz, dy, dx, ROUND((v - idx % 7 - 10) / (idx % 3 + 4), 6) AS v FROM cube")
def channel_normalize_by_file(spark, sf):
    norms = some_points(spark, sf).select("idx", (F.col("idx") % 7 + 10).alias("mean"), (F.col("idx") % 3 + 4).alias("std"))
    placed, each = _places(spark, sf)
    rows = cubes.spread(each, cubes.with_norms(placed, norms, "idx"), "_mean", "_std")
    return cubes.by_own_norms(rows).withColumn("v", F.round("v", 6))


@query("SELECT doc_id, [CAST(toxic = 0 AS INT), CAST(toxic = 1 AS INT)] AS target FROM labels")
def one_hot_label(spark, sf):
    return read(spark, sf, "labels").select("doc_id", scoring.one_hot(F.col("toxic") + 1, 2).alias("target"))


@query(f"WITH {VOX} SELECT z, y // 10 AS \"by\", x // 12 AS bx, ROUND(SUM(v) / 120.0, 6) AS v FROM vox GROUP BY 1, 2, 3")
def bin_mean_2d(spark, sf):
    return planes.bin_mean_2d(vox(spark, sf), 10, 12).withColumn("v", F.round("v", 6))


@query(f"WITH {VOX} SELECT z // 7 AS bz, y // 8 AS \"by\", x // 4 AS bx, ROUND(AVG(v), 6) AS v FROM vox GROUP BY 1, 2, 3")
def bin_mean_3d(spark, sf):
    return planes.bin_mean_3d(vox(spark, sf), shape(spark, sf), (7, 8, 4)).withColumn("v", F.round("v", 6))


@query(f"WITH {VOX} SELECT z, y - ({E} - 32) // 2 AS y, x - ({E} - 20) // 2 AS x, v FROM vox WHERE y - ({E} - 32) // 2 BETWEEN 0 AND 31 AND x - ({E} - 20) // 2 BETWEEN 0 AND 19")
def crop_center(spark, sf):
    return planes.crop_centre(vox(spark, sf), shape(spark, sf)[1:], (32, 20))


@query(f"WITH {VOX} SELECT v.z, p.range AS y, q.range AS x, v FROM (SELECT unnest(range({E} + 7)) AS range) p, (SELECT unnest(range({E} + 4)) AS range) q JOIN vox v ON v.y = LEAST(GREATEST(p.range - 3, 0), {E} - 1) AND v.x = LEAST(GREATEST(q.range - 2, 0), {E} - 1)")
def pad_center(spark, sf):
    e = shape(spark, sf)
    return planes.pad_centre(vox(spark, sf), e[1:], (e[1] + 7, e[2] + 4))


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE ((z - 3) / 3.0) ** 2 + ((y - 32) / 20.0) ** 2 + ((x - 32) / 10.0) ** 2 <= 1")
def sphere_mask(spark, sf):
    return planes.in_sphere(vox(spark, sf), dict(z=3, y=32, x=32), dict(z=3.0, y=20.0, x=10.0))


_WHOLE = POINTS + ", w AS (SELECT idx, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM pts)"


@query(f"""WITH {_WHOLE} SELECT z + c.range AS z, y + b.range AS y, x + a.range AS x, MIN(idx) AS idx FROM w, range(-2, 3) a, range(-2, 3) b, range(-2, 3) c
  WHERE z BETWEEN 2 AND 4 AND y BETWEEN 2 AND {E} - 3 AND x BETWEEN 2 AND {E} - 3 AND a.range * a.range + b.range * b.range + c.range * c.range <= 4 GROUP BY 1, 2, 3""")
def stamp_spheres(spark, sf):
    whole = some_points(spark, sf).select("idx", *(F.col(a).cast("long").alias(a) for a in "zyx"))
    return structures.stamped(whole, shape(spark, sf), 2)


@query(f"""WITH {DIM}, s AS (SELECT l_linenumber - 1 AS z, l_orderkey % {E} AS y, l_partkey % {E} AS x, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
  p AS (SELECT z, MIN(y) AS a, MAX(y) AS b, MIN(x) AS c, MAX(x) AS d, COUNT(*) AS n, COUNT(v) AS k FROM s GROUP BY z)
  SELECT CAST(z AS BIGINT) AS z, 'rows ' || a || ' to ' || b || ', columns ' || c || ' to ' || d || ', ' || n || ' pixels, ' || k || ' of them known; expected ' || {E} || ' x ' || {E} AS message
  FROM p WHERE NOT (a = 0 AND b = {E} - 1 AND c = 0 AND d = {E} - 1 AND n = {E} * {E} AND k = {E} * {E})""")
def plane_shape_errors(spark, sf):
    """Planes of the sums as they are, before gaps are filled."""
    e = shape(spark, sf)[1]
    rows = read(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("z"), (F.col("l_orderkey") % e).alias("y"), (F.col("l_partkey") % e).alias("x"), F.col("l_quantity").alias("v"))
    return planes.misshapen(rows.groupBy("z", "y", "x").agg(F.sum("v").alias("v")), shape(spark, sf)[1:])


def _two(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All points of orders, and all of lineitem."""
    a = some_points(spark, sf).select(*(F.col(c).cast("long").alias(c) for c in "xyz"))
    places = ((F.col("l_orderkey") % 61).alias("x"), (F.col("l_partkey") % 67).alias("y"), (F.col("l_suppkey") % 9).alias("z"))
    return a, read(spark, sf, "lineitem").select(*places)


_TWO = POINTS + ", a AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM pts), c AS (SELECT l_orderkey % 61 AS x, l_partkey % 67 AS y, l_suppkey % 9 AS z FROM lineitem)"
_NEAR = "near AS (SELECT DISTINCT x + i.range AS x, y + j.range AS y, z + k.range AS z FROM c, range(-2, 3) i, range(-2, 3) j, range(-2, 3) k)"


@query(f"WITH {_TWO}, {_NEAR} SELECT DISTINCT a.x, a.y, a.z FROM a JOIN near ON a.x = near.x AND a.y = near.y AND a.z = near.z")
def match_within_tolerance(spark, sf):
    return points.matched(*_two(spark, sf), 2)


@query(f"WITH {_TWO} SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c) UNION ALL SELECT *, 'right' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)")
def symmetric_difference(spark, sf):
    return points.symmetric_difference(*_two(spark, sf))


@query(f"WITH {_TWO} SELECT DISTINCT x, y, z FROM a")
def distinct_points(spark, sf):
    return _two(spark, sf)[0].dropDuplicates()


@query(f"WITH {_TWO} SELECT * FROM a UNION SELECT * FROM c")
def list_union(spark, sf):
    return points.union(*_two(spark, sf))


@query(f"WITH {_TWO} SELECT * FROM a INTERSECT SELECT * FROM c")
def list_intersection(spark, sf):
    return points.common(*_two(spark, sf))


@query("SELECT page_id, list_has_any(string_split(url, '/'), ['a', 'blog', 'news', 'docs']) AS overlaps FROM pages")
def list_overlap(spark, sf):
    words = F.array(*(F.lit(w) for w in ("a", "blog", "news", "docs")))
    return read(spark, sf, "pages").select("page_id", F.arrays_overlap(F.split("url", "/"), words).alias("overlaps"))


@query(f"WITH {_TWO} SELECT x, y, z FROM a GROUP BY ALL HAVING COUNT(*) > 1")
def duplicates(spark, sf):
    return points.duplicates(_two(spark, sf)[0], "x", "y", "z")


@query(f"WITH {POINTS} SELECT z AS a0, y AS a1, x AS a2 FROM pts WHERE type = 2")
def axis_reorder(spark, sf):
    return points.as_layer(some_points(spark, sf), 2)


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z >= 2 AND z < 5")
def plane_range_scan(spark, sf):
    return planes.plane_range(vox(spark, sf), 2, 5)


@query(f"WITH {VOX} SELECT z, y, x, CAST(LEAST(v, 65535) AS DOUBLE) AS v FROM vox WHERE z >= 2 AND z < 5")
def tiff_stack_scan(spark, sf):
    """The volume written as compressed planes, and a range of them read again: other planes' files are not opened for pixels."""
    folder = components.step_folder(spark)
    stacks.write_planes(vox(spark, sf), shape(spark, sf), f"{folder}/planes", compression="lzw", rows=16, differences=True)
    return planes.plane_range(stacks.read_planes(spark, f"{folder}/planes", each=1), 2, 5)


@query(f"WITH {VOX} SELECT z, COALESCE(MIN(NULLIF(v, 0)), 65535) AS v, COUNT(DISTINCT v) <= 1 AS equal FROM vox GROUP BY z")
def nonzero_min(spark, sf):
    return vox(spark, sf).groupBy("z").agg(structures.non_zero_min(F.col("v"), 65535).alias("v"), points.all_equal("v").alias("equal"))


@query("SELECT p_partkey, CAST(regexp_extract(p_name, '(\\d+)', 1) AS VARCHAR) AS digits, left(p_name, length(p_name) - 5) || CAST(p_size % 10 AS VARCHAR) || '.tif' AS file FROM part")
def channel_file_names(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.regexp_extract("p_name", r"(\d+)", 1).alias("digits"), points.channel_path(F.col("p_name"), F.col("p_size") % 10).alias("file"))


@query(f"WITH {POINTS} SELECT idx, CAST('0x' || substr(md5('7-' || idx), 1, 8) AS BIGINT) < 0.2 * 4294967296 AS test FROM pts")
def train_test_split(spark, sf):
    return some_points(spark, sf).select("idx", points.held_out(F.col("idx"), 0.2, 7).alias("test"))


@query(f"WITH {POINTS} SELECT idx, ROW_NUMBER() OVER (ORDER BY z, md5('3-' || idx), idx) - 1 AS position, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY z, md5('3-' || idx), idx) - 1) / 32) AS BIGINT) AS batch FROM pts")
def shuffled_batches(spark, sf):
    return points.batches(some_points(spark, sf), "z", 32, seed=3).select("idx", "position", "batch")


@query(f"WITH {POINTS} SELECT idx, [CAST(type = 1 AS INT), CAST(type = 2 AS INT)] AS one_hot, type - 1 AS index, CASE type WHEN 1 THEN 'no_cell' ELSE 'cell' END AS label FROM pts")
def target_modes(spark, sf):
    kind = F.col("type")
    return some_points(spark, sf).select("idx", scoring.target(kind, None).alias("one_hot"), scoring.target(kind, "index").alias("index"), scoring.target(kind, "label").alias("label"))


@query("SELECT label || '' AS name, CASE label WHEN 'cell' THEN 2 WHEN 'no_cell' THEN 1 ELSE -1 END AS type FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'cell' WHEN 1 THEN 'no_cell' END AS label FROM labels)")
def label_types(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, "cell").when(F.col("doc_id") % 3 == 1, "no_cell")
    return read(spark, sf, "labels").select(name.alias("name"), scoring.labelled_type(name).alias("type"))


@query(f"WITH {BOUNDS} SELECT idx, NOT ((x < x0 OR x >= x1) AND (y < y0 OR y >= y1) AND (z < z0 OR z >= z1)) AS inside FROM (SELECT idx, x, y, z, 20 AS x0, 40 AS x1, 10 AS y0, 30 AS y1, 2 AS z0, 5 AS z1 FROM pts)")
def centre_in_cuboid(spark, sf):
    box = {"x": (20, 40), "y": (10, 30), "z": (2, 5)}
    return some_points(spark, sf).select("idx", cubes.centre_inside({a: (F.lit(lo), F.lit(hi)) for a, (lo, hi) in box.items()}).alias("inside"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, label, measure and sort structures by size class."""
    return structures.centres(labelled(spark, sf_dir)).withColumn("kind", structures.triage(F.col("volume"), 8, 100))
