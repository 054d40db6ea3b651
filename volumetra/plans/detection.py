"""Detection and classification as whole plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.operators import ball, components, cubes, feedback, planes, scoring, structures
from volumetra.settings import DetectionSettings, check_volume


def detect(voxels: DataFrame, shape: tuple[int, int, int], settings: DetectionSettings) -> DataFrame:
    """x, y, z and type of the points found in a volume. z counts from the volume's first plane, whatever range is looked at.
    A structure that cannot be split fails the job; `detect_with_errors` goes on without it."""
    return _detect(voxels, shape, settings, structures.split_structures)[0]


def detect_with_errors(voxels: DataFrame, shape: tuple[int, int, int], settings: DetectionSettings, split: Callable = structures.split_points) -> tuple[DataFrame, DataFrame]:
    """The points as from `detect`, and sid and error of structures that could not be split, which have no point."""
    found, parts = _detect(voxels, shape, settings, lambda *how: components.written(structures.split_or_error(*how, split=split)))
    return found.where("x IS NOT NULL"), parts.where("error IS NOT NULL").select("sid", "error")


def _detect(voxels: DataFrame, shape: tuple[int, int, int], settings: DetectionSettings, split: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    check_volume(settings.dtype, shape)
    end = shape[0] if settings.end_plane < 0 else min(shape[0], settings.end_plane)
    depth, plane = end - settings.start_plane, shape[1:]
    if settings.ball_xy > min(plane):
        raise ValueError("planes are smaller than the ball")
    chosen = planes.plane_range(voxels, settings.start_plane, end).select((F.col("z") - settings.start_plane).alias("z"), "y", "x", F.greatest(F.lit(0.0), F.least(F.col("v").cast("double"), F.lit(float(settings.clip_value)))).alias("v"))
    tiles = planes.bright_tiles(chosen, plane, settings.tile)
    peaks = components.written(planes.enhance(chosen, plane, settings.sigma, settings.clip_value))
    if settings.tiled_thresh_tile_size:
        bright = planes.tiled_threshold(peaks, plane, round(settings.tiled_thresh_tile_size * settings.soma_diameter), settings.n_sds_above_mean_thresh, settings.n_sds_above_mean_tiled_thresh)
    else:
        bright = planes.global_threshold(peaks, settings.n_sds_above_mean_thresh)
    ratio = Fraction(str(settings.ball_overlap_fraction))
    marks = partial(feedback.marks, components.written(bright), batch=settings.batch_size, slab=settings.slab_planes) if settings.z_feedback else partial(ball.marks, bright)
    found = marks((depth, *plane), settings.ball_xy, settings.ball_z, ratio, tiles=tiles, tile=settings.tile)
    labelled = components.written(components.connected_components(found, (depth, *plane), settings.slab_planes).withColumn("z", F.col("z") + settings.start_plane))
    kinds = structures.centres(labelled).withColumn("kind", structures.triage(F.col("volume"), settings.max_cell_volume, settings.max_cluster_size))
    single = kinds.where("kind != 'needs_split'").select("x", "y", "z", F.when(F.col("kind") == "cell", structures.UNKNOWN).otherwise(structures.ARTIFACT).alias("type"))
    large = labelled.join(kinds.where("kind = 'needs_split'").select("sid"), "sid", "left_semi")
    parts = split(large, settings.split_ball, Fraction(str(settings.split_ball_overlap_fraction)), settings.n_splitting_iter, settings.correct_split_offset)
    return single.unionByName(parts.select("x", "y", "z", F.lit(structures.UNKNOWN).alias("type"))), parts


def channel_cubes(points: DataFrame, channels: Sequence[DataFrame], shape: tuple[int, int, int], cube: tuple[int, int, int], norms: Sequence[tuple[float, float]] | None = None, norm_planes: int | None = None) -> DataFrame:
    """idx, channel, dz, dy, dx and v of the cubes (sizes z, y, x) around points (idx, x, y, z) that lie inside the volume; the
    others are left out. channels: the signal's voxels, then the background's if there is one. Each is normalised by its
    (mean, std) in norms, or by those of norm_planes of its own planes, if either is given."""
    placed, each = channel_places(points, channels, shape, cube, norms, norm_planes)
    return cubes.spread(each, placed)


def channel_places(points: DataFrame, channels: Sequence[DataFrame], shape: tuple[int, int, int], cube: tuple[int, int, int], norms: Sequence[tuple[float, float]] | None = None, norm_planes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The points whose cubes lie inside the volume, with a place (idx, place, and point, all their columns); and the cubes as
    from `channel_cubes`, but by place (idx), once for all points that share one."""
    if norms is None and norm_planes is not None:
        norms = [tuple(planes.sampled_stats(c, shape[0], norm_planes).first()) for c in channels]
    bounded = cubes.full_only(cubes.bounds(points.select("idx", *"xyz", F.struct("*").alias("point")), dict(zip("zyx", cube))), dict(zip("zyx", shape)))
    placed, places = cubes.shared(bounded, shape)
    voxels = None
    for k, c in enumerate(channels):
        one = c.select("z", "y", "x", F.col("v").cast("double").alias("v"))
        if norms is not None:
            one = one.withColumn("v", (F.col("v") - norms[k][0]) / norms[k][1])
        one = one.withColumn("channel", F.lit(k))
        voxels = one if voxels is None else voxels.unionByName(one)
    return placed.select("idx", "place", "point"), cubes.extract(places, voxels)


def classify(points: DataFrame, channels: Sequence[DataFrame], shape: tuple[int, int, int], cube: tuple[int, int, int], to: tuple[int, int, int], scorer: scoring.Scorer, norms: Sequence[tuple[float, float]] | None = None, norm_planes: int | None = None) -> DataFrame:
    """Points (idx, x, y, z) whose cube lies inside the volume, typed by the model; the others are left out. Cubes and norms
    are those of `channel_cubes`; cubes are resampled to the model's sizes `to`."""
    wanted = getattr(scorer, "channels", len(channels))
    if wanted != len(channels):
        raise ValueError(f"the model takes {wanted} channels, but {len(channels)} were given")
    return classify_places(*channel_places(points, channels, shape, cube, norms, norm_planes), cube, to, scorer, len(channels))


def classify_places(placed: DataFrame, each: DataFrame, cube: tuple[int, int, int], to: tuple[int, int, int], scorer: scoring.Scorer, channels: int = 1) -> DataFrame:
    """The points of `channel_places`, typed by the model, which sees each place's cube once."""
    scores = scoring.predictions(each, cube, scorer, to if to != cube else None, channels)
    kinds = scores.select(F.col("idx").alias("place"), scoring.predicted_type(F.col("p")).alias("_type"))
    columns = [c for c in placed.schema["point"].dataType.names if c not in ("idx", "type")]
    return placed.where("idx IS NOT NULL").join(kinds, "place").select("idx", *(F.col("point").getField(c).alias(c) for c in columns), F.col("_type").alias("type"))


def classify_plane(points: DataFrame, channels: Sequence[DataFrame], shape: tuple[int, int], voxel_sizes: tuple[float, ...], network: tuple[tuple[int, int], tuple[float, ...]], scorer: scoring.Scorer, **norms) -> DataFrame:
    """2-D data (points idx, x, y and voxels y, x, v) through `classify`, as a volume of one plane whose z voxel size is the
    network's, so that nothing is rescaled in z. network: sizes y, x of the model's cubes, and its voxel sizes. All points
    share one plane; batches and joins deal by row and column, not by plane."""
    data, own = cubes.promoted(voxel_sizes, network[1])
    to = (1, *network[0])
    cube = tuple(cubes.data_voxels(n, a, b) for n, a, b in zip(to, own, data))
    flat = points.withColumn("z", F.lit(0.0))
    typed = classify(flat, [c.withColumn("z", F.lit(0).cast("long")) for c in channels], (1, *shape), cube, to, scorer, **norms)
    return typed.drop("z")
