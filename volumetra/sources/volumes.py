"""Volumes out of tables: any table with coordinates and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """Every z, y, x of a volume."""
    n, area = shape[0] * shape[1] * shape[2], shape[1] * shape[2]
    i = F.col("id")
    return spark.range(n).select(F.floor(i / area).alias("z"), F.floor(i % area / shape[2]).alias("y"), (i % shape[2]).alias("x"))


def dense(sparse: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """A dense volume from the sums of sparse values; 0 elsewhere."""
    sums = sparse.groupBy("z", "y", "x").agg(F.sum("v").alias("v"))
    return grid(sparse.sparkSession, shape).join(sums, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).cast("long").alias("v"))


def spheres(spark: SparkSession, shape: tuple[int, int, int], radius: float, centres: list[tuple[int, int, int]], value: float) -> DataFrame:
    """Balls (centres x, y, z) of one value, 0 elsewhere."""
    near = F.exists(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("xyz", c))) for c in centres)), lambda c: F.pow(F.col("x") - c["x"], F.lit(2)) + F.pow(F.col("y") - c["y"], F.lit(2)) + F.pow(F.col("z") - c["z"], F.lit(2)) <= radius * radius)
    return grid(spark, shape).withColumn("v", F.when(near, float(value)).otherwise(0.0))
