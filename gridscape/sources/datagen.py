"""Synthetic point sets, each row a function of its number and a seed, so they don't depend on partitions: row_id, features, label."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.functions.prep import standardise_vector, uniform

def row() -> Column:
    return F.col("row_id")


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number by the polar form of two uniform ones."""
    u = F.greatest(uniform(seed, *parts, F.lit("u")), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, *parts, F.lit("v")))


def _frame(spark: SparkSession, n: int, features: list[Column] | Column, label: Column, scale: bool) -> DataFrame:
    x = F.array(*features) if isinstance(features, list) else features
    rows = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", x.alias("features"), label.cast("int").alias("label"))
    return standardise_vector(rows) if scale else rows


def uniform_cube(spark: SparkSession, n: int, d: int, seed: int = 0, high: float = 10.0) -> DataFrame:
    return _frame(spark, n, [high * uniform(seed, row(), F.lit(j)) for j in range(d)], F.lit(0), False)


def blobs(spark: SparkSession, n: int, d: int = 2, k: int = 5, sigma: float = 1.0, seed: int = 0, box: float = 10.0, scale: bool = True) -> DataFrame:
    """k spherical clusters of equal size around centres uniform in a box."""
    label = row() % k
    centre = lambda j: box * (2 * uniform(seed, label, F.lit(j), F.lit("centre")) - 1)
    return _frame(spark, n, [centre(j) + sigma * normal(seed, row(), F.lit(j)) for j in range(d)], label, scale)


def grid_clusters(spark: SparkSession, per_cluster: int, rows: int, columns: int, sigma: float, seed: int = 0, low: float = 0.1, high: float = 0.9, scale: bool = True) -> DataFrame:
    """Clusters on a regular grid of centres: the overlap series (3 x 5, sigma .04 to .19) and the count series (sigma .04)."""
    k = rows * columns
    label = row() % k
    at = lambda i, size: low + (high - low) * i / max(1, size - 1)
    return _frame(spark, k * per_cluster, [at(label % columns, columns) + sigma * normal(seed, row(), F.lit(0)), at(F.floor(label / columns), rows) + sigma * normal(seed, row(), F.lit(1))], label, scale)


def moons(spark: SparkSession, n: int = 300, noise: float = 0.08, seed: int = 0, scale: bool = True) -> DataFrame:
    label, t = row() % 2, math.pi * F.floor(row() / 2) / max(1, n // 2 - 1)
    x = F.when(label == 0, F.cos(t)).otherwise(1 - F.cos(t)) + noise * normal(seed, row(), F.lit(0))
    y = F.when(label == 0, F.sin(t)).otherwise(0.5 - F.sin(t)) + noise * normal(seed, row(), F.lit(1))
    return _frame(spark, n, [x, y], label, scale)


def circles(spark: SparkSession, n: int = 300, noise: float = 0.05, factor: float = 0.4, seed: int = 0, scale: bool = True) -> DataFrame:
    label, t = row() % 2, 2 * math.pi * F.floor(row() / 2) / (n // 2)
    r = F.when(label == 0, 1.0).otherwise(factor)
    return _frame(spark, n, [r * F.cos(t) + noise * normal(seed, row(), F.lit(0)), r * F.sin(t) + noise * normal(seed, row(), F.lit(1))], label, scale)


def spiral(spark: SparkSession, per_arm: int = 100, arms: int = 3, noise: float = 0.04, seed: int = 0, scale: bool = True) -> DataFrame:
    label, t = row() % arms, F.floor(row() / arms) / per_arm
    angle = 2 * math.pi * label / arms + 2.5 * t
    return _frame(spark, arms * per_arm, [(0.1 + t) * F.cos(angle) + noise * normal(seed, row(), F.lit(0)), (0.1 + t) * F.sin(angle) + noise * normal(seed, row(), F.lit(1))], label, scale)


def anisotropic(spark: SparkSession, n: int = 300, k: int = 3, seed: int = 0, matrix: tuple[tuple[float, float], ...] = ((0.6, -0.6), (-0.4, 0.8)), scale: bool = True) -> DataFrame:
    """Spherical clusters under a linear map."""
    x = lambda i: F.get("features", F.lit(i))
    turned = blobs(spark, n, 2, k, 1.0, seed, scale=False).withColumn("features", F.array(*[x(0) * matrix[0][j] + x(1) * matrix[1][j] for j in (0, 1)]))
    return standardise_vector(turned) if scale else turned


def varied_density(spark: SparkSession, sizes: tuple[int, ...] = (100, 300, 600), sigmas: tuple[float, ...] = (0.5, 2.0, 4.0), seed: int = 0, scale: bool = True) -> DataFrame:
    label = sum((row() >= sum(sizes[: k + 1])).cast("int") for k in range(len(sizes) - 1))
    sigma = F.element_at(F.array(*[F.lit(s) for s in sigmas]), label + 1)
    return _frame(spark, sum(sizes), [10 * (2 * uniform(seed, label, F.lit(j), F.lit("centre")) - 1) + sigma * normal(seed, row(), F.lit(j)) for j in (0, 1)], label, scale)
