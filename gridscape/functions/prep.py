"""Preparation of columns and vectors before clustering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscape.errors import InvalidInputData
from gridscape.functions.vector import l2sq
from gridscape.schema import with_pos


def minmax(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min); a range below 1e-9 gives zeros. One small aggregate, joined back by broadcast of its one row."""
    if column not in df.columns:
        raise InvalidInputData(f"no column {column}")
    ends = df.agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    x = F.when(F.col("_high") - F.col("_low") < 1e-9, 0.0).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out or column, x).drop("_low", "_high")


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0, population deviation 1 for each column; a constant column is only centred."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def standardise_vector(rows: DataFrame, features: str = "features") -> DataFrame:
    """As `standardise`, for a vector column: one aggregate over (dimension, value), one broadcast row."""
    each = rows.select(F.posexplode(features).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = each.agg(F.array_sort(F.collect_list(F.struct("dim", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("_stats"))
    return rows.crossJoin(F.broadcast(stats)).withColumn(features, F.zip_with(features, "_stats", lambda x, t: (x - t["m"]) / t["s"])).drop("_stats")


def one_hot(df: DataFrame, column: str, out: str = "one_hot") -> DataFrame:
    """The distinct values in order as 0/1 floats. The classes are an aggregate of distinct values, broadcast as one row."""
    classes = df.where(F.col(column).isNotNull()).agg(F.array_sort(F.collect_set(column)).alias("_classes"))
    return df.crossJoin(F.broadcast(classes)).withColumn(out, F.transform("_classes", lambda c: F.when(c.eqNullSafe(F.col(column)), 1.0).otherwise(0.0).cast("float"))).drop("_classes")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """bin, density over `bins` equal bins of the column's own range; the last bin includes its upper end."""
    ends = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"), F.count(column).alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("low")) / width)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg((F.count(F.lit(1)) / F.first(F.col("n")) / F.first(width)).alias("density"))


def compare_distribution(a: DataFrame, column_a: str, b: DataFrame, column_b: str, bins: int = 100) -> DataFrame:
    """difference: the mean absolute difference of two histograms of densities, each over its own range."""
    left, right = histogram(a, column_a, bins), histogram(b, column_b, bins).withColumnRenamed("density", "other")
    gap = F.abs(F.coalesce(F.col("density"), F.lit(0.0)) - F.coalesce(F.col("other"), F.lit(0.0)))
    return left.join(right, "bin", "full").agg((F.sum(gap) / bins).alias("difference"))


def mean_vector(rows: DataFrame, features: str = "features", by: list[str] | None = None) -> DataFrame:
    """The mean of the vectors (of each group, in `by`) as one array: partial sums by dimension, so no vector is gathered."""
    keys = by or []
    sums = rows.select(*keys, F.posexplode(features).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda t: t["m"]).alias("mean"))


def edge_point(rows: DataFrame, features: str = "features", order: str = "row_id") -> DataFrame:
    """The row farthest from the mean, ties to the first."""
    far = l2sq(features, "mean").alias("d")
    return rows.crossJoin(F.broadcast(mean_vector(rows, features))).select(order, features, far).orderBy(F.desc("d"), order).limit(1)


def subset(rows: DataFrame, chosen: DataFrame, key: str = "row_id") -> DataFrame:
    return rows.join(chosen.select(key), key, "left_semi")


def pca(rows: DataFrame, k: int, features: str = "features") -> DataFrame:
    """The first k principal components instead of the features: a linear embedding to cluster in."""
    ready = rows.withColumn("_vector", array_to_vector(features))
    model = PCA(k=k, inputCol="_vector", outputCol="_scores").fit(ready)
    return model.transform(ready).withColumn(features, vector_to_array("_scores")).drop("_vector", "_scores")


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on its arguments only, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11).cast("double") / float(1 << 53)


def random_vector(d: int, seed: int, low: float = 0.0, high: float = 1.0, key: str = "row_id") -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: low + (high - low) * uniform(seed, F.col(key), j))


def hadamard_matrix(power: int) -> np.ndarray:
    """The Hadamard matrix of side 2^power."""
    i = np.arange(1 << power)
    return np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2 == 0, 1.0, -1.0)


def orthonormal(a: np.ndarray) -> np.ndarray:
    """The nearest orthonormal matrix of that shape, by SVD."""
    u, _, v = np.linalg.svd(a, full_matrices=False)
    return u @ v


def order_statistics(rows: DataFrame, value: str, fractions: dict[str, float], by: str) -> DataFrame:
    """by, and for each name in fractions the value of 0-based rank floor(fraction * n) within the group.

    One range sort by (group, value) gives every row its place; a group's ranks begin at the sum of the counts before it, so no group is gathered in a
    task. Groups are few (dimensions of a vector): their counts come to the driver.
    """
    counts = rows.groupBy(by).count().orderBy(by).collect()
    wanted, start = [], 0
    for r in counts:
        wanted += [(start + math.floor(f * r["count"]), name) for name, f in fractions.items()]
        start += r["count"]
    places = rows.sparkSession.createDataFrame(wanted, "pos long, name string")
    found = with_pos(rows.select(by, value), by, value).join(F.broadcast(places), "pos")
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in fractions])
