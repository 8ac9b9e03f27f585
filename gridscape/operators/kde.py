"""Kernel density: bandwidth from the first feature, density at every row, maxima in row order, farthest-first seeds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscape.errors import InsufficientData
from gridscape.operators import kernels
from gridscape.plans.planner import in_one_task, merged, pairwise, plan, vectors
from gridscape.plans.storage import stored
from gridscape.schema import with_pos


def bandwidth(rows: DataFrame) -> DataFrame:
    """bandwidth: (max - min) / (1 + log2 n) of the first feature, at least 1e-10; 1 below two rows."""
    x = F.get("features", F.lit(0))
    return rows.agg(F.max(x).alias("hi"), F.min(x).alias("lo"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(1e-10), (F.col("hi") - F.col("lo")) / (1 + F.log2("n")))).alias("bandwidth")
    )


def density(rows: DataFrame, width: float | None = None) -> DataFrame:
    """row_id, density: the mean of the Gaussian kernel at each row over all rows, block by block."""
    n = rows.count()
    if n == 0:
        return rows.select("row_id", F.lit(0.0).alias("density"))
    h = bandwidth(rows).first()[0] if width is None else width

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, total = np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            x, y = vectors(left["features"]), vectors(right["features"])
            ids = left["row_id"].to_numpy()
            total = np.empty(len(x))
            for s, d2 in kernels.l2sq_strips(x, y):
                d2 /= -2 * h * h
                total[s] = np.exp(d2, out=d2).sum(axis=1)
            total *= (2 * math.pi) ** (-x.shape[1] / 2) * h ** -x.shape[1]
        return pa.table({"row_id": pa.array(ids, pa.int64()), "part": pa.array(total, pa.float64())})

    base = rows.select("row_id", "features")
    return pairwise(base, base, part, "row_id long, part double", n=n, merge=merged(["row_id"], {"part": "sum"})).groupBy("row_id").agg((F.sum("part") / n).alias("density"))


def local_maxima(values: DataFrame, v: str = "density", order: str = "row_id", block: int = 100_000) -> DataFrame:
    """The rows above both neighbours in row order; the two ends are not.

    Rows are dealt by position into blocks, the edge rows of a block also to the block beside it, so neighbours meet without a window over all rows.
    """
    placed = with_pos(values, order)
    own = F.floor(F.col("pos") / block)
    first, last = F.col("pos") % block == 0, F.col("pos") % block == block - 1
    beside = F.array_compact(F.array(own, F.when(first & (own > 0), own - 1), F.when(last, own + 1)))
    w = Window.partitionBy("_block").orderBy("pos")
    near = placed.withColumn("_block", F.explode(beside)).withColumns({"_before": F.lag(v).over(w), "_after": F.lead(v).over(w)})
    top = (F.col("_block") == own) & (F.col("_before") < F.col(v)) & (F.col("_after") < F.col(v))
    return near.where(top).select(*values.columns)


def density_peaks(rows: DataFrame, k: int, wanted: str = "auto") -> np.ndarray:
    """k of the local maxima: the first, then each time the one farthest from all chosen, ties to the last."""
    from gridscape.operators.seeding import farthest_rows

    maxima = local_maxima(density(rows)).join(rows.select("row_id", "features"), "row_id").select("row_id", "features")
    peaks = stored(maxima)
    try:
        n = peaks.df.count()
        if n < k:
            raise InsufficientData(f"{n} maxima for {k} seeds")
        if plan(n, len(peaks.df.first().features), wanted) == "distributed":
            return farthest_rows(peaks.df, k, True)
        return in_one_task(peaks.df, lambda x: {"c": x[kernels.farthest_points(x, k, 0)]})["c"]
    finally:
        peaks.remove()
