"""Nearest-neighbour assignment: of rows to a small codebook (narrow), and of rows to rows (block by block)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscape.errors import InvalidMetric
from gridscape.functions import vector
from gridscape.operators import kernels
from gridscape.plans.planner import pairwise, vectors


def nearest_column(codebook: np.ndarray, features: Column | str = "features", metric: str = "euclidean") -> Column:
    """struct(unit, d) of the nearest codebook row: one Arrow function over the feature column, no join, fit for streams too.

    The codebook is a model's state (units x features), shipped with the plan.
    """
    if metric not in vector.DISTANCES:
        raise InvalidMetric(metric)

    @F.arrow_udf("unit int, d double")
    def assign(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.float64())], ["unit", "d"])
        unit, d = kernels.nearest(vectors(x), codebook, metric)
        return pa.StructArray.from_arrays([pa.array(unit.astype(np.int32)), pa.array(d)], ["unit", "d"])

    return assign(features if isinstance(features, Column) else F.col(features))


def nearest(rows: DataFrame, codebook: np.ndarray | DataFrame, metric: str = "euclidean", plan: str = "arrow", unit: str = "unit", distance: str | None = "distance") -> DataFrame:
    """rows with the nearest unit and its distance. plan: 'arrow' (kernel), 'array' (JVM, no shuffle), or 'join' (JVM, broadcast and aggregate).

    A DataFrame codebook is (unit, weights); for 'arrow' its rows come to the driver, as a model's state does.
    """
    if metric not in vector.DISTANCES:
        raise InvalidMetric(metric)
    spark, measure = rows.sparkSession, vector.DISTANCES[metric]
    if plan == "arrow":
        book = codebook if isinstance(codebook, np.ndarray) else np.array([r.weights for r in codebook.orderBy("unit").collect()])
        out = rows.withColumn("_near", nearest_column(book, "features", metric))
    else:
        table = codebook if isinstance(codebook, DataFrame) else codebook_table(spark, codebook)
        if plan == "array":
            book = table.agg(F.array_sort(F.collect_list(F.struct("unit", "weights"))).alias("_book"))
            out = rows.crossJoin(F.broadcast(book)).withColumn("_near", vector.argmin_unit("features", F.col("_book"), measure)).drop("_book")
        else:
            pairs = rows.select("row_id", "features").join(F.broadcast(table), how="cross").groupBy("row_id").agg(F.min(F.struct(measure("features", "weights").alias("d"), "unit")).alias("_near"))
            out = rows.join(pairs, "row_id")
    named = out.withColumn(unit, F.col("_near.unit").cast("int"))
    return (named.withColumn(distance, F.col("_near.d")) if distance else named).drop("_near")


def codebook_table(spark, weights: np.ndarray, columns: int | None = None) -> DataFrame:
    """unit, weights (and grid_row, grid_col of a map with that many columns)."""
    rows = [(i, *((i // columns, i % columns) if columns else ()), [float(v) for v in w]) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "unit int, " + ("grid_row int, grid_col int, " if columns else "") + "weights array<double>")


def distance_matrix(rows: DataFrame, table: DataFrame, metric: str = "euclidean") -> DataFrame:
    """row_id, unit, d of every pair of a row and a unit of a broadcast codebook (unit, weights)."""
    return rows.crossJoin(F.broadcast(table)).select("row_id", "unit", vector.DISTANCES[metric]("features", "weights").alias("d"))


def grid_place(unit: str, columns: int) -> tuple[Column, Column]:
    return F.floor(F.col(unit) / columns).cast("int"), (F.col(unit) % columns).cast("int")


def hit_map(assigned: DataFrame, units: int, unit: str = "unit") -> DataFrame:
    """unit, hits of every unit, 0 for those without any."""
    counts = assigned.groupBy(F.col(unit).cast("long").alias("unit")).agg(F.count(F.lit(1)).alias("hits"))
    return assigned.sparkSession.range(units).withColumnRenamed("id", "unit").join(counts, "unit", "left").select(F.col("unit").cast("int").alias("unit"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def nearest_row_per_unit(rows: DataFrame, codebook: np.ndarray, *carry: str) -> DataFrame:
    """unit, row_id, d2 and the carried columns of the training row nearest to each unit, ties to the first row.

    Each Arrow batch keeps its best row of every unit, so what is aggregated is units rows a batch.
    """
    kept = ["row_id", "features", *carry]
    schema = f"unit int, d2 double, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.select(*kept).schema if f.name != 'features')}"

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d2 = kernels.distances(vectors(b.column(1)), codebook, "sqeuclidean")
            ids = b.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            best = order[np.argmin(d2[order], axis=0)]
            others = [b.column(k).take(pa.array(best)) for k in range(len(kept)) if k != 1]
            exact = ((vectors(b.column(1))[best] - codebook) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(codebook), dtype=np.int32)), pa.array(exact), *others], ["unit", "d2", *[k for k in kept if k != "features"]])

    best = rows.select(*kept).mapInArrow(run, schema)
    return best.groupBy("unit").agg(F.min(F.struct("d2", "row_id", *carry)).alias("b")).select("unit", "b.*")


def neighbours(rows: DataFrame, k: int, *, include_self: bool = False, n: int | None = None) -> DataFrame:
    """row_id, rank (1..k), other, d: the k nearest other rows, ties to the smaller row_id; or k with the row itself, at distance 0, among them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            x, y = vectors(left["features"]), vectors(right["features"])
            a, b = left["row_id"].to_numpy(), right["row_id"].to_numpy()
            rank = np.argsort(b, kind="stable")
            y, b = y[rank], b[rank]
            d2 = kernels.cross_l2sq(x, y)
            if not include_self:
                d2[a[:, None] == b[None, :]] = np.inf
            take = np.argsort(d2, axis=1, kind="stable")[:, : k + 8]  # a few more, as the exact distances decide
            d = np.sqrt(((x[:, None, :] - y[take]) ** 2).sum(axis=2))
            d[~np.isfinite(np.take_along_axis(d2, take, axis=1))] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            d, take = np.take_along_axis(d, best, axis=1), np.take_along_axis(take, best, axis=1)
            fine = np.isfinite(d)
            out = [[np.repeat(a, fine.sum(axis=1))], [b[take[fine]]], [d[fine]]]
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"row_id": pa.array(cols[0].astype(np.int64)), "other": pa.array(cols[1].astype(np.int64)), "d": pa.array(cols[2].astype(float))})

    def best(found: pa.Table) -> pa.Table:
        row, other, d = (found[c].to_numpy() for c in ("row_id", "other", "d"))
        order = np.lexsort((other, d, row))
        first = np.flatnonzero(np.diff(row[order], prepend=row[order][:1] - 1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return found.take(pa.array(order[rank < k]))

    base = rows.select("row_id", "features")
    found = pairwise(base, base, run, "row_id long, other long, d double", n=n, merge=best)
    w = Window.partitionBy("row_id").orderBy("d", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("row_id", "rank", "other", "d")
