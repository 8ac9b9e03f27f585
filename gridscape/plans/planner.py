"""Which physical plan an iterative operator takes, and the ways to run it.

Below LOCAL_BYTES of features the whole loop runs as one task over the rows in order, which saves a job per iteration. Above, each iteration is one
narrow Arrow pass that emits partial sums by (cluster, dimension), added up by Spark; only the small state comes to the driver. Both give the
same numbers but for the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_BYTES = 256 << 20
PAIR_BLOCK, PAIR_TILE, FEW_BLOCKS = 16_384, 2_048, 4


def plan(n: int, d: int, wanted: str = "auto") -> str:
    """'local' or 'distributed'."""
    return ("local" if n * d * 8 <= LOCAL_BYTES else "distributed") if wanted == "auto" else wanted


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column as a matrix; an empty column gives a matrix of no rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(x, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if x.ndim > 1 else 0), pa.int32()), flat)


def in_one_task(rows: DataFrame, solve: Callable[..., dict[str, np.ndarray]], order: str = "row_id", with_ids: bool = False) -> dict[str, np.ndarray]:
    """Run solve over the feature matrix (and the values of `order`), rows in order, in one executor task; its arrays come back. For inputs within LOCAL_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids = [], [np.zeros(0, np.int64)]
        for b in batches:
            if b.num_rows:
                found.append(vectors(b.column(0)))
                ids += [b.column(1).to_numpy(zero_copy_only=False)] if with_ids else []
        x = np.concatenate(found) if found else np.zeros((0, 0))
        for name, value in (solve(x, np.concatenate(ids)) if with_ids else solve(x)).items():
            value = np.asarray(value, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(value.shape)], pa.list_(pa.int64())), pa.array([value.ravel()], pa.list_(pa.float64()))], ["name", "shape", "data"])

    sorted_rows = rows.select(order, "features").repartition(1).sortWithinPartitions(order).select("features", *([order] if with_ids else []))
    return {r.name: np.array(r.data).reshape(r.shape) for r in sorted_rows.mapInArrow(run, "name string, shape array<long>, data array<double>").collect()}


def added_up(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of partial(features), a matrix of fixed shape: narrow pass, then one sum per cell. The result is state-sized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = partial(vectors(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "x"])

    found = rows.select("features").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((found["i"].to_numpy().max(initial=-1) + 1, found["j"].to_numpy().max(initial=-1) + 1))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["x"].to_numpy()
    return out


def merged(keys: list[str], how: dict[str, str]) -> Callable[[pa.Table], pa.Table]:
    """The `merge` that groups by keys and takes sum, min or max of the other columns."""

    def run(found: pa.Table) -> pa.Table:
        out = found.group_by(keys).aggregate(list(how.items()))
        return pa.table({c: out[c if c in keys else f"{c}_{how[c]}"] for c in found.column_names})

    return run


def pairwise(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int | None = None, n: int | None = None, merge: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """fn over every pair of a tile of left and a tile of right rows: what fn returns should be aggregates, which the caller adds up.

    Rows are dealt by a hash of row_id into blocks of at most PAIR_BLOCK expected rows (smaller ones where there are few rows, so that many tasks share
    the work), and each row is copied once a block of the other side. A task holds two blocks, and works on tiles of PAIR_TILE rows, so it never
    holds the matrix of all its pairs. `merge` adds up what the tiles of a left tile gave, before anything leaves the task.
    """
    n = left.count() if n is None else n
    count = max(1, -(-n // block)) if block else max(1, min(-(-n // PAIR_TILE), max(FEW_BLOCKS, -(-n // PAIR_BLOCK))))
    deal = F.pmod(F.xxhash64("row_id"), F.lit(count)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # new names for what may be the same columns on both sides
    a = left.select(*[F.col(c).alias(c) for c in left.columns]).withColumn("_i", deal).withColumn("_j", every)
    b = right.select(*[F.col(c).alias(c) for c in right.columns]).withColumn("_j", deal).withColumn("_i", every)

    def tiled(x: pa.Table, y: pa.Table) -> pa.Table:
        found = []
        for i in range(0, x.num_rows, PAIR_TILE):
            parts = [fn(x.slice(i, PAIR_TILE), y.slice(j, PAIR_TILE)) for j in range(0, y.num_rows, PAIR_TILE)]
            if parts:
                found.append(merge(pa.concat_tables(parts)) if merge and len(parts) > 1 else pa.concat_tables(parts))
        return pa.concat_tables(found) if found else fn(x.slice(0, 0), y.slice(0, 0))

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(tiled, schema)
