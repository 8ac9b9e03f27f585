"""Exact top-k search by inner product over a vector-approximation file.

Every component is quantised to a cell of one byte: unit cells where the component's whole range has no more values than there are cells, else cells that
hold about equal shares of a sample, with outer cells that reach to the least and the largest value of all. The file of cells is written once. A scan of
it, which moves no exact vector but the queries', gives a lower and an upper bound of each score as two matrix products, the k-th best lower bound a query,
and as candidates what an upper bound lets reach it. Exact vectors are then read by id in the order of the upper bounds: first the k best bounds
of each query, and then, as nothing else can be among the k, those whose bound reaches the k-th exact score so far.

Rows are dealt by a hash of their id into blocks of bounded size, queries likewise; each pair of a query block and a data block is one task's group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscape.llm.common import cut, one_array

DATA_BLOCK = 262_144
QUERY_BLOCK = 32_768
#: Small tables are still dealt over up to FEW blocks of FEW_ROWS rows.
FEW, FEW_ROWS = 16, 8_192
#: The file's cells are fitted on at most that many vectors, those of least hash of vec_id. Their bounds hold for all.
SAMPLE = 4_096
BITS = 8
#: Queries, and rows of the file, that are scanned at a time.
QUERY_STRIP, DATA_STRIP = 512, 8_192
EXACT = 2.0**53


def scaled(df: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v array<double> of whole numbers: floor(scale * x), x as double. Vectors that are null or hold null, infinite or NaN components are left out.

    A component whose product is beyond the range of doubles is held at its end.
    """
    x, top = F.col(vector).cast("array<double>"), sys.float_info.max
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.least(F.lit(top), F.greatest(F.lit(-top), c * F.lit(float(scale))))
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)  # noqa: E731 (doubles beyond are whole)
    return df.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(F.transform(x, held), whole).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each list begins and the number of all) of a list column."""
    column = one_array(column)
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


@dataclass(frozen=True)
class Cells:
    """For each component, the least and the largest value of each cell, cells in order."""

    low: np.ndarray
    high: np.ndarray

    def encode(self, values: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The cells of values, which are components of that place."""
        out = np.zeros(len(values), np.uint8)
        for k in range(len(self.low)):
            own = place == k
            out[own] = np.searchsorted(self.low[k], values[own], side="right") - 1
        return out


def fitted(sample: list[np.ndarray], least: np.ndarray, most: np.ndarray, bits: int = BITS) -> Cells:
    """Cells of 2^bits values a component, over the components' ranges."""
    cells = 1 << bits
    low, high = np.empty((len(least), cells)), np.empty((len(least), cells))
    for k in range(len(least)):
        if most[k] - least[k] < cells:
            starts = least[k] + np.arange(most[k] - least[k] + 1)
        else:
            seen = np.sort(np.array([v[k] for v in sample if len(v) > k]))
            starts = np.unique(np.concatenate([[least[k]], seen[(np.arange(1, cells) * len(seen)) // cells] if len(seen) else []]))
        low[k], high[k] = np.inf, most[k]
        low[k, : len(starts)] = starts
        # values are whole numbers, so a cell ends one before the next; beyond 2^53 the next one's own start is the bound
        high[k, : len(starts) - 1] = np.where(np.abs(starts[1:]) < EXACT, starts[1:] - 1, starts[1:])
    return Cells(low, high)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of each query (row) with each vector between low and high (rows)."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.maximum(np.abs(low), np.abs(high)).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(1, q.shape[1])
        kind = np.float32 if most < 1 << 24 else np.float64
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        tight = np.array_equal(low, high)
        low, high = low.astype(kind).T, high.astype(kind).T
        if tight and most < EXACT:
            both = q.astype(kind) @ low
            return both, both
        lower, upper = up @ low + down @ high, up @ high + down @ low
        if most >= EXACT:  # sums are rounded: as much on either side
            slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)) * (2.0**-50 * max(4, q.shape[1]))
            lower, upper = lower - slack, upper + slack
            lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
    return lower, upper


def scan(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, same: np.ndarray, cells: np.ndarray, file: Cells, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, lower, upper) of the candidates of a block: all that may be among a query's k best of it.

    Of equal vectors (equal `same`) only the k + 1 of smallest ids can be. A row whose upper bound only equals the k-th lower bound isn't one if k
    others that reach that bound have smaller ids.
    """
    order = np.lexsort((vid, same))
    head = np.flatnonzero(np.diff(same[order], prepend=~same[order][:1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    rows = np.sort(order[rank <= k])
    rows = rows[np.argsort(vid[rows], kind="stable")]  # ties go to the smaller id, which is the earlier row
    width, place = cells.shape[1], np.arange(cells.shape[1])
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(q), QUERY_STRIP):
        own, ids = q[a : a + QUERY_STRIP], qid[a : a + QUERY_STRIP]
        best = np.full((len(own), k), -np.inf)
        parts: list[tuple[np.ndarray, ...]] = []
        for b in range(0, len(rows), DATA_STRIP):
            part = rows[b : b + DATA_STRIP]
            lower, upper = bounds(own, file.low[:width][place, cells[part]], file.high[:width][place, cells[part]])
            self_ = ids[:, None] == vid[part][None, :]
            if self_.any():
                lower, upper = np.where(self_, -np.inf, lower), np.where(self_, -np.inf, upper)
            best = -np.partition(-np.concatenate([best, lower], axis=1), k - 1, axis=1)[:, :k]
            i, j = np.nonzero((upper >= best.min(axis=1)[:, None]) & ~self_)
            parts.append((i, part[j], lower[i, j].astype(np.float64), upper[i, j].astype(np.float64)))
        if not parts:
            continue
        i, row, lower, upper = (np.concatenate(x) for x in zip(*parts, strict=True))
        least = best.min(axis=1)
        keep = upper >= least[i]
        i, row, lower, upper = i[keep], row[keep], lower[keep], upper[keep]
        # witnesses of the bound: the k best by lower bound, then id; a mere equal behind the last of them is beaten by all
        by = np.lexsort((vid[row], -lower, i))
        first = np.searchsorted(i[by], np.arange(len(own)))
        nth = np.arange(len(by)) - first[i[by]]
        last = np.full(len(own), np.iinfo(np.int64).max)
        tied = (nth < k) & (lower[by] == least[i[by]])
        last[:] = np.iinfo(np.int64).min
        np.maximum.at(last, i[by][tied], vid[row[by][tied]])
        full = np.bincount(i, minlength=len(own)) >= k
        keep = ~(full[i] & (upper == least[i]) & (vid[row] > last[i]))
        found.append((ids[i[keep]], row[keep], lower[keep], upper[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


CANDIDATE = "query_id long, vec_id long, same long, low double, high double"


def _scanned(file: Cells, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            qv, qat = matrix(left["v"])
            raw = one_array(right["cells"])
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            dn = np.array([len(x) for x in raw.to_pylist()], np.int64)
            dat = np.concatenate([[0], np.cumsum(dn)])
            qid, vid, same = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), right["same"].to_numpy()
            for width in np.intersect1d(np.diff(qat), dn):
                a, b, span = np.flatnonzero(np.diff(qat) == width), np.flatnonzero(dn == width), np.arange(width)
                query, row, low, high = scan(qid[a], qv[qat[a][:, None] + span], vid[b], same[b], data[dat[b][:, None] + span], file, k)
                found.append((query, vid[b][row], same[b][row], low, high))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3 + [np.empty(0)] * 2
        return pa.table(dict(zip(("query_id", "vec_id", "same", "low", "high"), map(pa.array, columns), strict=True)))

    return run


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, as whole numbers: doubles below 2^53, else Python's integers."""
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * max(1, q.shape[1])
    if most < EXACT:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)], object)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact scores of pairs; `far` tells scores beyond 64 bits, which are held at the ends of long, apart."""
    for batch in batches:
        (qv, qat), (dv, dat) = matrix(batch.column(3)), matrix(batch.column(4))
        score, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for width in np.unique(np.diff(qat)):
            at, span = np.flatnonzero(np.diff(qat) == width), np.arange(width)
            found = exact_scores(qv[qat[at][:, None] + span], dv[dat[at][:, None] + span])
            score[at] = found if found.dtype != object else [max(-(1 << 63), min((1 << 63) - 1, x)) for x in found]
            far[at] = [float(max(-(1 << 1023), min(1 << 1023, x))) for x in found.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score), pa.array(far)], ["query_id", "vec_id", "copies", "score", "far"])


def approximation(vectors: DataFrame, bits: int = BITS) -> tuple[DataFrame, Cells, int]:
    """The file (vec_id, same, cells) of all vectors, its cells, and the number of vectors. `same` is a hash of the vector."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = 0, np.empty(0), np.empty(0)
        for batch in batches:
            v, at = matrix(batch.column(0))
            width = int(np.diff(at).max(initial=0))
            least, most = (np.concatenate([x, np.full(max(0, width - len(x)), end)]) for x, end in ((least, np.inf), (most, -np.inf)))
            place = np.arange(len(v)) - np.repeat(at[:-1], np.diff(at))
            np.minimum.at(least, place, v)
            np.maximum.at(most, place, v)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "least": pa.array([least], pa.list_(pa.float64())), "most": pa.array([most], pa.list_(pa.float64()))})

    told = vectors.select("v").mapInArrow(ranges, "n long, least array<double>, most array<double>")
    both = told.select("n", F.posexplode_outer(F.arrays_zip("least", "most")).alias("place", "x")).groupBy(F.coalesce("place", F.lit(-1)).alias("place")).agg(F.sum("n").alias("n"), F.min("x.least").alias("least"), F.max("x.most").alias("most"))
    # bounded: one row a component of the longest vector
    rows = sorted(both.collect())
    n = max((r.n for r in rows), default=0) + sum(r.n for r in rows if r.place < 0)
    parts = [r for r in rows if r.place >= 0]
    sample = vectors.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).select("v").collect() if parts else []
    file = fitted([np.array(r.v) for r in sample], np.array([r.least for r in parts]), np.array([r.most for r in parts]), bits)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = matrix(batch.column(2))
            raw = file.encode(v, np.arange(len(v)) - np.repeat(at[:-1], np.diff(at))).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["vec_id", "same", "cells"])

    return cut(vectors.select("vec_id", F.xxhash64("v").alias("same"), "v").mapInArrow(encoded, "vec_id long, same long, cells binary")), file, n


def blocks_of(rows: int, most: int) -> int:
    return max(1, -(-rows // most), min(FEW, -(-rows // FEW_ROWS)) if most >= FEW_ROWS else 1)


def candidates(vectors: DataFrame, queries: DataFrame, k: int = 20, *, bits: int = BITS, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, same, low, high, copies: what the scan of the approximation file can't rule out. `queries`: vec_id (unique), v."""
    cells, file, n = approximation(vectors, bits)
    blocks, parts = blocks_of(n, data_block), max(1, -(-queries.count() // query_block))
    deal = lambda count, salt: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "v", deal(parts, 1).alias("part")).withColumn("block", every(blocks))
    right = cells.select("vec_id", "same", "cells", deal(blocks, 2).alias("block")).withColumn("part", every(parts))
    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_scanned(file, k), CANDIDATE)
    near = cut(near.groupBy("query_id", "vec_id", "same").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("copies")))
    # a row that occurs several times is several of the k
    best = Window.partitionBy("query_id").orderBy(F.desc("low"), F.asc("vec_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floor = near.withColumn("upto", F.sum("copies").over(best)).where(F.col("upto") >= k).groupBy(F.col("query_id").alias("q")).agg(F.max("low").alias("floor"))
    return near.join(floor, F.col("query_id") == F.col("q"), "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).drop("q", "floor")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, bits: int = BITS, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over `vectors` (both: vec_id, v array<double> of whole numbers), ties to the smaller vec_id.

    A query's own row (same vec_id) is no candidate. Vectors of another width than the query's are none either. Repeated rows of one vec_id count once
    each time they occur, equal in everything but their rank; of several query rows of one vec_id the one of least vector hash asks. Fewer than k
    candidates give all of them; no vectors, no rows. Scores beyond 64 bits are held at the ends of long, but ranked as they are.
    """
    asking = queries.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    found = cut(candidates(vectors, asking, k, bits=bits, data_block=data_block, query_block=query_block))
    exact = vectors.select("vec_id", F.xxhash64("v").alias("same"), "v")
    asked = asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def read(chosen: DataFrame) -> DataFrame:
        ids = chosen.select("vec_id", "same").distinct()
        wanted = exact.join(ids, ["vec_id", "same"], "left_semi").dropDuplicates(["vec_id", "same"])  # no other vector moves
        rows = chosen.join(wanted, ["vec_id", "same"]).join(asked, "query_id").select("query_id", "vec_id", "copies", "q", "v")
        return rows.mapInArrow(_read, "query_id long, vec_id long, copies long, score long, far double")

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("high"), F.asc("vec_id"))
    ranked = cut(found.withColumn("nth", F.row_number().over(by_bound)))
    first = cut(read(ranked.where(F.col("nth") <= k)))
    # with k exact scores read, nothing whose bound is below the least of them can be among the k
    sure = first.groupBy(F.col("query_id").alias("q")).agg(F.min("far").alias("least"), F.sum("copies").alias("read"))
    rest = ranked.where(F.col("nth") > k).join(sure, F.col("query_id") == F.col("q")).where((F.col("read") < k) | (F.col("high") >= F.col("least")))
    scored = first.unionByName(read(rest.select("query_id", "vec_id", "same", "copies")))
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("far"), F.asc("vec_id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
