"""Eleven ways to seed a codebook."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import InvalidClusterCount, InvalidInitMethod
from gridscape.functions.prep import hadamard_matrix, mean_vector, orthonormal
from gridscape.operators import kernels
from gridscape.plans.planner import added_up, in_one_task, plan, vectors
from gridscape.schema import shape

METHODS = ("random", "kde", "kmeans", "kmeans++", "kde_kmeans", "som++", "zero", "he", "naive_sharding", "lecun", "lsuv")


def global_range(rows: DataFrame) -> tuple[float, float]:
    r = rows.agg(F.min(F.array_min("features")).alias("low"), F.max(F.array_max("features")).alias("high")).first()
    return r.low, r.high


def random_uniform(low: float, high: float, k: int, d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).uniform(low, high if high - low >= 1e-12 else low + 1e-6, (k, d))


def he(k: int, d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0.0, math.sqrt(2 / d), (k, d))


def lecun(k: int, d: int, seed: int) -> np.ndarray:
    """Drawn features by units, then turned to units by features."""
    return np.random.default_rng(seed).normal(0.0, math.sqrt(1 / d), (d, k)).T


def zero(k: int, d: int, variant: str = "identity") -> np.ndarray:
    """The partial identity; 'hadamard': where there are more units than features, rows of a scaled Hadamard matrix between partial identities."""
    if variant == "hadamard" and k > d:
        power = math.ceil(math.log2(k))
        return np.eye(k, 1 << power) @ (hadamard_matrix(power) * 2 ** (-(power - 1) / 2)) @ np.eye(1 << power, d)
    return np.eye(k, d)


def naive_sharding(rows: DataFrame, k: int) -> DataFrame:
    """unit, weights: rows in order of their sum (ties by row_id) in k shards of ceil(n / k), each one's mean; shards without rows are zero vectors.

    The rank comes from a range sort with offsets, not from a window over all rows.
    """
    from gridscape.schema import with_pos

    n, d = shape(rows)
    chunk = math.ceil(n / k)
    summed = rows.withColumn("_sum", F.aggregate("features", F.lit(0.0), lambda s, x: s + x))
    ranked = with_pos(summed, "_sum", "row_id")
    means = mean_vector(ranked.withColumn("unit", F.floor(F.col("pos") / chunk).cast("int")), "features", ["unit"])
    zeros = F.array_repeat(F.lit(0.0), d)
    return rows.sparkSession.range(k).select(F.col("id").cast("int").alias("unit")).join(means, "unit", "left").select("unit", F.coalesce("mean", zeros).alias("weights"))


def farthest_rows(rows: DataFrame, k: int, first: bool = False) -> np.ndarray:
    """Distributed farthest-point traversal: k narrow passes, each batch answering with its one farthest row. `first`: from the first row, not the outermost."""
    n, _ = shape(rows)
    if k > n:
        raise InvalidClusterCount(f"{k} seeds of {n} rows")
    chosen: list[np.ndarray] = []
    taken: list[int] = []
    if first:
        r = rows.select("row_id", "features").orderBy("row_id").first()
        chosen, taken = [np.array(r.features)], [r.row_id]
    else:
        mean = np.array(mean_vector(rows).first()["mean"])
    while len(chosen) < k:
        book = np.array(chosen) if chosen else mean[None, :]
        skip = np.array(taken, np.int64)

        def run(batches, book=book, skip=skip):
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids = vectors(b.column(1)), b.column(0).to_numpy()
                d2 = np.min([((x - c) ** 2).sum(axis=1) for c in book], axis=0)
                d2[np.isin(ids, skip)] = -1.0
                best = np.lexsort((ids, d2))[-1]
                yield pa.RecordBatch.from_arrays([pa.array(d2[[best]]), pa.array(ids[[best]]), b.column(1).take(pa.array([best]))], ["d2", "row_id", "features"])

        r = rows.select("row_id", "features").mapInArrow(run, "d2 double, row_id long, features array<double>").orderBy(F.desc("d2"), F.desc("row_id")).first()
        chosen.append(np.array(r.features))
        taken.append(r.row_id)
    return np.array(chosen)


def d2_rows(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Distributed D^2 sampling over all rows: k narrow passes, each batch answering with the one row it draws; the same rows as in one task."""
    chosen: list[np.ndarray] = []
    taken: list[int] = []
    while len(chosen) < k:
        book, skip = np.array(chosen), list(taken)

        def run(batches, book=book, skip=skip):
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids = vectors(b.column(1)), b.column(0).to_numpy()
                near = np.min([((x - c) ** 2).sum(axis=1) for c in book], axis=0) if len(book) else np.ones(len(x))
                best, key, time = kernels.drawn(ids, near, skip, seed, len(book))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([time]), pa.array(ids[[best]]), b.column(1).take(pa.array([best]))], ["key", "time", "row_id", "features"])

        r = rows.select("row_id", "features").mapInArrow(run, "key double, time double, row_id long, features array<double>").orderBy("key", "time", "row_id").first()
        chosen.append(np.array(r.features))
        taken.append(r.row_id)
    return np.array(chosen)


def gram(rows: DataFrame) -> np.ndarray:
    """[n, sum x, sum x x^T] as one bordered matrix, by one narrow pass and a sum."""

    def part(x: np.ndarray) -> np.ndarray:
        bordered = np.column_stack([np.ones(len(x)), x])
        return bordered.T @ bordered

    return added_up(rows, part)


def lsuv(rows: DataFrame, k: int, d: int, seed: int, svd: bool = False) -> np.ndarray:
    """He weights scaled until the variance of all activations is within 0.1 of 1, ten rounds at most. Variances come from the Gram matrix."""
    w = np.random.default_rng(seed).normal(0.0, math.sqrt(2 / d), (d, k))
    w = orthonormal(w) if svd else w
    g = gram(rows)
    n, sums, squares = g[0, 0], g[0, 1:], g[1:, 1:]
    for _ in range(10):
        mean = (sums @ w).sum() / (n * k)
        var = np.einsum("ik,ij,jk->", w, squares, w) / (n * k) - mean**2
        if var < 1e-8 or abs(var - 1) < 0.1:
            break
        w = w / math.sqrt(var)
    return w.T


def kde_seeds(rows: DataFrame, k: int) -> np.ndarray:
    from gridscape.operators.kde import density_peaks

    return density_peaks(rows, k)


#: The ways that need no more than the feature matrix at hand.
AT_HAND = ("random", "he", "lecun", "zero", "som++", "kmeans", "kmeans++")
ALIASES = {"kmeans_plus_plus": "kmeans++", "farthest": "som++", "kdekmeans": "kde_kmeans"}


def codebook_at_hand(x: np.ndarray, method: str, k: int, seed: int = 0) -> np.ndarray:
    """What `init_codebook` gives for the rows of x, without a job."""
    from gridscape.operators.lloyd import fit_array

    d = x.shape[1]
    if method == "random":
        return random_uniform(x.min(), x.max(), k, d, seed)
    if method in ("he", "lecun", "zero"):
        return {"he": he, "lecun": lecun}[method](k, d, seed) if method != "zero" else zero(k, d)
    if method == "som++":
        return x[kernels.farthest_points(x, k)]
    return fit_array(x, k, "random" if method == "kmeans" else "farthest", seed=seed)[0]


def init_codebook(rows: DataFrame, method: str, k: int, seed: int = 0, wanted: str = "auto", variant: str = "default") -> np.ndarray:
    """The k x d seeds by any of METHODS. variant: 'hadamard' for zero, 'svd' for lsuv, 'refine' for kde_kmeans (then Lloyd follows)."""
    from gridscape.operators.lloyd import fit_rows

    n, d = shape(rows)
    method = ALIASES.get(method, method)
    if method not in METHODS:
        raise InvalidInitMethod(method)
    if method == "random":
        return random_uniform(*global_range(rows), k, d, seed)
    if method == "he":
        return he(k, d, seed)
    if method == "lecun":
        return lecun(k, d, seed)
    if method == "zero":
        return zero(k, d, variant)
    if method == "naive_sharding":
        return np.array([r.weights for r in naive_sharding(rows, k).orderBy("unit").collect()])
    if method == "som++":
        if k > n:
            raise InvalidClusterCount(f"{k} seeds of {n} rows")
        return in_one_task(rows, lambda x: {"c": x[kernels.farthest_points(x, k)]})["c"] if plan(n, d, wanted) == "local" else farthest_rows(rows, k)
    if method == "lsuv":
        return lsuv(rows, k, d, seed, variant == "svd")
    if method == "kmeans":
        return fit_rows(rows, k, "random", seed=seed, wanted=wanted).centers
    if method == "kmeans++":
        return fit_rows(rows, k, "farthest", wanted=wanted).centers
    peaks = kde_seeds(rows, k)
    return fit_rows(rows, k, initial=peaks, wanted=wanted).centers if variant == "refine" else peaks
