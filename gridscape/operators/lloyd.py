"""k-means: Lloyd's iterations from farthest points, D^2 sampling, random or given centres."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import AlreadyFitted, DimensionMismatch, InvalidClusterCount, InvalidInitMethod
from gridscape.operators import kernels
from gridscape.operators.assign import codebook_table, nearest, nearest_column
from gridscape.operators.seeding import d2_rows, farthest_rows, global_range
from gridscape.plans.planner import added_up, in_one_task, plan
from gridscape.schema import FeatureSpec, assemble, shape


INITS = ("farthest", "d2", "random")


@dataclass
class KMeansModel:
    centers: np.ndarray
    inertia: float
    n_iter: int
    features: str | list[str] = "features"

    def transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        """df with the nearest cluster's number; a narrow projection."""
        names = (self.features,) if isinstance(self.features, str) else tuple(self.features)
        return df.withColumn(out, nearest_column(self.centers, FeatureSpec(names).column(df))["unit"])

    def centroids(self, spark) -> DataFrame:
        return codebook_table(spark, self.centers).withColumnsRenamed({"unit": "cluster_id", "weights": "center"})


@dataclass
class KMeans:
    """init: 'farthest' (deterministic farthest-point seeds), 'd2' (k-means++ sampling), 'random' (uniform in the data's range)."""

    k: int = 8
    init: str = "farthest"
    max_iter: int = 300
    tol: float = 1e-6
    seed: int = 0
    plan: str = "auto"
    _fitted: bool = field(default=False, repr=False)

    def fit(self, df: DataFrame, features: str | list[str] = "features", order_by: str = "row_id", initial: np.ndarray | None = None) -> KMeansModel:
        if self._fitted:
            raise AlreadyFitted("this estimator has been fitted")
        rows = assemble(df, features, order_by)
        model = fit_rows(rows, self.k, self.init, self.max_iter, self.tol, self.seed, initial, self.plan)
        model.features = features
        self._fitted = True
        return model


def seeds(x: np.ndarray, k: int, init: str, seed: int, ids: np.ndarray | None = None) -> np.ndarray:
    """ids: of the rows, their positions if not given; D^2 sampling draws by them."""
    if init == "farthest":
        return x[kernels.farthest_points(x, k)]
    if init == "d2":
        return kernels.d2_sampling(x, k, np.arange(len(x)) if ids is None else ids, seed)
    rng = np.random.default_rng(seed)
    low, high = x.min(), x.max()
    return rng.uniform(low, high if high - low >= 1e-12 else low + 1e-6, (k, x.shape[1]))


def fit_array(x: np.ndarray, k: int, init: str = "farthest", max_iter: int = 300, tol: float = 1e-6, seed: int = 0, initial: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
    start = np.array(initial, float) if initial is not None else seeds(x, k, init, seed, ids)
    return kernels.lloyd(lambda c: kernels.lloyd_sums(x, c), start, max_iter, tol)


def fit_rows(rows: DataFrame, k: int, init: str = "farthest", max_iter: int = 300, tol: float = 1e-6, seed: int = 0, initial: np.ndarray | None = None, wanted: str = "auto", known: tuple[int, int] | None = None) -> KMeansModel:
    """Over (row_id, features). Distributed: one narrow pass and one sum of k x (d + 2) cells an iteration. known: (rows, features), if checked already."""
    n, d = known or shape(rows)
    k = k if initial is None else len(initial)
    if not 1 <= k <= n:
        raise InvalidClusterCount(f"{k} clusters of {n} rows")
    if init not in INITS:
        raise InvalidInitMethod(init)
    if initial is not None and np.shape(initial)[1] != d:
        raise DimensionMismatch(f"centres of {np.shape(initial)[1]} and rows of {d} features")
    if plan(n, d, wanted) == "local":

        def solve(x: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
            c, inertia, passes = fit_array(x, k, init, max_iter, tol, seed, initial, ids)
            return {"centers": c, "inertia": np.array([inertia]), "passes": np.array([passes])}

        found = in_one_task(rows, solve, with_ids=True)
        return KMeansModel(found["centers"], float(found["inertia"][0]), int(found["passes"][0]))
    rows = rows.persist()
    try:
        if initial is not None:
            start = np.array(initial, float)
        elif init == "farthest":
            start = farthest_rows(rows, k)
        elif init == "d2":
            start = d2_rows(rows, k, seed)
        else:
            low, high = global_range(rows)
            start = np.random.default_rng(seed).uniform(low, high if high - low >= 1e-12 else low + 1e-6, (k, d))
        return KMeansModel(*kernels.lloyd(lambda c: _padded(added_up(rows, lambda x: kernels.lloyd_sums(x, c)), c), start, max_iter, tol))
    finally:
        rows.unpersist()


def fit_several(rows: DataFrame, k: int, initial: list[np.ndarray | None], wanted: str = "auto") -> list[KMeansModel]:
    """`fit_rows` from each of the starts (None: farthest points), in one task where the rows fit one."""
    n, d = shape(rows)
    if plan(n, d, wanted) != "local" or not 1 <= k <= n:
        return [fit_rows(rows, k, initial=s, wanted=wanted, known=(n, d)) for s in initial]

    def solve(x: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for i, s in enumerate(initial):
            c, inertia, passes = fit_array(x, k, initial=s)
            out |= {f"c{i}": c, f"told{i}": np.array([inertia, passes])}
        return out

    found = in_one_task(rows, solve)
    return [KMeansModel(found[f"c{i}"], float(found[f"told{i}"][0]), int(found[f"told{i}"][1])) for i in range(len(initial))]


def _padded(sums: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(c), c.shape[1] + 2))
    out[: sums.shape[0], : sums.shape[1]] = sums
    return out


def inertia(rows: DataFrame, centers: np.ndarray) -> float:
    found = nearest(rows, centers, "sqeuclidean").agg(F.sum("distance").alias("s")).first()
    return float(found.s or 0.0)
