"""Gaussian mixtures with diagonal covariance, by expectation-maximisation over partial sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import InvalidClusterCount
from gridscape.operators import kernels, lloyd
from gridscape.plans.planner import added_up, in_one_task, plan, vectors
from gridscape.plans.storage import stored
from gridscape.schema import FeatureSpec, assemble, shape

FLOOR = 1e-6


def log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    v = np.maximum(variances, FLOOR)
    quad = (x * x) @ (1 / v).T - 2 * x @ (means / v).T + (means**2 / v).sum(axis=1)
    return np.log(np.maximum(weights, 1e-300)) - 0.5 * (quad + np.log(2 * np.pi * v).sum(axis=1))


def responsibilities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, float]:
    lp = log_joint(x, weights, means, variances)
    top = lp.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(lp - top).sum(axis=1, keepdims=True))
    return np.exp(lp - total), float(total.sum())


def likeliest(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Each row's likeliest component, ties to the last."""
    lp = log_joint(x, weights, means, variances)
    return (lp.shape[1] - 1 - np.argmax(lp[:, ::-1], axis=1)).astype(np.int32)


def e_sums(x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """By component: N, sum r (x - mean), sum r (x - mean)^2 about the current means; the log-likelihood stands in a column of its own."""
    r, ll = responsibilities(x, *state)
    away = r.T @ x - r.sum(axis=0)[:, None] * state[1]
    second = r.T @ (x * x) - 2 * state[1] * (r.T @ x) + r.sum(axis=0)[:, None] * state[1] ** 2
    out = np.column_stack([r.sum(axis=0), away, second, np.zeros(len(state[0]))])
    out[0, -1] = ll
    return out


def m_step(sums: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = means.shape[1]
    n = sums[:, 0]
    safe = np.maximum(n, 1e-10)[:, None]
    shift = sums[:, 1 : 1 + d] / safe
    return n / n.sum(), means + shift, np.maximum(sums[:, 1 + d : 1 + 2 * d] / safe - shift**2 * (2 - n[:, None] / safe), FLOOR)


def start(centers: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Uniform weights, k-means' centres, and variances (1 + sum of squares) / rows: each sum begins at 1."""
    n, k = np.maximum(sums[:, 0], 1)[:, None], len(centers)
    return np.full(k, 1 / k), centers, np.maximum((1 + sums[:, 1:]) / n, FLOOR)


def square_sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    label, _ = kernels.nearest(x, centers)
    out = np.zeros((len(centers), 1 + x.shape[1]))
    np.add.at(out, label, np.column_stack([np.ones(len(x)), (x - centers[label]) ** 2]))
    return out


def em(step, state: tuple[np.ndarray, np.ndarray, np.ndarray], max_iter: int, tol: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """Converged parameters are those of the likelihood returned: the test comes before the maximisation."""
    before = -math.inf
    ll = before
    for _ in range(max_iter):
        sums = step(state)
        ll = float(sums[0, -1])
        if abs(ll - before) < tol * max(abs(before), 1.0):
            break
        before = ll
        state = m_step(sums, state[1])
    return state, ll


def bic(ll: float, n: int, k: int, d: int) -> float:
    return -2 * ll + (k * (2 * d + 1) - 1) * math.log(n)


def fit_array(x: np.ndarray, k: int, max_iter: int = 100, tol: float = 1e-4) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    centers, _, _ = lloyd.fit_array(x, k, max_iter=50)
    return em(lambda s: e_sums(x, s), start(centers, square_sums(x, centers)), max_iter, tol)


@dataclass
class GMMModel:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float
    bic: float
    features: str | list[str] = "features"

    def transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        """df with the likeliest component, ties to the last; narrow."""
        state = (self.weights, self.means, self.variances)

        @F.arrow_udf("int")
        def component(x: pa.Array) -> pa.Array:
            return pa.array(likeliest(vectors(x), *state) if len(x) else [], pa.int32())

        names = (self.features,) if isinstance(self.features, str) else tuple(self.features)
        return df.withColumn(out, component(FeatureSpec(names).column(df)))

    def components(self, spark) -> DataFrame:
        rows = [(i, float(w), m.tolist(), v.tolist()) for i, (w, m, v) in enumerate(zip(self.weights, self.means, self.variances, strict=True))]
        return spark.createDataFrame(rows, "cluster_id int, weight double, mean array<double>, var array<double>")


@dataclass
class DiagGMM:
    k: int = 8
    max_iter: int = 100
    tol: float = 1e-4
    plan: str = "auto"

    def fit(self, df: DataFrame, features: str | list[str] = "features", order_by: str = "row_id") -> GMMModel:
        rows = assemble(df, features, order_by)
        model = self.fit_rows(rows, *shape(rows))
        model.features = features
        return model

    def fit_rows(self, rows: DataFrame, n: int, d: int) -> GMMModel:
        """Over (row_id, features) of that many rows and features."""
        if not 1 <= self.k <= n:
            raise InvalidClusterCount(f"{self.k} components of {n} rows")
        if plan(n, d, self.plan) == "local":

            def solve(x: np.ndarray) -> dict[str, np.ndarray]:
                (w, m, v), ll = fit_array(x, self.k, self.max_iter, self.tol)
                return {"w": w, "m": m, "v": v, "ll": np.array([ll])}

            found = in_one_task(rows, solve)
            state, ll = (found["w"], found["m"], found["v"]), float(found["ll"][0])
        else:
            rows = stored(rows)
            centers = lloyd.fit_rows(rows.df, self.k, max_iter=50, wanted="distributed").centers
            state, ll = em(lambda s: added_up(rows.df, lambda x: e_sums(x, s)), start(centers, added_up(rows.df, lambda x: square_sums(x, centers))), self.max_iter, self.tol)
            rows.remove()
        return GMMModel(*state, ll, bic(ll, n, self.k, d))


def bic_select_k(sample: np.ndarray, ks: range, max_iter: int = 100, tol: float = 1e-4, fallback: int = 2) -> int:
    """The k of least BIC, the first of equals; ks with fewer than two rows each are passed over."""
    best, at = math.inf, fallback
    for k in ks:
        if len(sample) >= 2 * k:
            score = bic(fit_array(sample, k, max_iter, tol)[1], len(sample), k, sample.shape[1])
            if score < best:
                best, at = score, k
    return at
