"""Operators on the map's grid of units: smoothing, threshold, components, watershed, spanning tree. A grid is a model's size."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def influence(m: int, n: int, unit: int, radius: float, rate: float) -> np.ndarray:
    """The Gaussian share of every unit for one best-matching unit."""
    r, c = np.indices((m, n))
    return rate * np.exp(-((r - unit // n) ** 2 + (c - unit % n) ** 2) / (2 * max(radius * radius, 1e-18)))


def smooth(hits: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, not normalised, zero beyond the edges, cut at ceil(3 sigma)."""
    sigma = max(sigma, 1e-6)
    reach = math.ceil(3 * sigma)

    def band(size: int) -> np.ndarray:
        gap = np.abs(np.subtract.outer(np.arange(size), np.arange(size)))
        return np.where(gap <= reach, np.exp(-(gap**2) / (2 * sigma * sigma)), 0.0)

    return band(hits.shape[0]) @ hits @ band(hits.shape[1])


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The lower edge of the histogram bin that parts the values best, the first of equals; the least value if they are flat."""
    v = np.asarray(values, float).ravel()
    low, high = v.min(), v.max()
    if high - low < 1e-12:
        return float(low)
    p = np.bincount(((v - low) / (high - low) * (bins - 1)).astype(int), minlength=bins) / len(v)
    weight, moment = np.cumsum(p), np.cumsum(p * np.arange(bins))
    rest = 1 - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (moment / weight - (moment[-1] - moment) / rest) ** 2
    between[(weight <= 0) | (rest <= 1e-12)] = -1
    return float(low + int(np.argmax(between)) / (bins - 1) * (high - low))


def _around(unit: int, m: int, n: int) -> list[int]:
    """Neighbours: up, down, left, right."""
    r, c = divmod(unit, n)
    return [unit - n] * (r > 0) + [unit + n] * (r < m - 1) + [unit - 1] * (c > 0) + [unit + 1] * (c < n - 1)


def components(core: np.ndarray, m: int, n: int) -> np.ndarray:
    """4-connected components of the core units, numbered in row-major order of discovery; -1 elsewhere."""
    label, found = np.full(m * n, -1), 0
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        label[start], queue = found, deque([int(start)])
        while queue:
            for other in _around(queue.popleft(), m, n):
                if core[other] and label[other] < 0:
                    label[other] = found
                    queue.append(other)
        found += 1
    return label


def watershed(density: np.ndarray, core: np.ndarray, m: int, n: int) -> np.ndarray:
    """Basins of the strict peaks among core units, by decreasing density, flooded breadth first; a core unit that no basin reaches is -1.

    Without any strict peak the densest core unit, the last of equals, is the only seed.
    """
    v = np.asarray(density, float).ravel()
    cores = np.flatnonzero(core)
    label = np.full(m * n, -1)
    if not len(cores):
        return label
    peaks = [int(u) for u in cores if all(v[u] > v[o] for o in _around(int(u), m, n) if core[o])]
    if not peaks:
        peaks = [int(cores[len(cores) - 1 - int(np.argmax(v[cores][::-1]))])]
    queue: deque[int] = deque()
    for k, u in enumerate(sorted(peaks, key=lambda u: -v[u])):
        label[u] = k
        queue.append(u)
    while queue:
        u = queue.popleft()
        for o in _around(u, m, n):
            if core[o] and label[o] < 0:
                label[o] = label[u]
                queue.append(o)
    return label


def cut_tree(weights: np.ndarray, m: int, n: int, k: int) -> np.ndarray:
    """Unit labels after cutting the k - 1 heaviest edges of the minimum spanning tree over grid edges."""
    edges = sorted((float(np.sqrt(((weights[u] - weights[o]) ** 2).sum())), u, o) for u in range(m * n) for o in _around(u, m, n) if o > u)
    up = list(range(m * n))

    def root(u: int) -> int:
        while up[u] != u:
            up[u] = up[up[u]]
            u = up[u]
        return u

    tree = []
    for e in edges:
        a, b = root(e[1]), root(e[2])
        if a != b:
            up[max(a, b)] = min(a, b)
            tree.append(e)
    kept = tree[: max(0, len(tree) - (k - 1))]
    near: dict[int, list[int]] = {}
    for _, a, b in kept:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label, found = np.full(m * n, -1), 0
    for start in range(m * n):
        if label[start] < 0:
            label[start], queue = found, deque([start])
            while queue:
                for o in near.get(queue.popleft(), []):
                    if label[o] < 0:
                        label[o] = found
                        queue.append(o)
            found += 1
    return label


def smooth_table(grid: DataFrame, sigma: float, value: str = "hits") -> DataFrame:
    """grid_row, grid_col, density: `smooth` as two joins of the grid with itself, for SQL's sake."""
    reach, two = math.ceil(3 * max(sigma, 1e-6)), 2 * max(sigma, 1e-6) ** 2

    def along(df: DataFrame, axis: str, v: str) -> DataFrame:
        fixed = "grid_col" if axis == "grid_row" else "grid_row"
        other = df.select(F.col(fixed).alias("f"), F.col(axis).alias("x"), F.col(v).alias("v"))
        near = df.select("grid_row", "grid_col").join(F.broadcast(other), (F.col(fixed) == F.col("f")) & (F.abs(F.col(axis) - F.col("x")) <= reach))
        return near.groupBy("grid_row", "grid_col").agg(F.sum(F.col("v") * F.exp(-F.pow(F.col(axis) - F.col("x"), 2) / two)).alias("density"))

    return along(along(grid, "grid_row", value), "grid_col", "density")


def otsu_table(values: DataFrame, v: str = "density", bins: int = 256) -> DataFrame:
    """threshold: `otsu` as a grouped histogram and running sums over its at most `bins` rows."""
    ends = values.agg(F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high"), F.count(F.lit(1)).alias("all"))
    at = F.when(F.col("high") - F.col("low") < 1e-12, 0).otherwise(((F.col(v) - F.col("low")) / (F.col("high") - F.col("low")) * (bins - 1)).cast("int"))
    hist = values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg((F.count(F.lit(1)) / F.first("all")).alias("p"), F.first("low").alias("low"), F.first("high").alias("high"))
    run, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    sums = hist.withColumn("w", F.sum("p").over(run)).withColumn("s", F.sum(F.col("p") * F.col("bin")).over(run)).withColumn("t", F.sum(F.col("p") * F.col("bin")).over(whole))
    between = F.when(1 - F.col("w") > 1e-12, F.col("w") * (1 - F.col("w")) * F.pow(F.col("s") / F.col("w") - (F.col("t") - F.col("s")) / (1 - F.col("w")), F.lit(2))).otherwise(-1.0)
    best = sums.agg(F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("i"))).alias("best"), F.first("low").alias("low"), F.first("high").alias("high"))
    return best.select((F.col("low") - F.col("best.i") / (bins - 1) * (F.col("high") - F.col("low"))).alias("threshold"))
