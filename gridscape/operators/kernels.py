"""Numeric kernels on numpy arrays: distances, Lloyd steps, farthest points, the ordered fold of map training.

Ties: a nearest unit is the first of equals; a farthest point, a most likely component and a best score are the last of equals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

CLOSE = 1e-9


def first_min(d: np.ndarray) -> np.ndarray:
    return np.argmin(d, axis=-1)


def last_max(v: np.ndarray) -> int:
    return len(v) - 1 - int(np.argmax(v[::-1]))


def cross_l2sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T))


def inverse_norms(x: np.ndarray) -> np.ndarray:
    n2 = (x * x).sum(axis=1)
    return np.where(n2 > 0, 1 / np.maximum(np.sqrt(np.maximum(n2, 0)), 1e-12), 1e12)


def distances(x: np.ndarray, c: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The matrix of distances of rows to rows."""
    if metric == "cosine":
        return np.clip(1 - (x @ c.T) * inverse_norms(x)[:, None] * inverse_norms(c)[None, :], 0.0, 2.0)
    if metric == "manhattan":
        return np.stack([np.abs(x - row).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0))
    d2 = cross_l2sq(x, c)
    return d2 if metric == "sqeuclidean" else np.sqrt(d2)


def nearest(x: np.ndarray, c: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """(unit, distance) of each row: by the matrix product, and where that leaves more than one unit close, by direct differences."""
    if metric in ("cosine", "manhattan"):
        d = distances(x, c, metric)
        unit = first_min(d)
        return unit, d[np.arange(len(x)), unit]
    unit = nearest_l2(x, c)
    exact = ((x - c[unit]) ** 2).sum(axis=1)
    return unit, exact if metric == "sqeuclidean" else np.sqrt(exact)


def nearest_l2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d2 = cross_l2sq(x, c)
    unit = first_min(d2)
    low = d2[np.arange(len(x)), unit]
    close = np.flatnonzero((d2 <= (low + CLOSE * (1 + low))[:, None]).sum(axis=1) > 1)
    step = max(1, (1 << 20) // max(1, c.size))
    for i in range(0, len(close), step):
        rows = close[i : i + step]
        unit[rows] = first_min(((x[rows][:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    return unit


#: Numbers of a strip of rows, or of a strip's matrix, that are worked on at a time, so that they stay in a core's cache.
STRIP = 1 << 17


def l2sq_strips(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of x, their squared distances to all of y), strip by strip; the matrix may be changed in place."""
    xx, yy, turned = (x * x).sum(axis=1), (y * y).sum(axis=1), np.ascontiguousarray(y.T)
    step = max(1, STRIP // max(1, len(y)))
    for i in range(0, len(x), step):
        s = slice(i, i + step)
        both = x[s] @ turned
        both *= -2
        d2 = xx[s, None] + yy
        d2 += both
        yield s, np.maximum(d2, 0.0, out=d2)


def farthest_points(x: np.ndarray, k: int, start: int | None = None) -> np.ndarray:
    """Positions of k rows: the one farthest from the mean (or `start`), then each time the one farthest from all chosen."""
    start = last_max(((x - x.mean(axis=0)) ** 2).sum(axis=1)) if start is None else start
    chosen = [start]
    near = ((x - x[start]) ** 2).sum(axis=1)
    while len(chosen) < k:
        open_ = near.copy()
        open_[chosen] = -np.inf
        chosen.append(last_max(open_))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def lloyd_sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By cluster: rows, sum of squares and sums about the old centre; what a Lloyd step needs, and what adds up over batches."""
    out = np.zeros((len(c), 2 + x.shape[1]))
    step = max(1, STRIP // max(1, *c.shape))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        label = nearest_l2(part, c)
        away = part - c[label]
        out += (label == np.arange(len(c))[:, None]).astype(float) @ np.column_stack([np.ones(len(part)), (away**2).sum(axis=1), away])
    return out


def lloyd_step(sums: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(new centres, squared shift, inertia of the old labels about the new centres); an empty cluster keeps its centre."""
    n = sums[:, 0]
    shift = np.where(n[:, None] > 0, sums[:, 2:] / np.maximum(n, 1)[:, None], 0.0)
    return c + shift, float((shift**2).sum()), float(sums[:, 1].sum() - (n * (shift**2).sum(axis=1)).sum())


def lloyd(step, c: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """(centres, inertia, passes): step(c) gives lloyd_sums over all rows; at the end labels and inertia are taken anew."""
    before, passes = math.inf, 0
    while passes < max_iter:
        passes += 1
        c, moved, inertia = lloyd_step(step(c), c)
        if moved < tol * tol or abs(before - inertia) < tol:
            break
        before = inertia
    return c, float(step(c)[:, 1].sum()), passes


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def row_hashes(ids: np.ndarray, *values: int) -> np.ndarray:
    """Spark's xxhash64 of a long and ints, so that a task orders and draws rows as a plan of Columns does."""
    lane = _rotated(np.asarray(ids, np.int64).view(np.uint64) * _P[1], 31) * _P[0]
    h = _finished(_rotated(lane ^ (np.uint64(42 + 8) + _P[4]), 27) * _P[0] + _P[3])
    for v in values:
        lane = np.array([v & 0xFFFFFFFF], np.uint64) * _P[0]
        h = _finished(_rotated((h + _P[4] + np.uint64(4)) ^ lane, 23) * _P[1] + _P[2])
    return h.view(np.int64)


def hashed_order(ids: np.ndarray, *values: int) -> np.ndarray:
    return np.lexsort((ids, row_hashes(ids, *values)))


def drawn(ids: np.ndarray, near: np.ndarray, taken: list[int], seed: int, turn: int) -> tuple[int, float, float]:
    """(row, key, second key): the row of least key is drawn with probability in proportion to `near`, whatever the parts the rows lie in.

    An exponential race: a row's time is drawn by the hash of its id, seed and turn, and runs at the speed of its weight. Rows without
    weight come last, those taken before last of all.
    """
    time = -np.log(((row_hashes(ids, seed, turn).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
    time = np.where(np.isin(ids, np.array(taken, np.int64)), np.inf, time)
    key = np.full(len(ids), np.inf)
    np.divide(time, near, out=key, where=near > 0)
    best = int(np.lexsort((ids, time, key))[0])
    return best, float(key[best]), float(time[best])


def d2_sampling(x: np.ndarray, k: int, ids: np.ndarray, seed: int) -> np.ndarray:
    """k-means++ proper: each next seed with probability in proportion to its squared distance to the chosen."""
    chosen: list[int] = []
    near = np.ones(len(x))
    while len(chosen) < k:
        chosen.append(drawn(ids, near, [int(ids[i]) for i in chosen], seed, len(chosen))[0])
        d2 = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        near = d2 if len(chosen) == 1 else np.minimum(near, d2)
    return x[chosen]


def quick_exp(x: np.ndarray) -> np.ndarray:
    series = np.ones_like(x)
    for k in range(6, 0, -1):
        series = 1 + x / k * series
    with np.errstate(over="ignore"):
        return np.where(x < -100, 0.0, np.where(x > 100, np.inf, np.where(np.abs(x) < 2, series, np.exp(np.clip(x, -700, 700)))))


class Schedule:
    """Rate and radius by the global index of a sample: rate0 * e^(-5p), radius0 * e^(-3p) with p = index / total."""

    def __init__(self, rate: float, radius: float, total: int, last: tuple[float, float] | None = None) -> None:
        self.rate0, self.radius0, self.total, self.last = rate, radius, max(1, total), last

    def at(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = g / self.total
        rate, radius = self.rate0 * np.exp(-5 * p), np.maximum(self.radius0 * np.exp(-3 * p), 1e-12)
        if self.last is not None:  # a trained map's first sample still has the rate and radius that training ended with
            rate, radius = np.where(g == 0, self.last[0], rate), np.where(g == 0, self.last[1], radius)
        return rate, radius

    def end(self) -> tuple[float, float]:
        rate, radius = self.at(np.array([float(self.total)]))
        return float(rate[0]), float(radius[0])


def influence(bmu: np.ndarray, g: np.ndarray, schedule: Schedule, n: int, units: int, exp_mode: str = "exact", cutoff: bool = True) -> np.ndarray:
    """h of every sample (rows) for every unit: Gaussian in grid distance, cut off beyond three radii and below 1e-8."""
    rate, radius = (a[:, None] for a in schedule.at(g))
    unit = np.arange(units)
    dr, dc = np.abs(unit // n - (bmu // n)[:, None]), np.abs(unit % n - (bmu % n)[:, None])
    x = -(dr * dr + dc * dc) / (2 * np.maximum(radius**2, 1e-18))
    h = rate * (quick_exp(x) if exp_mode == "taylor" else np.exp(np.maximum(x, -745)))
    if cutoff:
        reach = np.ceil(3 * radius)
        h[(dr > reach) | (dc > reach) | (h < 1e-8)] = 0.0
    return h


def neighbourhood(n: int, units: int, radius: float) -> np.ndarray:
    """The Gaussian in grid distance of every unit to every unit, up to three radii; no rate, so nothing within them is too small to count."""
    unit = np.arange(units)
    dr, dc = (np.abs(a[:, None] - a) for a in (unit // n, unit % n))
    return np.where(np.maximum(dr, dc) <= np.ceil(3 * radius), np.exp(-(dr * dr + dc * dc) / (2 * max(radius**2, 1e-18))), 0.0)


def fold(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) of the samples in order: each maps w to (1 - h) w + h x, and all together w to A w + B.

    A sample's part of B is its h times all later (1 - h), a product over a suffix, so B is one matrix product.
    """
    keep = 1 - h
    later = np.ones_like(h)
    later[:-1] = np.cumprod(keep[:0:-1], axis=0)[::-1]
    return later[0] * keep[0], (h * later).T @ x


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return then[0] * first[0], then[0][:, None] * first[1] + then[1]


def train_batch(w: np.ndarray, x: np.ndarray, g: np.ndarray, schedule: Schedule, n: int, metric: str, exp_mode: str) -> np.ndarray:
    """One batch with the units found at its start."""
    bmu, _ = nearest(x, w, metric)
    for i in range(0, len(x), 256):
        a, b = fold(influence(bmu[i : i + 256], g[i : i + 256], schedule, n, len(w), exp_mode), x[i : i + 256])
        w = a[:, None] * w + b
    return w


def updated(w: np.ndarray, h: np.ndarray, x: np.ndarray, rule: str) -> np.ndarray:
    """One sample's update by the rule: euclidean moves toward x, cosine turns toward it at the same length, manhattan steps by sign."""
    h = h[:, None]
    if rule == "cosine":
        length = np.maximum(np.sqrt((w * w).sum(axis=1)), 1e-12)[:, None]
        unit, to = w / length, x / max(float(np.sqrt((x * x).sum())), 1e-12)
        return w + h * length * (to - unit * (unit @ to)[:, None])
    return w + h * (np.sign(x - w) if rule == "manhattan" else x - w)


def train_single(w: np.ndarray, x: np.ndarray, g: np.ndarray, schedule: Schedule, n: int, metric: str, exp_mode: str, cutoff: bool, rule: str = "euclidean") -> np.ndarray:
    """Sample by sample, each with the unit nearest to it at its turn."""
    for i in range(len(x)):
        bmu, _ = nearest(x[i : i + 1], w, metric)
        w = updated(w, influence(bmu, g[i : i + 1], schedule, n, len(w), exp_mode, cutoff)[0], x[i], rule)
    return w
