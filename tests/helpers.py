"""Small inputs by formula, and plain-Python definitions to hold results against."""

from __future__ import annotations

import numpy as np


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in row], *([int(labels[i])] if labels is not None else [])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>" + (", label int" if labels is not None else ""))


def two_groups(n: int = 20) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([[0.01 * i + 0.01 * j for j in range(2)] if i < n // 2 else [100 + 0.01 * i] * 2 for i in range(n)])
    return x, np.array([0] * (n // 2) + [1] * (n - n // 2))


def waves(n: int = 100, d: int = 4) -> np.ndarray:
    i, j = np.arange(n)[:, None], np.arange(d)[None, :]
    return (1 + j / d) * np.cos(0.7 * i) + 0.3 * np.sin(1.9 * i * (j + 1))


def line_blobs() -> np.ndarray:
    return np.array([[0.01 * i, 0.01 * i] for i in range(60)] + [[8 + 0.01 * i, 0.01 * i] for i in range(60)])


def plain_lloyd(x: np.ndarray, c: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(steps):
        label = np.array([min(range(len(c)), key=lambda j: (((row - c[j]) ** 2).sum(), j)) for row in x])
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        if np.array_equal(new, c):
            break
        c = new
    return c, label
