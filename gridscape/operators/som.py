"""Self-organizing maps: exact training as an ordered fold, scoring as a narrow projection, clustering of and through the map.

Within a batch units are those nearest at its start, and each sample's update w -> (1 - h) w + h x is affine, so a run of samples folds to one pair
(A, B) a unit. Spark partitions that hold consecutive positions fold on their own; the driver composes the pairs, of the map's size, in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import DimensionMismatch, InsufficientData, InvalidClusterCount, InvalidLearningRate, InvalidMetric
from gridscape.functions.vector import DISTANCES
from gridscape.operators import gridops, kernels, lloyd, metrics
from gridscape.operators.assign import codebook_table, hit_map, nearest, nearest_column
from gridscape.operators.seeding import ALIASES, AT_HAND, codebook_at_hand, init_codebook
from gridscape.plans.planner import added_up, in_one_task, lists, plan, vectors
from gridscape.plans.storage import Stored
from gridscape.schema import FeatureSpec, assemble, check_width, positions, shape

MOST_RATE = 1.76
#: Features that one task trains on, sample by sample, at a time.
SLICE_BYTES = 128 << 20
RULES = {"euclidean": "euclidean", "cosine": "cosine", "manhattan": "manhattan"}


@dataclass
class SOMModel:
    """weights of m x n units in row-major order, and how the next training starts: rate and radius, first and last."""

    weights: np.ndarray
    m: int
    n: int
    distance: str = "euclidean"
    learning_rate: float = 0.5
    neighbor_radius: float = 1.0
    last: tuple[float, float] | None = None
    features: str | list[str] = "features"

    @property
    def units(self) -> int:
        return self.m * self.n

    def _spec(self, df: DataFrame):
        names = (self.features,) if isinstance(self.features, str) else tuple(self.features)
        return FeatureSpec(names).column(df)

    def rows(self, df: DataFrame, order_by: str = "row_id", *keep: str) -> DataFrame:
        out = assemble(df, self.features, order_by, *keep)
        check_width(out, self.weights.shape[1])
        return out

    def transform(self, df: DataFrame, out: str = "bmu", distance: str | None = None) -> DataFrame:
        """df with the best-matching unit of each row (and its distance); lazy, narrow, and fit for a streaming df."""
        near = df.withColumn("_near", nearest_column(self.weights, self._spec(df), self.distance))
        named = near.withColumn(out, F.col("_near.unit"))
        return (named.withColumn(distance, F.col("_near.d")) if distance else named).drop("_near")

    def neurons(self, spark) -> DataFrame:
        return codebook_table(spark, self.weights, self.n).withColumnRenamed("unit", "neuron_id")

    def hits(self, df: DataFrame) -> np.ndarray:
        return np.array([r.hits for r in hit_map(self.transform(df), self.units, "bmu").orderBy("unit").collect()])

    def quantisation_error(self, df: DataFrame) -> float:
        return float(self.transform(df, distance="_d").agg(F.avg("_d")).first()[0])

    def mapped(self, df: DataFrame, labels: np.ndarray, out: str = "label") -> DataFrame:
        """df with the label of its unit."""
        book = F.array(*[F.lit(int(v)) for v in labels])
        return self.transform(df, "_bmu").withColumn(out, F.get(book, F.col("_bmu"))).drop("_bmu")

    def cluster(self, df: DataFrame, k: int, out: str = "label") -> DataFrame:
        """k-means of the units, looked up through each row's unit."""
        if not 1 <= k <= self.units:
            raise InvalidClusterCount(f"{k} clusters of {self.units} units")
        c, _, _ = lloyd.fit_array(self.weights, k)
        return self.mapped(df, kernels.nearest(self.weights, c)[0], out)

    def tree_cluster(self, df: DataFrame, k: int, out: str = "label") -> DataFrame:
        """The units' spanning tree over grid edges without its k - 1 heaviest."""
        return self.mapped(df, gridops.cut_tree(self.weights, self.m, self.n, k), out)

    def cluster_refined(self, df: DataFrame, k: int, order_by: str = "row_id", wanted: str = "auto", out: str = "label") -> DataFrame:
        """Lloyd from several seeds that the map suggests, and the best of them; see `refined_centers`."""
        centers = refined_centers(self, self.rows(df, order_by), k, wanted)
        return df.withColumn(out, nearest_column(centers, self._spec(df))["unit"])

    def evaluate(self, df: DataFrame, names: list[str] | str = "all", order_by: str = "row_id", pairwise_limit: int | None = None) -> dict[str, float | None]:
        rows = nearest(self.rows(df, order_by), self.weights, self.distance, unit="label", distance=None)
        return metrics.evaluate(rows, names, pairwise_limit)

    def bcubed(self, df: DataFrame, y: str) -> tuple[float, float]:
        r = metrics.bcubed(self.transform(df), "bmu", y).first()
        return r.precision, r.recall


@dataclass
class SOM:
    """bmu_refresh: 'batch' finds units at each batch's start, 'sample' at each sample's turn (sequential, one task at a time). exp_mode: 'exact' or 'taylor'.

    algorithm 'batch_map' is Kohonen's batch map, one aggregate an epoch: a faster way of training, not the same result.
    update: None follows the affine rule for any distance; 'cosine' or 'manhattan' use that distance's own rule, sample by sample.
    """

    m: int = 10
    n: int = 10
    learning_rate: float = 0.5
    neighbor_radius: float = 1.0
    init: str = "random"
    distance: str = "euclidean"
    max_iter: int | None = None
    seed: int = 0
    bmu_refresh: str = "batch"
    exp_mode: str = "exact"
    cutoff: bool = True
    algorithm: str = "online"
    update: str | None = None
    plan: str = "auto"

    def __post_init__(self) -> None:
        if self.learning_rate > MOST_RATE:
            raise InvalidLearningRate(f"{self.learning_rate} is above {MOST_RATE}")
        if self.distance not in DISTANCES:
            raise InvalidMetric(self.distance)
        if self.update is not None and self.update not in RULES:
            raise InvalidMetric(self.update)

    def fit(self, df: DataFrame, epochs: int, shuffle: bool = True, batch_size: int | None = None, features: str | list[str] = "features", order_by: str = "row_id", warm: SOMModel | None = None, seeds: np.ndarray | None = None) -> SOMModel:
        """seeds: the units to begin with, where `init` has been run already."""
        rows = assemble(df, features, order_by)
        count, d = shape(rows)
        if batch_size is not None and batch_size < 1:
            raise InsufficientData("a batch has at least one row")
        if warm is not None and warm.weights.shape != (self.m * self.n, d):
            raise DimensionMismatch(f"a map of {warm.weights.shape} and {d} features")
        if seeds is not None and seeds.shape != (self.m * self.n, d):
            raise DimensionMismatch(f"seeds of {seeds.shape} and {d} features")
        one_by_one = self.bmu_refresh == "sample" or self.update in ("cosine", "manhattan")
        local = self.algorithm != "batch_map" and plan(count, d, self.plan) == "local"
        method, units = ALIASES.get(self.init, self.init), self.m * self.n
        inside = local and warm is None and seeds is None and method in AT_HAND  # seeds and training are one job then
        if inside and units > count and method in ("som++", "kmeans", "kmeans++"):
            raise InvalidClusterCount(f"{units} seeds of {count} rows")
        w = warm.weights if warm is not None else seeds if seeds is not None else None if inside else init_codebook(rows, self.init, units, self.seed, self.plan)
        size = batch_size or min(max(count // 10, 64), count)
        total = min(epochs * count, self.max_iter) if self.max_iter is not None else epochs * count
        schedule = kernels.Schedule(self.learning_rate, self.neighbor_radius, total, warm.last if warm is not None else None)
        if self.algorithm == "batch_map":
            w = self._batch_map(rows, w, epochs, schedule, count)
        elif local:

            def solve(x: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
                start = codebook_at_hand(x, method, units, self.seed) if inside else w
                return {"w": self._train(x, ids, start, epochs, shuffle, size, total, schedule, one_by_one)}

            w = in_one_task(rows, solve, with_ids=True)["w"]
        elif one_by_one:
            w = self._sequential(rows, w, epochs, shuffle, total, schedule, count, d)
        else:
            w = self._distributed(rows, w, epochs, shuffle, size, total, schedule, count)
        return SOMModel(w, self.m, self.n, self.distance, self.learning_rate, self.neighbor_radius, schedule.end(), features)

    def _train(self, x: np.ndarray, ids: np.ndarray, w: np.ndarray, epochs: int, shuffle: bool, size: int, total: int, schedule: kernels.Schedule, one_by_one: bool) -> np.ndarray:
        whole, done = x, 0
        for epoch in range(epochs):
            if shuffle:
                x = whole[kernels.hashed_order(ids, self.seed + epoch)]
            for i in range(0, len(x), size):
                batch = x[i : min(i + size, i + total - done)]
                g = np.arange(done, done + len(batch), dtype=float)
                if one_by_one:
                    w = kernels.train_single(w, batch, g, schedule, self.n, self.distance, self.exp_mode, self.cutoff, self.update or "euclidean")
                else:
                    w = kernels.train_batch(w, batch, g, schedule, self.n, self.distance, self.exp_mode)
                done += len(batch)
                if done >= total:
                    return w
        return w

    def _placed(self, rows: DataFrame, epoch: int, shuffle: bool) -> Stored:
        order = [F.xxhash64("row_id", F.lit(self.seed + epoch)), F.col("row_id")] if shuffle else [F.col("row_id")]
        return positions(rows, *order)

    def _sequential(self, rows: DataFrame, w: np.ndarray, epochs: int, shuffle: bool, total: int, schedule: kernels.Schedule, count: int, d: int) -> np.ndarray:
        """Sample by sample beyond what a task holds: one task after another takes the next slice of positions, of at most SLICE_BYTES."""
        done, size = 0, max(1, SLICE_BYTES // (8 * d))
        for epoch in range(epochs):
            placed = self._placed(rows, epoch, shuffle)
            try:
                for i in range(0, count, size):
                    end = min(i + size, count, i + total - done)
                    part = placed.df.where((F.col("pos") >= i) & (F.col("pos") < end))
                    start, before = w, done
                    w = in_one_task(part, lambda x: {"w": kernels.train_single(start, x, np.arange(before, before + len(x), dtype=float), schedule, self.n, self.distance, self.exp_mode, self.cutoff, self.update or "euclidean")}, "pos")["w"]
                    done += end - i
                    if done >= total:
                        return w
            finally:
                placed.remove()
        return w

    def _distributed(self, rows: DataFrame, w: np.ndarray, epochs: int, shuffle: bool, size: int, total: int, schedule: kernels.Schedule, count: int) -> np.ndarray:
        done = 0
        for epoch in range(epochs):
            placed = self._placed(rows, epoch, shuffle)
            try:
                for i in range(0, count, size):
                    end = min(i + size, count, i + total - done)
                    w = fold_job(placed.df.where((F.col("pos") >= i) & (F.col("pos") < end)), w, schedule, done - i, self)
                    done += end - i
                    if done >= total:
                        return w
            finally:
                placed.remove()
        return w

    def _batch_map(self, rows: DataFrame, w: np.ndarray, epochs: int, schedule: kernels.Schedule, count: int) -> np.ndarray:
        for epoch in range(epochs):
            sums = added_up(rows, lambda x, w=w: _unit_sums(x, w, self.distance))
            h = kernels.neighbourhood(self.n, len(w), float(schedule.at(np.array([float(epoch * count)]))[1][0]))
            weight = h.T @ sums[:, 0]
            w = np.where(weight[:, None] > 0, (h.T @ sums[:, 1:]) / np.where(weight > 0, weight, 1.0)[:, None], w)
        return w


def _unit_sums(x: np.ndarray, w: np.ndarray, metric: str) -> np.ndarray:
    out = np.zeros((len(w), 1 + x.shape[1]))
    np.add.at(out, kernels.nearest(x, w, metric)[0], np.column_stack([np.ones(len(x)), x]))
    return out


#: Pairs that the driver composes at most; more are composed by executors first.
MOST_PAIRS = 64
PAIR = "pos long, a array<double>, b array<double>"


def _pair(pos: int, pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(pos)]), lists(pair[0][None, :]), lists(pair[1].reshape(1, -1))], ["pos", "a", "b"])


def _composed(batches):
    """The pairs of a partition, in order, as one."""
    found = None
    for b in batches:
        for pos, a, c in zip(b.column(0).to_pylist(), vectors(b.column(1)), vectors(b.column(2)), strict=True):
            pair = (a, c.reshape(len(a), -1))
            found = (pos, pair) if found is None else (found[0], kernels.compose(found[1], pair))
    if found is not None:
        yield _pair(*found)


def fold_job(batch: DataFrame, w: np.ndarray, schedule: kernels.Schedule, shift: int, som: SOM) -> np.ndarray:
    """One batch: a pair (A, B) from each run of consecutive positions that a partition has, composed in order.

    A file of positions is one run or several whole ones, so there are no more pairs than files; above MOST_PAIRS, ranges of them are composed first.
    """

    def run(batches):
        begin = after = pair = None
        for b in batches:
            if not b.num_rows:
                continue
            pos, x = b.column(0).to_numpy(), vectors(b.column(1))
            bmu, _ = kernels.nearest(x, w, som.distance)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(pos) != 1) + 1, [len(pos)]])
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if pair is not None and pos[first] != after:
                    yield _pair(begin, pair)
                    pair = None
                begin, after = pos[first] if pair is None else begin, pos[end - 1] + 1
                for i in range(first, end, 256):
                    s = slice(i, min(i + 256, end))
                    part = kernels.fold(kernels.influence(bmu[s], (pos[s] + shift).astype(float), schedule, som.n, len(w), som.exp_mode), x[s])
                    pair = part if pair is None else kernels.compose(pair, part)
        if pair is not None:
            yield _pair(begin, pair)

    pairs = batch.sortWithinPartitions("pos").select("pos", "features").mapInArrow(run, PAIR)
    if len(batch.inputFiles()) > MOST_PAIRS:
        pairs = pairs.repartitionByRange(MOST_PAIRS, "pos").sortWithinPartitions("pos").mapInArrow(_composed, PAIR)
    for r in sorted(pairs.collect(), key=lambda r: r.pos):
        w = np.array(r.a)[:, None] * w + np.array(r.b).reshape(w.shape)
    return w


def spread_units(weights: np.ndarray, hits: np.ndarray, start: int, k: int) -> np.ndarray:
    """k units: the start, then each time the first that maximises (hits + 0.5) * squared distance to those chosen."""
    chosen = [start]
    near = ((weights - weights[start]) ** 2).sum(axis=1)
    while len(chosen) < k:
        score = (hits + 0.5) * near
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        near = np.minimum(near, ((weights - weights[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def unit_cluster_means(model: SOMModel, rows: DataFrame, unit_label: np.ndarray, hits: np.ndarray, k: int) -> np.ndarray:
    """Means of raw rows by their unit's cluster; a cluster without rows takes its units' mean, weighted by max(hits, 0.5)."""
    sums = added_up(rows, lambda x: _label_sums(x, unit_label[kernels.nearest(x, model.weights, model.distance)[0]], k))
    full = np.zeros((k, 1 + model.weights.shape[1]))
    full[: sums.shape[0], : sums.shape[1]] = sums
    out = np.zeros((k, model.weights.shape[1]))
    for c in range(k):
        if full[c, 0] > 0:
            out[c] = full[c, 1:] / full[c, 0]
        elif (unit_label == c).any():
            own = unit_label == c
            out[c] = np.average(model.weights[own], axis=0, weights=np.maximum(hits[own], 0.5))
    return out


def _label_sums(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, 1 + x.shape[1]))
    np.add.at(out, label, np.column_stack([np.ones(len(x)), x]))
    return out


def _score(rows: DataFrame, centers: np.ndarray, whole: tuple[float, float]) -> float | None:
    """Calinski-Harabasz of the assignment to these centres, from one pass; None where it isn't defined."""
    n, spread = whole
    sums = added_up(rows, lambda x: kernels.lloyd_sums(x, centers))
    live = sums[:, 0] > 0
    k = int(live.sum())
    if k <= 1:
        return 0.0
    within = sums[live, 1].sum() - ((sums[live, 2:] ** 2).sum(axis=1) / sums[live, 0]).sum()
    return None if within < 1e-12 else ((spread - within) / (k - 1)) / (within / (n - k))


def refined_centers(model: SOMModel, rows: DataFrame, k: int, wanted: str = "auto") -> np.ndarray:
    """Candidates, each by Lloyd: from raw means through clustered units, from far apart units, from three spreads by hits, from far apart rows.

    Among those within 5 % of the least inertia the first of largest Calinski-Harabasz wins; if that is nowhere defined, the first of least inertia.
    """
    if not 1 <= k <= model.units:
        raise InvalidClusterCount(f"{k} clusters of {model.units} units")
    rows = rows.persist()
    try:
        hits = np.array([r.hits for r in hit_map(nearest(rows, model.weights, model.distance), model.units).orderBy("unit").collect()])
        own, _, _ = lloyd.fit_array(model.weights, k)
        seeds = [unit_cluster_means(model, rows, kernels.nearest(model.weights, own)[0], hits, k), model.weights[kernels.farthest_points(model.weights, k)]]
        seeds += [model.weights[spread_units(model.weights, hits, int(s), k)] for s in np.argsort(-hits, kind="stable")[:3]]
        pool = lloyd.fit_several(rows, k, [*seeds, None], wanted)
        least = min(p.inertia for p in pool)
        moments = added_up(rows, lambda x: np.concatenate([[len(x), (x * x).sum()], x.sum(axis=0)])[None, :])[0]
        whole = (moments[0], moments[1] - (moments[2:] ** 2).sum() / moments[0])
        best, top = None, -math.inf
        for p in pool:
            if p.inertia <= 1.05 * least:
                score = _score(rows, p.centers, whole)
                if score is not None and score > top:
                    best, top = p, score
        return (best or min(pool, key=lambda p: p.inertia)).centers
    finally:
        rows.unpersist()
