"""Choosing the number of clusters: elbow, gap statistic, BIC, stratified samples, smoothing bandwidths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscape.functions.prep import order_statistics
from gridscape.operators import gmm, kernels, lloyd
from gridscape.plans.planner import in_one_task, plan, vectors

SAMPLE = 2_000
FLAT = 1e-9


def elbow(curve: DataFrame) -> DataFrame:
    """k_elbow of (k, inertia): the largest second difference of the curve scaled to [0, 1], the last of equals; 2 if it is flat or has under three points."""
    whole, w = Window.partitionBy(), Window.orderBy("k")
    span = F.greatest(F.max("inertia").over(whole) - F.min("inertia").over(whole), F.lit(1e-12))
    scaled = curve.select("k", ((F.col("inertia") - F.min("inertia").over(whole)) / span).alias("y"))
    bends = scaled.select("k", (F.lag("y").over(w) - 2 * F.col("y") + F.lead("y").over(w)).alias("bend"))
    best = bends.where(F.col("bend").isNotNull()).agg(F.max(F.struct("bend", "k")).alias("b"))
    return best.select(F.when(F.col("b.bend") >= FLAT, F.col("b.k")).otherwise(2).cast("int").alias("k_elbow"))


def elbow_of(ks: list[int], inertias: list[float]) -> int:
    """As `elbow`, of a curve at hand."""
    if len(ks) < 3:
        return 2
    y = np.array(inertias, float)
    y = (y - y.min()) / max(y.max() - y.min(), 1e-12)
    bend = y[:-2] - 2 * y[1:-1] + y[2:]
    at = kernels.last_max(bend)
    return ks[at + 1] if bend[at] >= FLAT else 2


def candidates(k_elbow: int, k_max: int) -> list[int]:
    """The elbow and two on either side, within [2, k_max]."""
    return sorted({max(2, k_elbow - 2), max(2, k_elbow - 1), k_elbow, min(k_max, k_elbow + 1), min(k_max, k_elbow + 2)})


def inertia_curve(x: np.ndarray, ks: range, max_iter: int = 100) -> list[float]:
    return [lloyd.fit_array(x, k, max_iter=max_iter)[1] for k in ks]


def over_tasks(spark, sample: np.ndarray, tasks: list[tuple[int, int]], solve) -> dict[tuple[int, int], float]:
    """solve(sample, k, ref) for each (k, ref), each in a task of its own, over a sample of bounded size that ships with the plan."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ks, refs = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [solve(sample, k, r) for k, r in zip(ks, refs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], ["k", "ref", "value"])

    rows = spark.createDataFrame(tasks, "k int, ref int").repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    return {(r.k, r.ref): r.value for r in rows.mapInArrow(run, "k int, ref int, value double").collect()}


def _log_inertia(sample: np.ndarray, k: int, ref: int, seed: int) -> float:
    """log W of the sample (ref -1), or of as many points uniform in its bounding box."""
    x = sample
    if ref >= 0:
        rng = np.random.default_rng([seed, k, ref])
        x = rng.uniform(sample.min(axis=0), sample.max(axis=0), sample.shape)
    w = lloyd.fit_array(x, k, max_iter=100)[1]
    return math.log(w) if w > 0 else math.nan


def _best_gap(found: dict[tuple[int, int], float], ks: list[int], n_refs: int, fallback: int) -> int:
    best, at = -math.inf, fallback
    for k in ks:
        refs = [found[k, r] for r in range(n_refs) if not math.isnan(found[k, r])]
        if refs and not math.isnan(found[k, -1]) and sum(refs) / len(refs) - found[k, -1] >= best:
            best, at = sum(refs) / len(refs) - found[k, -1], k
    return at


BIC = -2


def select_k(spark, sample: np.ndarray, gap_ks: list[int], bic_ks: list[int], n_refs: int = 10, fallback: int = 2) -> tuple[int, int]:
    """(k by the gap statistic, k by BIC), all fits in one job; ks with under two rows each are passed over."""
    gap_ks, bic_ks = ([k for k in ks if len(sample) >= 2 * k] for ks in (gap_ks, bic_ks))
    seed = len(sample)
    solve = lambda x, k, r: gmm.bic(gmm.fit_array(x, k)[1], len(x), k, x.shape[1]) if r == BIC else _log_inertia(x, k, r, seed)
    tasks = [(k, BIC) for k in bic_ks] + [(k, r) for k in gap_ks for r in range(-1, n_refs)]
    found = over_tasks(spark, sample, tasks, solve) if tasks else {}
    return _best_gap(found, gap_ks, n_refs, fallback), min(bic_ks, key=lambda k: (found[k, BIC], k)) if bic_ks else fallback


def gap_statistic(spark, sample: np.ndarray, ks: list[int], n_refs: int = 10, fallback: int = 2) -> int:
    """The k of the largest mean log W of references less log W of the sample, the last of equals; ks with under two rows each are passed over."""
    return select_k(spark, sample, ks, [], n_refs, fallback)[0]


def bic_k(spark, sample: np.ndarray, ks: list[int], fallback: int = 2) -> int:
    """The k of least BIC, the first of equals, each k in a task of its own."""
    return select_k(spark, sample, [], ks, 0, fallback)[1]


def stratified_sample(rows: DataFrame, label: str = "label", most: int = SAMPLE, seed: int | None = None) -> DataFrame:
    """At most `most` rows: an equal quota of each label by a hash of the row, then others by hash up to the whole number. All, if there are no more.

    Ranking within a label takes only each partition's best (the limit on row_number is pushed below the exchange).
    """
    n = rows.count()
    if n <= most:
        return rows
    seed = n if seed is None else seed
    k = (rows.agg(F.max(label)).first()[0] or 0) + 1
    quota = max(1, most // k)
    chance = F.xxhash64("row_id", F.lit(seed))
    first = rows.withColumn("_h", chance).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", "row_id"))).where(F.col("_r") <= quota).drop("_r", "_h")
    got = first.count()
    if got >= most:
        return first
    rest = rows.join(first.select("row_id"), "row_id", "left_anti").orderBy(chance, "row_id").limit(most - got)
    return first.unionByName(rest.select(first.columns))


def smoothing_bandwidth(rows: DataFrame, m: int, n: int, method: str = "silverman") -> DataFrame:
    """sigma: Silverman's 0.9 min(s, IQR / 1.34) n^-1/5 or Scott's n^(-1/(d+4)) s, from deviations and order statistics averaged over features."""
    each = rows.select(F.posexplode("features").alias("dim", "x"))
    stats = each.groupBy("dim").agg(F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("rows"))
    joined = stats.join(order_statistics(each, "x", {"q1": 0.25, "q3": 0.75}, "dim"), "dim").agg(F.greatest(F.avg("s"), F.lit(1e-12)).alias("s"), F.greatest(F.avg(F.col("q3") - F.col("q1")), F.lit(1e-12)).alias("iqr"), F.max("rows").cast("double").alias("rows"), F.count(F.lit(1)).alias("d"))
    silverman = 0.9 * F.least(F.col("s"), F.col("iqr") / 1.34) * F.pow("rows", F.lit(-0.2))
    scott = F.pow(F.col("rows"), -1 / (F.col("d") + 4)) * F.col("s")
    return joined.select(F.greatest(F.lit(0.5), F.least(F.lit(max(m, n) / 2), silverman if method == "silverman" else scott)).alias("sigma"))


def smoothing_sigma(rows: DataFrame, m: int, n: int, method: str, shape: tuple[int, int], wanted: str = "auto") -> float:
    """As `smoothing_bandwidth`, in one task where the rows fit one."""
    if plan(*shape, wanted) != "local":
        return float(smoothing_bandwidth(rows, m, n, method).first()[0])

    def solve(x: np.ndarray) -> dict[str, np.ndarray]:
        ranked = np.sort(x, axis=0)
        s, iqr = max(x.std(axis=0).mean(), 1e-12), max((ranked[math.floor(len(x) * 0.75)] - ranked[math.floor(len(x) * 0.25)]).mean(), 1e-12)
        raw = 0.9 * min(s, iqr / 1.34) * len(x) ** -0.2 if method == "silverman" else len(x) ** (-1 / (x.shape[1] + 4)) * s
        return {"sigma": np.array([max(0.5, min(max(m, n) / 2, raw))])}

    return float(in_one_task(rows, solve)["sigma"][0])


def sample_array(rows: DataFrame) -> np.ndarray:
    """A bounded sample's features, by row_id."""
    return vectors(rows.orderBy("row_id").select("features").toArrow()["features"])
