"""Scores of a clustering: internal (features and labels), external (two labelings), classification.

Each returns a DataFrame of one row, so that it stays lazy; `value` turns one into a number. Internal scores read (row_id, features, label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscape.errors import InsufficientData, InvalidMetric
from gridscape.functions.prep import mean_vector
from gridscape.functions.vector import l2, l2sq
from gridscape.operators import kernels
from gridscape.operators.assign import neighbours
from gridscape.plans.planner import PAIR_TILE, lists, merged, pairwise, vectors
from gridscape.plans.storage import stored


def value(df: DataFrame) -> float:
    return float(df.first()[0])


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each left row and each label of the right block: sum, count, least and largest of the distances."""
    names = ["row_id", "label", "other", "total", "n", "low", "high"]
    if not (left.num_rows and right.num_rows):
        return pa.table(dict(zip(names, [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())], strict=True)))
    x, y = vectors(left["features"]), vectors(right["features"])
    labels = right["label"].to_numpy()
    order = np.argsort(labels, kind="stable")
    d = np.sqrt(kernels.cross_l2sq(x, y[order]))
    d[left["row_id"].to_numpy()[:, None] == right["row_id"].to_numpy()[order][None, :]] = 0.0
    own, first = np.unique(labels[order], return_index=True)
    sums, low, high = (f.reduceat(d, first, axis=1) for f in (np.add, np.minimum, np.maximum))
    count = np.diff(np.append(first, len(labels)))
    rep = lambda a: np.repeat(a, len(own))
    return pa.table({"row_id": rep(left["row_id"].to_numpy()), "label": rep(left["label"].to_numpy()), "other": np.tile(own, len(x)), "total": sums.ravel(), "n": np.tile(count, len(x)), "low": low.ravel(), "high": high.ravel()})


def _distances_by_label(rows: DataFrame) -> DataFrame:
    base = rows.select("row_id", "features", F.col("label").cast("long").alias("label"))
    parts = pairwise(base, base, _pair_sums, "row_id long, label long, other long, total double, n long, low double, high double", merge=merged(["row_id", "label", "other"], {"total": "sum", "n": "sum", "low": "min", "high": "max"}))
    return parts.groupBy("row_id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean of (b - a) / max(a, b): 0 for one cluster, a row alone in its cluster has a = 0, and rows with a = b = 0 don't count."""
    by = _distances_by_label(rows)
    own = F.col("label") == F.col("other")
    each = by.groupBy("row_id").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(0.0))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    s = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return each.agg(F.coalesce(F.avg(F.when(F.greatest("a", "b") > 0, s).otherwise(F.when(F.col("b").isNull(), F.lit(0.0)))), F.lit(0.0)).alias("silhouette"))


def _sums_by_label(left: pa.Table, right: pa.Table, at: np.ndarray, known: np.ndarray) -> pa.Table:
    """Of each left row, the sums of its distances to the right rows of each cluster: clusters of all labelings side by side, labeling by labeling."""
    if not (left.num_rows and right.num_rows):
        return pa.table({"row_id": pa.array([], pa.int64()), "labels": pa.array([], pa.list_(pa.int64())), "sums": pa.array([], pa.list_(pa.float64()))})
    x, y = vectors(left["features"]), vectors(right["features"])
    own = _cluster_columns(right["labels"], at, known)
    member = np.zeros((len(y), len(known)))
    member[np.arange(len(y))[:, None], own] = 1.0
    _, here, there = np.intersect1d(left["row_id"].to_numpy(), right["row_id"].to_numpy(), return_indices=True)
    sums = np.empty((len(x), len(known)))
    for s, d in kernels.l2sq_strips(x, y):
        inside = (here >= s.start) & (here < s.stop)
        d[here[inside] - s.start, there[inside]] = 0.0
        sums[s] = np.sqrt(d, out=d) @ member
    return pa.table({"row_id": left["row_id"], "labels": left["labels"], "sums": lists(sums)})


def _cluster_columns(labels: pa.ChunkedArray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each row's clusters stand in `known`, the sorted labels of one labeling after the other, which begin at `at`."""
    found = labels.combine_chunks().flatten().to_numpy().reshape(len(labels), -1)
    return np.stack([a + np.searchsorted(known[a:b], found[:, k]) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))], axis=1)


def _added_rows(found: pa.Table) -> pa.Table:
    """One row of each row_id, its sums added up."""
    ids = found["row_id"].to_numpy()
    own, first, at = np.unique(ids, return_index=True, return_inverse=True)
    sums = vectors(found["sums"])
    total = np.zeros((len(own), sums.shape[1]))
    order = np.argsort(at, kind="stable")
    np.add.reduceat(sums[order], np.searchsorted(at[order], np.arange(len(own))), axis=0, out=total)
    return pa.table({"row_id": pa.array(own), "labels": found["labels"].take(pa.array(first)), "sums": lists(total)})


def silhouettes(rows: DataFrame) -> list[float]:
    """`silhouette` of each labeling in the array `labels` of (row_id, features, labels), all from one pass over the pairs."""
    base = rows.select("row_id", "features", F.col("labels").cast("array<long>").alias("labels"))
    counts = base.select(F.posexplode("labels").alias("k", "label")).groupBy("k", "label").count().orderBy("k", "label").collect()  # a row a cluster
    known, size = np.array([r.label for r in counts], np.int64), np.array([r["count"] for r in counts], float)
    at = np.searchsorted([r.k for r in counts], np.arange(counts[-1].k + 2)) if counts else np.zeros(1, int)
    n = int(size[: at[1]].sum()) if counts else 0

    def scores(found: pa.Table) -> pa.Table:
        found = _added_rows(found)
        sums, own = vectors(found["sums"]), _cluster_columns(found["labels"], at, known)
        each = np.arange(len(sums))
        total, among = [], []
        for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            count = size[own[:, k]]
            a = np.where(count > 1, sums[each, own[:, k]] / np.maximum(count - 1, 1), 0.0)
            means = sums[:, i:j] / size[i:j]
            means[each, own[:, k] - i] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            fine = (top > 0) & np.isfinite(b)
            total.append(float(((b - a)[fine] / top[fine]).sum()))
            among.append(int(fine.sum()))
        return pa.table({"k": pa.array(range(len(total)), pa.int32()), "s": pa.array(total, pa.float64()), "n": pa.array(among, pa.int64())})

    parts = pairwise(base, base, lambda x, y: _sums_by_label(x, y, at, known), "row_id long, labels array<long>, sums array<double>", n=n, merge=_added_rows)
    deal = F.pmod(F.xxhash64(F.lit(1), "row_id"), F.lit(max(1, -(-n // PAIR_TILE))))
    found = parts.groupBy(deal.alias("part")).applyInArrow(scores, "k int, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    told = {r.k: r.s / r.n for r in found if r.n}
    return [told.get(k, 0.0) for k in range(len(at) - 1)]


def silhouette_array(x: np.ndarray, label: np.ndarray) -> float:
    """As `silhouette`, of a sample at hand."""
    order = np.argsort(label, kind="stable")
    x, label = x[order], label[order]
    _, first, size = np.unique(label, return_index=True, return_counts=True)
    if len(first) < 2:
        return 0.0
    d = np.sqrt(kernels.cross_l2sq(x, x))
    np.fill_diagonal(d, 0.0)
    sums, own = np.add.reduceat(d, first, axis=1), np.repeat(np.arange(len(first)), size)
    rows = np.arange(len(x))
    a = np.where(size[own] > 1, sums[rows, own] / np.maximum(size[own] - 1, 1), 0.0)
    means = sums / size
    means[rows, own] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    return float(((b - a)[top > 0] / top[top > 0]).mean()) if (top > 0).any() else 0.0


def dunn(rows: DataFrame) -> DataFrame:
    """Least distance between clusters over largest within: 0 for one cluster, infinite if all are single rows."""
    own = F.col("label") == F.col("other")
    ends = _distances_by_label(rows).agg(F.min(F.when(~own, F.col("low"))).alias("apart"), F.max(F.when(own, F.col("high"))).alias("wide"))
    return ends.select(F.when(F.col("apart").isNull(), 0.0).when(F.col("wide") == 0, float("inf")).otherwise(F.col("apart") / F.col("wide")).alias("dunn"))


def _centres(rows: DataFrame) -> DataFrame:
    """label, mean: clusters x features, a model's size."""
    return mean_vector(rows, "features", ["label"])


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """Mean over clusters of the largest (s_i + s_j) / d_ij: 0 for one cluster; centres within 1e-12 are passed over."""
    centres = _centres(rows)
    spread = rows.join(centres, "label").groupBy("label").agg(F.avg(l2("features", "mean")).alias("s")).join(centres, "label").select(F.col("label").alias("row_id"), F.col("mean").alias("features"), "s")

    def worst(left: pa.Table, right: pa.Table) -> pa.Table:
        label, most = np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            label = left["row_id"].to_numpy().astype(np.int64)
            y = vectors(right["features"])
            d = np.array([np.sqrt(((y - x) ** 2).sum(axis=1)) for x in vectors(left["features"])])
            apart = (d > 1e-12) & (label[:, None] != right["row_id"].to_numpy()[None, :])
            both = left["s"].to_numpy()[:, None] + right["s"].to_numpy()[None, :]
            most = np.divide(both, d, out=np.zeros(d.shape), where=apart).max(axis=1)
        return pa.table({"label": pa.array(label, pa.int64()), "r": pa.array(most, pa.float64())})

    return pairwise(spread, spread, worst, "label long, r double", merge=merged(["label"], {"r": "max"})).groupBy("label").agg(F.max("r").alias("r")).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """Between over within dispersion, by degrees of freedom: 0 for one cluster; null where the dispersion within is below 1e-12."""
    centres, middle = _centres(rows), mean_vector(rows).withColumnRenamed("mean", "whole")
    # the middle is one row
    sums = rows.join(centres, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(l2sq("features", "mean")).alias("w")).join(centres, "label").crossJoin(F.broadcast(middle))
    parts = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), F.sum(F.col("n") * l2sq("mean", "whole")).alias("b"))
    score = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return parts.select(F.when(F.col("k") <= 1, 0.0).when(F.col("w") >= 1e-12, score).alias("calinski_harabasz"))


def core_distances(rows: DataFrame, core_k: int = 5) -> DataFrame:
    """row_id, core: the distance to the core_k-th nearest other row."""
    return neighbours(rows, core_k).groupBy("row_id").agg(F.max("d").alias("core"))


#: Rows of a cluster whose spanning tree is grown in one task; a larger one's by rounds over all tasks, with the same result.
TREE_ROWS = 20_000


def _largest_tree_edge(pdf):
    """Prim's algorithm within one cluster, over mutual reachability; memory grows with the rows, not their pairs."""
    import pandas as pd

    x, core = np.stack(pdf["features"]), pdf["core"].to_numpy()
    n, worst = len(x), 0.0
    near, inside, at = np.full(n, np.inf), np.zeros(n, bool), 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(core, core[at]), np.sqrt(((x - x[at]) ** 2).sum(axis=1)))
        near = np.minimum(near, d)
        at = int(np.argmin(np.where(inside, np.inf, near)))
        worst = max(worst, float(near[at]))
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "n": [n], "dsc": [worst]})


def _nearest_outside(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left row's part, its least edge, by mutual reachability, to another part of the same cluster."""
    part, to, r = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if left.num_rows and right.num_rows:
        d = kernels.distances(vectors(left["features"]), vectors(right["features"]))
        d = np.maximum(d, np.maximum(left["core"].to_numpy()[:, None], right["core"].to_numpy()[None, :]))
        own, other = left["part"].to_numpy(), right["part"].to_numpy()
        d[(left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]) | (own[:, None] == other[None, :])] = np.inf
        at = d.argmin(axis=1)
        low = d[np.arange(len(d)), at]
        fine = np.isfinite(low)
        part, to, r = own[fine], other[at][fine], low[fine]
        order = np.lexsort((to, r, part))
        first = order[np.unique(part[order], return_index=True)[1]]
        part, to, r = part[first], to[first], r[first]
    return pa.table({"part": pa.array(part, pa.int64()), "to": pa.array(to, pa.int64()), "r": pa.array(r, pa.float64())})


def largest_tree_edges(base: DataFrame) -> DataFrame:
    """label, n, dsc: the largest edge of each cluster's least spanning tree, for clusters of any size, by rounds that at least halve the parts.

    In a round every part takes its least edge to another part of its cluster (ties to the smaller part), which belongs to a least spanning tree; parts joined
    by such edges become one. Pairs are met block by block, and only a part's least edge leaves a task.
    """
    state = stored(base.withColumn("part", F.col("row_id")).withColumn("worst", F.lit(0.0)))
    while True:
        rows = state.df.select("row_id", "features", "core", "label", "part")
        best = pairwise(rows, rows, _nearest_outside, "part long, to long, r double").groupBy("part").agg(F.min(F.struct("r", "to")).alias("e")).select("part", F.col("e.to").alias("to"), F.col("e.r").alias("r"))
        edges = stored(best)
        if edges.df.isEmpty():
            break
        root = part_roots(edges.df)
        worst = edges.df.join(root, "part").groupBy("root").agg(F.max("r").alias("r"))
        moved = root.join(worst, "root").select(F.col("part").alias("old"), F.col("root").alias("new"), "r")
        joined = state.df.join(moved, F.col("part") == F.col("old"), "left")
        after = stored(joined.select("row_id", "features", "core", "label", F.coalesce("new", "part").alias("part"), F.greatest("worst", F.coalesce("r", F.lit(0.0))).alias("worst")))
        for old in (state, edges):
            old.remove()
        state = after
    return state.df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("worst").alias("dsc"))


def part_roots(edges: DataFrame) -> DataFrame:
    """part, root: the least part reachable over (part, to), in which every part has one edge out, by labels that take turns with jumps."""
    both = stored(edges.select("part", "to").unionByName(edges.select(F.col("to").alias("part"), F.col("part").alias("to"))).distinct()).df
    state = stored(both.groupBy("part").agg(F.least(F.col("part"), F.min("to")).alias("root"))).df
    while True:
        told = both.join(state.select(F.col("part").alias("to"), "root"), "to").groupBy("part").agg(F.min("root").alias("heard"))
        least = state.join(told, "part").select("part", F.least("root", "heard").alias("low"), F.col("root").alias("before"))
        jump = state.select(F.col("part").alias("low"), F.col("root").alias("further"))
        new = stored(least.join(jump, "low", "left").select("part", F.least("low", F.coalesce("further", "low")).alias("root"), "before")).df
        state = new.select("part", "root")
        if new.where(F.col("root") != F.col("before")).isEmpty():
            return state


def dbcv(rows: DataFrame, core_k: int = 5, task_rows: int = TREE_ROWS) -> DataFrame:
    """Density-based validation, simplified: by cluster (separation - sparseness) / the larger, weighted by size; 0 for one cluster."""
    base = rows.select("row_id", "features", F.col("label").cast("long").alias("label")).join(core_distances(rows, core_k), "row_id")
    large = [r.label for r in base.groupBy("label").count().where(F.col("count") > task_rows).select("label").collect()]  # at most rows / task_rows
    small = ~F.col("label").isin(large) if large else F.lit(True)
    inside = base.where(small).groupBy("label").applyInPandas(_largest_tree_edge, "label long, n long, dsc double")
    if large:
        inside = inside.unionByName(largest_tree_edges(base.where(F.col("label").isin(large))))

    def apart(left: pa.Table, right: pa.Table) -> pa.Table:
        low = np.empty(0)
        labels = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            d = np.sqrt(kernels.cross_l2sq(vectors(left["features"]), vectors(right["features"])))
            d = np.maximum(d, np.maximum(left["core"].to_numpy()[:, None], right["core"].to_numpy()[None, :]))
            d[left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]] = np.inf
            labels, at = np.unique(left["label"].to_numpy(), return_inverse=True)
            low = np.full(len(labels), np.inf)
            np.minimum.at(low, at, d.min(axis=1))
            labels, low = labels[np.isfinite(low)], low[np.isfinite(low)]
        return pa.table({"label": pa.array(labels, pa.int64()), "low": pa.array(low, pa.float64())})

    sep = pairwise(base, base, apart, "label long, low double", merge=merged(["label"], {"low": "min"})).groupBy("label").agg(F.min("low").alias("sep"))
    each = inside.join(sep, "label")
    top = F.greatest("sep", "dsc")
    v = F.when(top >= 1e-12, (F.col("sep") - F.col("dsc")) / top).otherwise(0.0)
    return each.agg(F.coalesce(F.sum(v * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("dbcv"))


def knn_consistency(rows: DataFrame, k: int = 5) -> DataFrame:
    """Share of the k nearest neighbours with the row's own label, adjusted for chance and held in [0, 1]."""
    labels = rows.select("row_id", "label")
    near = neighbours(rows, k).join(labels, "row_id").join(labels.select(F.col("row_id").alias("other"), F.col("label").alias("l2")), "other")
    seen = near.groupBy("row_id").agg(F.avg((F.col("label") == F.col("l2")).cast("double")).alias("same")).agg(F.avg("same").alias("seen"))
    chance = labels.groupBy("label").count().agg((F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), F.lit(2))).alias("chance"))
    score = (F.col("seen") - F.col("chance")) / (1 - F.col("chance"))
    return seen.crossJoin(F.broadcast(chance)).select(F.when(F.col("chance") >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("knn_consistency"))


def contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, label, n."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _margins(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Each cell with its row, column and grand totals: windows over cells, of which there are clusters x labels."""
    w = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    return contingency(df, cluster, label).select("n", w("cluster").alias("a"), w("label").alias("b"), w().alias("all"), F.row_number().over(Window.partitionBy("cluster").orderBy("label")).alias("ra"), F.row_number().over(Window.partitionBy("label").orderBy("cluster")).alias("rb"))


def bcubed(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """precision, recall; 0 and 0 of no rows."""
    n2 = F.col("n") * F.col("n")
    return _margins(df, cluster, label).agg(F.coalesce(F.sum(n2 / F.col("a")) / F.first("all"), F.lit(0.0)).alias("precision"), F.coalesce(F.sum(n2 / F.col("b")) / F.first("all"), F.lit(0.0)).alias("recall"))


def _f1(p: str = "precision", r: str = "recall"):
    return F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(0.0)


def bcubed_f1(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return bcubed(df, cluster, label).select(_f1().alias("f1"))


def accuracy(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """In percent; 0 of no rows."""
    return df.agg(F.coalesce(F.avg((F.col(y) == F.col(predicted)).cast("double")) * 100, F.lit(0.0)).alias("accuracy"))


def binary(df: DataFrame, y: str, predicted: str, positive: int = 1) -> DataFrame:
    """precision, recall, f1 of the positive class; 0 where undefined."""
    hit = lambda a, b: F.count_if(a & b).cast("double")
    is_y, is_p = F.col(y) == positive, F.col(predicted) == positive
    sums = df.agg(hit(is_y, is_p).alias("tp"), F.count_if(is_p).alias("p"), F.count_if(is_y).alias("t"))
    rates = sums.select(F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0).alias("precision"), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0).alias("recall"))
    return rates.withColumn("f1", _f1())


def external(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """ari, nmi (arithmetic), fmi, v_measure, homogeneity, completeness from the contingency table."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    once_a, once_b = F.col("ra") == 1, F.col("rb") == 1
    plogp = lambda c: -F.col(c) / F.col("all") * F.log(F.col(c) / F.col("all"))
    sums = _margins(df, cluster, label).agg(
        F.sum(pairs("n")).alias("s"), F.sum(F.when(once_a, pairs("a"))).alias("sa"), F.sum(F.when(once_b, pairs("b"))).alias("sb"), F.first(pairs("all")).alias("t"),
        F.sum(F.when(once_a, plogp("a"))).alias("ha"), F.sum(F.when(once_b, plogp("b"))).alias("hb"),
        F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"),
    )
    c = F.col
    expected = c("sa") * c("sb") / c("t")
    ari = F.when((c("sa") + c("sb")) / 2 == expected, 1.0).otherwise((c("s") - expected) / ((c("sa") + c("sb")) / 2 - expected))
    nmi = F.when(c("ha") + c("hb") == 0, 1.0).otherwise(2 * c("mi") / (c("ha") + c("hb")))
    fmi = F.when(c("sa") * c("sb") == 0, 0.0).otherwise(c("s") / F.sqrt(c("sa").cast("double") * c("sb")))
    part = lambda h: F.when(c(h) == 0, 1.0).otherwise(c("mi") / c(h))
    return sums.select(ari.alias("ari"), nmi.alias("nmi"), fmi.alias("fmi"), nmi.alias("v_measure"), part("hb").alias("homogeneity"), part("ha").alias("completeness"))


def bootstrap_ari_difference(df: DataFrame, label: str, first: str, second: str, times: int = 1000, seed: int = 0) -> DataFrame:
    """low, high (95 %), p: of ari(first) - ari(second) over `times` Poisson resamples of the rows.

    One pass gives each distinct (label, first, second) its count in every resample; the counts, of the cells' size, are turned to scores together.
    """
    cells = df.groupBy(label, first, second).agg(F.count(F.lit(1)).alias("n"))

    def resampled(key, pdf):
        import pandas as pd

        (b,) = key
        rng = np.random.default_rng([seed, int(b)])
        n = rng.poisson(pdf["n"])

        def ari(column: str) -> float:
            t = pd.crosstab(pdf[label], pdf[column], values=n, aggfunc="sum").fillna(0).to_numpy()
            two = lambda x: (x * (x - 1) / 2).sum()
            s, a, b_, t2 = two(t), two(t.sum(axis=1)), two(t.sum(axis=0)), two(np.array([t.sum()]))
            return 1.0 if (a + b_) / 2 == a * b_ / t2 else (s - a * b_ / t2) / ((a + b_) / 2 - a * b_ / t2)

        return pd.DataFrame({"b": [b], "gap": [ari(first) - ari(second)]})

    spark = df.sparkSession
    gaps = spark.range(times).withColumnRenamed("id", "b").crossJoin(F.broadcast(cells)).groupBy("b").applyInPandas(resampled, "b long, gap double")
    return gaps.agg(F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"), F.avg((F.col("gap") <= 0).cast("double")).alias("p"))


INTERNAL = {"silhouette": silhouette, "davies_bouldin": davies_bouldin, "calinski_harabasz": calinski_harabasz, "dunn": dunn}


def evaluate(rows: DataFrame, names: list[str] | str = "all", pairwise_limit: int | None = None) -> dict[str, float | None]:
    """The named internal scores; 'all' for the four. Scores over pairs are left out above pairwise_limit rows, if given. One that fails is None."""
    wanted = list(INTERNAL) if names == "all" or "all" in names else [names] if isinstance(names, str) else list(names)
    if unknown := set(wanted) - set(INTERNAL):
        raise InvalidMetric(", ".join(sorted(unknown)))
    if rows.isEmpty():
        raise InsufficientData("no rows")
    if pairwise_limit is not None and rows.count() > pairwise_limit:
        wanted = [w for w in wanted if w not in ("silhouette", "dunn")]
    return {w: INTERNAL[w](rows).first()[0] for w in wanted}
