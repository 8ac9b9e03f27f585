"""Queries on the map's grid: smoothed hits, threshold, core, components, peaks, bandwidth, elbow, mixtures by the step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.functions.vector import l2sq
from gridscape.operators import gmm, gridops, kselect
from gridscape.operators.assign import distance_matrix, grid_place, hit_map, nearest
from gridscape.operators.density import DensityModel, grid_clusters
from gridscape.operators.som import SOMModel
from gridscape.plans.planner import added_up
from gridscape.queries import unrolled
from gridscape.queries.base import COLUMNS, E_SQL, UNITS, codebook, near_sql, points, registry, shards_sql, sq, weights

QUERIES, query = registry()
ROWS = UNITS // COLUMNS
SIGMA = 1.5 * math.sqrt(UNITS) / (2 * math.pi)
REACH = math.ceil(3 * SIGMA)

GRID = f"WITH RECURSIVE {E_SQL}, {shards_sql()}, {near_sql()}, g AS (SELECT CAST(i AS INTEGER) AS unit, CAST(i // {COLUMNS} AS INTEGER) AS gr, CAST(i % {COLUMNS} AS INTEGER) AS gc, count(a.unit) AS hits FROM range({UNITS}) t(i) LEFT JOIN a ON a.unit = t.i GROUP BY i)"
SMOOTH = f"""{GRID}, g1 AS (SELECT p.unit, p.gr, p.gc, sum(q.hits * exp(-pow(p.gr - q.gr, 2) / (2 * {SIGMA} * {SIGMA}))) AS v FROM g p JOIN g q ON p.gc = q.gc AND abs(p.gr - q.gr) <= {REACH} GROUP BY ALL),
sm AS (SELECT p.unit, p.gr, p.gc, sum(q.v * exp(-pow(p.gc - q.gc, 2) / (2 * {SIGMA} * {SIGMA}))) AS density FROM g1 p JOIN g1 q ON p.gr = q.gr AND abs(p.gc - q.gc) <= {REACH} GROUP BY ALL)"""
OTSU = f"""{SMOOTH}, en AS (SELECT min(density) AS lo, max(density) AS hi, count(*) AS n FROM sm),
hs AS (SELECT CAST(trunc((density - lo) / (hi - lo) * 255) AS INTEGER) AS bin, count(*) / any_value(n) AS p FROM sm CROSS JOIN en GROUP BY bin),
ru AS (SELECT bin, sum(p) OVER o AS w, sum(p * bin) OVER o AS s, sum(p * bin) OVER () AS t FROM hs WINDOW o AS (ORDER BY bin)),
th AS (SELECT lo + (SELECT bin FROM ru WHERE 1 - w > 1e-12 ORDER BY w * (1 - w) * pow(s / w - (t - s) / (1 - w), 2) DESC, bin LIMIT 1) / 255.0 * (hi - lo) AS th FROM en),
co AS (SELECT sm.*, density >= th AS core FROM sm CROSS JOIN th)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = grid_place("unit", COLUMNS)
    return hit_map(nearest(points(spark, sf_dir), weights(spark, sf_dir)), UNITS).withColumns({"grid_row": r, "grid_col": c})


def _clusters(spark: SparkSession, sf_dir: str):
    hits = np.array([r.hits for r in _grid(spark, sf_dir).orderBy("unit").collect()]).reshape(ROWS, COLUMNS)
    return grid_clusters(hits, 1.5)


def _units(spark: SparkSession, values, kind: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"unit int, {kind}")


@query(f"{SMOOTH} SELECT gr AS grid_row, gc AS grid_col, round(density, 4) AS density FROM sm")
def grid_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridops.smooth_table(_grid(spark, sf_dir), SIGMA).select("grid_row", "grid_col", F.round("density", 4).alias("density"))


@query(f"{SMOOTH} SELECT row_id, round(sm.density / (SELECT max(density) FROM sm), 4) AS density FROM a JOIN sm ON sm.unit = a.unit")
def density_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's density, 1 at the densest unit."""
    rows = points(spark, sf_dir).drop("label")
    model = DensityModel.from_som(SOMModel(weights(spark, sf_dir), ROWS, COLUMNS), 1.5).refit_density(rows)
    return model.transform(rows).select("row_id", F.round("density", 4).alias("density"))


@query(f"{OTSU} SELECT round(th, 4) AS threshold FROM th")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridops.otsu_table(gridops.smooth_table(_grid(spark, sf_dir), SIGMA)).select(F.round("threshold", 4).alias("threshold"))


@query(f"{OTSU} SELECT unit, core FROM co")
def core_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, [bool(v) for v in _clusters(spark, sf_dir).core], "core boolean")


@query(f"""{OTSU}, reach(unit, other) AS (SELECT unit, unit FROM co WHERE core
  UNION SELECT r.unit, c.unit FROM reach r JOIN co o ON o.unit = r.other JOIN co c ON c.core AND abs(c.gr - o.gr) + abs(c.gc - o.gc) = 1)
SELECT unit, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INTEGER) AS component FROM (SELECT unit, min(other) AS m FROM reach GROUP BY unit)""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = gridops.components(_clusters(spark, sf_dir).core, ROWS, COLUMNS)
    return _units(spark, [int(v) for v in labels], "component int").where("component >= 0")


@query(f"{OTSU} SELECT unit FROM co c WHERE core AND NOT EXISTS (SELECT 1 FROM co o WHERE o.core AND abs(o.gr - c.gr) + abs(o.gc - c.gc) = 1 AND o.density >= c.density)")
def watershed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units whose basin label is their own: found as the densest of each basin."""
    g = _clusters(spark, sf_dir)
    peaks = [u for u in range(UNITS) if g.labels[u] >= 0 and g.density[u] == g.density[g.labels == g.labels[u]].max()]
    return spark.createDataFrame([(u,) for u in peaks], "unit int")


@query(f"{OTSU}, {', '.join(unrolled.watershed('co', ROWS, COLUMNS, 'ws'))} SELECT unit, cluster FROM ws")
def watershed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, [int(v) for v in _clusters(spark, sf_dir).labels], "cluster int")


@query(f"SELECT CAST(i AS INTEGER) AS unit, round(0.5 * exp(-(pow(i // {COLUMNS} - 1, 2) + pow(i % {COLUMNS} - 2, 2)) / 4.5), 6) AS h FROM range({UNITS}) t(i)")
def gaussian_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = gridops.influence(ROWS, COLUMNS, COLUMNS + 2, 1.5, 0.5).ravel()
    return _units(spark, [float(v) for v in h], "h double").withColumn("h", F.round("h", 6))


@query(f"WITH RECURSIVE {', '.join([E_SQL, shards_sql(), *unrolled.tree_cut('cb', COLUMNS, 3, 'tc')])} SELECT unit, cluster FROM tc")
def tree_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, [int(v) for v in gridops.cut_tree(weights(spark, sf_dir), ROWS, COLUMNS, 3)], "cluster int")


SIGMA_SQL = f"""WITH {E_SQL}, u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM e), r AS (SELECT dim, v, row_number() OVER (PARTITION BY dim ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY dim) AS n FROM u),
s AS (SELECT dim, stddev_pop(v) AS s, max(v) FILTER (WHERE k = floor(n * 0.75)) - max(v) FILTER (WHERE k = floor(n * 0.25)) AS iqr, max(n) AS n FROM r GROUP BY dim),
a AS (SELECT avg(s) AS s, avg(iqr) AS iqr, max(n) AS n, count(*) AS d FROM s)"""


@query(f"{SIGMA_SQL} SELECT round(greatest(0.001, least(2.0, 0.9 * least(s, iqr / 1.34) * pow(n, -0.2))), 6) AS raw, round(greatest(0.5, least(2.0, 0.9 * least(s, iqr / 1.34) * pow(n, -0.2))), 6) AS sigma FROM a")
def adaptive_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silverman's bandwidth; raw is the same before its lower bound, as vectors of unit length fall below it."""
    rows = points(spark, sf_dir)
    scaled = rows.withColumn("features", F.transform("features", lambda x: x * 100))
    wide = kselect.smoothing_bandwidth(scaled, 400, 400).select(F.round(F.col("sigma") / 100, 6).alias("raw"))
    return wide.crossJoin(kselect.smoothing_bandwidth(rows, ROWS, COLUMNS).select(F.round("sigma", 6).alias("sigma")))


@query(f"{SIGMA_SQL} SELECT round(greatest(0.5, least(2.0, pow(n, -1 / (d + 4.0)) * s)), 6) AS sigma FROM a")
def scott_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kselect.smoothing_bandwidth(points(spark, sf_dir), ROWS, COLUMNS, "scott").select(F.round("sigma", 6).alias("sigma"))


CURVE = [(2, 100.0), (3, 95.0), (4, 90.0), (5, 60.0), (6, 65.0), (7, 68.0), (8, 70.0)]


@query(f"""WITH c(k, y) AS (VALUES {', '.join(map(str, CURVE))}), n AS (SELECT k, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM c),
b AS (SELECT k, lag(y) OVER o - 2 * y + lead(y) OVER o AS b FROM n WINDOW o AS (ORDER BY k)) SELECT CAST(k AS INTEGER) AS k_elbow FROM b WHERE b IS NOT NULL ORDER BY b DESC, k DESC LIMIT 1""")
def elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kselect.elbow(spark.createDataFrame(CURVE, "k int, inertia double"))


K = 3


def _state(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mixture to step from: even weights, the first rows as means, variances of .05."""
    means = np.array([r.features for r in rows.where(F.col("row_id") < K).orderBy("row_id").collect()])
    return np.full(K, 1 / K), means, np.full(means.shape, 0.05)


LP = f"ln(1.0 / {K}) + list_sum(list_transform(list_zip(e.x, c.x), lambda p: -0.5 * ln(2 * pi()) - 0.5 * ln(0.05) - 0.5 * (p[1] - p[2]) * (p[1] - p[2]) / 0.05))"
ESTEP = f"""WITH {E_SQL}, l AS (SELECT e.row_id, c.row_id AS k, e.x, {LP} AS lp FROM e CROSS JOIN (SELECT row_id, x FROM e WHERE row_id < {K}) c),
z AS (SELECT *, max(lp) OVER (PARTITION BY row_id) + ln(sum(exp(lp - top)) OVER (PARTITION BY row_id)) AS s FROM (SELECT *, max(lp) OVER (PARTITION BY row_id) AS top FROM l))"""


@query(f"{ESTEP} SELECT row_id, CAST(k AS INTEGER) AS k, round(exp(lp - s), 6) AS r FROM z")
def gmm_estep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The E-step as Columns: the log joint of every component, and the log-sum-exp over them."""
    rows = points(spark, sf_dir)
    _, means, var = _state(rows)
    joint = [F.lit(math.log(1 / K)) + means.shape[1] * (-0.5 * math.log(2 * math.pi) - 0.5 * math.log(0.05)) - 0.5 * l2sq("features", F.array(*[F.lit(float(v)) for v in m])) / 0.05 for m in means]
    lp = rows.select("row_id", F.array(*joint).alias("lp")).withColumn("top", F.array_max("lp"))
    s = F.col("top") + F.log(F.aggregate("lp", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    return lp.select("row_id", F.posexplode(F.transform("lp", lambda v: F.exp(v - s))).alias("k", "r")).select("row_id", "k", F.round("r", 6).alias("r"))


@query(f"""{ESTEP}, u AS (SELECT k, exp(lp - s) AS r, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM z),
m AS (SELECT k, dim, sum(r) AS n, sum(r * v) / sum(r) AS mean FROM u GROUP BY k, dim)
SELECT CAST(m.k AS INTEGER) AS k, CAST(m.dim - 1 AS INTEGER) AS dim, round(any_value(n) / (SELECT count(*) FROM e), 5) AS weight, round(any_value(mean), 5) + 0.0 AS mean, round(greatest(1e-6, sum(r * (v - mean) * (v - mean)) / any_value(n)), 5) AS var
FROM u JOIN m USING (k, dim) GROUP BY m.k, m.dim""")
def gmm_mstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    state = _state(rows)
    w, m, v = gmm.m_step(added_up(rows, lambda x: gmm.e_sums(x, state)), state[1])
    out = [(k, j, round(float(w[k]), 5), round(float(m[k, j]), 5) + 0.0, round(float(v[k, j]), 5)) for k in range(K) for j in range(m.shape[1])]
    return spark.createDataFrame(out, "k int, dim int, weight double, mean double, var double")


@query(f"{ESTEP} SELECT round(-2 * sum(s) + ({K} * (2 * 64 + 1) - 1) * ln(count(*)), 4) AS bic FROM (SELECT DISTINCT row_id, s FROM z)")
def gmm_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    state = _state(rows)
    ll = added_up(rows, lambda x: gmm.e_sums(x, state))[0, -1]
    return spark.createDataFrame([(round(gmm.bic(float(ll), rows.count(), K, state[1].shape[1]), 4),)], "bic double")


@query(f"WITH {E_SQL}, {shards_sql()} SELECT row_id, CAST(unit AS INTEGER) AS unit, round(sqrt({sq('e.x', 'cb.w')}), 6) AS d FROM e CROSS JOIN cb")
def pairwise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of distances of all rows to a codebook."""
    return distance_matrix(points(spark, sf_dir), codebook(spark, sf_dir)).withColumn("d", F.round("d", 6))
