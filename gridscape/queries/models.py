"""Queries on models: Lloyd's steps, map training, density, mixtures, automatic choice, classification, storage, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.operators import kernels, kselect, lloyd
from gridscape.operators.assign import codebook_table, nearest, nearest_row_per_unit
from gridscape.operators.auto import AutoCluster
from gridscape.operators.classify import SOMClassifier
from gridscape.operators.density import DensityModel
from gridscape.operators.gmm import DiagGMM
from gridscape.operators.picker import ModelPicker
from gridscape.operators.som import SOM, SOMModel, fold_job, unit_cluster_means
from gridscape.plans.planner import added_up
from gridscape.plans.storage import shared_dir
from gridscape.queries import unrolled
from gridscape.queries.base import COLUMNS, E_SQL, UNITS, long_form, near_sql, points, registry, shards_sql, sq, table, weights
from gridscape.queries.grids import OTSU
from gridscape.schema import positions
from gridscape.sources import datagen, persist
from gridscape.streaming.score import score_stream

QUERIES, query = registry()
ROWS = UNITS // COLUMNS


def _lloyd_sql(steps: int) -> str:
    parts = [E_SQL, shards_sql(), "c0 AS (SELECT unit, w FROM cb)"]
    for i in range(steps):
        parts.append(f"a{i} AS (SELECT row_id, x, m.unit AS unit FROM (SELECT e.row_id, any_value(e.x) AS x, min({{'d': {sq('e.x', 'c.w')}, 'unit': c.unit}}) AS m FROM e CROSS JOIN c{i} c GROUP BY e.row_id))")
        parts.append(f"u{i} AS (SELECT unit, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM a{i}), v{i} AS (SELECT unit, dim, avg(v) AS v FROM u{i} GROUP BY unit, dim), n{i} AS (SELECT unit, list(v ORDER BY dim) AS w FROM v{i} GROUP BY unit)")
        parts.append(f"c{i + 1} AS (SELECT c.unit, coalesce(n.w, c.w) AS w FROM c{i} c LEFT JOIN n{i} n USING (unit))")
    return f"WITH {', '.join(parts)}"


DIMS = "SELECT unit, CAST(dim - 1 AS INTEGER) AS dim, round(v, 4) + 0.0 AS x FROM (SELECT unit, unnest(w) AS v, generate_subscripts(w, 1) AS dim FROM {book})"


def _book(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return long_form(codebook_table(spark, c), "unit", "weights")


def _step(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(c), c.shape[1] + 2))
    found = added_up(rows, lambda x: kernels.lloyd_sums(x, c))
    sums[: len(found), : found.shape[1]] = found
    return kernels.lloyd_step(sums, c)[0]


@query(f"{_lloyd_sql(1)} {DIMS.format(book='c1')}")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, _step(points(spark, sf_dir), weights(spark, sf_dir)))


@query(f"{_lloyd_sql(3)} {DIMS.format(book='c3')}")
def kmeans_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = points(spark, sf_dir), weights(spark, sf_dir)
    for _ in range(3):
        c = _step(rows, c)
    return _book(spark, c)


NEAR = f"WITH {E_SQL}, {shards_sql()}, {near_sql()}"


@query(f"{NEAR} SELECT round(sum(d2), 4) AS inertia FROM a")
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), weights(spark, sf_dir), "sqeuclidean").agg(F.round(F.sum("distance"), 4).alias("inertia"))


@query(f"{NEAR}, u AS (SELECT unit % 4 AS c, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM a) SELECT CAST(c AS INTEGER) AS unit, CAST(dim - 1 AS INTEGER) AS dim, round(avg(v), 4) + 0.0 AS x FROM u GROUP BY c, dim")
def cluster_means_via_bmu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw means by the cluster of each row's unit, here unit % 4."""
    model = SOMModel(weights(spark, sf_dir), ROWS, COLUMNS)
    means = unit_cluster_means(model, points(spark, sf_dir), np.arange(UNITS) % 4, np.zeros(UNITS), 4)
    return _book(spark, means)


REST = 25


@query(f"WITH {', '.join([E_SQL, *unrolled.farthest('e', 10, 'f'), *unrolled.lloyd('e', 'f', REST, 'l'), unrolled.assigned('e', 'l', 'z')])} SELECT row_id, CAST(unit AS INTEGER) AS cluster FROM z")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.KMeans(k=10).fit(points(spark, sf_dir)).transform(points(spark, sf_dir)).select("row_id", F.col("label").alias("cluster"))


@query("WITH s AS (SELECT count(*) AS n FROM embeddings) SELECT n, true AS means_fixed, true AS labels_fixed FROM s")
def kmeans_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the fitted centres are the means of their rows, and each row's label its nearest centre."""
    rows = points(spark, sf_dir)
    model = lloyd.KMeans(k=10).fit(rows)
    moved = np.abs(_step(rows, model.centers) - model.centers).max()
    labelled = model.transform(rows, "cluster").withColumn("d", F.lit(0.0))
    near = nearest(labelled, codebook_table(spark, model.centers), plan="array")
    return near.agg(F.count(F.lit(1)).alias("n"), F.lit(bool(moved < 1e-3)).alias("means_fixed"), F.bool_and(F.col("cluster") == F.col("unit")).alias("labels_fixed"))


RATE, RADIUS = 0.5, 1.5
H = f"{RATE} * exp(-5 * (p / n)) * exp(-(pow(c.unit // {COLUMNS} - a.unit // {COLUMNS}, 2) + pow(c.unit % {COLUMNS} - a.unit % {COLUMNS}, 2)) / (2 * pow({RADIUS} * exp(-3 * (p / n)), 2)))"
STEP_SQL = f"""{NEAR}, f AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS p, CAST(count(*) OVER () AS DOUBLE) AS n FROM a),
h0 AS (SELECT c.unit, a.p, a.n, a.x, {H} AS h, abs(c.unit // {COLUMNS} - a.unit // {COLUMNS}) AS dr, abs(c.unit % {COLUMNS} - a.unit % {COLUMNS}) AS dc FROM f a CROSS JOIN cb c),
h1 AS (SELECT unit, p, x, CASE WHEN dr > ceil(3 * {RADIUS} * exp(-3 * (p / n))) OR dc > ceil(3 * {RADIUS} * exp(-3 * (p / n))) OR h < 1e-8 THEN 0 ELSE h END AS h FROM h0),
h2 AS (SELECT *, coalesce(product(1 - h) OVER (PARTITION BY unit ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS later FROM h1),
b AS (SELECT unit, unnest(x) AS v, generate_subscripts(x, 1) AS dim, h * later AS k FROM h2), bs AS (SELECT unit, dim, sum(k * v) AS b FROM b GROUP BY unit, dim),
k AS (SELECT unit, product(1 - h) AS a FROM h1 GROUP BY unit), w AS (SELECT unit, unnest(w) AS w, generate_subscripts(w, 1) AS dim FROM cb)
SELECT CAST(w.unit AS INTEGER) AS unit, CAST(w.dim - 1 AS INTEGER) AS dim, round(k.a * w.w + bs.b, 4) + 0.0 AS x FROM w JOIN k USING (unit) JOIN bs USING (unit, dim)"""


@query(STEP_SQL)
def som_batch_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of the distributed ordered fold, over all rows."""
    placed = positions(points(spark, sf_dir).select("row_id", "features"))
    w = fold_job(placed.df, weights(spark, sf_dir), kernels.Schedule(RATE, RADIUS, placed.df.count()), 0, SOM(ROWS, COLUMNS))
    placed.remove()
    return _book(spark, w)


MAP = [E_SQL, *unrolled.farthest("e", 36, "f"), *unrolled.trained("e", "f", 6, 3, 0.5, 3.0, "t")]
ON_MAP = f"{', '.join([*MAP, unrolled.assigned('e', 't', 'z')])}"
UNIT_ROWS = "tu AS MATERIALIZED (SELECT unit AS row_id, w AS x FROM t)"


def _map(spark: SparkSession, sf_dir: str, **options) -> SOMModel:
    return SOM(6, 6, 0.5, 3.0, options.pop("init", "som++"), **options).fit(points(spark, sf_dir), 3, False)


@query(f"WITH {ON_MAP} SELECT row_id, CAST(unit AS INTEGER) AS bmu, round(sqrt(d2), 4) AS distance FROM z")
def som_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).transform(points(spark, sf_dir), distance="distance").select("row_id", "bmu", F.round("distance", 4).alias("distance"))


@query("SELECT true AS same")
def som_fit_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That training by folds over partitions gives the map of one task."""
    local, spread = _map(spark, sf_dir, plan="local"), _map(spark, sf_dir, plan="distributed")
    return spark.createDataFrame([(bool(np.abs(local.weights - spread.weights).max() < 1e-9),)], "same boolean")


def _samples_sql(**options) -> str:
    return f"WITH RECURSIVE {', '.join([E_SQL, *unrolled.farthest('e', 36, 'f'), *unrolled.by_samples('e', 'f', 6, 3, 0.5, 3.0, 't', **options)])}"


COUNTS = "SELECT CAST(unit AS INTEGER) AS bmu, count(*) AS count FROM z GROUP BY unit"
COSINE = "1 - list_sum(list_transform(list_zip(e.x, t.w), lambda v: v[1] * v[2])) / sqrt(list_sum(list_transform(t.w, lambda v: v * v))) / sqrt(list_sum(list_transform(e.x, lambda v: v * v)))"


@query(f"{_samples_sql(cutoff=False)}, {unrolled.assigned('e', 't', 'z')} {COUNTS}")
def som_fit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, bmu_refresh="sample", cutoff=False).transform(points(spark, sf_dir)).groupBy("bmu").count()


@query(f"WITH {', '.join([E_SQL, *unrolled.farthest('e', 36, 'f'), *unrolled.batch_map('e', 'f', 6, 3, 3.0, 't'), unrolled.assigned('e', 't', 'z')])} SELECT CAST(unit AS INTEGER) AS bmu, count(*) AS count FROM z GROUP BY unit")
def som_fit_batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, algorithm="batch_map").transform(points(spark, sf_dir)).groupBy("bmu").count()


@query(f"{_samples_sql(rule='cosine')}, z AS (SELECT row_id, m.unit AS unit FROM (SELECT e.row_id, min({{'d': {COSINE}, 'unit': t.unit}}) AS m FROM e CROSS JOIN t GROUP BY e.row_id)) {COUNTS}")
def som_cosine_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, distance="cosine", update="cosine").transform(points(spark, sf_dir)).groupBy("bmu").count()


@query(f"WITH {', '.join([ON_MAP, UNIT_ROWS, *unrolled.farthest('tu', 10, 'uf'), *unrolled.lloyd('tu', 'uf', REST, 'ul'), unrolled.assigned('tu', 'ul', 'uz')])} SELECT z.row_id, CAST(uz.unit AS INTEGER) AS label FROM z JOIN uz ON uz.row_id = z.unit")
def som_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).cluster(points(spark, sf_dir).drop("label"), 10).select("row_id", "label")


@query(f"WITH RECURSIVE {', '.join([ON_MAP, *unrolled.tree_cut('t', 6, 10, 'c')])} SELECT row_id, cluster AS label FROM z JOIN c USING (unit)")
def som_tree_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).tree_cluster(points(spark, sf_dir).drop("label"), 10).select("row_id", "label")


@query(f"WITH {', '.join([ON_MAP, *unrolled.refined('e', 't', 'z', 10, 8, 'rf')])} SELECT row_id, CAST(label AS INTEGER) AS label FROM rf")
def som_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).cluster_refined(points(spark, sf_dir).drop("label"), 10).select("row_id", "label")


@query(f"WITH {', '.join([ON_MAP, 'on_unit AS (SELECT row_id, unit AS label, x FROM z)', *unrolled.internal('on_unit', 'iv')])} SELECT score, round(value, 6) AS value FROM iv")
def som_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _map(spark, sf_dir).evaluate(points(spark, sf_dir))
    return spark.createDataFrame([(k, None if v is None else round(v, 6)) for k, v in found.items()], "score string, value double")


BASINS = f"{OTSU}, {', '.join(unrolled.watershed('co', ROWS, COLUMNS, 'ws'))}"


@query(f"{BASINS} SELECT row_id, ws.cluster AS label, round(sm.density / (SELECT max(density) FROM sm), 4) AS density FROM a JOIN sm USING (unit) JOIN ws USING (unit)")
def density_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).drop("label")
    return DensityModel.from_som(SOMModel(weights(spark, sf_dir), ROWS, COLUMNS), 1.5).refit_density(rows).transform(rows).select("row_id", "label", F.round("density", 4).alias("density"))


@query("SELECT count(*) AS n, count(*) AS noise FROM embeddings")
def density_before_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before its density is fitted, every row of a model taken from a map is noise."""
    model = DensityModel.from_som(SOMModel(weights(spark, sf_dir), ROWS, COLUMNS))
    return model.transform(points(spark, sf_dir).drop("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == -1).alias("noise"))


@query(f"{BASINS} SELECT CAST(max(cluster) + 1 AS INTEGER) AS n_clusters, (SELECT avg(CAST(ws.cluster < 0 AS DOUBLE)) FROM a JOIN ws USING (unit)) AS noise_ratio FROM ws")
def density_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).drop("label")
    return DensityModel.from_som(SOMModel(weights(spark, sf_dir), ROWS, COLUMNS), 1.5).refit_density(rows).summary(rows)


@query(f"WITH {', '.join([E_SQL, *unrolled.farthest('e', 3, 'f'), *unrolled.lloyd('e', 'f', REST, 'l'), *unrolled.mixture('e', 'l', 3, 64, 20, 'gm')])} SELECT row_id, CAST(label AS INTEGER) AS label FROM gm")
def gmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).drop("label")
    return DiagGMM(3).fit(rows).transform(rows).select("row_id", "label")


@query()
def gap_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = kselect.sample_array(kselect.stratified_sample(points(spark, sf_dir)))
    return spark.createDataFrame([(kselect.gap_statistic(spark, sample, list(range(2, 13))), kselect.bic_k(spark, sample, list(range(2, 13))))], "k_gap int, k_bic int")


@query("SELECT label, least(count(*), 200 // any_value(k)) AS count FROM embeddings CROSS JOIN (SELECT max(label) + 1 AS k FROM embeddings) GROUP BY label")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kselect.stratified_sample(points(spark, sf_dir), "label", 200).groupBy("label").count()


@query()
def auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).drop("label")
    return AutoCluster(4, 4, init="som++").fit(rows, 2, False).transform(rows).select("row_id", "label")


@query()
def model_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    picker = ModelPicker(3, 3, epochs=1).evaluate(points(spark, sf_dir).drop("label"))
    return spark.createDataFrame([(name, round(score, 4)) for name, score, _ in picker.results], "method string, silhouette double")


NEAR_ROW = f"{NEAR}, t2 AS (SELECT c.unit, min({{'d': {sq('e.x', 'c.w')}, 'row_id': e.row_id, 'label': e.label}}) AS m FROM e CROSS JOIN cb c GROUP BY c.unit), lb AS (SELECT unit, m.row_id AS row_id, m.label AS label FROM t2)"


@query(f"{NEAR_ROW} SELECT CAST(unit AS INTEGER) AS unit, row_id, label FROM lb")
def classifier_neuron_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_row_per_unit(points(spark, sf_dir), weights(spark, sf_dir), "label").select("unit", "row_id", "label")


@query(f"{NEAR_ROW} SELECT a.row_id, lb.label AS prediction FROM a JOIN lb USING (unit)")
def classifier_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir)
    near = nearest_row_per_unit(points(spark, sf_dir), w, "label").orderBy("unit").collect()
    return SOMModel(w, ROWS, COLUMNS).mapped(points(spark, sf_dir), np.array([r.label for r in near]), "prediction").select("row_id", "prediction")


@query(f"""WITH {', '.join([E_SQL, *unrolled.farthest('e', 36, 'f'), *unrolled.trained('e', 'f', 6, 3, 0.5, 1.0, 't'), unrolled.assigned('e', 't', 'z')])},
t2 AS (SELECT c.unit, min({{'d': {sq('e.x', 'c.w')}, 'row_id': e.row_id, 'label': e.label}}).label AS label FROM e CROSS JOIN t c GROUP BY c.unit),
pr AS (SELECT e.label AS y, t2.label AS p FROM z JOIN t2 USING (unit) JOIN e ON e.row_id = z.row_id),
n AS (SELECT count(*) AS n, sum(count(*)) OVER (PARTITION BY p) AS a, sum(count(*)) OVER (PARTITION BY y) AS b, sum(count(*)) OVER () AS t FROM pr GROUP BY p, y),
s AS (SELECT sum(n * n / a) / any_value(t) AS precision, sum(n * n / b) / any_value(t) AS recall FROM n), v AS (SELECT (SELECT avg(CAST(p = y AS DOUBLE)) * 100 FROM pr) AS accuracy, *, 2 * precision * recall / (precision + recall) AS f1 FROM s)
SELECT score, round(value, 6) AS value FROM (UNPIVOT v ON accuracy, precision, recall, f1 INTO NAME score VALUE value)""")
def classifier_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = SOMClassifier(6, 6, init="som++").fit(points(spark, sf_dir), "label", 3, False)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in model.evaluate(points(spark, sf_dir), "label").items()], "score string, value double")


@query(f"{NEAR} SELECT row_id, unit AS bmu FROM a")
def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/gridscape-model"
    persist.save(SOMModel(weights(spark, sf_dir), ROWS, COLUMNS), spark, path)
    return persist.load(spark, path).transform(points(spark, sf_dir)).select("row_id", "bmu")


@query(f"{NEAR} SELECT row_id, unit AS bmu FROM a")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings read as a stream, scored, and drained into a table in memory."""
    model = SOMModel(weights(spark, sf_dir), ROWS, COLUMNS)
    source = table(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*embeddings*").parquet(sf_dir) if not source.inputFiles()[0].rpartition("/")[0].endswith(".parquet") else spark.readStream.schema(source.schema).parquet(f"{sf_dir}/embeddings.parquet")
    rows = stream.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))
    name = "stream_score_out"
    done = score_stream(rows, model).select("row_id", "bmu").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(name)


_SETS = (("blobs", 5, "20"), ("grid", 15, "5"), ("moons", 2, "50"), ("circles", 2, "50"), ("spiral", 3, "20"), ("anisotropic", 3, "30"), ("varied", 3, "[10, 30, 60][i + 1]"), ("uniform", 1, "50"))


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, CAST(i AS INTEGER) AS label, CAST({n} AS BIGINT) AS n FROM range({k}) t(i)" for name, k, n in _SETS))
def generated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"blobs": datagen.blobs(spark, 100), "grid": datagen.grid_clusters(spark, 5, 3, 5, 0.04), "moons": datagen.moons(spark, 100), "circles": datagen.circles(spark, 100), "spiral": datagen.spiral(spark, 20), "anisotropic": datagen.anisotropic(spark, 90), "varied": datagen.varied_density(spark, (10, 30, 60)), "uniform": datagen.uniform_cube(spark, 50, 3)}
    parts = [df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "label", "n") for name, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
