"""Queries through files, services and checks: what is written is read back, and what is wrong is refused."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.errors import GridscapeError
from gridscape.functions import vector as V
from gridscape.operators import lloyd, metrics
from gridscape.operators.assign import distance_matrix, nearest
from gridscape.operators.classify import SOMClassifier
from gridscape.operators.density import DensitySOM
from gridscape.operators.gmm import DiagGMM
from gridscape.operators.picker import ModelPicker
from gridscape.operators.som import SOM, SOMModel
from gridscape.plans.storage import shared_dir
from gridscape.queries import unrolled
from gridscape.queries.base import COLUMNS, E_SQL, UNITS, codebook, near_sql, points, registry, shards_sql, weights
from gridscape.service import ModelRegistry
from gridscape.sources import io, persist

QUERIES, query = registry()
ROWS = UNITS // COLUMNS
NEAR = f"WITH {E_SQL}, {shards_sql()}, {near_sql()}"
COS = "1 - list_sum(list_transform(list_zip(e.x, c.w), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(e.x, lambda v: v * v))) / sqrt(list_sum(list_transform(c.w, lambda v: v * v)))"


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gridscape/{uuid.uuid4().hex}"


@query(f"WITH {E_SQL}, {shards_sql()} SELECT row_id, CAST(unit AS INTEGER) AS unit, round({COS}, 6) + 0.0 AS d FROM e CROSS JOIN cb c")
def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance_matrix(points(spark, sf_dir), codebook(spark, sf_dir), "cosine").withColumn("d", F.round("d", 6) + F.lit(0.0))


@query(f"WITH {E_SQL} SELECT row_id, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS s FROM e")
def sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("row_id", F.round(V.sum_squares("features"), 6).alias("s"))


CSV_ROWS = f"WITH {E_SQL} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, label, round(list_sum(x), 5) + 0.0 AS total FROM e"


def _csv(spark: SparkSession, sf_dir: str, labelled: bool) -> DataFrame:
    path = _place(spark)
    rows = points(spark, sf_dir).orderBy("row_id")
    rows.select(*[F.col("features")[i].alias(f"f{i}") for i in range(64)], "label").write.csv(path, header=True)
    return io.read_points(spark, path, 64, labelled)


@query(CSV_ROWS)
def csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings through CSV files with a header and a label, numbered by file and line."""
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return _csv(spark, sf_dir, True).select("row_id", "label", (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query(f"SELECT count(*) AS n, round(sum(total), 3) + 0.0 AS total FROM ({CSV_ROWS})")
def csv_features_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv(spark, sf_dir, False)
    return rows.select(F.explode("features").alias("x"), "row_id").agg(F.count_distinct("row_id").alias("n"), (F.round(F.sum("x"), 3) + F.lit(0.0)).alias("total"))


@query(f"{NEAR} SELECT CAST(unit AS VARCHAR) AS value, count(*) AS n FROM a GROUP BY unit")
def label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest units as a file of one label a line."""
    path = _place(spark)
    io.write_labels(nearest(points(spark, sf_dir), weights(spark, sf_dir)), path, "unit")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E_SQL}, s AS (SELECT label, avg(list_sum(x)) AS m FROM e GROUP BY label) SELECT CAST(label AS BIGINT) AS label, round(m, 4) + 0.0 AS m, CAST(NULL AS DOUBLE) AS none FROM s")
def json_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by label as JSON: rounded, and null where they aren't finite."""
    path = _place(spark)
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    io.write_metrics(points(spark, sf_dir).groupBy("label").agg(F.avg(total).alias("m")).withColumn("none", F.lit(float("nan"))), path, 4)
    return spark.read.schema("label long, m double, none double").json(path).withColumn("m", F.col("m") + F.lit(0.0))


@query("SELECT 'blobs' AS name, CAST(5 AS INTEGER) AS n_true_clusters, CAST(4 AS INTEGER) AS som_m, CAST(6 AS INTEGER) AS som_n, CAST(10 AS INTEGER) AS epochs UNION ALL SELECT 'rest', 2, 3, 3, 5")
def json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    made = [{"name": "blobs", "n_true_clusters": 5, "som_m": 4, "som_n": 6, "epochs": 10, "other": 1}, {"name": "rest", "n_true_clusters": 2, "som_m": 3, "som_n": 3, "epochs": 5}]
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(path)
    return io.read_config(spark, path)


@query("SELECT vec_id AS row_id, 5 AS kinds, true AS same FROM embeddings")
def json_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of each kind through JSON: every row's result by the stored model is the model's own."""
    rows = points(spark, sf_dir).drop("label")
    som = SOMModel(weights(spark, sf_dir), ROWS, COLUMNS)
    models = [som, lloyd.KMeans(k=5).fit(rows), DiagGMM(3).fit(rows), DensitySOM(SOM(3, 3, init="som++")).fit(rows, 1, False), SOMClassifier(3, 3, init="som++").fit(points(spark, sf_dir), "label", 1, False)]
    out = rows.select("row_id", "features")
    for i, model in enumerate(models):
        path = _place(spark)
        persist.save_json(model, spark, path)
        out = persist.load_json(spark, path).transform(model.transform(out, f"a{i}"), f"b{i}")
    same = [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(models))]
    return out.select("row_id", F.lit(len(models)).alias("kinds"), F.forall(F.array(*same), lambda v: v).alias("same"))


@query(f"{NEAR} SELECT row_id, unit AS prediction FROM a")
def service_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a service that holds the sharding codebook, of all rows in one request, whose body passes through the driver as any does."""
    service = ModelRegistry(spark)
    service.models["m"] = SOMModel(weights(spark, sf_dir), ROWS, COLUMNS)
    rows = points(spark, sf_dir).orderBy("row_id").select("row_id", "features").toArrow()
    found = service.predict({"model_id": "m", "data": rows["features"].to_pylist()})["predictions"]
    return spark.createDataFrame(list(zip(rows["row_id"].to_pylist(), found, strict=True)), "row_id long, prediction int")


REFUSED = [
    ("already fitted", "AlreadyFitted"), ("clusters above rows", "InvalidClusterCount"), ("no clusters", "InvalidClusterCount"), ("rate too high", "InvalidLearningRate"), ("unknown distance", "InvalidMetric"), ("unknown score", "InvalidMetric"),
    ("unknown seeds", "InvalidInitMethod"), ("not finite", "InvalidInputData"), ("ragged rows", "DimensionMismatch"), ("one row for a density", "InsufficientData"), ("nothing picked", "NotFitted"), ("unknown model", "NotFitted"), ("another width", "DimensionMismatch"), ("no such file", "PersistenceError"),
]


@query(" UNION ALL ".join(f"SELECT '{what}' AS request, '{error}' AS error" for what, error in REFUSED))
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each wrong request raises."""
    rows = points(spark, sf_dir).drop("label")
    fitted = lloyd.KMeans(k=2)
    fitted.fit(rows)
    book = SOMModel(weights(spark, sf_dir), ROWS, COLUMNS)
    small = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_id long, features array<double>")
    tries = [
        lambda: fitted.fit(rows), lambda: lloyd.KMeans(k=3).fit(small), lambda: lloyd.KMeans(k=0).fit(small), lambda: SOM(learning_rate=1.77), lambda: SOM(distance="none"), lambda: metrics.evaluate(small.withColumn("label", F.lit(0)), ["none"]),
        lambda: SOM(2, 2, init="none").fit(small, 1), lambda: lloyd.KMeans(k=1).fit(small.withColumn("features", F.array(F.lit(float("nan"))))), lambda: lloyd.KMeans(k=1).fit(small.withColumn("features", F.slice("features", 1, (F.col("row_id") + 1).cast("int")))),
        lambda: DensitySOM(SOM(2, 2)).fit(small.limit(1), 1), lambda: ModelPicker().best(), lambda: ModelRegistry(spark).predict({"model_id": "none", "data": [[1.0]]}), lambda: book.evaluate(small), lambda: persist.load(spark, f"{_place(spark)}/none"),
    ]
    out = []
    for (what, _), attempt in zip(REFUSED, tries, strict=True):
        try:
            attempt()
            out.append((what, "nothing"))
        except GridscapeError as e:
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "request string, error string")


@query(f"WITH RECURSIVE {', '.join([E_SQL, *unrolled.farthest('e', 36, 'f'), *unrolled.by_samples('e', 'f', 6, 3, 0.5, 3.0, 't', rule='manhattan')])}, {unrolled.assigned('e', 't', 'z')} SELECT CAST(unit AS INTEGER) AS bmu, count(*) AS count FROM z GROUP BY unit")
def som_manhattan_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return SOM(6, 6, 0.5, 3.0, "som++", update="manhattan").fit(rows, 3, False).transform(rows).groupBy("bmu").count()
