"""What the queries share: tables, the sharding codebook, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.operators.seeding import naive_sharding
from gridscape.schema import assemble

UNITS, COLUMNS = 16, 4
Registry = dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]


def registry() -> tuple[Registry, Callable]:
    found: Registry = {}

    def query(sql: str | None = None):
        def add(fn):
            found[fn.__name__] = (fn, sql)
            return fn

        return add

    return found, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, features, label of the embeddings."""
    return assemble(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")


def plane(spark: SparkSession, sf_dir: str, d: int = 4) -> DataFrame:
    return points(spark, sf_dir).withColumn("features", F.slice("features", 1, d))


def first_point(rows: DataFrame) -> DataFrame:
    """One row: the features of row 0."""
    return F.broadcast(rows.where("row_id = 0").select(F.col("features").alias("center")))


def codebook(spark: SparkSession, sf_dir: str, k: int = UNITS) -> DataFrame:
    return naive_sharding(points(spark, sf_dir).select("row_id", "features"), k)


def weights(spark: SparkSession, sf_dir: str, k: int = UNITS) -> np.ndarray:
    return np.array([r.weights for r in codebook(spark, sf_dir, k).orderBy("unit").collect()])


def long_form(df: DataFrame, key: str, vector: str, digits: int = 4) -> DataFrame:
    """(key, dim, x): a vector column as rows of rounded numbers."""
    return df.select(key, F.posexplode(vector).alias("dim", "x")).select(key, "dim", F.round("x", digits).alias("x"))


E_SQL = "e AS (SELECT vec_id AS row_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings)"


def plane_sql(d: int = 4) -> str:
    return f"e AS (SELECT vec_id AS row_id, label, list_transform(embedding[1:{d}], lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings)"


def shards_sql(k: int = UNITS) -> str:
    return f"""r AS (SELECT x, row_number() OVER (ORDER BY list_sum(x), row_id) - 1 AS p, count(*) OVER () AS n FROM e),
s AS (SELECT CAST(p // CAST(ceil(n / {k}.0) AS BIGINT) AS INTEGER) AS unit, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM r),
t AS (SELECT unit, dim, avg(v) AS v FROM s GROUP BY unit, dim),
cb AS (SELECT unit, list(v ORDER BY dim) AS w FROM t GROUP BY unit)"""


SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def sq(a: str, b: str) -> str:
    return SQ.format(a=a, b=b)


def near_sql(book: str = "cb", unit: str = "unit", w: str = "w") -> str:
    """a: row_id, label, x, unit, d2 of the nearest row of a codebook, ties to the first."""
    return f"""a AS (SELECT row_id, label, x, m.{unit} AS unit, m.d AS d2 FROM (
  SELECT e.row_id, any_value(e.label) AS label, any_value(e.x) AS x, min({{'d': {sq("e.x", f"c.{w}")}, '{unit}': c.{unit}}}) AS m FROM e CROSS JOIN {book} c GROUP BY e.row_id))"""
