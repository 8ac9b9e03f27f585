"""Queries on scores: internal over the embeddings' own labels, external over document labels and nearest units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.operators import metrics as M
from gridscape.operators.assign import nearest
from gridscape.queries.base import E_SQL, near_sql, points, registry, shards_sql, sq, table, weights

QUERIES, query = registry()

PAIRS = f"p AS (SELECT a.row_id, a.label, b.row_id AS other, b.label AS l2, sqrt({sq('a.x', 'b.x')}) AS d FROM e a JOIN e b ON a.row_id <> b.row_id)"


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


@query(f"""WITH {E_SQL}, {PAIRS}, s AS (SELECT row_id, label, l2, avg(d) AS m FROM p GROUP BY row_id, label, l2),
t AS (SELECT row_id, coalesce(max(m) FILTER (WHERE label = l2), 0) AS a, min(m) FILTER (WHERE label <> l2) AS b FROM s GROUP BY row_id)
SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM t WHERE greatest(a, b) > 0""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.silhouette(points(spark, sf_dir)))


CENTRES = "u AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM e), v AS (SELECT label, dim, avg(v) AS v FROM u GROUP BY label, dim), c AS (SELECT label, list(v ORDER BY dim) AS m FROM v GROUP BY label)"


@query(f"""WITH {E_SQL}, {CENTRES}, s AS (SELECT c.label, avg(sqrt({sq('e.x', 'c.m')})) AS s, any_value(c.m) AS m FROM e JOIN c ON e.label = c.label GROUP BY c.label),
r AS (SELECT a.label, max((a.s + b.s) / sqrt({sq('a.m', 'b.m')})) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)
SELECT round(avg(r), 5) AS davies_bouldin FROM r""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.davies_bouldin(points(spark, sf_dir)))


@query(f"""WITH {E_SQL}, {CENTRES}, w AS (SELECT dim, avg(v) AS v FROM u GROUP BY dim), mu AS (SELECT list(v ORDER BY dim) AS m FROM w),
s AS (SELECT c.label, count(*) AS n, sum({sq('e.x', 'c.m')}) AS w, count(*) * any_value({sq('c.m', 'mu.m')}) AS b FROM e JOIN c ON e.label = c.label CROSS JOIN mu GROUP BY c.label)
SELECT round((sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) AS calinski_harabasz FROM s""")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.calinski_harabasz(points(spark, sf_dir)))


@query(f"WITH {E_SQL}, {PAIRS} SELECT round(min(d) FILTER (WHERE label <> l2) / max(d) FILTER (WHERE label = l2), 5) AS dunn FROM p")
def dunn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.dunn(points(spark, sf_dir)))


CORE = f"{PAIRS}, k AS (SELECT row_id, d, label, l2, row_number() OVER (PARTITION BY row_id ORDER BY d, other) AS rank FROM p), core AS (SELECT row_id, max(d) AS core FROM k WHERE rank <= 5 GROUP BY row_id)"


@query(f"WITH {E_SQL}, {CORE} SELECT row_id, round(core, 5) AS core FROM core")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.core_distances(points(spark, sf_dir)).select("row_id", F.round("core", 5).alias("core"))


@query(f"""WITH {E_SQL}, {CORE}, o AS (SELECT avg(s) AS seen FROM (SELECT row_id, avg(CAST(label = l2 AS DOUBLE)) AS s FROM k WHERE rank <= 5 GROUP BY row_id)),
h AS (SELECT sum(n * n) / pow(sum(n), 2) AS chance FROM (SELECT count(*) AS n FROM e GROUP BY label)) SELECT round(greatest(0, least(1, (seen - chance) / (1 - chance))), 5) AS knn_consistency FROM o CROSS JOIN h""")
def knn_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.knn_consistency(points(spark, sf_dir)))


@query(f"""WITH RECURSIVE {E_SQL}, {CORE}, q AS (SELECT p.row_id, p.other, p.label, p.l2, greatest(p.d, a.core, b.core) AS r FROM p JOIN core a ON a.row_id = p.row_id JOIN core b ON b.row_id = p.other),
sep AS (SELECT label, min(r) AS sep FROM q WHERE label <> l2 GROUP BY label),
f(step, seen, worst, label, n) AS (
  SELECT 1, [min(row_id)], 0.0::DOUBLE, label, count(*) FROM e GROUP BY label
  UNION ALL
  SELECT step + 1, list_append(seen, m.o), greatest(worst, m.r), label, n FROM (
    SELECT f.step, f.seen, f.worst, f.label, f.n, (SELECT min({{'r': q.r, 'o': q.other}}) FROM q WHERE q.label = f.label AND q.l2 = f.label AND list_contains(f.seen, q.row_id) AND NOT list_contains(f.seen, q.other)) AS m FROM f WHERE f.step < f.n)),
t AS (SELECT label, n, worst FROM f WHERE step = n)
SELECT round(sum(n * CASE WHEN greatest(sep, worst) >= 1e-12 THEN (sep - worst) / greatest(sep, worst) ELSE 0 END) / sum(n), 5) AS dbcv FROM t JOIN sep USING (label)""")
def dbcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.dbcv(points(spark, sf_dir)))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), weights(spark, sf_dir))


NEAR = f"WITH {E_SQL}, {shards_sql()}, {near_sql()}"
CELLS = f"{NEAR}, n AS (SELECT unit, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) AS a, sum(count(*)) OVER (PARTITION BY label) AS b, sum(count(*)) OVER () AS t FROM a GROUP BY unit, label)"


@query(f"{NEAR} SELECT unit AS cluster, label, count(*) AS n FROM a GROUP BY unit, label")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contingency(_assigned(spark, sf_dir), "unit", "label")


@query(f"{CELLS} SELECT round(sum(n * n / a) / any_value(t), 6) AS precision, round(sum(n * n / b) / any_value(t), 6) AS recall FROM n")
def bcubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.bcubed(_assigned(spark, sf_dir), "unit", "label"), 6)


@query(f"{CELLS}, pr AS (SELECT sum(n * n / a) / any_value(t) AS p, sum(n * n / b) / any_value(t) AS r FROM n) SELECT round(2 * p * r / (p + r), 6) AS f1 FROM pr")
def bcubed_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.bcubed_f1(_assigned(spark, sf_dir), "unit", "label"), 6)


@query(f"""{CELLS}, ca AS (SELECT DISTINCT unit, a, t FROM n), cb2 AS (SELECT DISTINCT label, b, t FROM n),
s2 AS (SELECT sum(n * (n - 1) / 2) AS s, any_value(t) AS t, sum(n / t * ln(n * t / (a * b))) AS mi FROM n),
x AS (SELECT sum(a * (a - 1) / 2) AS sa, sum(-a / t * ln(a / t)) AS ha FROM ca), y AS (SELECT sum(b * (b - 1) / 2) AS sb, sum(-b / t * ln(b / t)) AS hb FROM cb2)
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(s / sqrt(sa * sb), 6) AS fmi,
round(2 * mi / (ha + hb), 6) AS v_measure, round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness FROM s2, x, y""")
def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.external(_assigned(spark, sf_dir), "unit", "label"), 6)


@query("SELECT round(avg(CAST(quality = toxic AS DOUBLE)) * 100, 6) AS accuracy FROM labels")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic"), 6)


@query("""WITH s AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE quality = 1) AS t FROM labels)
SELECT round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(2 * (tp / p) * (tp / t) / (tp / p + tp / t), 6) AS f1 FROM s""")
def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.binary(table(spark, sf_dir, "labels"), "quality", "toxic"), 6)


@query()
def bootstrap_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir).withColumn("second", F.col("unit") % 4)
    return M.bootstrap_ari_difference(rows, "label", "unit", "second", 200)
