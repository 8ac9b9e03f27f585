"""Queries on vectors and columns: distances, kernels, preparation, seeding, assignment."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.functions import prep
from gridscape.functions import vector as V
from gridscape.operators import seeding
from gridscape.operators.assign import codebook_table, grid_place, hit_map, nearest, neighbours
from gridscape.operators.kde import bandwidth, density, local_maxima
from gridscape.queries import unrolled
from gridscape.queries.base import COLUMNS, E_SQL, UNITS, codebook, first_point, long_form, near_sql, plane, plane_sql, points, registry, shards_sql, sq, table, weights
from gridscape.schema import bad_features, wrong_width

QUERIES, query = registry()

L1_SQL = "list_sum(list_transform(list_zip(e.x, z.x), lambda p: abs(p[1] - p[2])))"
DOT_SQL = "list_sum(list_transform(list_zip(e.x, z.x), lambda p: p[1] * p[2]))"


def _to_first(expression: str) -> str:
    return f"WITH {E_SQL} SELECT e.row_id, round({expression}, 6) AS d FROM e CROSS JOIN (SELECT x FROM e WHERE row_id = 0) z"


def _against_first(spark: SparkSession, sf_dir: str, distance) -> DataFrame:
    rows = points(spark, sf_dir)
    return rows.crossJoin(first_point(rows)).select("row_id", F.round(distance("features", "center"), 6).alias("d"))


@query(f"""WITH {E_SQL}, {shards_sql()}, {near_sql()}
SELECT unit, count(*) AS hits, round(avg(sqrt(d2)), 4) AS mean_distance FROM a GROUP BY unit""")
def codebook_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: sharding codebook, nearest unit, hits and mean distance by unit."""
    near = nearest(points(spark, sf_dir), codebook(spark, sf_dir), plan="array")
    return near.groupBy("unit").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("distance"), 4).alias("mean_distance"))


@query(_to_first(f"sqrt({sq('e.x', 'z.x')})"))
def vec_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_first(spark, sf_dir, V.l2)


@query(_to_first(sq("e.x", "z.x")))
def vec_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_first(spark, sf_dir, V.l2sq)


@query(_to_first(L1_SQL))
def vec_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_first(spark, sf_dir, V.l1)


@query(_to_first(f"greatest(0, least(2, 1 - {DOT_SQL} / sqrt(list_sum(list_transform(e.x, lambda c: c * c))) / sqrt(list_sum(list_transform(z.x, lambda c: c * c)))))"))
def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_first(spark, sf_dir, V.cosine)


@query(_to_first(f"sqrt({sq('e.x', 'z.x')})"))
def vec_l2_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a temporary SQL function."""
    V.register(spark)
    rows = points(spark, sf_dir)
    return rows.crossJoin(first_point(rows)).select("row_id", F.expr("round(vec_l2(features, center), 6)").alias("d"))


@query("SELECT p_partkey, round(0.5 * exp(-p_size / (2 * 3.0 * 3.0)), 6) AS h FROM part")
def gaussian_nbh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(V.gaussian_nbh(F.col("p_size").cast("double"), 3.0, 0.5), 6).alias("h"))


@query(f"""WITH {E_SQL} SELECT e.row_id, round(-32 * ln(2 * pi()) - 64 * ln(0.5) - {sq('e.x', 'z.x')} / (2 * 0.25), 6) AS d
FROM e CROSS JOIN (SELECT x FROM e WHERE row_id = 0) z""")
def gaussian_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its logarithm, as the kernel itself is near 0 in 64 dimensions."""
    rows = points(spark, sf_dir)
    return rows.crossJoin(first_point(rows)).select("row_id", F.round(F.ln(V.gaussian_kernel("features", "center", 0.5, 64)), 6).alias("d"))


@query("""WITH t AS (SELECT p_partkey, (p_size - 25) / 10.0 AS x FROM part)
SELECT p_partkey, round(CASE WHEN abs(x) < 2 THEN 1 + x * (1 + x / 2 * (1 + x / 3 * (1 + x / 4 * (1 + x / 5 * (1 + x / 6))))) ELSE exp(x) END, 6) AS y FROM t""")
def fast_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(V.taylor_exp((F.col("p_size") - 25) / 10.0), 6).alias("y"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 1e12 ELSE 1 / sqrt(c_acctbal) END, 6) AS y FROM customer")
def fast_inv_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(V.fast_inv_sqrt(F.col("c_acctbal")), 6).alias("y"))


@query(f"""WITH {E_SQL} SELECT e.row_id, abs((e.row_id % 10 + 1) / 4.0 * sqrt(list_sum(list_transform(e.x, lambda c: c * c))) - sqrt(list_sum(list_transform(z.x, lambda c: c * c)))) > 0.6 AS skip
FROM e CROSS JOIN (SELECT x FROM e WHERE row_id = 0) z""")
def triangle_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of several lengths against the first one."""
    rows = points(spark, sf_dir)
    norm = lambda c: F.sqrt(V.sum_squares(c))
    longer = F.transform("features", lambda x: x * ((F.col("row_id") % 10 + 1) / 4.0))
    return rows.crossJoin(first_point(rows)).select("row_id", V.triangle_skip(norm(longer), norm("center"), F.lit(0.6)).alias("skip"))


@query(f"WITH {E_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL OR len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) > 0) AS bad, count(*) FILTER (WHERE len(x) <> 64) AS wrong FROM e")
def finite_and_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad_features()).alias("bad"), F.count_if(wrong_width(64)).alias("wrong"))


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 6) AS p_size FROM part")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.minmax(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", F.round("p_size", 6).alias("p_size"))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 4) + 0.0 AS l_quantity,
round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 4) + 0.0 AS l_discount FROM lineitem""")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return prep.standardise(rows, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_discount", 4).alias("l_discount"))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS hot, (SELECT count(DISTINCT p_brand) FROM part) AS width FROM part")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.one_hot(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")
    return rows.select("p_partkey", (F.array_position("one_hot", F.lit(1.0).cast("float")) - 1).cast("int").alias("hot"), F.size("one_hot").cast("long").alias("width"))


def _hist_sql(name: str, column: str) -> str:
    return f"""{name}e AS (SELECT min({column}) AS lo, max({column}) AS hi, count(*) AS n FROM {name}),
{name}h AS (SELECT least(99, CAST(floor(({column} - lo) / ((hi - lo) / 100)) AS INTEGER)) AS bin, count(*) / any_value(n) / any_value((hi - lo) / 100) AS p FROM {name} CROSS JOIN {name}e GROUP BY bin)"""


@query(f"""WITH {_hist_sql('customer', 'c_acctbal')}, {_hist_sql('supplier', 's_acctbal')}
SELECT round(sum(abs(coalesce(customerh.p, 0) - coalesce(supplierh.p, 0))) / 100, 8) AS difference FROM customerh FULL JOIN supplierh USING (bin)""")
def hist_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prep.compare_distribution(table(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "supplier"), "s_acctbal")
    return found.select(F.round("difference", 8).alias("difference"))


MEAN_SQL = "u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM e), q AS (SELECT dim, avg(v) AS v FROM u GROUP BY dim), mu AS (SELECT list(v ORDER BY dim) AS m FROM q)"


@query(f"WITH {E_SQL}, u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM e) SELECT CAST(dim - 1 AS INTEGER) AS dim, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sd FROM u GROUP BY dim")
def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = points(spark, sf_dir).select(F.posexplode("features").alias("dim", "v")).groupBy("dim")
    return each.agg(*[F.round(f("v"), 6).alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"), (F.stddev_pop, "sd"))])


@query(f"WITH {E_SQL} SELECT round(min(list_min(x)), 6) AS low, round(max(list_max(x)), 6) AS high FROM e")
def global_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).agg(F.round(F.min(F.array_min("features")), 6).alias("low"), F.round(F.max(F.array_max("features")), 6).alias("high"))


@query(f"WITH {E_SQL}, {MEAN_SQL} SELECT row_id, round(sqrt({sq('e.x', 'mu.m')}), 6) AS d FROM e CROSS JOIN mu ORDER BY {sq('e.x', 'mu.m')} DESC, row_id LIMIT 1")
def edge_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.edge_point(points(spark, sf_dir)).select("row_id", F.round(F.sqrt("d"), 6).alias("d"))


@query(f"WITH {E_SQL} SELECT row_id, label FROM e WHERE label = (SELECT min(label) FROM e)")
def row_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    least = rows.agg(F.min("label").alias("label"))
    return prep.subset(rows, rows.join(F.broadcast(least), "label")).select("row_id", "label")


@query(f"WITH {E_SQL}, {shards_sql()} SELECT unit, CAST(dim - 1 AS INTEGER) AS dim, round(v, 6) + 0.0 AS x FROM t")
def init_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(codebook(spark, sf_dir), "unit", "weights", 6)


@query("SELECT CAST(i AS INTEGER) AS unit, CAST(j AS INTEGER) AS dim, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM range(16) a(i), range(64) b(j)")
def init_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(codebook_table(spark, seeding.zero(UNITS, 64)), "unit", "weights")


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END AS h FROM range(16) a(i), range(16) b(j)")
def hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    return spark.range(256).select(F.floor(F.col("id") / 16).cast("int").alias("i"), (F.col("id") % 16).cast("int").alias("j")).withColumn("h", V.hadamard(i, j))


FARTHEST = 4


def _farthest_sql(k: int) -> str:
    parts = [E_SQL, MEAN_SQL, f"f0 AS (SELECT row_id, x FROM e CROSS JOIN mu ORDER BY {sq('e.x', 'mu.m')} DESC, row_id DESC LIMIT 1)", f"m0 AS (SELECT e.row_id, e.x, {sq('e.x', 'f0.x')} AS d FROM e CROSS JOIN f0)"]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT row_id FROM f{j}" for j in range(i))
        parts.append(f"f{i} AS (SELECT row_id, x FROM m{i - 1} WHERE row_id NOT IN ({chosen}) ORDER BY d DESC, row_id DESC LIMIT 1)")
        parts.append(f"m{i} AS (SELECT m.row_id, m.x, least(m.d, {sq('m.x', f'f{i}.x')}) AS d FROM m{i - 1} m CROSS JOIN f{i})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i} AS unit, row_id FROM f{i}" for i in range(k))


@query(_farthest_sql(FARTHEST))
def init_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that farthest-point seeding chooses, found again by equality with the seeds."""
    rows = points(spark, sf_dir).select("row_id", "features")
    seeds = codebook_table(spark, seeding.init_codebook(rows, "som++", FARTHEST))
    return rows.join(F.broadcast(seeds), V.l2sq("features", "weights") == 0).groupBy("unit").agg(F.max("row_id").alias("row_id"))


@query("SELECT CAST(i AS INTEGER) AS unit, CAST(j AS INTEGER) AS dim, CASE WHEN bit_count(i & j) % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END * pow(2, -0.5) + 0.0 AS x FROM range(16) a(i), range(8) b(j)")
def init_zero_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More units than features: scaled Hadamard rows between partial identities."""
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(seeding.zero(UNITS, 8, "hadamard")) for j, v in enumerate(row)], "unit int, dim int, x double")


def _seeded(method: str, variant: str = "default"):
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        # in 64 dimensions a row's own kernel is all of its density, so that maxima would be noise: seeds by density look at four
        rows = (plane if method.startswith("kde") else points)(spark, sf_dir).select("row_id", "features")
        return long_form(codebook_table(spark, seeding.init_codebook(rows, method, UNITS, SEED, variant=variant)), "unit", "weights", 6)

    fn.__name__ = f"init_{method.replace('++', '_plus_plus')}" + ("" if variant == "default" else f"_{variant}")
    return fn


def _values(x: np.ndarray) -> str:
    """v(unit, dim, x): numbers as the generator of that seed draws them, for what follows from them by SQL."""
    return f"v(unit, dim, x) AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {float(x[i, j])!r}::DOUBLE)' for i in range(x.shape[0]) for j in range(x.shape[1]))}))"


WIDTH, SEED = 64, 7
_RANGE = "g AS (SELECT min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM e)"
_BOOK = "SELECT CAST(unit AS INTEGER) AS unit, CAST(dim AS INTEGER) AS dim, round({x}, 6) + 0.0 AS x FROM {of}"
_LIST = "SELECT CAST(unit AS INTEGER) AS unit, CAST(dim - 1 AS INTEGER) AS dim, round(x, 6) + 0.0 AS x FROM (SELECT unit, unnest(w) AS x, generate_subscripts(w, 1) AS dim FROM {of})"


def _drawn(kind: str, shape: tuple[int, int] = (UNITS, WIDTH)) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.random(shape) if kind == "uniform" else rng.standard_normal(shape)


def _scaled_sql(x: np.ndarray) -> str:
    """x, each of its columns a unit, divided by the deviation of all its activations, where that isn't near 1 already."""
    act = "ac AS (SELECT var_pop(s) AS v FROM (SELECT row_id, unit, sum(u.v * v.x) AS s FROM (SELECT row_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM e) u JOIN v USING (dim) GROUP BY row_id, unit))"
    return f"WITH {E_SQL}, {_values(x)}, {act} {_BOOK.format(x='CASE WHEN ac.v < 1e-8 OR abs(ac.v - 1) < 0.1 THEN v.x ELSE v.x / sqrt(ac.v) END', of='v CROSS JOIN ac')}"


_HE = math.sqrt(2 / WIDTH)
SEED_SQL = {
    ("random", "default"): f"WITH {E_SQL}, {_RANGE}, {_values(_drawn('uniform'))} {_BOOK.format(x='lo + (hi - lo) * x', of='v CROSS JOIN g')}",
    ("he", "default"): f"WITH {_values(_drawn('normal'))} {_BOOK.format(x=f'sqrt(2 / {WIDTH}.0) * x', of='v')}",
    ("lecun", "default"): f"WITH {_values(_drawn('normal', (WIDTH, UNITS)).T)} {_BOOK.format(x=f'sqrt(1 / {WIDTH}.0) * x', of='v')}",
    ("lsuv", "default"): _scaled_sql(_HE * _drawn("normal", (WIDTH, UNITS)).T),
    ("lsuv", "svd"): _scaled_sql(prep.orthonormal(_HE * _drawn("normal", (WIDTH, UNITS))).T),
    ("kmeans++", "default"): f"WITH {', '.join([E_SQL, *unrolled.farthest('e', UNITS, 'f'), *unrolled.lloyd('e', 'f', 25, 'l')])} {_LIST.format(of='l')}",
    ("kmeans", "default"): f"WITH {', '.join([E_SQL, _RANGE, _values(_drawn('uniform')), 'sd AS MATERIALIZED (SELECT unit, list(lo + (hi - lo) * x ORDER BY dim) AS w FROM v CROSS JOIN g GROUP BY unit)', *unrolled.lloyd('e', 'sd', 40, 'l')])} {_LIST.format(of='l')}",
}

_PEAKS = f"""{plane_sql()}, bw AS (SELECT greatest(1e-10, (max(x[1]) - min(x[1])) / (1 + log2(count(*)))) AS h FROM e),
kd AS MATERIALIZED (SELECT a.row_id, any_value(a.x) AS x, sum(exp(-{sq("a.x", "b.x")} / (2 * h * h))) AS density FROM e a CROSS JOIN e b CROSS JOIN bw GROUP BY a.row_id),
pk AS MATERIALIZED (SELECT row_id, x FROM (SELECT *, lag(density) OVER o AS p, lead(density) OVER o AS q FROM kd WINDOW o AS (ORDER BY row_id)) WHERE p < density AND q < density)"""
SEED_SQL["kde", "default"] = f"WITH {', '.join([_PEAKS, *unrolled.farthest('pk', UNITS, 'f', first=True)])} {_LIST.format(of='f')}"
SEED_SQL["kde_kmeans", "refine"] = f"WITH {', '.join([_PEAKS, *unrolled.farthest('pk', UNITS, 'f', first=True), *unrolled.lloyd('e', 'f', 25, 'l')])} {_LIST.format(of='l')}"

for _method, _variant in (("random", "default"), ("he", "default"), ("lecun", "default"), ("lsuv", "default"), ("lsuv", "svd"), ("kmeans", "default"), ("kmeans++", "default"), ("kde", "default"), ("kde_kmeans", "refine")):
    query(SEED_SQL.get((_method, _variant)))(_seeded(_method, _variant))


BW_SQL = "bw AS (SELECT greatest(1e-10, (max(x[1]) - min(x[1])) / (1 + log2(count(*)))) AS h, count(*) AS n FROM e)"
KDE_SQL = f"""WITH {plane_sql()}, {BW_SQL},
k AS (SELECT a.row_id, sum(pow(2 * pi(), -2) * pow(h, -4) * exp(-{sq('a.x', 'b.x')} / (2 * h * h))) / any_value(n) AS density FROM e a CROSS JOIN e b CROSS JOIN bw GROUP BY a.row_id)"""


@query(f"WITH {plane_sql()}, {BW_SQL} SELECT round(h, 8) AS bandwidth FROM bw")
def kde_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandwidth(plane(spark, sf_dir)).select(F.round("bandwidth", 8).alias("bandwidth"))


@query(f"{KDE_SQL} SELECT row_id, round(density, 4) AS density FROM k")
def kde_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density(plane(spark, sf_dir)).select("row_id", F.round("density", 4).alias("density"))


@query(f"{KDE_SQL}, w AS (SELECT row_id, density, lag(density) OVER o AS p, lead(density) OVER o AS q FROM k WINDOW o AS (ORDER BY row_id)) SELECT row_id FROM w WHERE p < density AND q < density")
def kde_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_maxima(density(plane(spark, sf_dir))).select("row_id")


NEAR = f"WITH {E_SQL}, {shards_sql()}, {near_sql()}"


@query(f"{NEAR} SELECT row_id, unit, round(sqrt(d2), 6) AS distance FROM a")
def bmu_assign_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), codebook(spark, sf_dir), plan="array").select("row_id", "unit", F.round("distance", 6).alias("distance"))


@query(f"{NEAR} SELECT row_id, unit, round(sqrt(d2), 6) AS distance FROM a")
def bmu_assign_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), weights(spark, sf_dir)).select("row_id", "unit", F.round("distance", 6).alias("distance"))


@query(f"{NEAR} SELECT row_id, unit, round(sqrt(d2), 6) AS distance FROM a")
def bmu_assign_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), codebook(spark, sf_dir), plan="join").select("row_id", "unit", F.round("distance", 6).alias("distance"))


COS = "1 - list_sum(list_transform(list_zip(e.x, c.w), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(e.x, lambda v: v * v))) / sqrt(list_sum(list_transform(c.w, lambda v: v * v)))"


@query(f"WITH {E_SQL}, {shards_sql()} SELECT row_id, CAST(m.u AS INTEGER) AS unit, round(m.d, 6) AS distance FROM (SELECT e.row_id, min({{'d': {COS}, 'u': c.unit}}) AS m FROM e CROSS JOIN cb c GROUP BY e.row_id)")
def bmu_assign_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), weights(spark, sf_dir), "cosine").select("row_id", "unit", F.round("distance", 6).alias("distance"))


@query(f"WITH {E_SQL}, {shards_sql()} SELECT row_id, CAST(m.u AS INTEGER) AS unit, round(m.d, 6) AS distance FROM (SELECT e.row_id, min({{'d': list_sum(list_transform(list_zip(e.x, c.w), lambda p: abs(p[1] - p[2]))), 'u': c.unit}}) AS m FROM e CROSS JOIN cb c GROUP BY e.row_id)")
def bmu_assign_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), weights(spark, sf_dir), "manhattan").select("row_id", "unit", F.round("distance", 6).alias("distance"))


@query(f"{NEAR} SELECT row_id, CAST(unit // {COLUMNS} AS INTEGER) AS grid_row, CAST(unit % {COLUMNS} AS INTEGER) AS grid_col FROM a")
def bmu_rowcol(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = grid_place("unit", COLUMNS)
    return nearest(points(spark, sf_dir), weights(spark, sf_dir)).select("row_id", r.alias("grid_row"), c.alias("grid_col"))


@query(f"{NEAR} SELECT CAST(i AS INTEGER) AS unit, count(a.unit) AS hits FROM range({UNITS}) g(i) LEFT JOIN a ON a.unit = g.i GROUP BY i")
def hit_map_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_map(nearest(points(spark, sf_dir), weights(spark, sf_dir)), UNITS)


@query(f"{NEAR} SELECT round(avg(sqrt(d2)), 6) AS error FROM a")
def quantisation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), weights(spark, sf_dir)).agg(F.round(F.avg("distance"), 6).alias("error"))


@query(f"WITH {E_SQL}, d AS (SELECT a.row_id, b.row_id AS other, sqrt({sq('a.x', 'b.x')}) AS d FROM e a JOIN e b ON a.row_id <> b.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, other) AS rank FROM d) SELECT row_id, CAST(rank AS INTEGER) AS rank, other, round(d, 6) AS d FROM r WHERE rank <= 5")
def k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(points(spark, sf_dir), 5).select("row_id", "rank", "other", F.round("d", 6).alias("d"))


@query("SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, true AS inside, true AS even, true AS the_same FROM embeddings CROSS JOIN range(3) t(dim) GROUP BY dim")
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By dimension: the numbers drawn, that they lie in [0, 1), that mean and variance are a uniform number's, and that other partitions draw the same."""
    drawn = lambda rows: long_form(rows.withColumn("v", prep.random_vector(3, 11)), "row_id", "v", 9)
    again = drawn(points(spark, sf_dir).repartition(5)).withColumnRenamed("x", "again")
    both = drawn(points(spark, sf_dir)).join(again, ["row_id", "dim"]).groupBy("dim")
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("x") >= 0) & (F.col("x") < 1)).alias("inside"), ((F.abs(F.avg("x") - 0.5) < 0.08) & (F.abs(F.var_pop("x") - 1 / 12) < 0.03)).alias("even"), F.bool_and(F.col("x") == F.col("again")).alias("the_same"))


@query("SELECT CAST(i AS INTEGER) AS unit, CAST(j AS INTEGER) AS dim, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM range(8) a(i), range(8) b(j)")
def orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of the columns of an orthonormal matrix."""
    q = prep.orthonormal(np.random.default_rng(3).normal(size=(12, 8)))
    return long_form(codebook_table(spark, q.T @ q), "unit", "weights", 6)


@query("SELECT true AS unit_variance")
def lsuv_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That activations through the variance-scaled seeds have a variance within 0.1 of 1."""
    rows = points(spark, sf_dir).select("row_id", "features")
    book = codebook_table(spark, seeding.init_codebook(rows, "lsuv", UNITS, 7))
    act = rows.crossJoin(F.broadcast(book)).agg(F.var_pop(V.dot("features", "weights")).alias("v"))
    return act.select((F.abs(F.col("v") - 1) < 0.1 + 1e-9).alias("unit_variance"))
