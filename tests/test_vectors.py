import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridscape.errors import DimensionMismatch, InsufficientData, InvalidInputData, InvalidMetric
from gridscape.functions import prep
from gridscape.functions import vector as V
from gridscape.operators import kernels
from gridscape.operators.assign import codebook_table, hit_map, nearest, nearest_row_per_unit, neighbours
from gridscape.schema import FeatureSpec, assemble, shape, with_pos
from tests.helpers import frame, waves


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_known_distances(spark):
    r = one(spark, V.l2(arr(0, 0), arr(3, 4)), V.l2sq(arr(0, 0), arr(3, 4)), V.l1(arr(0, 0), arr(3, 4)), V.cosine(arr(1, 0), arr(0, 1)), V.cosine(arr(0, 0), arr(1, 1)), V.dot(arr(1, 2), arr(3, 4)))
    assert list(r) == pytest.approx([5, 25, 7, 1, 1, 11])


def test_scalars(spark):
    x = F.lit(-1.5)
    r = one(spark, V.fast_inv_sqrt(F.lit(4.0)), V.fast_inv_sqrt(F.lit(0.0)), V.taylor_exp(x), V.taylor_exp(F.lit(-101.0)), V.taylor_exp(F.lit(101.0)), V.taylor_exp(F.lit(3.0)), V.gaussian_nbh(F.lit(0.0), 2.0, 0.5), V.gaussian_kernel(arr(0), arr(0), 1.0, 1))
    assert r[0] == 0.5 and r[1] == 1e12 and r[3] == 0 and r[4] == math.inf
    assert r[2] == pytest.approx(sum((-1.5) ** k / math.factorial(k) for k in range(7)))
    assert r[5] == pytest.approx(math.exp(3)) and r[6] == 0.5 and r[7] == pytest.approx(1 / math.sqrt(2 * math.pi))


def test_numpy_and_column_exponentials_agree(spark):
    x = np.linspace(-5, 5, 41)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(V.taylor_exp(F.col("x"))).collect()]
    assert np.allclose(got, kernels.quick_exp(x))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 8), st.integers(1, 5), st.integers(0, 10**6))
def test_nearest_is_first_minimum(n, k, d, seed):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-3, 4, (n, d)).astype(float), rng.integers(-3, 4, (k, d)).astype(float)
    unit, dist = kernels.nearest(x, c)
    for i in range(n):
        d2 = [((x[i] - c[j]) ** 2).sum() for j in range(k)]
        assert unit[i] == d2.index(min(d2)) and dist[i] == pytest.approx(math.sqrt(min(d2)))


def test_plans_agree_and_empty(spark):
    x = waves(40, 3)
    c = x[[1, 5, 9, 5]]  # a tie between units 1 and 3
    rows = frame(spark, x)
    found = {p: {r.row_id: r.unit for r in nearest(rows, c, plan=p).collect()} for p in ("arrow", "array", "join")}
    assert found["arrow"] == found["array"] == found["join"] and 3 not in found["arrow"].values()
    assert nearest(rows.where("row_id < 0"), c).count() == 0
    for metric in ("cosine", "manhattan", "manhattan_compat", "sqeuclidean"):
        a, b = ({r.row_id: r.unit for r in nearest(rows, c, metric, p).collect()} for p in ("arrow", "array"))
        assert a == b
    with pytest.raises(InvalidMetric):
        nearest(rows, c, "hamming")


def test_hits_keep_empty_units(spark):
    rows = nearest(frame(spark, [[0.0], [0.1], [9.0]]), np.array([[0.0], [4.0], [9.0]]))
    assert [r.hits for r in hit_map(rows, 3).orderBy("unit").collect()] == [2, 0, 1]


def test_neighbours_and_nearest_row(spark):
    rows = frame(spark, [[0.0], [1.0], [3.0], [3.0]])
    near = {(r.row_id, r.rank): (r.other, r.d) for r in neighbours(rows, 2).collect()}
    assert near[0, 1] == (1, 1.0) and near[2, 1] == (3, 0.0) and near[1, 2] == (2, 2.0)
    best = nearest_row_per_unit(rows, np.array([[3.0], [0.4]])).orderBy("unit").collect()
    assert [r.row_id for r in best] == [2, 0]
    with_self = neighbours(rows, 1, include_self=True).orderBy("row_id").collect()
    assert all(r.d == 0 for r in with_self)


def test_checks(spark):
    with pytest.raises(InvalidInputData):
        shape(frame(spark, [[1.0, math.nan], [1.0, 2.0]]))
    with pytest.raises(DimensionMismatch):
        shape(frame(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(InsufficientData):
        shape(frame(spark, [[1.0]]), 2)
    with pytest.raises(InsufficientData):
        shape(frame(spark, [[1.0]]).where("row_id < 0"))


def test_assemble_columns_and_vectors(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(0, 1.0, 2, Vectors.dense(5.0, 6.0))], ["id", "a", "b", "v"])
    assert assemble(df, ["a", "b"], "id").first().features == [1.0, 2.0]
    assert assemble(df, FeatureSpec(("v",)), "id").first().features == [5.0, 6.0]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_positions_are_dense_for_any_partitions(spark, parts):
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("row_id")).repartition(parts)
    placed = with_pos(rows)
    assert all(r.row_id == r.pos for r in placed.collect())
    assert with_pos(rows.where("row_id < 0")).count() == 0


def test_preparation(spark):
    df = spark.createDataFrame([(0, 1.0, "b"), (1, 3.0, "a"), (2, 2.0, None)], "row_id int, x double, c string")
    assert sorted(r.x for r in prep.minmax(df, "x").collect()) == [0, 0.5, 1]
    assert {r.x for r in prep.minmax(df.withColumn("x", F.lit(2.0)), "x").collect()} == {0.0}
    with pytest.raises(InvalidInputData):
        prep.minmax(df, "y")
    z = [r.x for r in prep.standardise(df, ["x"]).collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    assert {r.row_id: r.one_hot for r in prep.one_hot(df, "c").collect()} == {0: [0, 1], 1: [1, 0], 2: [0, 0]}
    scaled = prep.standardise_vector(frame(spark, [[1.0, 5.0], [3.0, 5.0]])).orderBy("row_id").collect()
    assert [r.features for r in scaled] == [[-1, 0], [1, 0]]
    assert prep.compare_distribution(df, "x", df, "x").first().difference == 0
    assert prep.edge_point(frame(spark, [[0.0], [1.0], [5.0]])).first().row_id == 2


def test_pca(spark):
    rows = frame(spark, [[float(i), 2.0 * i, 0.0] for i in range(20)])
    got = prep.pca(rows, 1).orderBy("row_id").collect()
    steps = np.diff([r.features[0] for r in got])
    assert len(got[0].features) == 1 and np.allclose(np.abs(steps), np.sqrt(5))


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    data = {g: sorted(rng.random(n).tolist()) for g, n in ((0, 9), (1, 4), (5, 1))}
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in x], "dim int, x double").repartition(4)
    got = {r.dim: (r.q1, r.q3) for r in prep.order_statistics(df, "x", {"q1": 0.25, "q3": 0.75}, "dim").collect()}
    assert got == {g: (x[int(0.25 * len(x))], x[int(0.75 * len(x))]) for g, x in data.items()}


def test_matrices():
    h = prep.hadamard_matrix(3)
    assert np.array_equal(h @ h.T, 8 * np.eye(8))
    q = prep.orthonormal(np.random.default_rng(0).normal(size=(5, 3)))
    assert np.allclose(q.T @ q, np.eye(3))


def test_sql_functions(spark):
    V.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM som_grid(2, 2) ORDER BY neuron_id").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    assert spark.sql("SELECT vec_l2(array(0D, 0D), array(3D, 4D)), vec_l1(array(0D), array(-2D))").first()[:] == (5.0, 2.0)


def test_codebook_is_small_table(spark):
    rows = codebook_table(spark, np.eye(4), 2).orderBy("unit").collect()
    assert [(r.grid_row, r.grid_col) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1)]
