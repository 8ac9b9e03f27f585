"""Vector arithmetic as Columns over ARRAY<DOUBLE>: all inside the JVM, usable in SQL through `register`."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Vector = Column | str


def _col(x: Vector) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Vector) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda s, v: s + v)


def l2sq(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2sq(a, b))


def l1(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def dot(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def sum_squares(x: Vector) -> Column:
    return total(F.transform(_col(x), lambda v: v * v))


def fast_inv_sqrt(x: Column) -> Column:
    """1 / sqrt(x); 1e12 where x isn't positive."""
    return F.when(x <= 0, F.lit(1e12)).otherwise(1 / F.sqrt(x))


def inverse_norm(x: Vector) -> Column:
    return F.least(F.lit(1e12), fast_inv_sqrt(sum_squares(x)))


def cosine(a: Vector, b: Vector) -> Column:
    """1 - the cosine, held in [0, 2]; a zero vector is at distance 1 from any."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) * inverse_norm(a) * inverse_norm(b)))


DISTANCES = {"euclidean": l2, "sqeuclidean": l2sq, "cosine": cosine, "manhattan": l1, "manhattan_compat": l2}


def taylor_exp(x: Column) -> Column:
    """The quick exponential: sixth-order series within 2 of zero, 0 below -100, infinite above 100."""
    series = F.lit(1.0)
    for k in range(6, 0, -1):
        series = 1 + x / k * series
    return F.when(x < -100, 0.0).when(x > 100, float("inf")).when(F.abs(x) < 2, series).otherwise(F.exp(x))


def exponential(x: Column, mode: str = "exact") -> Column:
    return taylor_exp(x) if mode == "taylor" else F.exp(x)


def gaussian_nbh(d2: Column, radius: Column | float, rate: Column | float, mode: str = "exact") -> Column:
    """A unit's share of an update: rate * exp(-d2 / (2 radius^2)) at squared grid distance d2."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return (rate if isinstance(rate, Column) else F.lit(float(rate))) * exponential(-d2 / (2 * F.greatest(r * r, F.lit(1e-18))), mode)


def gaussian_kernel(x: Vector, center: Vector, bandwidth: float, d: int) -> Column:
    return F.lit((2 * math.pi) ** (-d / 2) * bandwidth**-d) * F.exp(-l2sq(x, center) / (2 * bandwidth * bandwidth))


def triangle_skip(norm_a: Column, norm_b: Column, nearest: Column) -> Column:
    """Whether the norms alone tell that b is farther from a than what is nearest so far."""
    return F.abs(norm_a - norm_b) > nearest


def hadamard(i: Column, j: Column) -> Column:
    """An entry of the Hadamard matrix of a power of two."""
    return F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, 1).otherwise(-1)


def argmin_unit(features: Vector, codebook: Column, distance=l2sq) -> Column:
    """struct(d, unit) of the nearest entry of an array of (unit, weights), ties to the smallest unit: narrow, no join."""
    return F.array_min(F.transform(codebook, lambda u: F.struct(distance(_col(features), u["weights"]).alias("d"), u["unit"].alias("unit"))))


SQL_FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    "vec_l2sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"),
    "vec_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))"),
    "vec_l1": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, v) -> s + v)"),
}


GRID_FUNCTION = """CREATE OR REPLACE TEMPORARY FUNCTION som_grid(m INT, n INT) RETURNS TABLE (neuron_id INT, grid_row INT, grid_col INT)
RETURN SELECT u, u DIV n, u % n FROM (SELECT explode(sequence(0, m * n - 1)) AS u)"""


def register(spark: SparkSession) -> None:
    """The distances as temporary SQL functions, and the units of an m x n map as the table function som_grid(m, n)."""
    spark.sql(GRID_FUNCTION)
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
