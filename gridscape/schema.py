"""Feature vectors as ARRAY<DOUBLE>, row order as a dense position, and the checks that every estimator makes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscape.errors import DimensionMismatch, InsufficientData, InvalidInputData
from gridscape.plans.storage import Stored, stored


@dataclass(frozen=True)
class FeatureSpec:
    """Where the features are: one array or ML vector column, or some numeric columns."""

    columns: tuple[str, ...]

    def column(self, df: DataFrame) -> Column:
        if len(self.columns) > 1:
            return F.array(*[F.col(c).cast("double") for c in self.columns])
        (name,) = self.columns
        kind = df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            return F.col(name).cast("array<double>")
        return vector_to_array(F.col(name)) if kind.typeName().startswith("vector") else F.array(F.col(name).cast("double"))


def assemble(df: DataFrame, features: str | list[str] | tuple[str, ...] | FeatureSpec = "features", order_by: str = "row_id", *keep: str) -> DataFrame:
    """row_id, features array<double>, and the columns to keep: nothing else is read."""
    spec = features if isinstance(features, FeatureSpec) else FeatureSpec((features,) if isinstance(features, str) else tuple(features))
    return df.select(F.col(order_by).cast("long").alias("row_id"), spec.column(df).alias("features"), *[F.col(c) for c in keep])


def bad_features(features: str = "features") -> Column:
    """True for a vector that is null or holds null, NaN or an infinity."""
    return F.col(features).isNull() | F.exists(F.col(features), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def wrong_width(d: int, features: str = "features") -> Column:
    return F.size(features) != d


def shape(rows: DataFrame, least: int = 1) -> tuple[int, int]:
    """(rows, features) in one pass over the data, after checking that all are finite, of one width, and enough."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.count_if(bad_features()).alias("bad")).first()
    if found.bad:
        raise InvalidInputData(f"{found.bad} rows hold null, NaN or infinite features")
    if found.n < least:
        raise InsufficientData(f"{found.n} rows, at least {least} are needed")
    if found.low != found.high:
        raise DimensionMismatch(f"between {found.low} and {found.high} features")
    return found.n, found.low


def check_width(rows: DataFrame, d: int) -> None:
    if not rows.where(wrong_width(d)).isEmpty():
        raise DimensionMismatch(f"the model has {d} features")


def positions(rows: DataFrame, *order: Column | str) -> Stored:
    """rows with pos, the dense 0-based rank by `order`, without a window over all rows: a range sort, the partitions' counts, and an offset for each.

    The sorted rows are a table in the shared folder, so that a lost executor can't number them anew; remove it when done.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order or ("row_id",)]
    ranged = stored(rows.orderBy(*sort).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ranged.df.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    offset, total = [], 0
    for r in counts:
        offset += [F.lit(r.part), F.lit(total - (r.part << 33)).cast("long")]
        total += r["count"]
    pos = F.col("_at") + F.create_map(*offset)[part] if offset else F.lit(0).cast("long")
    return Stored(ranged.df.withColumn("pos", pos).drop("_at"), ranged.path)


def with_pos(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The same for a lazy result, whose table stays until the shared folder's owner clears it."""
    return positions(rows, *order).df
