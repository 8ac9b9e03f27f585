"""Files in and out: labelled CSV, label lists, JSON configurations and metrics, JSON arrays of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscape.errors import DimensionMismatch
from gridscape.schema import with_pos

CONFIG = "name string, n_true_clusters int, som_m int, som_n int, epochs int"


def read_points(spark: SparkSession, path: str, width: int, labelled: bool = True, delimiter: str = ",") -> DataFrame:
    """row_id, features (and label) of CSV files with a header, whose last column is the label and is dropped if not wanted.

    The schema is given, never inferred. Rows are numbered from 0 in the order of the files' names and of the lines in them, however Spark deals the files.
    """
    schema = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(width)] + [T.StructField("label", T.DoubleType())])
    raw = spark.read.csv(path, header=True, schema=schema, sep=delimiter, enforceSchema=True)
    # within one split of a file, this id rises with the lines
    places = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line")]
    rows = raw.select(*places, F.array(*[F.col(f"f{i}") for i in range(width)]).alias("features"), F.col("label").cast("int").alias("label"))
    rows = with_pos(rows, "_file", "_split", "_line").select(F.col("pos").alias("row_id"), "features", "label")
    return rows if labelled else rows.drop("label")


def write_labels(labels: DataFrame, path: str, label: str = "label", order: str = "row_id") -> None:
    """One label a line, no header, in row order."""
    labels.orderBy(order).select(F.col(label).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=CONFIG, multiLine=True)


def finite(column: str, digits: int = 6):
    x = F.col(column).cast("double")
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), F.round(x, digits))


def write_metrics(scores: DataFrame, path: str, digits: int = 6) -> None:
    """JSON with rounded numbers, null for what isn't finite."""
    out = [finite(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in scores.schema]
    scores.select(*out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def rows_from_json(df: DataFrame, column: str = "data", first: str | None = None) -> DataFrame:
    """row_id, features from a JSON array of arrays of numbers, or from pieces of one, `first` being the number of a piece's first row; ragged rows are an error."""
    begin = F.col(first).cast("long") if first else F.lit(0).cast("long")
    data = df.select(begin.alias("_first"), F.from_json(column, "array<array<double>>").alias("d")).select("_first", F.posexplode("d").alias("row_id", "features"))
    data = data.select((F.col("_first") + F.col("row_id")).alias("row_id"), "features")
    widths = data.agg(F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")).first()
    if widths.low != widths.high:
        raise DimensionMismatch(f"rows of {widths.low} to {widths.high} numbers")
    return data
