"""Models as Parquet: units and one row of settings. The way of seeding, the iteration limit and the plan are not kept."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gridscape.errors import PersistenceError
from gridscape.operators.classify import SOMClassifierModel
from gridscape.operators.density import DensityModel, GridClusters
from gridscape.operators.gmm import GMMModel
from gridscape.operators.lloyd import KMeansModel
from gridscape.operators.som import SOMModel

META = "m int, n int, distance string, learning_rate double, neighbor_radius double, last_rate double, last_radius double, features array<string>, one_column boolean"


def save(model: SOMModel, spark: SparkSession, path: str, format: str = "parquet") -> None:
    """format: 'parquet' or 'json'."""
    last = model.last or (None, None)
    names = [model.features] if isinstance(model.features, str) else list(model.features)
    meta = spark.createDataFrame([(model.m, model.n, model.distance, model.learning_rate, model.neighbor_radius, *last, names, isinstance(model.features, str))], META)
    meta.coalesce(1).write.mode("overwrite").format(format).save(f"{path}/meta")
    model.neurons(spark).coalesce(1).write.mode("overwrite").format(format).save(f"{path}/neurons")


def load(spark: SparkSession, path: str, format: str = "parquet") -> SOMModel:
    try:
        meta = spark.read.format(format).schema(META).load(f"{path}/meta").first()
        units: DataFrame = spark.read.format(format).schema("neuron_id int, grid_row int, grid_col int, weights array<double>").load(f"{path}/neurons")
        weights = np.array([r.weights for r in units.orderBy("neuron_id").collect()])
    except AnalysisException as e:
        raise PersistenceError(f"no model at {path}") from e
    if meta is None:
        raise PersistenceError(f"no settings at {path}")
    last = (meta.last_rate, meta.last_radius) if meta.last_rate is not None else None
    return SOMModel(weights, meta.m, meta.n, meta.distance, meta.learning_rate, meta.neighbor_radius, last, meta.features[0] if meta.one_column else list(meta.features))


def _plain(value: object) -> object:
    """A model as JSON values: arrays and models as dictionaries that tell what they are."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "type": str(value.dtype)}
    if is_dataclass(value):
        return {"model": type(value).__name__, "fields": {f.name: _plain(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, np.generic):
        return value.item()
    return {"tuple": [_plain(v) for v in value]} if isinstance(value, tuple) else value


def _model(value: object) -> object:
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], value["type"])
    if "tuple" in value:
        return tuple(_model(v) for v in value["tuple"])
    kinds = {k.__name__: k for k in (SOMModel, KMeansModel, GMMModel, DensityModel, GridClusters, SOMClassifierModel)}
    if value.get("model") not in kinds:
        raise PersistenceError(f"no model of the kind {value.get('model')}")
    return kinds[value["model"]](**{k: _model(v) for k, v in value["fields"].items()})


def save_json(model: object, spark: SparkSession, path: str) -> None:
    """Any fitted model (map, k-means, mixture, density, classifier) as one line of JSON."""
    spark.createDataFrame([(json.dumps(_plain(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> object:
    try:
        row = spark.read.text(path).first()
    except AnalysisException as e:
        raise PersistenceError(f"no model at {path}") from e
    if row is None:
        raise PersistenceError(f"nothing at {path}")
    return _model(json.loads(row.value))
