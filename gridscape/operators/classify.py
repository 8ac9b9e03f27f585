"""Classification through a map: a unit takes the class of the training row nearest to it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import InvalidMetric
from gridscape.operators import metrics
from gridscape.operators.assign import nearest_row_per_unit
from gridscape.operators.som import SOM, SOMModel

SCORES = ("accuracy", "precision", "recall", "f1")


@dataclass
class SOMClassifierModel:
    som: SOMModel
    labels: np.ndarray

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.som.mapped(df, self.labels, out)

    def neuron_labels(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, int(v)) for i, v in enumerate(self.labels)], "neuron_id int, label int")

    def evaluate(self, df: DataFrame, y: str, names: list[str] | str = "all", binary: bool = False) -> dict[str, float]:
        """accuracy in percent; precision, recall and f1 by BCubed, or of class 1 if binary."""
        wanted = list(SCORES) if names == "all" or "all" in names else [names] if isinstance(names, str) else list(names)
        if unknown := set(wanted) - set(SCORES):
            raise InvalidMetric(", ".join(sorted(unknown)))
        scored = self.transform(df)
        found = {"accuracy": metrics.value(metrics.accuracy(scored, y, "prediction"))} if "accuracy" in wanted else {}
        if set(wanted) - {"accuracy"}:
            rates = metrics.binary(scored, y, "prediction") if binary else metrics.bcubed(scored, "prediction", y).withColumn("f1", metrics._f1())
            row = rates.first().asDict()
            found |= {k: row[k] for k in ("precision", "recall", "f1") if k in wanted}
        return found


@dataclass
class SOMClassifier:
    m: int = 10
    n: int = 10
    learning_rate: float = 0.5
    init: str = "random"
    seed: int = 0
    plan: str = "auto"

    def fit(self, df: DataFrame, label: str, epochs: int, shuffle: bool = True, batch_size: int | None = None, features: str | list[str] = "features", order_by: str = "row_id") -> SOMClassifierModel:
        som = SOM(self.m, self.n, self.learning_rate, init=self.init, seed=self.seed, plan=self.plan).fit(df, epochs, shuffle, batch_size, features, order_by)
        near = nearest_row_per_unit(som.rows(df, order_by, label).withColumn(label, F.col(label).cast("int")), som.weights, label)
        return SOMClassifierModel(som, np.array([r[label] for r in near.orderBy("unit").collect()]))
