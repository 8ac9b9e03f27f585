"""Model selection over ways of seeding: the map of best silhouette, the last of equals; a method that fails is passed over."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import GridscapeError, NotFitted
from gridscape.operators import metrics
from gridscape.operators.assign import nearest_column
from gridscape.operators.seeding import METHODS, init_codebook
from gridscape.operators.som import SOM, SOMModel
from gridscape.plans.storage import stored
from gridscape.schema import assemble


@dataclass
class ModelPicker:
    m: int = 10
    n: int = 10
    learning_rate: float = 0.5
    neighbor_radius: float = 1.0
    epochs: int = 10
    distance: str = "euclidean"
    seed: int = 0
    methods: tuple[str, ...] = METHODS
    results: list[tuple[str, float, SOMModel]] = field(default_factory=list)

    def evaluate(self, df: DataFrame, features: str | list[str] = "features", order_by: str = "row_id") -> ModelPicker:
        """All maps first, then the silhouettes of all in one pass over the pairs of rows."""
        found: list[tuple[str, SOMModel]] = []
        rows = assemble(df, features, order_by)
        peaks: np.ndarray | None = None
        for method in self.methods:
            try:
                by_density = method in ("kde", "kde_kmeans")  # without refinement both start from the same maxima, which cost a pass over all pairs
                if by_density and peaks is None:
                    peaks = init_codebook(rows, method, self.m * self.n, self.seed)
                som = SOM(self.m, self.n, self.learning_rate, self.neighbor_radius, method, self.distance, seed=self.seed)
                found.append((method, som.fit(df, self.epochs, True, None, features, order_by, seeds=peaks if by_density else None)))
            except GridscapeError:
                continue
        self.results = []
        if found:
            books = [model.weights for _, model in found]
            labelled = stored(rows.withColumn("labels", F.array(*[nearest_column(w, "features", self.distance)["unit"] for w in books])))
            try:
                self.results = [(method, score, model) for (method, model), score in zip(found, metrics.silhouettes(labelled.df), strict=True)]
            finally:
                labelled.remove()
        return self

    def best(self) -> tuple[str, float, SOMModel]:
        if not self.results:
            raise NotFitted("no method gave a map")
        top = max(score for _, score, _ in self.results)
        return next(r for r in reversed(self.results) if r[1] == top)
