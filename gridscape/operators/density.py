"""Density clustering on a map: smoothed hits, threshold, basins; rows take their unit's cluster and density."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.errors import InsufficientData
from gridscape.operators import gridops
from gridscape.operators.assign import hit_map, nearest
from gridscape.operators.som import SOM, SOMModel
from gridscape.schema import shape


@dataclass
class GridClusters:
    density: np.ndarray
    core: np.ndarray
    labels: np.ndarray
    n_clusters: int


def grid_clusters(hits: np.ndarray, smooth_sigma: float = 1.0) -> GridClusters:
    """Clusters of an m x n grid of hits. No hits at all: every unit is core, of one cluster; a flat density: connected components."""
    m, n = hits.shape
    density = gridops.smooth(hits.astype(float), smooth_sigma * math.sqrt(m * n) / (2 * math.pi)).ravel()
    if density.max() <= 0:
        return GridClusters(density, np.ones(m * n, bool), np.zeros(m * n, int), 1)
    if density.std() < 1e-9:
        core = np.ones(m * n, bool)
        labels = gridops.components(core, m, n)
    else:
        core = density >= gridops.otsu(density)
        labels = gridops.watershed(density, core, m, n)
    return GridClusters(density, core, labels, int(labels.max()) + 1)


@dataclass
class DensityModel:
    """A trained map, and after `refit_density` its units' clusters; before that every row is noise (-1)."""

    som: SOMModel
    smooth_sigma: float = 1.0
    grid: GridClusters | None = None

    @classmethod
    def from_som(cls, som: SOMModel, smooth_sigma: float = 1.0) -> DensityModel:
        return cls(som, smooth_sigma)

    def set_smooth_sigma(self, sigma: float) -> DensityModel:
        self.smooth_sigma = sigma
        return self

    def refit_density(self, df: DataFrame, order_by: str = "row_id") -> DensityModel:
        rows = self.som.rows(df, order_by)
        if rows.limit(2).count() < 2:
            raise InsufficientData("a density needs two rows")
        hits = [r.hits for r in hit_map(nearest(rows, self.som.weights, self.som.distance), self.som.units).orderBy("unit").collect()]
        self.grid = grid_clusters(np.array(hits).reshape(self.som.m, self.som.n), self.smooth_sigma)
        return self

    def transform(self, df: DataFrame, label: str = "label", density: str = "density") -> DataFrame:
        """df with its rows' cluster and density, 1 at the densest unit; narrow."""
        grid = self.grid or GridClusters(np.zeros(self.som.units), np.zeros(self.som.units, bool), np.full(self.som.units, -1), 0)
        top = float(grid.density.max()) or 1.0
        labels, heights = F.array(*[F.lit(int(v)) for v in grid.labels]), F.array(*[F.lit(float(v) / top) for v in grid.density])
        return self.som.transform(df, "_bmu").withColumns({label: F.get(labels, F.col("_bmu")), density: F.get(heights, F.col("_bmu"))}).drop("_bmu")

    def summary(self, df: DataFrame) -> DataFrame:
        """n_clusters, noise_ratio."""
        n = self.grid.n_clusters if self.grid else 0
        return self.transform(df).agg(F.lit(n).alias("n_clusters"), F.avg((F.col("label") < 0).cast("double")).alias("noise_ratio"))

    def grid_table(self, spark) -> DataFrame:
        g = self.grid
        return spark.createDataFrame([(u, u // self.som.n, u % self.som.n, float(g.density[u]), bool(g.core[u]), int(g.labels[u])) for u in range(self.som.units)], "neuron_id int, grid_row int, grid_col int, density double, core boolean, cluster int")


@dataclass
class DensitySOM:
    som: SOM
    smooth_sigma: float = 1.0

    def fit(self, df: DataFrame, epochs: int, shuffle: bool = True, batch_size: int | None = None, features: str | list[str] = "features", order_by: str = "row_id") -> DensityModel:
        from gridscape.schema import assemble

        shape(assemble(df, features, order_by), 2)
        return DensityModel(self.som.fit(df, epochs, shuffle, batch_size, features, order_by), self.smooth_sigma).refit_density(df, order_by)
