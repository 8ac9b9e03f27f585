"""The automatic pipeline: a map, the number of clusters, and the best of k-means, mixture and density clustering."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gridscape.operators import kernels, kselect, lloyd, metrics
from gridscape.operators.density import DensityModel
from gridscape.operators.gmm import DiagGMM, likeliest
from gridscape.operators.som import SOM, SOMModel
from gridscape.schema import assemble, shape

#: What results call the algorithms.
NAMES = ("DenSOM", "KMeans", "GMM")


@dataclass
class AutoResult:
    """algorithm names the model whose transform gives the labels; k_detected is what the statistics said."""

    algorithm: str
    k_detected: int
    n_clusters: int
    noise_ratio: float
    scores: dict[str, float]
    model: object
    som: SOMModel

    def transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        return self.model.transform(df, out)


@dataclass
class AutoCluster:
    m: int = 10
    n: int = 10
    learning_rate: float = 0.5
    neighbor_radius: float = 3.0
    init: str = "random"
    distance: str = "euclidean"
    max_iter: int | None = None
    sigma_method: str = "silverman"
    gap_n_refs: int = 10
    seed: int = 0
    plan: str = "auto"
    som: SOM = field(init=False)

    def __post_init__(self) -> None:
        self.som = SOM(self.m, self.n, self.learning_rate, self.neighbor_radius, self.init, self.distance, self.max_iter, self.seed, plan=self.plan)

    def fit(self, df: DataFrame, epochs: int, shuffle: bool = True, batch_size: int | None = None, features: str | list[str] = "features", order_by: str = "row_id") -> AutoResult:
        spark, rows = df.sparkSession, assemble(df, features, order_by).persist()
        try:
            n, d = shape(rows, 2)
            som = self.som.fit(rows, epochs, shuffle, batch_size)
            k_max = min(50, max(2, self.m * self.n // 2))
            curve = range(2, min(k_max, self.m * self.n) + 1)
            k_elbow = kselect.elbow_of(list(curve), kselect.inertia_curve(som.weights, curve))
            units, _, _ = lloyd.fit_array(som.weights, min(k_elbow, self.m * self.n), max_iter=100)
            sample_rows = kselect.stratified_sample(som.mapped(rows, kernels.nearest(som.weights, units)[0]))
            sample = kselect.sample_array(sample_rows)
            sweep = range(2, k_max + 1) if d <= 10 else range(max(2, k_elbow - 5), min(k_max, k_elbow + 5) + 1)
            k = min(n, max(kselect.select_k(spark, sample, list(range(2, k_max + 1)), list(sweep), self.gap_n_refs, k_elbow)))
            km = lloyd.fit_rows(rows, k, wanted=self.plan, known=(n, d))
            mixture = DiagGMM(k, plan=self.plan).fit_rows(rows, n, d)
            sigma = kselect.smoothing_sigma(rows, self.m, self.n, self.sigma_method, (n, d), self.plan)
            density = DensityModel.from_som(som, sigma).refit_density(rows)
            whole = density.summary(rows).first()
            # of the sample, which is of bounded size and at hand
            unit = density.grid.labels[kernels.nearest(sample, som.weights, som.distance)[0]]
            quiet = unit >= 0
            scores = {
                "KMeans": metrics.silhouette_array(sample, kernels.nearest(sample, km.centers)[0]),
                "GMM": metrics.silhouette_array(sample, likeliest(sample, mixture.weights, mixture.means, mixture.variances)),
                "DenSOM": metrics.silhouette_array(sample[quiet], unit[quiet]) if quiet.sum() >= 4 else math.nan,
            }
        finally:
            rows.unpersist()
        name = choose(scores, density.grid.n_clusters, whole.noise_ratio)
        model = {"DenSOM": density, "GMM": mixture, "KMeans": km}[name]
        for part in (som, km, mixture):
            part.features = features
        found = density.grid.n_clusters if name == "DenSOM" else k
        return AutoResult(name, k, found, whole.noise_ratio if name == "DenSOM" else 0.0, scores, model, som)


def choose(scores: dict[str, float], density_clusters: int, noise: float) -> str:
    """Density clustering if it is finite, of two clusters and under 20 % noise, and clearly better than k-means; a mixture if clearly better; else k-means.

    A comparison with NaN is false.
    """
    km, mixture, density = scores["KMeans"], scores["GMM"], scores["DenSOM"]
    dense = math.isfinite(density) and density_clusters >= 2 and noise < 0.20 and (density > km + 0.02 or (km < 0.05 and density > 0.1))
    mixed = mixture > km + 0.02
    if dense and (not mixed or density >= mixture):
        return "DenSOM"
    return "GMM" if mixed else "KMeans"
