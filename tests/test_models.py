import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridscape.errors import AlreadyFitted, DimensionMismatch, InsufficientData, InvalidClusterCount, InvalidInitMethod, InvalidLearningRate, PersistenceError
from gridscape.operators import gmm, gridops, kde, kernels, kselect, lloyd, metrics, seeding
from gridscape.operators.auto import AutoCluster, choose
from gridscape.operators.classify import SOMClassifier
from gridscape.operators.density import DensityModel, DensitySOM, grid_clusters
from gridscape.operators.gmm import DiagGMM
from gridscape.operators.kde import bandwidth, density, density_peaks, local_maxima
from gridscape.operators.picker import ModelPicker
from gridscape.operators.som import SOM, SOMModel
from gridscape.sources import persist
from tests.helpers import frame, line_blobs, plain_lloyd, waves, two_groups


@pytest.mark.parametrize("plan", ["local", "distributed"])
def test_lloyd_equals_definition(spark, plan):
    x = waves(60, 3)
    model = lloyd.fit_rows(frame(spark, x).repartition(3), 4, wanted=plan)
    c, label = plain_lloyd(x, x[kernels.farthest_points(x, 4)])
    assert np.allclose(model.centers, c, atol=1e-3)
    assert model.inertia == pytest.approx(((x - c[label]) ** 2).sum(), rel=1e-3)
    got = {r.row_id: r.label for r in model.transform(frame(spark, x)).collect()}
    assert sum(got[i] != label[i] for i in range(60)) <= 1


def test_lloyd_cases(spark):
    x, _ = two_groups()
    rows = frame(spark, x)
    km = lloyd.KMeans(k=2)
    model = km.fit(rows)
    assert len({r.label for r in model.transform(rows).collect()}) == 2 and model.inertia >= 0 and model.n_iter >= 1
    with pytest.raises(AlreadyFitted):
        km.fit(rows)
    for k in (0, 21):
        with pytest.raises(InvalidClusterCount):
            lloyd.KMeans(k=k).fit(rows)
    with pytest.raises(InvalidInitMethod):
        lloyd.KMeans(k=2, init="none").fit(rows)
    for init in ("d2", "random"):
        assert lloyd.KMeans(k=2, init=init).fit(rows).centers.shape == (2, 2)
    with pytest.raises(DimensionMismatch):
        lloyd.fit_rows(rows, 2, initial=np.zeros((2, 3)))
    kept = lloyd.fit_rows(rows, 2, initial=np.array([[0.0, 0.0], [1e6, 1e6], [100.0, 100.0]]))
    assert np.array_equal(kept.centers[1], [1e6, 1e6])  # an empty cluster keeps its centre


def test_row_hashes_are_those_of_spark(spark):
    ids = np.array([0, 1, -1, 7, 2**40, -(2**62)], np.int64)
    got = spark.createDataFrame([(i,) for i in ids.tolist()], "i long").select(*[F.xxhash64("i", *map(F.lit, v)).alias(str(v)) for v in ((), (3,), (-5, 9))]).collect()
    for k, v in enumerate(((), (3,), (-5, 9))):
        assert [r[k] for r in got] == kernels.row_hashes(ids, *v).tolist()


def test_d2_seeds_from_all_rows_on_either_plan(spark):
    """One far row of 12 000 that no sample of 10 000 by hash of the row would hold."""
    x = np.random.default_rng(0).normal(size=(12_000, 2))
    far = int(np.argsort(kernels.row_hashes(np.arange(len(x)), 0))[-1])
    x[far] = 1e6
    rows = frame(spark, x).repartition(3)
    found = [lloyd.fit_rows(rows, 2, "d2", max_iter=0 if k else 20, wanted=plan).centers for k in (0, 1) for plan in ("local", "distributed")]
    for a, b in (found[:2], found[2:]):
        assert np.allclose(a, b)
        assert np.abs(a - 1e6).max(axis=1).min() < 1


def test_shuffled_map_is_the_same_on_either_plan(spark):
    rows = frame(spark, waves(150, 3)).repartition(3)
    local, spread = (SOM(3, 3, init="zero", seed=2, plan=plan).fit(rows, 2) for plan in ("local", "distributed"))
    assert np.allclose(local.weights, spread.weights, atol=1e-9)
    assert not np.allclose(local.weights, SOM(3, 3, init="zero", seed=2).fit(rows, 2, False).weights, atol=1e-6)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 40), st.integers(1, 4), st.integers(0, 10**6))
def test_lloyd_inertia_never_rises(n, k, seed):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    c, before = x[: min(k, n)], math.inf
    for _ in range(8):
        c, _, inertia = kernels.lloyd_step(kernels.lloyd_sums(x, c), c)
        assert inertia <= before + 1e-9
        before = inertia


def test_farthest_points_take_the_last_of_equals():
    x = np.array([[0.0], [2.0], [-2.0], [2.0]])
    assert list(kernels.farthest_points(x - x.mean(), 2)) in ([2, 3], [3, 2])


def test_seeding(spark):
    x = waves(50, 3)
    rows = frame(spark, x)
    for method in seeding.METHODS:
        if "kde" not in method:
            assert seeding.init_codebook(rows, method, 4, 1).shape == (4, 3)
    assert np.allclose(seeding.init_codebook(rows, "som++", 5, wanted="local"), seeding.init_codebook(rows, "som++", 5, wanted="distributed"))
    shards = seeding.init_codebook(frame(spark, [[3.0], [1.0], [2.0]]), "naive_sharding", 4)
    assert shards.ravel().tolist() == [1, 2, 3, 0]  # a shard without rows is zero
    assert np.array_equal(seeding.zero(2, 3), np.eye(2, 3)) and seeding.zero(5, 3, "hadamard").shape == (5, 3)
    with pytest.raises(InvalidInitMethod):
        seeding.init_codebook(rows, "nothing", 3)
    with pytest.raises(InvalidClusterCount):
        seeding.init_codebook(rows, "som++", 51)
    w = seeding.lsuv(rows, 6, 3, 0)
    assert (x @ w.T).var() == pytest.approx(1, abs=0.11)


def test_ordered_fold_equals_sequence():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(40, 3)), rng.normal(size=(9, 3))
    schedule = kernels.Schedule(0.5, 2.0, 40)
    g = np.arange(40.0)
    bmu, _ = kernels.nearest(x, w)
    h = kernels.influence(bmu, g, schedule, 3, 9)
    seq = w.copy()
    for i in range(40):
        seq = (1 - h[i])[:, None] * seq + h[i][:, None] * x[i]
    for cuts in ([0, 40], [0, 13, 40], [0, 5, 6, 31, 40]):
        pair = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = kernels.fold(h[a:b], x[a:b])
            pair = part if pair is None else kernels.compose(pair, part)
        assert np.abs(pair[0][:, None] * w + pair[1] - seq).max() < 1e-12


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_training_does_not_depend_on_partitions(spark, parts):
    rows = frame(spark, waves(90, 3)).repartition(parts)
    a = SOM(3, 3, 0.5, 1.5, "naive_sharding", plan="local").fit(rows, 2, False, 30)
    b = SOM(3, 3, 0.5, 1.5, "naive_sharding", plan="distributed").fit(rows, 2, False, 30)
    assert np.abs(a.weights - b.weights).max() < 1e-10


def test_distributed_training_leaves_nothing_behind(spark):
    """No table stays in memory or in the shared folder, and the driver gets one pair a file of positions, however many Arrow batches that is."""
    import glob

    from gridscape.operators import som as module
    from gridscape.plans.storage import shared_dir
    from gridscape.schema import positions

    rows = frame(spark, waves(400, 3)).repartition(4)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    files = set(glob.glob(f"{shared_dir(spark)}/gridscape/*"))
    SOM(3, 3, init="zero", plan="distributed").fit(rows, 2, batch_size=200)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert set(glob.glob(f"{shared_dir(spark)}/gridscape/*")) == files
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        placed = positions(rows)
        schedule, som, w = kernels.Schedule(0.5, 1.5, 400), SOM(3, 3), np.zeros((9, 3)) + np.arange(9)[:, None]
        whole = module.fold_job(placed.df, w, schedule, 0, som)
        module.MOST_PAIRS, most = 1, module.MOST_PAIRS
        try:
            assert np.allclose(module.fold_job(placed.df, w, schedule, 0, som), whole)  # composed by executors first
        finally:
            module.MOST_PAIRS = most
        placed.remove()
    finally:
        spark.conf.set(key, before)
    assert np.allclose(whole, kernels.train_batch(w, waves(400, 3), np.arange(400.0), schedule, 3, "euclidean", "exact"))


@pytest.mark.parametrize("options", [{"bmu_refresh": "sample"}, {"distance": "cosine", "update": "cosine"}, {"update": "manhattan", "max_iter": 170}])
def test_sequential_training_in_slices(spark, monkeypatch, options):
    from gridscape.operators import som as module

    rows = frame(spark, waves(90, 3)).repartition(3)
    whole = SOM(3, 3, init="zero", plan="local", **options).fit(rows, 2)
    monkeypatch.setattr(module, "SLICE_BYTES", 8 * 3 * 25)
    assert np.allclose(SOM(3, 3, init="zero", plan="distributed", **options).fit(rows, 2).weights, whole.weights)


def test_bandwidth_in_one_task_is_the_same(spark):
    rows = frame(spark, 9 * waves(60, 3))
    for method in ("silverman", "scott"):
        assert kselect.smoothing_sigma(rows, 20, 20, method, (60, 3)) == pytest.approx(kselect.smoothing_bandwidth(rows, 20, 20, method).first()[0])


def test_several_starts_at_once(spark):
    x = waves(60, 3)
    starts = [x[:4], x[10:14], None]
    one = lloyd.fit_several(frame(spark, x), 4, starts)
    for a, s in zip(one, starts, strict=True):
        b = lloyd.fit_rows(frame(spark, x), 4, initial=s)
        assert np.allclose(a.centers, b.centers) and a.inertia == pytest.approx(b.inertia)


def test_seeds_inside_the_training_job_are_the_same(spark):
    x = waves(40, 3)
    for method in seeding.AT_HAND:
        assert np.allclose(seeding.codebook_at_hand(x, method, 4, 3), seeding.init_codebook(frame(spark, x), method, 4, 3))


def test_schedule_and_limits(spark):
    s = kernels.Schedule(0.5, 3.0, 100)
    rate, radius = s.at(np.array([0.0, 100.0]))
    assert rate[0] == 0.5 and radius[0] == 3.0 and rate[1] == pytest.approx(0.5 * math.exp(-5))
    warm = kernels.Schedule(0.5, 3.0, 100, (0.1, 0.2)).at(np.array([0.0, 1.0]))
    assert warm[0][0] == 0.1 and warm[1][0] == 0.2 and warm[0][1] == pytest.approx(0.5 * math.exp(-0.05))
    rows = frame(spark, waves(30, 2))
    still = SOM(2, 2, init="naive_sharding", max_iter=0).fit(rows, 3, False)
    assert np.allclose(still.weights, seeding.init_codebook(rows, "naive_sharding", 4))
    with pytest.raises(InvalidLearningRate):
        SOM(learning_rate=1.77)
    with pytest.raises(InsufficientData):
        SOM(2, 2).fit(rows, 1, batch_size=0)


def test_map_cycle(spark):
    rows = frame(spark, waves(), np.arange(100) % 3)
    model = SOM(4, 4, init="som++").fit(rows, 3)
    bmu = [r.bmu for r in model.transform(rows).collect()]
    assert 0 <= min(bmu) and max(bmu) < 16 and model.neurons(spark).count() == 16
    scores = model.evaluate(rows)
    assert set(scores) == {"silhouette", "davies_bouldin", "calinski_harabasz", "dunn"} and -1 <= scores["silhouette"] <= 1
    assert all(0 <= v <= 1 for v in model.bcubed(rows, "label"))
    for fn in (model.cluster, model.cluster_refined, model.tree_cluster):
        assert {r.k for r in fn(rows, 3, out="k").collect()} <= {0, 1, 2}
    with pytest.raises(InvalidClusterCount):
        model.cluster(rows, 17)
    with pytest.raises(DimensionMismatch):
        model.evaluate(frame(spark, [[1.0]]))
    again = SOM(4, 4, init="som++").fit(rows, 1, warm=model)
    assert again.weights.shape == model.weights.shape
    with pytest.raises(DimensionMismatch):
        SOM(2, 2).fit(rows, 1, warm=model)


@pytest.mark.parametrize("options", [{"bmu_refresh": "sample"}, {"distance": "cosine", "update": "cosine"}, {"update": "manhattan"}, {"algorithm": "batch_map"}, {"exp_mode": "taylor"}])
def test_ways_of_training(spark, options):
    rows = frame(spark, waves(40, 3))
    assert np.isfinite(SOM(3, 3, init="som++", **options).fit(rows, 2).weights).all()


def test_refined_is_no_worse_than_plain(spark):
    rows = frame(spark, waves(80, 2))
    model = SOM(4, 4, init="som++").fit(rows, 3, False)
    refined = model.cluster_refined(rows, 4)
    c = np.array([r.m for r in refined.groupBy("label").agg(F.array(*[F.avg(F.col("features")[j]) for j in range(2)]).alias("m")).collect()])
    assert lloyd.inertia(rows, c) <= 1.06 * lloyd.fit_rows(rows, 4).inertia


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_save_and_load(spark, tmp_path, format):
    rows = frame(spark, [[i + 0.1 * j for j in range(3)] for i in range(50)])
    model = SOM(3, 3, distance="manhattan", init="som++").fit(rows, 1)
    persist.save(model, spark, str(tmp_path / "m"), format)
    back = persist.load(spark, str(tmp_path / "m"), format)
    assert back.distance == "manhattan" and back.last == pytest.approx(model.last)
    assert model.transform(rows).exceptAll(back.transform(rows)).isEmpty()
    with pytest.raises(PersistenceError):
        persist.load(spark, str(tmp_path / "none"))


def test_grid_smoothing_equals_sum():
    hits = np.zeros((4, 6))
    for u, v in {0: 7, 5: 3, 10: 15, 17: 9, 23: 2}.items():
        hits[divmod(u, 6)] = v
    full = np.array([[sum(hits[a, b] * math.exp(-((a - r) ** 2 + (b - c) ** 2) / 4.5) for a in range(4) for b in range(6) if abs(a - r) <= 5 and abs(b - c) <= 5) for c in range(6)] for r in range(4)])
    assert np.abs(gridops.smooth(hits, 1.5) - full).max() < 1e-10


def test_grid_operators(spark):
    assert 0.05 < gridops.otsu(np.array([0.01 * i for i in range(10)] + [1 - 0.01 * i for i in range(10)])) < 0.95
    assert gridops.otsu(np.full(5, 2.0)) == 2.0
    core = np.zeros(25, bool)
    core[[0, 1, 5, 6, 18, 19, 23, 24]] = True
    label = gridops.components(core, 5, 5)
    assert label.max() == 1 and label[12] == -1 and label[0] == 0 and label[24] == 1
    v = np.full(25, 0.1)
    v[0], v[24] = 1.0, 0.9
    two = gridops.watershed(v, np.ones(25, bool), 5, 5)
    assert set(two) == {0, 1} and two[0] == 0 and two[24] == 1
    assert set(gridops.watershed(np.ones(9), np.ones(9, bool), 3, 3)) == {0}
    tree = gridops.cut_tree(np.array([[0.0], [0.1], [9.0], [9.1]]), 2, 2, 2)
    assert tree.tolist() == [0, 0, 1, 1]


def test_density(spark):
    empty = grid_clusters(np.zeros((3, 3)))
    assert empty.n_clusters == 1 and empty.core.all()
    rows = frame(spark, line_blobs())
    model = DensitySOM(SOM(6, 6, 0.5, 3.0, "som++"), 1.0).fit(rows, 10)
    summary = model.summary(rows).first()
    assert summary.n_clusters >= 1 and 0 <= summary.noise_ratio < 0.5
    som = SOM(6, 6, init="som++").fit(rows, 3, False)
    bare = DensityModel.from_som(som)
    assert {r.label for r in bare.transform(rows).collect()} == {-1}
    a, b = bare.refit_density(rows), DensitySOM(SOM(6, 6, init="som++")).fit(rows, 3, False)
    assert a.transform(rows).exceptAll(b.transform(rows)).isEmpty()
    assert a.grid_table(spark).count() == 36
    with pytest.raises(InsufficientData):
        DensityModel.from_som(som).refit_density(rows.limit(1))


def test_mixture(spark):
    x = np.array([[i, j] for i in range(10) for j in range(10)], float)
    x = np.concatenate([x, x + 100])
    rows = frame(spark, x)
    local, spread = (DiagGMM(2, plan=p).fit(rows) for p in ("local", "distributed"))
    assert local.bic == pytest.approx(spread.bic, rel=1e-9) and np.allclose(local.means, spread.means)
    assert len({r.label for r in local.transform(rows).collect()}) == 2 and local.components(spark).count() == 2
    assert gmm.bic_select_k(x, range(2, 6)) == 2 and kselect.bic_k(spark, x, [2, 3, 4, 5]) == 2
    assert kselect.gap_statistic(spark, x, [2, 3, 4], 3) in (2, 3, 4)


def test_kde(spark):
    rows = frame(spark, [[i + 0.1 * j for j in range(2)] for i in range(20)])
    assert bandwidth(rows).first()[0] == pytest.approx(19 / (1 + math.log2(20)))
    assert bandwidth(rows.limit(1)).first()[0] == 1.0
    assert all(r.density >= 0 for r in density(rows).collect())
    spike = spark.createDataFrame([(i, 1.0 if i == 5 else 0.1) for i in range(11)], "row_id long, density double")
    assert [r.row_id for r in local_maxima(spike).collect()] == [5]
    rng = np.random.default_rng(0).random(40)
    wave = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng)], "row_id long, density double").repartition(5)
    want = [i for i in range(1, 39) if rng[i - 1] < rng[i] > rng[i + 1]]
    for block in (1, 3, 40, 1000):
        assert sorted(r.row_id for r in local_maxima(wave, block=block).collect()) == want
    with pytest.raises(InsufficientData):
        density_peaks(rows, 19)


@pytest.mark.parametrize("curve,k", [([100, 95, 90, 60, 65, 68, 70], 5), ([100, 90, 80, 70], 2), ([100], 2)])
def test_elbow(spark, curve, k):
    ks = list(range(2, 2 + len(curve)))
    assert kselect.elbow_of(ks, curve) == k
    assert kselect.elbow(spark.createDataFrame(list(zip(ks, map(float, curve), strict=True)), "k int, inertia double")).first().k_elbow == k


def test_stratified_sample(spark):
    rows = frame(spark, np.zeros((300, 1)), np.array([0] * 290 + [1] * 10))
    sample = kselect.stratified_sample(rows, most=100)
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert sum(counts.values()) == 100 and counts[1] == 10
    assert kselect.stratified_sample(rows, most=300).count() == 300


def test_choice_rules():
    nan = math.nan
    assert choose({"KMeans": 0.5, "GMM": 0.51, "DenSOM": 0.6}, 3, 0.1) == "DenSOM"
    assert choose({"KMeans": 0.5, "GMM": 0.7, "DenSOM": 0.6}, 3, 0.1) == "GMM"
    assert choose({"KMeans": 0.5, "GMM": nan, "DenSOM": 0.6}, 3, 0.3) == "KMeans"
    assert choose({"KMeans": 0.01, "GMM": 0.0, "DenSOM": nan}, 3, 0.0) == "KMeans"


def test_auto(spark):
    rows = frame(spark, line_blobs())
    found = AutoCluster(4, 4, init="som++", gap_n_refs=2).fit(rows, 2, False)
    assert found.algorithm in ("DenSOM", "KMeans", "GMM") and found.k_detected >= 2
    assert found.transform(rows).count() == 120


def test_classifier_and_picker(spark):
    x = np.array([[0.1 * i + 0.01 * j for j in range(2)] for i in range(30)])
    rows = frame(spark, x, np.arange(30) // 10)
    model = SOMClassifier(5, 5, init="som++").fit(rows, "label", 5)
    scores = model.evaluate(rows, "label")
    assert scores["accuracy"] > 60 and 0 <= scores["f1"] <= 1
    assert set(model.evaluate(rows, "label", ["f1"], binary=True)) == {"f1"}
    picker = ModelPicker(2, 2, epochs=1, methods=("random", "som++", "kde")).evaluate(rows)
    assert picker.best()[1] == max(s for _, s, _ in picker.results)


def test_picker_goes_over_pairs_once(spark, monkeypatch):
    rows = frame(spark, np.vstack([line_blobs(), waves(80, 2)])).persist()
    passes = {"scores": 0, "densities": 0}

    def counted(name, fn):
        def run(*args, **options):
            passes[name] += 1
            return fn(*args, **options)

        return run

    monkeypatch.setattr(metrics, "pairwise", counted("scores", metrics.pairwise))
    monkeypatch.setattr(kde, "pairwise", counted("densities", kde.pairwise))
    picker = ModelPicker(2, 2, epochs=1, methods=("random", "som++", "kde", "kde_kmeans", "he")).evaluate(rows)
    assert passes == {"scores": 1, "densities": 1} and len(picker.results) == 5
    for method, score, model in picker.results:
        assert score == pytest.approx(model.evaluate(rows, ["silhouette"])["silhouette"], abs=1e-9), method


@pytest.mark.parametrize("n", [1, 700, 5000])
def test_lloyd_sums_and_strips_equal_definition(n):
    x = waves(n, 3)
    c = x[:: max(1, n // 40)][:40].copy()
    label, _ = kernels.nearest(x, c)
    sums = kernels.lloyd_sums(x, c)
    for j in range(len(c)):
        away = x[label == j] - c[j]
        assert np.allclose(sums[j], [len(away), (away**2).sum(), *away.sum(axis=0)])
    d2 = np.concatenate([d.copy() for _, d in kernels.l2sq_strips(x, c)])
    assert np.allclose(d2, ((x[:, None, :] - c) ** 2).sum(axis=2))


def test_batch_map_counts_every_unit_within_three_radii(spark):
    x, epochs, radius = waves(150, 3), 3, 3.0
    w = start = np.vstack([x[:20], x[:16] + 40.0])
    rows, columns = np.divmod(np.arange(36), 6)
    away = (rows[:, None] - rows) ** 2 + (columns[:, None] - columns) ** 2
    reach = np.maximum(abs(rows[:, None] - rows), abs(columns[:, None] - columns))
    for epoch in range(epochs):
        label, s = kernels.nearest(x, w)[0], radius * math.exp(-3 * epoch / epochs)
        h = np.where(reach <= math.ceil(3 * s), np.exp(-away / (2 * s * s)), 0.0)
        sums = np.array([x[label == j].sum(axis=0) for j in range(36)])
        n = np.array([(label == j).sum() for j in range(36)])
        w = np.array([h[j] @ sums / (h[j] @ n) if h[j] @ n > 0 else w[j] for j in range(36)])
    model = SOM(6, 6, 0.5, radius, algorithm="batch_map").fit(frame(spark, x), epochs, False, seeds=start)
    assert np.abs(model.weights - w).max() < 1e-10
