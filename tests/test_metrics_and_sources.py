import json
import math
import threading
import urllib.error
import urllib.request
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridscape.errors import DimensionMismatch, InvalidMetric, NotFitted, PersistenceError
from gridscape.operators import metrics as M
from gridscape.operators.classify import SOMClassifier
from gridscape.operators.density import DensityModel
from gridscape.operators.gmm import DiagGMM
from gridscape.operators.lloyd import KMeans
from gridscape.operators.som import SOM, SOMModel
from gridscape.plans import planner
from gridscape.service import ModelRegistry, server
from gridscape.sources import datagen, io, persist
from gridscape.streaming.score import OnlineSOM, score_stream, windowed_hits
from tests.helpers import frame, waves, two_groups

SF = "/root/testdata/sf0.001"


def test_two_groups(spark):
    x, y = two_groups()
    rows = frame(spark, x, y)
    s = M.evaluate(rows)
    assert s["silhouette"] > 0.5 and s["dunn"] > 0 and s["calinski_harabasz"] > 0 and s["davies_bouldin"] >= 0
    assert M.value(M.knn_consistency(rows, 3)) > 0.5 and M.value(M.dbcv(rows, 3)) > 0.5


def test_edge_cases(spark):
    x, _ = two_groups()
    one = frame(spark, x, np.zeros(20))
    assert [M.value(f(one)) for f in (M.silhouette, M.davies_bouldin, M.calinski_harabasz, M.dunn, M.dbcv)] == [0] * 5
    alone = frame(spark, [[0.0], [1.0], [5.0]], [0, 1, 2])
    assert M.value(M.silhouette(alone)) == 1.0 and M.value(M.dunn(alone)) == math.inf
    assert M.calinski_harabasz(frame(spark, [[0.0], [0.0], [1.0], [1.0]], [0, 0, 1, 1])).first()[0] is None
    with pytest.raises(InvalidMetric):
        M.evaluate(one, ["nothing"])
    assert set(M.evaluate(one, pairwise_limit=5)) == {"davies_bouldin", "calinski_harabasz"}


def test_silhouette_equals_definition(spark):
    x, y = waves(30, 2), np.arange(30) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(30):
        own = (y == y[i]) & (np.arange(30) != i)
        a, b = d[i][own].mean(), min(d[i][y == c].mean() for c in range(3) if c != y[i])
        want.append((b - a) / max(a, b))
    assert M.value(M.silhouette(frame(spark, x, y))) == pytest.approx(np.mean(want), abs=1e-6)


def test_external(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(12)], "c int, y int")
    r = M.bcubed(same, "c", "y").first()
    assert (r.precision, r.recall) == (1, 1) and M.value(M.accuracy(same, "c", "y")) == 100
    e = M.external(same, "c", "y").first()
    assert e.ari == pytest.approx(1) and e.nmi == pytest.approx(1) and e.fmi == pytest.approx(1)
    none = same.where("c < 0")
    assert M.bcubed(none, "c", "y").first()[:] == (0, 0) and M.value(M.accuracy(none, "c", "y")) == 0
    b = M.binary(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int"), "y", "p").first()
    assert (b.precision, b.recall, b.f1) == (0.5, 0.5, 0.5)
    boot = M.bootstrap_ari_difference(same.withColumn("z", F.lit(0)), "y", "c", "z", 20).first()
    assert boot.low <= boot.high and boot.low > 0.5


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("f0,f1,label\n1.5,2,0\n3,4,1\n")
    rows = io.read_points(spark, str(tmp_path / "p.csv"), 2).orderBy("row_id").collect()
    assert [r.features for r in rows] == [[1.5, 2], [3, 4]] and [r.label for r in rows] == [0, 1]
    assert "label" not in io.read_points(spark, str(tmp_path / "p.csv"), 2, False).columns
    io.write_labels(spark.createDataFrame([(1, -1), (0, 7)], "row_id int, label int"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["7", "-1"]
    (tmp_path / "c.json").write_text(json.dumps([{"name": "a", "n_true_clusters": 2, "som_m": 3, "som_n": 4, "epochs": 5}]))
    assert io.read_config(spark, str(tmp_path / "c.json")).first().som_n == 4
    io.write_metrics(spark.createDataFrame([("a", math.inf, 1 / 3)], "n string, x double, y double"), str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"n": "a", "x": None, "y": 0.333333}
    with pytest.raises(DimensionMismatch):
        io.rows_from_json(spark.createDataFrame([("[[1,2],[3]]",)], "data string"))


def test_generators_do_not_depend_on_partitions(spark):
    a = datagen.blobs(spark, 60, seed=3).orderBy("row_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    b = datagen.blobs(spark, 60, seed=3).repartition(5).orderBy("row_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [np.round(r.features, 9).tolist() for r in a] == [np.round(r.features, 9).tolist() for r in b]
    x = np.array([r.features for r in a])
    assert np.allclose(x.mean(axis=0), 0) and np.allclose(x.std(axis=0), 1)


def test_service(spark):
    reg = ModelRegistry(spark)
    data = waves(20, 2).tolist()
    out = reg.train({"data": data, "grid_size": 10, "learning_rate": 9, "epochs": 2, "init_method": "?", "distance": "?"})
    assert out["grid_size"] == 4 and out["samples"] == 20 and reg.models[out["model_id"]].learning_rate == 0.5
    assert len(reg.predict({"model_id": out["model_id"], "data": data[:3]})["predictions"]) == 3
    with pytest.raises(NotFitted):
        reg.predict({"model_id": "none", "data": data})
    with pytest.raises(DimensionMismatch):
        reg.train({"data": [[1, 2], [3]]})
    assert reg.health()["models"] == 1 and reg.benchmark({"samples": 50, "grid_size": 3, "epochs": 1})["seconds"] > 0


def test_streams(spark, tmp_path):
    rows = frame(spark, waves(40, 2)).withColumn("ts", F.timestamp_seconds(F.col("row_id") * 60))
    rows.write.parquet(str(tmp_path / "in"))
    model = SOM(3, 3, init="som++").fit(rows, 1)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("scored", score_stream(stream(), model).select("row_id", "bmu"), "append"), ("hits", windowed_hits(stream(), model, "ts"), "complete")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("scored").exceptAll(model.transform(rows).select("row_id", "bmu")).isEmpty()
    assert spark.table("hits").agg(F.sum("hits")).first()[0] == 40
    sink = OnlineSOM(SOM(3, 3, init="som++"))
    stream().writeStream.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    first = sink.model.weights
    sink(rows, 0)  # a batch that comes again
    assert np.array_equal(first, sink.model.weights)
    sink(rows, sink.done + 1)
    assert not np.array_equal(first, sink.model.weights)


def test_spanning_trees_by_rounds_are_those_of_one_task(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(70, 2)), 5 + rng.normal(size=(50, 2)), np.zeros((5, 2)) + 9])
    rows = frame(spark, x, [0] * 70 + [1] * 50 + [2] * 5)
    base = rows.join(M.core_distances(rows, 3), "row_id").withColumn("label", F.col("label").cast("long"))
    prim = {r.label: (r.n, r.dsc) for r in base.groupBy("label").applyInPandas(M._largest_tree_edge, "label long, n long, dsc double").collect()}
    found = {r.label: (r.n, r.dsc) for r in M.largest_tree_edges(base).collect()}
    assert found.keys() == prim.keys() and all(found[k][0] == prim[k][0] and found[k][1] == pytest.approx(prim[k][1]) for k in prim)
    assert M.value(M.dbcv(rows, 3, 20)) == pytest.approx(M.value(M.dbcv(rows, 3)))


def test_pairs_in_tiles(spark, monkeypatch):
    rows = frame(spark, waves(90, 3), np.arange(90) % 4)
    want = [M.value(f(rows)) for f in (M.silhouette, M.dunn, M.davies_bouldin, M.dbcv)]
    monkeypatch.setattr(planner, "PAIR_TILE", 13)
    assert [M.value(f(rows)) for f in (M.silhouette, M.dunn, M.davies_bouldin, M.dbcv)] == pytest.approx(want)


def test_silhouette_of_a_sample_at_hand(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 3)), np.ones((3, 3))])
    for label in (rng.integers(0, 4, 43), np.arange(43) // 42, np.zeros(43, int)):
        assert M.silhouette_array(x, label) == pytest.approx(M.value(M.silhouette(frame(spark, x, label))))


def test_csv_rows_are_numbered_by_file_and_line(spark, tmp_path):
    want = []
    for k, n in enumerate((3, 400, 1, 50)):
        lines = [f"{k}.0,{i}.0,{i % 3}" for i in range(n)]
        (tmp_path / f"part-{k}.csv").write_text("a,b,label\n" + "\n".join(lines) + "\n")
        want += [[float(k), float(i)] for i in range(n)]
    got = io.read_points(spark, str(tmp_path), 2).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(454)) and [r.features for r in got] == want


def test_any_model_as_json(spark, tmp_path):
    rows = frame(spark, waves(60, 3), np.arange(60) % 3)
    som = SOM(3, 3, init="som++").fit(rows, 1)
    models = [som, KMeans(k=3).fit(rows), DiagGMM(2).fit(rows), DensityModel.from_som(som).refit_density(rows), SOMClassifier(3, 3, init="som++").fit(rows, "label", 1)]
    for i, model in enumerate(models):
        persist.save_json(model, spark, str(tmp_path / str(i)))
        back = persist.load_json(spark, str(tmp_path / str(i)))
        assert type(back) is type(model) and model.transform(rows).exceptAll(back.transform(rows)).isEmpty()
    with pytest.raises(PersistenceError):
        persist.load_json(spark, str(tmp_path / "none"))


def test_online_training_goes_on_after_a_restart(spark, tmp_path):
    som, parts = SOM(3, 3, init="som++"), [frame(spark, waves(40, 2)[i : i + 20]) for i in (0, 20)]
    whole = OnlineSOM(som)
    for i, part in enumerate(parts):
        whole(part, i)
    first = OnlineSOM(som, path=str(tmp_path / "state"))
    first(parts[0], 0)
    second = OnlineSOM(som, path=str(tmp_path / "state"))
    second(parts[0], 0)  # comes again after a restart of the driver
    second(parts[1], 1)
    assert np.allclose(second.model.weights, whole.model.weights)


def test_http(spark):
    http = server(ModelRegistry(spark), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode()), timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health") == (200, {"status": "ok", "models": 0})
        data = waves(30, 2).tolist()
        status, made = ask("/train", {"data": data, "grid_size": 3, "epochs": 1})
        assert status == 200 and made["samples"] == 30
        status, found = ask("/predict", {"model_id": made["model_id"], "data": data[:4]})
        assert status == 200 and len(found["predictions"]) == 4
        assert ask("/predict", {"model_id": "none", "data": data})[0] == 404 and ask("/nowhere", {})[0] == 404
        assert ask("/train", {})[0] == 400 and ask("/train", {"data": [[1.0], [1.0, 2.0]]})[0] == 400
    finally:
        http.shutdown()
        http.server_close()


def test_entry(spark):
    assert entry.entry(spark).count() == 16
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 80


@pytest.mark.parametrize("name", ["codebook_summary", "bmu_assign_arrow", "dbcv", "som_batch_step", "classifier_predict", "grid_components", "stream_score", "kmeans_fit", "som_fit", "som_fit_samples", "som_tree_cluster", "density_predict", "gmm_fit", "init_kmeans", "refused", "csv_points", "json_models"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "labels", "part", "customer", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (df[columns].sort_values(columns).reset_index(drop=True).astype(str) for df in (got, want))
    assert a.equals(b)


def test_service_takes_large_bodies_in_pieces(spark, monkeypatch):
    from gridscape import service
    from gridscape.plans.storage import shared_dir

    x = waves(103, 4)
    longest = []
    parse = service.rows_from_json

    def seen(df, *args, **options):
        longest.append(df.agg(F.max(F.length("data"))).first()[0])
        return parse(df, *args, **options)

    monkeypatch.setattr(service, "PIECE_NUMBERS", 20)
    monkeypatch.setattr(service, "PIECES", 3)
    monkeypatch.setattr(service, "rows_from_json", seen)
    reg = ModelRegistry(spark)
    model = reg.models["m"] = SOMModel(x[:6], 2, 3)
    left = set((Path(shared_dir(spark)) / "gridscape").glob("*"))
    for n in (1, 15, 16, 103):
        want = [r.bmu for r in model.transform(frame(spark, x[:n])).orderBy("row_id").collect()]
        assert reg.predict({"model_id": "m", "data": x[:n].tolist()})["predictions"] == want
    assert max(longest) < 6 * 100 and set((Path(shared_dir(spark)) / "gridscape").glob("*")) == left
