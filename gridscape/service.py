"""Train, predict and benchmark requests as dictionaries, models kept by id, and a small HTTP server over them."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridscape.errors import DimensionMismatch, GridscapeError, InvalidInputData, NotFitted
from gridscape.functions.vector import DISTANCES
from gridscape.operators.seeding import METHODS
from gridscape.operators.som import MOST_RATE, SOM, SOMModel
from gridscape.plans.storage import Stored, shared_dir
from gridscape.sources.datagen import uniform_cube
from gridscape.sources.io import rows_from_json

MOST_ITERATIONS = 500_000
#: Numbers in a piece of a body, which is one row and is parsed at a time, and pieces that go to Spark together.
PIECE_NUMBERS, PIECES = 8_192, 64


class ModelRegistry:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.models = spark, {}

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "models": len(self.models)}

    @contextmanager
    def _rows(self, data: list[list[float]]) -> Iterator[DataFrame]:
        """The rows of a body; one of more than PIECES pieces goes through a table in the shared folder, so that no task or call carries it whole."""
        if not data or not data[0]:
            raise InvalidInputData("no data")
        if len({len(r) for r in data}) > 1:
            raise DimensionMismatch("rows of different lengths")
        size = max(1, PIECE_NUMBERS // len(data[0]))

        def pieces(begin: int) -> DataFrame:
            starts = range(begin, min(begin + size * PIECES, len(data)), size)
            return self.spark.createDataFrame([(i, json.dumps(data[i : i + size])) for i in starts], "first long, data string")

        if len(data) <= size * PIECES:
            yield rows_from_json(pieces(0), first="first")
            return
        path = f"{shared_dir(self.spark)}/gridscape/{uuid.uuid4().hex}"
        try:
            for i in range(0, len(data), size * PIECES):
                pieces(i).write.mode("append").parquet(path)
            yield rows_from_json(self.spark.read.schema("first long, data string").parquet(path), first="first")
        finally:
            Stored(self.spark.range(0), path).remove()

    def train(self, request: dict[str, Any]) -> dict[str, Any]:
        """A grid of more units than rows shrinks to the root of the rows (2 at least); a bad rate becomes 0.5; unknown names their defaults."""
        with self._rows(request["data"]) as rows:
            return self._trained(request, rows, len(request["data"]))

    def _trained(self, request: dict[str, Any], rows: DataFrame, n: int) -> dict[str, Any]:
        size = int(request.get("grid_size", 10))
        if size * size > n:
            size = max(2, math.isqrt(n))
        rate = float(request.get("learning_rate", 0.5))
        rate = rate if rate <= MOST_RATE else 0.5
        init, distance = request.get("init_method", "random"), request.get("distance", "euclidean")
        som = SOM(size, size, rate, float(request.get("neighbor_radius", 1.0)), init if init in METHODS else "random", distance if distance in DISTANCES else "euclidean", MOST_ITERATIONS)
        began = time.monotonic()
        model = som.fit(rows, int(request.get("epochs", 10)))
        elapsed = int((time.monotonic() - began) * 1000)
        scores = model.evaluate(rows, ["silhouette", "davies_bouldin", "calinski_harabasz"])
        key = str(uuid.uuid4())
        self.models[key] = model
        return {"model_id": key, "status": "trained", "grid_size": size, "dimensions": model.weights.shape[1], "samples": n, "elapsed_ms": elapsed, **scores}

    def model(self, key: str) -> SOMModel:
        if key not in self.models:
            raise NotFitted(f"no model {key}")
        return self.models[key]

    def predict(self, request: dict[str, Any]) -> dict[str, Any]:
        model = self.model(request["model_id"])
        with self._rows(request["data"]) as rows:
            scored = model.transform(model.rows(rows)).select("row_id", "bmu").orderBy("row_id").select("bmu").toArrow()
        return {"predictions": scored["bmu"].to_pylist(), "model_info": {"grid": [model.m, model.n], "distance": model.distance}}

    def benchmark(self, request: dict[str, Any]) -> dict[str, Any]:
        """Seconds to train on uniform points; the way of seeding is always random."""
        n, d, size = int(request.get("samples", 1000)), int(request.get("dimensions", 3)), int(request.get("grid_size", 10))
        rows = uniform_cube(self.spark, n, d)
        began = time.monotonic()
        SOM(size, size, max_iter=MOST_ITERATIONS).fit(rows, int(request.get("epochs", 10)))
        return {"samples": n, "dimensions": d, "grid_size": size, "seconds": time.monotonic() - began}


def server(registry: ModelRegistry, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """GET /health, POST /train, /predict and /benchmark with JSON bodies; what a request did wrong is 400, an unknown model or path 404.

    Call serve_forever() on it. Jobs of requests that come together share the session.
    """

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict[str, Any]) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(200, registry.health()) if self.path == "/health" else self.answer(404, {"error": self.path})

        def do_POST(self) -> None:
            routes = {"/train": registry.train, "/predict": registry.predict, "/benchmark": registry.benchmark}
            if self.path not in routes:
                return self.answer(404, {"error": self.path})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                self.answer(200, routes[self.path](body))
            except NotFitted as e:
                self.answer(404, {"error": str(e)})
            except (GridscapeError, KeyError, ValueError, TypeError) as e:
                self.answer(400, {"error": f"{type(e).__name__}: {e}"})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
