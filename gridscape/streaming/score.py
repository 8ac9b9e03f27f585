"""Models on streams: scoring is a narrow projection and runs unchanged; refitting warm-starts from the last map, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.operators.som import SOM, SOMModel
from gridscape.sources import persist


def score_stream(stream: DataFrame, model: SOMModel, out: str = "bmu") -> DataFrame:
    """The stream with each row's unit; no state, so no watermark is needed."""
    return model.transform(stream, out)


def windowed_hits(stream: DataFrame, model: SOMModel, ts: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits of each unit in tumbling windows of event time; rows later than `late` are left out by the watermark."""
    return score_stream(stream, model).withWatermark(ts, late).groupBy(F.window(ts, window), "bmu").agg(F.count(F.lit(1)).alias("hits"))


class OnlineSOM:
    """A sink for foreachBatch: each micro-batch trains the map on from where the last one left it.

    With `path`, a folder that outlives the driver, the map and the batch's id are kept there after each batch and taken up again by a new sink, so that a
    batch that comes again after a failure or a restart is passed over and not trained on twice. Without it that holds for this object only.
    """

    def __init__(self, som: SOM, epochs: int = 1, features: str | list[str] = "features", order_by: str = "row_id", after: Callable[[SOMModel, int], None] | None = None, path: str | None = None) -> None:
        self.som, self.epochs, self.features, self.order_by, self.after, self.path = som, epochs, features, order_by, after, path
        self.model: SOMModel | None = None
        self.done = -1
        self._resumed = path is None

    def _resume(self, spark: SparkSession) -> None:
        """The last batch whose map was kept whole."""
        try:
            last = spark.read.schema("batch long").json(f"{self.path}/done").agg(F.max("batch")).first()[0]
        except AnalysisException:
            last = None
        if last is not None:
            self.model, self.done = persist.load(spark, f"{self.path}/{last}"), last
        self._resumed = True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not self._resumed:
            self._resume(batch.sparkSession)
        if batch_id <= self.done or batch.isEmpty():
            return
        self.model = self.som.fit(batch, self.epochs, False, None, self.features, self.order_by, self.model)
        if self.path is not None:
            spark = batch.sparkSession
            persist.save(self.model, spark, f"{self.path}/{batch_id}")
            spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").json(f"{self.path}/done")
        self.done = batch_id
        if self.after:
            self.after(self.model, batch_id)
