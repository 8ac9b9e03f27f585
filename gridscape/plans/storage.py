"""Tables in the folder that driver and executors share: they end lineage, and lost executors cost no recomputation."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridscape.errors import NoSharedFolder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a new local one where that is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridscape-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@dataclass(frozen=True)
class Stored:
    """A table that was written, and how to remove it."""

    df: DataFrame
    path: str

    def remove(self) -> None:
        spark = self.df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What executions inside exchange is removed from executors' disks as each ends, and not when the driver's memory is next collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> Stored:
    """df computed once into a table."""
    path = f"{shared_dir(df.sparkSession)}/gridscape/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)
