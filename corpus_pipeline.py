"""A training corpus in five stages over the table `documents`: quality, lines, near-duplicates, mixture, packing.

Each stage is a function of (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.llm import linededup, mil, mixing, packing, simhash
from gridscape.llm.common import in_written_order, named, table
from gridscape.llm.queries import byte_vocabulary
from gridscape.plans.storage import shared_dir, shuffles_removed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this table, accepts."""
    return mil.accepted(docs, mil.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines that many sources share; n_chars follows the text."""
    found = linededup.deduplicated(docs)
    text = F.col("kept_text")
    return found.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of equal or similar texts (five words, 0.8)."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, in training order, repeated or left out as their source's target asks; the order is that of the files and of their rows."""
    return mixing.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids, in training order: by sequence_id and offset."""
    return packing.pack(docs, byte_vocabulary(), order=in_written_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor SimHash; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/gridscape/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
