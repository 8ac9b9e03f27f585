"""The driver's queries over the test tables, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridscape.queries import files, grids, models, scores, vectors
from gridscape.queries.vectors import codebook_summary

REGISTRIES = (vectors.QUERIES, scores.QUERIES, grids.QUERIES, models.QUERIES, files.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for r in REGISTRIES for name, (fn, _) in r.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, (_, sql) in r.items() if sql}


__all__ = ["codebook_summary", "oracle_sql", "queries"]
