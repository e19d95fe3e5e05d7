"""Named queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomseq.plans import files, genome, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = genome.QUERIES | files.QUERIES | relational.QUERIES
ORACLE_SQL: dict[str, str] = genome.ORACLE_SQL | files.ORACLE_SQL | relational.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.search_primary_bulges(spark, sf_dir)
