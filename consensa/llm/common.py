"""Shared plumbing: tables that survive lost executors, and batch helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import keep as durable
from ..functions.tables import release, scope

__all__ = ["durable", "packed", "release", "scope", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *columns) -> DataFrame:
    """Whole rows as one struct ``row`` beside ``columns``: names that an operator adds cannot clash with the table's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)
