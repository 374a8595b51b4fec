"""Parquet table scans with explicit column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Scan one table; selecting ``cols`` here makes the parquet ReadSchema minimal."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df
