"""What the operators share: tables, small batches, and Parquet in the cluster's shared folder to cut lineage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, fresh_path, materialize, shared_dir

__all__ = ["batches_of", "discard", "fresh_path", "materialize", "shared_dir", "small_batches", "table", "text_volume"]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python workers at most so many rows at once, so that a batch of texts stays small beside them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """For the jobs within: so many rows in a batch that a Python worker gets at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_volume(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column, counted over every row."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
