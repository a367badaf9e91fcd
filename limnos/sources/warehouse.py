"""Warehouse tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, target: str, mode: str = "append", time_col: str = "time") -> None:
    """Observations as Parquet by year, ordered by place and time within the files.

    Range partitioning cuts a year or a station with very many rows into several files.
    """
    (
        df.withColumn("year", F.year(time_col))
        .repartitionByRange("year", "place", time_col)
        .sortWithinPartitions("year", "place", time_col)
        .write.mode(mode)
        .partitionBy("year")
        .parquet(target)
    )


def save_jdbc(df: DataFrame, options: Mapping[str, str], mode: str = "append") -> None:
    """Rows to a relational table; ``options`` (url, dbtable, driver, user, ...) come from configuration."""
    df.write.format("jdbc").options(**options).mode(mode).save()


def load(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
