"""Station reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.text import station_key, station_number
from limnos.operators.paging import page


def lookup(df: DataFrame, **equals) -> DataFrame:
    """At most one row whose columns equal the given values; empty when there is none."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.limit(1)


def station_list(df: DataFrame) -> DataFrame:
    """Every station number with the location of its lowest id, over all rows.

    The ids are reduced per station and location first: a whole number is hash-aggregated, while picking
    the text by id at once would sort all rows.
    """
    return (
        df.groupBy(station_number("place").alias("place"), "location")
        .agg(F.min("id").alias("id"))
        .groupBy("place")
        .agg(F.min_by("location", "id").alias("location"))
        .orderBy("place")
    )


def station_rows(df: DataFrame, place: int | float | str) -> DataFrame:
    return df.filter(F.col("place") == station_key(F.lit(place)))


def station_page(df: DataFrame, place: int | float | str, number: int = 1, items: int = 10) -> DataFrame:
    """One page of a station's rows by time."""
    return page(station_rows(df, place), ["time", "id"], number, items)
