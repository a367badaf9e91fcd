"""Room catalog: search and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.joins import live


def contains_all(col: str, wanted: Sequence[int]) -> Column:
    """Is every wanted id in the array? A null array contains nothing."""
    want = F.array(*[F.lit(int(w)) for w in wanted])
    return F.coalesce(F.size(F.array_except(want, F.col(col))) == 0, F.lit(False)) & F.col(col).isNotNull()


def search_rooms(
    rooms: DataFrame,
    min_price: float | None = None,
    max_price: float | None = None,
    features: Sequence[int] = (),
    badges: Sequence[int] = (),
) -> DataFrame:
    """Live rooms in a closed price range that have all wanted features and badges; no bound or no ids, no filter."""
    found = live(rooms)
    if min_price is not None:
        found = found.filter(F.col("price") >= min_price)
    if max_price is not None:
        found = found.filter(F.col("price") <= max_price)
    if features:
        found = found.filter(contains_all("feature_ids", features))
    if badges:
        found = found.filter(contains_all("badge_ids", badges))
    return found


def enrich(df: DataFrame, ids_col: str, dim: DataFrame, out: str, key: str = "id") -> DataFrame:
    """Adds ``out``: the dimension rows for the ids in ``ids_col``, by id.

    An id that is listed twice counts once, unknown and null ids drop out, and an id that the dimension holds twice gives both rows. ``key``
    is unique in ``df``; rows without it get an empty list.
    """
    fields = ["id", *[c for c in dim.columns if c != "id"]]
    shape = f"array<struct<{','.join(f'{c}:{dim.schema[c].dataType.simpleString()}' for c in fields)}>>"
    links = df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.col(ids_col))).alias("_id"))
    # Of a left join only the dimension can be broadcast, never the links, of which there are more than rows.
    found = links.join(dim.select(*fields), F.col("_id") == F.col("id"), "left")
    rows = F.collect_list(F.when(F.col("id").isNotNull(), F.struct(*fields)))
    gathered = found.groupBy("_key").agg(F.array_sort(rows).alias(out))
    # There is a list for nearly every row of ``df``; by the size of compressed files alone Catalyst would broadcast them all.
    joined = df.join(gathered.hint("merge"), df[key] == gathered["_key"], "left").drop("_key")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(shape)))


def dimension_usage(dim: DataFrame, rooms: DataFrame, ids_col: str) -> DataFrame:
    """The whole dimension with the number of rooms that name each row, zero included."""
    used = (
        rooms.select(F.explode(F.array_distinct(F.col(ids_col))).alias("id"))
        .groupBy("id")
        .agg(F.count("*").alias("n_rooms"))
    )
    return dim.join(used, "id", "left").withColumn("n_rooms", F.coalesce("n_rooms", F.lit(0)))
