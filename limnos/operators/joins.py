"""Joined reads.

No join carries a broadcast hint: Catalyst broadcasts a side whose size it knows to be below the threshold, and
adaptive execution splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.text import epoch_time


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted, by ``is_deleted`` where there is one (null: not deleted), else by ``deleted_at``."""
    if "is_deleted" in df.columns:
        return df.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    return df.filter(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def joined(
    df: DataFrame,
    other: DataFrame,
    on: Column,
    prefix: str = "",
    how: str = "left",
    where: Column | None = None,
) -> DataFrame:
    """``df`` with the columns of ``other`` under ``prefix``; ``on`` names them with the prefix.

    ``where`` filters the primary side before the join. ``on`` may carry further predicates. In a left join
    only the primary side can be split where a key is frequent, so the larger table belongs there.
    """
    primary = df.filter(where) if where is not None else df
    return primary.join(prefixed(other, prefix), on, how)


def with_user_and_room(bookings: DataFrame, users: DataFrame, rooms: DataFrame) -> DataFrame:
    """Bookings with their user and room, kept when either is missing."""
    step = joined(bookings, users, F.col("user_id") == F.col("user__id"), prefix="user__")
    return joined(step, rooms, F.col("room_id") == F.col("room__id"), prefix="room__")


def without_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the list."""
    return df.join(listed.select(key), key, "left_anti")


def listed_tokens(tokens: DataFrame, token: str = "token", expiry: str = "exp") -> DataFrame:
    """Tokens to put on the list, each once, with the latest end of validity read from epoch seconds."""
    return (
        tokens.groupBy(F.col(token).alias("token"))
        .agg(F.max(expiry).alias("_exp"))
        .select("token", epoch_time("_exp").alias("expires_at"))
    )


def rows_in(df: DataFrame, col: str, wanted: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is one of ``wanted``: a short list becomes a scan filter, a table a semi join."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(*wanted))


def only_existing(df: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key exists in ``base``."""
    return df.join(base.select(*keys), list(keys), "left_semi")


def children_of(
    parents: DataFrame, name_col: str, wanted: DataFrame, children: DataFrame, fk: str
) -> DataFrame:
    """One row per wanted name and child; ``wanted`` has the names as ``name``.

    ``found`` is false when there is no such parent; a parent without children has ``found`` true and
    null child columns.
    """
    live_parents = live(parents).select(F.col("id").alias("parent_id"), F.col(name_col).alias("name"))
    matched = wanted.select("name").join(live_parents, "name", "left").withColumn(
        "found", F.col("parent_id").isNotNull()
    )
    kids = prefixed(live(children), "child_")
    fk = f"child_{fk}"
    # An inner join, where a parent with very many children can be split, and the parents without any.
    # One outer join could not split its children side.
    pairs = kids.join(matched, F.col(fk) == F.col("parent_id"))
    having = kids.select(F.col(fk).alias("parent_id")).distinct()
    alone = matched.join(having, "parent_id", "left_anti")
    return pairs.drop(fk).unionByName(alone, allowMissingColumns=True)
