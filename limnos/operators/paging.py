"""Sorting and paging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.ordered import key_at, ranked_in_ranges, sort_columns
from limnos.session import settle

# Deepest row a top-k may reach: each task keeps that many rows and one task merges them.
SHALLOW = 100_000


def page(df: DataFrame, order: Sequence[str], number: int = 1, items: int = 10, shallow: int = SHALLOW) -> DataFrame:
    """Page ``number`` (from 1) of ``df`` in ``order``, which must be unique to make pages tile.

    A shallow page is a top-k. For a deep one the key before its first row is searched for, and the rows after
    that key are read as by :func:`keyset_page`, so that no task holds the skipped rows. Both order as Spark sorts, nulls last.
    """
    offset = (number - 1) * items
    if offset + items <= shallow or offset == 0:
        return df.orderBy(*sort_columns(order)).offset(offset).limit(items)
    key = key_at(df, order, offset)
    return df.limit(0) if key is None else keyset_page(df, order, key, items)


def page_header(df: DataFrame, number: int = 1, items: int = 10) -> DataFrame:
    """One row: total_count, has_more, page, items_per_page."""
    return df.agg(F.count("*").alias("total_count")).select(
        "total_count",
        (F.lit(number) * F.lit(items) < F.col("total_count")).alias("has_more"),
        F.lit(number).alias("page"),
        F.lit(items).alias("items_per_page"),
    )


def _literal(df: DataFrame, name: str, value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(df.schema[name].dataType)


def keyset_page(df: DataFrame, order: Sequence[str], after: Sequence | None, items: int = 10) -> DataFrame:
    """The ``items`` rows after the key ``after``: the cost does not grow with the depth.

    Nulls come last in either direction, in the order and in the comparison. The bound on the first column is stated on its own so that it
    reaches the scan.
    """
    if after is not None:
        beyond = F.lit(False)
        for name, value in reversed(list(zip(order, after, strict=True))):
            column = name.removeprefix("-")
            c = F.col(column)
            if value is None:
                beyond = c.isNull() & beyond
                continue
            v = _literal(df, column, value)
            past = (c < v if name.startswith("-") else c > v) | c.isNull()
            beyond = past | ((c == v) & beyond)
        first = order[0].removeprefix("-")
        if after[0] is None:
            bound = F.col(first).isNull()
        else:
            v = _literal(df, first, after[0])
            bound = (F.col(first) <= v if order[0].startswith("-") else F.col(first) >= v) | F.col(first).isNull()
        df = df.filter(bound).filter(F.coalesce(beyond, F.lit(False)))
    return df.orderBy(*sort_columns(order)).limit(items)


def keyset_walk(df: DataFrame, order: Sequence[str], items: int) -> Iterator[DataFrame]:
    """All pages one after another; each starts after the last row of the one before, of which the driver sees the key.

    For a client that reads on: a page is a job. :func:`numbered` tells the page of all rows at once.
    """
    names = [name.removeprefix("-") for name in order]
    after = None
    while True:
        found = settle(keyset_page(df, order, after, items), "page")
        turned = [name.removeprefix("-") if name.startswith("-") else f"-{name}" for name in order]
        last = found.orderBy(*[_first_last(name) for name in turned]).select(*names).first()
        if last is None:
            return
        yield found
        after = tuple(last)


def numbered(df: DataFrame, order: Sequence[str], items: int) -> DataFrame:
    """``df`` with ``page`` (from 0): the pages of :func:`keyset_walk`, without a job for each.

    Rows are ranked in ranges of ``order``, so no task sorts more than a range.
    """
    return ranked_in_ranges(df, [], order).withColumn("page", F.floor((F.col("_upto") - 1) / items)).drop("_upto", "n")


def _first_last(name: str) -> Column:
    """The reverse of a sort with nulls last."""
    return F.col(name[1:]).desc_nulls_first() if name.startswith("-") else F.col(name).asc_nulls_first()


def full_list(df: DataFrame) -> DataFrame:
    """A whole dimension by id, without a limit."""
    return df.orderBy("id")
