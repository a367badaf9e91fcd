"""Tables kept in an order, with a directory that leads to any page.

Every load is a segment: its rows are sorted by the order, which is unique, over files of ranges, and its directory holds every ``step``-th key with its rank in the
segment. A page looks its place up in the directories, counts what lies between directory entries of the other segments, and reads on from a
key near it: a bounded number of rows, whose row groups Parquet finds by the first column's bounds. Loading adds a segment and leaves the others alone.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Sequence
from functools import total_ordering

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.ordered import sort_columns
from limnos.operators.paging import keyset_page

# Rows between directory entries, at least; entries of a segment, at most, which are read by the driver.
STEP = 1_000
ENTRIES = 10_000
_SEGMENT, _PART, _AT = "_segment", "_part", "_at"


@total_ordering
class _Place:
    """A key, compared as Spark sorts it: each column up or down, nulls last."""

    __slots__ = ("values", "order")

    def __init__(self, values: Sequence, order: Sequence[str]):
        self.values, self.order = tuple(values), order

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Place) and self.values == other.values

    def __lt__(self, other: _Place) -> bool:
        for name, a, b in zip(self.order, self.values, other.values, strict=True):
            if a == b:
                continue
            if a is None or b is None:
                return b is None
            return a > b if name.startswith("-") else a < b
        return False


def _names(order: Sequence[str]) -> list[str]:
    return [name.removeprefix("-") for name in order]


def _beyond(df: DataFrame, order: Sequence[str], key: Sequence) -> Column:
    """Does the row come after ``key``?"""
    beyond = F.lit(False)
    for name, value in reversed(list(zip(order, key, strict=True))):
        c = F.col(name.removeprefix("-"))
        if value is None:
            beyond = c.isNull() & beyond
            continue
        v = F.lit(value).cast(df.schema[name.removeprefix("-")].dataType)
        beyond = (c < v if name.startswith("-") else c > v) | c.isNull() | ((c == v) & beyond)
    return F.coalesce(beyond, F.lit(False))


def append(df: DataFrame, target: str, order: Sequence[str], step: int = STEP) -> None:
    """Add the rows of ``df`` as a segment of the table at ``target``. ``order`` is unique over the whole table and the same for all loads."""
    spark, segment = df.sparkSession, uuid.uuid4().hex
    ranged = df.repartitionByRange(*sort_columns(order)).sortWithinPartitions(*sort_columns(order))
    # Within a partition ids count rows in their order.
    placed = ranged.withColumns({_PART: F.spark_partition_id(), _AT: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.parquet(f"{target}/{_SEGMENT}={segment}")
    _list(spark, target, segment, order, step)


def _list(spark: SparkSession, target: str, segment: str, order: Sequence[str], step: int) -> None:
    """Write the directory of a segment: its number of rows with a null key, and every ``step``-th key."""
    rows = spark.read.parquet(f"{target}/{_SEGMENT}={segment}")
    # One row for each file.
    counts = sorted((r[_PART], r["n"]) for r in rows.groupBy(_PART).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    step = max(step, math.ceil(total / ENTRIES))
    before, start = {}, 0
    for part, n in counts:
        before[part] = start
        start += n
    starts = spark.createDataFrame(list(before.items()), f"{_PART} int, _before long")
    rank = F.col("_before") + F.col(_AT) + 1
    names = _names(order)
    entries = rows.select(*names, _PART, _AT).join(starts, _PART).select(rank.alias("_rank"), *names)
    kept = entries.filter((F.col("_rank") % step == 0) | (F.col("_rank") == total))
    kept.withColumns({"_step": F.lit(step), "_rows": F.lit(total)}).coalesce(1).write.mode("overwrite").parquet(f"{target}/_directory/{_SEGMENT}={segment}")


def read(spark: SparkSession, target: str) -> DataFrame:
    """All rows of the table."""
    return spark.read.parquet(target).drop(_SEGMENT, _PART, _AT)


def _directory(spark: SparkSession, target: str, order: Sequence[str]) -> dict[str, list[tuple[_Place, int, int]]]:
    """Entries (place, rank, rows to the next entry) by segment."""
    try:
        rows = spark.read.parquet(f"{target}/_directory").collect()
    except AnalysisException:  # every load so far was empty, or there was none
        return {}
    held: dict[str, list[tuple[_Place, int, int]]] = {}
    for row in rows:
        held.setdefault(row[_SEGMENT], []).append((_Place([row[c] for c in _names(order)], order), row["_rank"], row["_step"]))
    return {segment: sorted(entries, key=lambda e: e[1]) for segment, entries in held.items()}


def count(spark: SparkSession, target: str) -> int:
    """Rows of the table, from its directory alone."""
    try:
        return spark.read.parquet(f"{target}/_directory").groupBy(_SEGMENT).agg(F.max("_rows").alias("n")).agg(F.sum("n")).first()[0] or 0
    except AnalysisException:
        return 0


def page(spark: SparkSession, target: str, order: Sequence[str], number: int = 1, items: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of the table at ``target``."""
    table = spark.read.parquet(target)
    offset = (number - 1) * items
    directory = _directory(spark, target, order)
    if offset >= sum(entries[-1][1] for entries in directory.values()):
        return table.limit(0).drop(_SEGMENT, _PART, _AT)
    places = {segment: [e[0] for e in entries] for segment, entries in directory.items()}

    def below(segment: str, place: _Place) -> int:
        """Entries of the segment up to ``place``."""
        return bisect_right(places[segment], place)

    def known(place: _Place) -> int:
        return sum(directory[s][k - 1][1] for s in directory if (k := below(s, place)))

    def unsure(place: _Place, own: str) -> int:
        return sum(entries[0][2] - 1 for s, entries in directory.items() if s != own)

    # The last entry of which it is sure that the page lies behind it. Ranks grow along the entries of a segment.
    start: tuple[_Place, str] | None = None
    for segment, entries in directory.items():
        k = bisect_right(entries, offset, key=lambda e, own=segment: known(e[0]) + unsure(e[0], own))
        if k and (start is None or start[0] < entries[k - 1][0]):
            start = entries[k - 1][0], segment
    if start is None:
        skipped, key = 0, None
    else:
        key = start[0].values
        skipped = known(start[0])
        between = F.lit(False)
        for segment in directory:
            if segment != start[1]:
                k = below(segment, start[0])
                after = _beyond(table, order, places[segment][k - 1].values) if k else F.lit(True)
                between = between | ((F.col(_SEGMENT) == segment) & after)
        if len(directory) > 1:
            skipped += table.filter(between & ~_beyond(table, order, key) & _up_to(table, order, key)).count()
    wanted = offset - skipped + items
    # A row that far behind the key: nothing beyond it can be on the page.
    ends = [e[0] for entries in directory.values() for e in entries if e[1] >= offset + items and known(e[0]) >= offset + items]
    if ends:
        table = table.filter(_up_to(table, order, min(ends).values))
    return keyset_page(table, order, key, wanted).drop(_SEGMENT, _PART, _AT).orderBy(*sort_columns(order)).offset(offset - skipped)


def _up_to(df: DataFrame, order: Sequence[str], key: Sequence) -> Column:
    """A bound on the first column that every row up to ``key`` keeps; it reaches the scan."""
    first, value = order[0].removeprefix("-"), key[0]
    if value is None:
        return F.lit(True)
    v = F.lit(value).cast(df.schema[first].dataType)
    return F.col(first) >= v if order[0].startswith("-") else F.col(first) <= v
