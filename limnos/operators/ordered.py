"""Ordered operators that hold when one group has a third of all rows.

A plain window sorts a whole group in one task. That is kept only for groups whose
size has been checked; larger groups are cut into ranges first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.session import HOT, settle

_DAY = 86_400_000_000
# Sums in which the sizes of groups are bounded from above.
_BUCKETS = 65_536


def sort_columns(order: Sequence[str]) -> list[Column]:
    """``["time", "-id"]`` -> time ascending with nulls last, id descending with nulls last."""
    return [
        F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()
        for name in order
    ]


def micros(df: DataFrame, name: str) -> Column:
    """An ordered number for a date, timestamp or numeric column, without going through the session time zone."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        in_day = (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000
        return days * _DAY + in_day + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("double")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise TypeError(f"column {name} has type {kind.simpleString()}, need a number or a time")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group: one column-pruned scan with map-side counts."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return row[0] or 0


def hot_groups(df: DataFrame, by: Sequence[str], hot: int) -> DataFrame | None:
    """Groups of more than ``hot`` rows, with their number as ``_hot``; at most one row per ``hot`` rows of ``df``. None if there are none.

    Rows are counted by the hash of their group first, in ``_BUCKETS`` sums that tasks combine before the shuffle. Where none is above ``hot``, no group
    is; only otherwise are the groups themselves counted, which may shuffle as many rows as there are.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(_BUCKETS)) if by else F.lit(0)
    if (df.groupBy(bucket.alias("_bucket")).count().agg(F.max("count")).first()[0] or 0) <= hot:
        return None
    return settle(df.groupBy(*by).agg(F.count("*").alias("_hot")).filter(F.col("_hot") > hot), "hot")


def ranked_in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Adds ``_upto``, the sum of ``weight`` (1) over the rows of the group up to and including this one, and ``n``, the sum over all.

    Rows are cut into ranges of group and order, so a group of any size is spread over tasks; a range starts where the sums of the
    ranges before it end.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *sort_columns(order))
    ranged = settle(ranged.select("*", weight.alias("_w"), F.spark_partition_id().alias("_range")), "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_w"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by, "_range", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_start"), F.sum("_w").over(group).alias("n")
    )
    upto = Window.partitionBy(*by, "_range").orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_inside", F.sum("_w").over(upto))
    placed = _join(inside, settle(starts, "starts"), [*by, "_range"], "inner")
    return placed.withColumn("_upto", F.col("_start") + F.col("_inside")).drop("_w", "_range", "_start", "_inside")


def ranked(
    df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column | None = None, hot: int = HOT
) -> DataFrame:
    """``df`` with ``_upto`` and ``n`` as in :func:`ranked_in_ranges`.

    Groups of up to ``hot`` rows take one window. Only groups above are cut into ranges; both ways order as Spark sorts, whatever the
    type of the columns: nulls last, NaN as the largest number.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    group = Window.partitionBy(*by)
    upto = group.orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)

    def in_windows(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"n": F.sum(weight).over(group), "_upto": F.sum(weight).over(upto)})

    large = hot_groups(df, by, hot)
    if large is None or large.isEmpty():
        return in_windows(df)
    # Written once, since both parts and the cutting into ranges read it.
    told = settle(_join(df, large, by), "told")
    small = in_windows(told.filter(F.col("_hot").isNull()).drop("_hot"))
    spread = ranked_in_ranges(told.filter(F.col("_hot").isNotNull()).drop("_hot"), by, order, weight)
    return small.unionByName(spread)


def mark_first(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    k: Column | int,
    out: str = "is_first",
    kth: str | None = None,
    hot: int = HOT,
) -> DataFrame:
    """Adds ``n`` (rows of the group) and ``out``: is the row among the first ``k`` of its group?

    ``kth`` names a further flag for the k-th row itself.

    ``k`` may be a column over ``n``. ``order`` must be unique inside a group; a leading
    ``-`` sorts descending, nulls come last. No task sorts a group of more than ``hot`` rows.
    """
    k = F.lit(k) if isinstance(k, int) else k
    flags = {out: F.col("_upto") <= k} | ({kth: F.col("_upto") == k} if kth else {})
    return ranked(df, by, order, hot=hot).withColumns(flags).drop("_upto")


def key_at(df: DataFrame, order: Sequence[str], position: int) -> tuple | None:
    """The values of ``order`` in the row at ``position`` (from 1), or None beyond the end.

    Only the order columns are read. They are cut into ranges; the driver sees the number of rows of each range and
    one key, and one task sorts the range that holds it.
    """
    names = [name.removeprefix("-") for name in order]
    ranged = df.select(*names).repartitionByRange(*sort_columns(order)).withColumn("_range", F.spark_partition_id())
    ranged = settle(ranged, "keys")
    before = 0
    for row in ranged.groupBy("_range").count().orderBy("_range").collect():
        if position <= before + row["count"]:
            held = ranged.filter(F.col("_range") == row["_range"]).drop("_range").orderBy(*sort_columns(order))
            return tuple(held.offset(position - before - 1).limit(1).first())
        before += row["count"]
    return None


def _join(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``by`` where nulls match nulls, keeping the columns of ``df`` first."""
    keys = [f"_k{i}" for i in range(len(by))]
    right = other.withColumnsRenamed(dict(zip(by, keys, strict=True)))
    on = reduce(and_, [df[name].eqNullSafe(right[key]) for name, key in zip(by, keys, strict=True)])
    return df.join(right, on, how).drop(*keys)


def running_sums(
    df: DataFrame, by: Sequence[str], at: str, cols: Sequence[str], split: bool = True
) -> DataFrame:
    """One row per ``(by, at)`` with ``cum_<col>``: the sum of ``col`` over the group up to and including ``at``.

    Equal times are added up before the shuffle. With ``split`` the sums are taken in three steps (day,
    second, microsecond), each window seeing one step only; without it one window sees a group's distinct
    times, which is for groups of checked size.
    """
    at_sums = df.groupBy(*by, at).agg(*[F.sum(c).alias(c) for c in cols])
    if not split:
        upto = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        return at_sums.withColumns({f"cum_{c}": F.sum(c).over(upto) for c in cols})

    fine = at_sums.withColumn("_second", F.floor(micros(df, at) / 1_000_000)).withColumn(
        "_day", F.to_date(F.col(at))
    )
    seconds = fine.groupBy(*by, "_day", "_second").agg(*[F.sum(c).alias(c) for c in cols])
    days = seconds.groupBy(*by, "_day").agg(*[F.sum(c).alias(c) for c in cols])

    def before(table: DataFrame, group: Sequence[str], step: str, prefix: str) -> DataFrame:
        past = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        return table.select(
            *group, step, *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{prefix}{c}") for c in cols]
        )

    day_before = before(days, by, "_day", "_d_")
    second_before = before(seconds, [*by, "_day"], "_second", "_s_")
    carried = _join(second_before, day_before, [*by, "_day"], "inner")
    carried = carried.select(
        *by, "_day", "_second", *[(F.col(f"_s_{c}") + F.col(f"_d_{c}")).alias(f"_b_{c}") for c in cols]
    )
    here = Window.partitionBy(*by, "_day", "_second").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    within = fine.withColumns({f"_w_{c}": F.sum(c).over(here) for c in cols})
    summed = _join(within, carried, [*by, "_day", "_second"], "inner")
    return summed.select(
        *by, at, *cols, *[(F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in cols]
    )


def forward_fill(
    df: DataFrame,
    cols: Sequence[str],
    order: Sequence[str],
    by: Sequence[str] = (),
    bucket: int = HOT,
) -> DataFrame:
    """Replace nulls in ``cols`` by the last value before them in ``order``.

    The last column of ``order`` is a whole number, unique under the others (a line number); any
    columns before it (a file name) sort first. Rows are filled inside buckets of ``bucket`` consecutive
    numbers; one row per bucket carries the last value on to the buckets after it.
    """
    *files, line = order
    parts = [*by, *files]
    b = df.withColumn("_bucket", F.floor(F.col(line) / F.lit(bucket)))
    group = [*parts, "_bucket"]

    lasts = b.groupBy(*group).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(line))).alias(c) for c in cols]
    )
    if files:
        lasts = settle(lasts, "lasts")
    in_file = Window.partitionBy(*(parts or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*group, *[F.last(c, ignorenulls=True).over(in_file).alias(c) for c in cols])
    if files:
        # Between files one row per file is carried.
        of_file = lasts.groupBy(*parts).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_bucket"))).alias(c) for c in cols]
        )
        earlier = (
            Window.partitionBy(*(by or [F.lit(0)])).orderBy(*files).rowsBetween(Window.unboundedPreceding, -1)
        )
        before = of_file.select(*parts, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_f_{c}") for c in cols])
        carry = _join(carry, before, parts).withColumns({c: F.coalesce(c, f"_f_{c}") for c in cols})
        carry = carry.drop(*[f"_f_{c}" for c in cols])
    # The carried values join their bucket as a row ahead of all others, so the big side is shuffled once.
    rows = b.withColumn("_ahead", F.lit(0)).unionByName(
        carry.withColumn("_ahead", F.lit(-1)), allowMissingColumns=True
    )
    upto = (
        Window.partitionBy(*group).orderBy("_ahead", line).rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in cols})
    return filled.filter(F.col("_ahead") == 0).drop("_bucket", "_ahead")
