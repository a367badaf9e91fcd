"""Room search by bitmaps: which rooms have a feature, a badge or a price band is kept as bits, and a search combines bits.

Rooms are numbered by their ids, positive whole numbers, unique among live rooms; a bitmap covers 32,768 of them. The total of a search is counted from
the bits, and only the rooms of a page are read. Price bounds are exact: whole bands come from the index, rooms of the two bands that a bound cuts are
looked up by price.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.joins import live
from limnos.session import settle

_BITS = 32_768


def _bits(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def room_index(rooms: DataFrame, bands: Sequence[float]) -> DataFrame:
    """``kind``, ``value``, ``bucket`` and ``bits`` of all live rooms: one bitmap per feature, badge and price band, and one of all rooms.

    ``bands`` are the ascending lower bounds of price bands; cheaper rooms are band 0, rooms without a price are in none. One shuffle of
    bitmaps, not of rooms.
    """
    rooms = live(rooms)
    band = F.when(F.col("price").isNotNull(), F.size(F.filter(F.array(*[F.lit(float(b)) for b in bands]).cast("array<double>"), lambda b: b <= F.col("price"))))
    entry = "struct<kind:string,value:int>"

    def entries(kind: str, ids: str):
        own = F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))
        return F.coalesce(F.transform(own, lambda i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("value"))), F.array().cast(f"array<{entry}>"))

    alone = F.array(F.struct(F.lit("all").alias("kind"), F.lit(0).alias("value")), F.struct(F.lit("price").alias("kind"), band.alias("value")))
    listed = F.concat(entries("feature", "feature_ids"), entries("badge", "badge_ids"), alone)
    return _bits(rooms.select("id", F.inline(listed)).filter("value is not null"), "kind", "value")


def matching(
    index: DataFrame,
    rooms: DataFrame,
    bands: Sequence[float],
    min_price: float | None = None,
    max_price: float | None = None,
    features: Sequence[int] = (),
    badges: Sequence[int] = (),
) -> DataFrame:
    """``bucket`` and ``bits`` of the rooms that :func:`limnos.operators.catalog.search_rooms` finds, and their number ``n``; settled, a row for each
    32,768 rooms at most. ``index`` and ``bands`` belong to ``rooms`` as they are now."""
    wanted = sorted({("feature", int(f)) for f in features} | {("badge", int(b)) for b in badges}) or [("all", 0)]
    named = F.struct("kind", "value").isin([F.struct(F.lit(kind), F.lit(value)) for kind, value in wanted])
    found = index.filter(named).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n")).filter(F.col("_n") == len(wanted))
    found = found.drop("_n")
    if min_price is not None or max_price is not None:
        priced = _priced(index, rooms, list(bands), min_price, max_price)
        both = found.unionByName(priced).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n"))
        found = both.filter("_n = 2").drop("_n")
    return settle(found.withColumn("n", F.bitmap_count("bits")).filter("n > 0"), "matching")


def _priced(index: DataFrame, rooms: DataFrame, bands: list[float], low: float | None, high: float | None) -> DataFrame:
    """Rooms with a price in a closed range: whole bands, and what lies in the bands at its ends."""
    first = 0 if low is None else bisect_left(bands, low) + 1
    last = len(bands) if high is None else bisect_right(bands, high) - 1
    parts = index.filter((F.col("kind") == "price") & F.col("value").between(first, last)).select("bucket", "bits")
    below = F.lit(False) if low is None else (F.col("price") >= low) & (F.col("price") < bands[first - 1] if first <= len(bands) else F.lit(True))
    above = F.lit(False) if high is None else (F.col("price") <= high) & (F.col("price") >= bands[last] if last >= 0 else F.lit(True))
    if low is not None:
        above = above & (F.col("price") >= low)
    if high is not None:
        below = below & (F.col("price") <= high)
    edges = _bits(live(rooms).filter(below | above).select("id"))
    return parts.unionByName(edges).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def total(found: DataFrame) -> DataFrame:
    """One row: ``total_count``, from the bits alone."""
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"))


def ids(found: DataFrame) -> DataFrame:
    """The ids of all rooms found."""
    text = F.hex("bits")
    byte = F.transform(F.sequence(F.lit(0), F.lit(_BITS // 8 - 1)), lambda i: F.struct(i.alias("i"), F.substr(text, 2 * i + 1, F.lit(2)).alias("b")))
    some = F.filter(byte, lambda s: s["b"] != "00")
    bits = F.flatten(
        F.transform(
            some,
            lambda s: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.lit(7)),
                    lambda bit: F.call_function("shiftright", F.conv(s["b"], 16, 10).cast("int"), bit).bitwiseAND(F.lit(1)) == 1,
                ),
                lambda bit: 8 * s["i"] + bit,
            ),
        )
    )
    at = found.select("bucket", F.explode(bits).alias("_at"))
    return at.select(((F.col("bucket") - 1) * _BITS + F.col("_at") + 1).cast("bigint").alias("id"))


def page(found: DataFrame, rooms: DataFrame, number: int = 1, items: int = 10) -> DataFrame:
    """The rooms of page ``number`` by id, with ``total_count``. Bits are spelt out only where the page lies, and ``rooms`` is read for its ids only."""
    offset = (number - 1) * items
    # A row for each bitmap.
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = found.withColumn("_upto", F.sum("n").over(order))
    near = upto.filter((F.col("_upto") > offset) & (F.col("_upto") - F.col("n") < offset + items))
    start = near.agg(F.min(F.col("_upto") - F.col("n"))).first()[0]
    count = F.lit(total(found).first()[0]).cast("bigint").alias("total_count")
    if start is None:
        return live(rooms).limit(0).select("*", count)
    mine = [r.id for r in ids(near).orderBy("id").offset(offset - start).limit(items).collect()]
    return live(rooms).filter(F.col("id").isin(mine)).select("*", count).orderBy("id")
