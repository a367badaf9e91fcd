"""Exact quantiles from value counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.ordered import ranked
from limnos.session import HOT


def exact_quantiles(counts: DataFrame, probs: Mapping[str, float], hot: int = HOT) -> DataFrame:
    """One row per ``metric`` with a column per probability, interpolated between neighbours.

    ``counts`` has one row ``(metric, value, c)`` per distinct value. Values sort as Spark sorts them, NaN last; between a finite and an
    infinite neighbour the quantile is infinite.
    """
    running = ranked(counts, ["metric"], ["value"], F.col("c"), hot)

    def at(rank: Column) -> Column:
        holds = (F.col("_upto") - F.col("c") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(holds, F.col("value")))

    def place(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    ends = [
        end
        for name, p in probs.items()
        for end in (at(F.floor(place(p))).alias(f"_lo_{name}"), at(F.ceil(place(p))).alias(f"_hi_{name}"))
    ]
    picked = running.groupBy("metric").agg(F.max("n").alias("n"), *ends)

    def between(name: str, p: float) -> Column:
        lo, hi, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), place(p) - F.floor(place(p))
        return F.when((lo == hi) | (part == 0), lo).otherwise(lo + (hi - lo) * part)

    return picked.select("metric", *[between(name, p).alias(name) for name, p in probs.items()])
