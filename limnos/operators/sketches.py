"""Profiles that add up: one summary for each load, merged instead of reading the loads again.

A summary holds counts, moments and extremes, a quantile sketch (KLL) and a distinct sketch (HyperLogLog) for each numeric column, and the most frequent values of
text columns as an item sketch. Summaries of any parts of a table merge into that of the whole: moments exactly up to rounding, quantiles
within ``RANK_ERROR`` of the rank, distinct counts within ``DISTINCT_ERROR`` (three standard errors), frequent values exactly while a column has no
more than ``ITEMS`` distinct ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of the quantile sketch and its error in rank at 99 % confidence; size (as a power of two) and error of the distinct sketch.
QUANTILE_K, RANK_ERROR = 1600, 0.005
DISTINCT_LG, DISTINCT_ERROR = 14, 0.025
# Distinct values that an item sketch tells apart without error.
ITEMS = 4096


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per numeric column: ``metric``, ``n``, ``n_null``, ``n_nan``, ``mean``, ``apart`` (sum of squared deviations), ``low``, ``high``, and the
    sketches ``quantiles`` and ``distinct``. One pass with map-side combine; NaN is counted and otherwise left out. An empty table has a row for each
    column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "metric", "value")
    number = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy("metric").agg(
        F.count(number).alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count_if(F.isnan("value")).alias("n_nan"),
        F.avg(number).alias("mean"),
        (F.var_pop(number) * F.count(number)).alias("apart"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.kll_sketch_agg_double(number, QUANTILE_K).alias("quantiles"),
        # A negative zero is a zero.
        F.hll_sketch_agg(F.when(number.isNotNull(), F.xxhash64(number + F.lit(0.0))), DISTINCT_LG).alias("distinct"),
    )


def merge(summaries: DataFrame) -> DataFrame:
    """Summaries of several parts, of one metric each, as one summary per metric. Merging merged summaries gives the same."""
    whole = summaries.groupBy("metric").agg(
        F.sum("n").alias("_n"), (F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean")
    )
    moved = F.col("apart") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    return (
        summaries.join(whole, "metric")
        .groupBy("metric")
        .agg(
            F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.sum("n_nan").alias("n_nan"), F.first("_mean").alias("mean"),
            F.sum(moved).alias("apart"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.kll_merge_agg_double("quantiles", QUANTILE_K).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
        )
    )


def told(merged: DataFrame, ranks: Sequence[tuple[str, float]] = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))) -> DataFrame:
    """A summary in words: ``metric``, ``n``, ``n_null``, ``n_nan``, ``n_distinct``, ``mean``, ``std``, ``min``, ``max`` and quantiles by name; null where a
    column has no number."""
    some = F.col("n") > 0

    def quantile(rank: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(rank)))

    return merged.select(
        "metric", "n", "n_null", "n_nan", F.hll_sketch_estimate("distinct").alias("n_distinct"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("apart") / (F.col("n") - 1))).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"),
        *[quantile(rank).alias(name) for name, rank in ranks],
    )


def text_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column of any type that reads as text: ``column``, ``n``, ``n_null``, and the sketches ``distinct`` and ``items``."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "value")
    return long.groupBy("column").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.hll_sketch_agg("value", DISTINCT_LG).alias("distinct"), F.expr(f"approx_top_k_accumulate(value, {ITEMS})").alias("items"),
    )


def merge_text(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(items, {ITEMS})").alias("items"),
    )


def told_text(merged: DataFrame, top: int = 5) -> DataFrame:
    """``column``, ``n``, ``n_null``, ``n_distinct`` and ``top``: the most frequent values with their numbers, by number and then by value."""
    found = F.filter(F.expr(f"approx_top_k_estimate(items, {ITEMS})"), lambda t: t["item"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda t: F.struct((-t["count"]).alias("few"), t["item"].alias("value"))))
    tops = F.transform(F.slice(ordered, 1, top), lambda t: F.struct(t["value"].alias("value"), (-t["few"]).alias("c")))
    return merged.select("column", "n", "n_null", F.hll_sketch_estimate("distinct").alias("n_distinct"), tops.alias("top"))


def store(summaries: DataFrame, target: str, load: str) -> None:
    """Keep the summary of a load; a load that is done again replaces its own."""
    summaries.write.mode("overwrite").parquet(f"{target}/load={load}")


def stored(spark: SparkSession, target: str) -> DataFrame:
    """The summaries of all loads, with ``load``."""
    return spark.read.parquet(target)
