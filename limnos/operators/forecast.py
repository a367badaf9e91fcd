"""Chronological split and scoring of every station in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.text import station_number
from limnos.operators.ordered import mark_first
from limnos.schemas import METRICS
from limnos.session import HOT, settle

# Share of a station's rows that is history; the scorer's features in order.
HISTORY_SHARE = 0.8
FEATURES = ["place", *METRICS]

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def chrono_split(
    df: DataFrame, by: str = "place", order: Sequence[str] = ("time", "id"), share: float = HISTORY_SHARE, hot: int = HOT
) -> DataFrame:
    """Adds ``n``, ``n_history`` (``floor(n * share)``), ``part`` (``history`` for the first ``n_history`` rows of a station, else
    ``predict``) and ``is_last``, true for the last history row."""
    history = F.floor(F.col("n") * F.lit(share))
    marked = mark_first(df, [by], order, history, kth="is_last", hot=hot)
    part = F.when(F.col("is_first"), "history").otherwise("predict")
    return marked.withColumn("n_history", history).withColumn("part", part).drop("is_first")


def first_rows(
    df: DataFrame, rows: int, by: str = "place", order: Sequence[str] = ("time", "id"), hot: int = HOT
) -> DataFrame:
    """A filter of its own: only the first ``rows`` rows of every station."""
    return mark_first(df, [by], order, rows, hot=hot).filter("is_first").drop("n", "is_first")


def split_status(split: DataFrame, by: str = "place") -> DataFrame:
    """Per station: sizes of both parts and whether there is history to predict from."""
    history = F.count(F.when(F.col("part") == "history", 1))
    return split.groupBy(by).agg(
        history.alias("n_history"),
        (F.count("*") - history).alias("n_predict"),
        F.when(history > 0, "ok").otherwise("insufficient data").alias("status"),
    )


def last_history(split: DataFrame) -> DataFrame:
    """The last history row of each station that has one."""
    return split.filter("is_last").drop("n", "n_history", "part", "is_last")


def feature_vector(cols: Sequence[str] = FEATURES) -> Column:
    """Station number and the nine metrics as 32-bit floats; a missing value counts as 0."""
    return F.array(
        *[
            F.coalesce(station_number(c) if c == "place" else F.col(c), F.lit(0)).cast("float")
            for c in cols
        ]
    )


def forecast(
    df: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | Column,
    share: float = HISTORY_SHARE,
    hot: int = HOT,
) -> DataFrame:
    """Rows ``(place, time, id, predicted_wqi)`` for the part to predict of every station that has history.

    ``scorer`` is a column over the row to score, or a function from the split (columns of
    ``df`` plus ``n``, ``n_history`` and ``part``) to scored rows with ``predicted_wqi``.
    """
    split = chrono_split(df, share=share, hot=hot)
    if isinstance(scorer, Column):
        scored = to_predict(split).withColumn("predicted_wqi", scorer)
    else:
        scored = scorer(split)
    return scored.select("place", "time", "id", "predicted_wqi")


def to_predict(split: DataFrame) -> DataFrame:
    """Rows to score, without stations whose history is empty."""
    return split.filter((F.col("part") == "predict") & (F.col("n_history") >= 1))


# Sums for the station scorers are taken over whole numbers in decimals: exact, so the
# result does not depend on the order in which tasks finish.
DECIMALS = 4


def _units(target: str, decimals: int) -> Column:
    return F.round(F.col(target) * 10**decimals).cast("decimal(20,0)")


def mean_scorer(target: str, decimals: int = DECIMALS) -> Callable[[DataFrame], DataFrame]:
    """Predict the mean of the station's history. The target is read to ``decimals`` places, all that the index has."""

    def score(split: DataFrame) -> DataFrame:
        history = split.filter((F.col("part") == "history") & F.col(target).isNotNull())
        means = history.groupBy("place").agg(
            (F.sum(_units(target, decimals)).cast("double") / F.count("*") / F.lit(float(10**decimals))).alias("predicted_wqi")
        )
        return to_predict(split).join(settle(means, "means"), "place", "left")

    return score


def trend_scorer(target: str, decimals: int = DECIMALS) -> Callable[[DataFrame], DataFrame]:
    """Predict with the least-squares line of the station's history over days. The target is read to ``decimals`` places."""

    def score(split: DataFrame) -> DataFrame:
        day = F.datediff(F.col("time").cast("date"), F.lit("1970-01-01").cast("date"))
        x = day.cast("decimal(10,0)")
        y = _units(target, decimals)
        history = split.filter((F.col("part") == "history") & F.col(target).isNotNull() & day.isNotNull())
        sums = history.groupBy("place").agg(
            F.count("*").cast("decimal(12,0)").alias("c"),
            F.sum(x).cast("decimal(18,0)").alias("sx"),
            F.sum(y).cast("decimal(20,0)").alias("sy"),
            F.sum((x * x).cast("decimal(12,0)")).cast("decimal(25,0)").alias("sxx"),
            F.sum((x * y).cast("decimal(14,0)")).cast("decimal(25,0)").alias("sxy"),
        )
        spread = (F.col("c") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
        joint = (F.col("c") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
        lines = sums.withColumn("slope", F.when(spread != 0, joint / spread)).select(
            "place",
            "slope",
            ((F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double")) / F.col("c").cast("double")).alias(
                "intercept"
            ),
        )
        scored = to_predict(split).join(settle(lines, "lines"), "place", "left")
        value = (F.col("intercept") + F.col("slope") * day.cast("double")) / F.lit(float(10**decimals))
        return scored.withColumn("predicted_wqi", value)

    return score


def batch_scorer(score: Scorer) -> Callable[[DataFrame], DataFrame]:
    """Score with a model that works on batches.

    ``score`` gets an iterator of frames with ``place, time, id, features`` and yields
    ``place, time, id, predicted_wqi``; it runs once per partition, so it can load a model first.
    """

    def run(split: DataFrame) -> DataFrame:
        rows = to_predict(split).select("place", "time", "id", feature_vector().alias("features"))
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        out = f"place string, time {kinds['time']}, id {kinds['id']}, predicted_wqi double"
        return rows.mapInPandas(score, out)

    return run
