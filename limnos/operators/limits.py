"""Request limits: fixed windows per user and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.text import sanitize_path
from limnos.operators.ordered import mark_first, micros
from limnos.session import HOT

# Limit and period (seconds) where no rule applies.
DEFAULT_LIMIT = 10
DEFAULT_PERIOD = 3600


def with_limits(
    requests: DataFrame,
    users: DataFrame,
    limits: DataFrame,
    limit: int = DEFAULT_LIMIT,
    period: int = DEFAULT_PERIOD,
) -> DataFrame:
    """Adds ``limit`` and ``period``: the rule of the user's tier for the path, else the defaults."""
    tiers = users.select(F.col("id").alias("user_id"), "tier")
    rules = limits.select("tier", sanitize_path("path").alias("path"), "limit", "period")
    return (
        requests.withColumn("path", sanitize_path("path"))
        .join(tiers, "user_id", "left")
        .join(rules, ["tier", "path"], "left")
        .withColumn("limit", F.coalesce("limit", F.lit(limit)))
        .withColumn("period", F.coalesce("period", F.lit(period)))
    )


def windowed(requests: DataFrame, limit: int = DEFAULT_LIMIT, period: int = DEFAULT_PERIOD) -> DataFrame:
    """Sanitized path and ``window_start`` in epoch seconds; a row's own ``limit`` and ``period`` come first."""
    for name, default in (("limit", limit), ("period", period)):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(default))
    at = F.floor(micros(requests, "ts") / 1_000_000)
    return requests.withColumn("path", sanitize_path("path")).withColumn(
        "window_start", at - F.pmod(at, F.col("period"))
    )


def flag_limited(
    requests: DataFrame,
    limit: int = DEFAULT_LIMIT,
    period: int = DEFAULT_PERIOD,
    hot: int = HOT,
    event: str = "event_id",
) -> DataFrame:
    """Adds ``limited``: the request comes after ``limit`` others in its window, by time and ``event``."""
    keyed = windowed(requests, limit, period)
    key = ["user_id", "path", "window_start", "limit"]
    marked = mark_first(keyed, key, ["ts", event], F.col("limit"), out="allowed", hot=hot)
    return marked.withColumn("limited", ~F.col("allowed")).drop("allowed", "n")


def audit(requests: DataFrame, limit: int = DEFAULT_LIMIT, period: int = DEFAULT_PERIOD) -> DataFrame:
    """Requests and refusals per user, path and window: one aggregate with map-side combine."""
    return (
        windowed(requests, limit, period)
        .groupBy("user_id", "path", "window_start", "limit")
        .agg(F.count("*").alias("n_requests"))
        .withColumn("n_limited", F.greatest(F.col("n_requests") - F.col("limit"), F.lit(0)))
    )
