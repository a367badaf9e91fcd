"""Field rules and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.quantiles import exact_quantiles
from limnos.session import HOT, settle

# Patterns.
USERNAME_PATTERN = r"^[a-z0-9]+$"
PASSWORD_PATTERN = r"^.{8,}|[0-9]+|[A-Z]+|[a-z]+|[^a-zA-Z0-9]+$"
URL_PATTERN = r"^(https?|ftp)://[^\s/$.?#].[^\s]*$"
# A working form of an address: local part, @, host labels, letters at the end.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"


def required(col: str) -> Column:
    return F.col(col).isNotNull()


def length_between(col: str, low: int, high: int) -> Column:
    return F.length(col).between(low, high)


def matches(col: str, pattern: str) -> Column:
    return F.col(col).rlike(pattern)


def user_rules() -> dict[str, Column]:
    """Rules for a new user. A null value breaks the ``required`` rule only."""
    return {
        "name_required": required("name"),
        "name_length": length_between("name", 2, 30),
        "username_required": required("username"),
        "username_length": length_between("username", 2, 20),
        "username_pattern": matches("username", USERNAME_PATTERN),
        "email_required": required("email"),
        "email_pattern": matches("email", EMAIL_PATTERN),
        "phone_required": required("phone_number"),
        "phone_length": length_between("phone_number", 10, 15),
        "password_required": required("password"),
        "password_pattern": matches("password", PASSWORD_PATTERN),
    }


def user_update_rules() -> dict[str, Column]:
    """Rules for a change of a user: every field may be left out."""
    return {
        "name_length": length_between("name", 2, 30),
        "username_length": length_between("username", 2, 20),
        "username_pattern": matches("username", USERNAME_PATTERN),
        "email_pattern": matches("email", EMAIL_PATTERN),
        "image_url_pattern": matches("profile_image_url", URL_PATTERN),
        "phone_length": length_between("phone_number", 0, 15),
    }


# Fields a booking and a room must have.
BOOKING_REQUIRED = [
    "user_id",
    "room_id",
    "check_in",
    "check_out",
    "total_price",
    "status",
    "guest_name",
    "guest_contact_number",
    "guest_email",
    "number_of_guests",
]
ROOM_REQUIRED = ["name", "description", "price", "feature_ids", "badge_ids"]


def booking_rules() -> dict[str, Column]:
    """Rules for a new booking: all fields given, and the stay ends after it starts."""
    rules = {f"{c}_required": required(c) for c in BOOKING_REQUIRED}
    return rules | {"interval": F.col("check_in") < F.col("check_out")}


def booking_update_rules() -> dict[str, Column]:
    """Rules for a change of a booking: every field may be left out, and a stay that is given ends after it starts."""
    return {"interval": F.col("check_in") < F.col("check_out")}


def room_rules() -> dict[str, Column]:
    return {f"{c}_required": required(c) for c in ROOM_REQUIRED}


# Fields that a change of a booking or a room may carry.
BOOKING_UPDATABLE = ["check_in", "check_out", "total_price", "status", "guest_name", "guest_contact_number", "guest_email", "number_of_guests"]
ROOM_UPDATABLE = ["name", "description", "image_2d", "image_3d", "price", "from_date", "to_date", "status", "feature_ids", "badge_ids"]


def extra_fields(payload: str, allowed: Sequence[str]) -> Column:
    """Names in a map column ``payload`` that are not ``allowed``, in order: a closed list of fields, checked row by row."""
    return F.array_sort(F.array_except(F.map_keys(payload), F.array(*[F.lit(c) for c in allowed]).cast("array<string>")))


def check(df: DataFrame, rules: Mapping[str, Column], allowed: Sequence[str] | None = None) -> DataFrame:
    """Adds ``broken``: names of the rules a row breaks, in rule order. A rule that gives null holds.

    ``allowed`` forbids any further column.
    """
    if allowed is not None:
        extra = sorted(set(df.columns) - set(allowed))
        if extra:
            raise ValueError(f"columns not allowed: {extra}")
    named = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("broken", F.array_compact(F.array(*named)))


def profile(df: DataFrame, cols: Sequence[str], approximate: bool = False, hot: int = HOT) -> DataFrame:
    """One row per numeric column: count, mean, spread, extremes, quartiles and distinct values.

    The table is read twice: for its moments, and into the counts of each value, from which the rest comes. Quartiles interpolate
    between neighbours and are exact. NaN counts as the largest number. ``approximate`` settles for one pass with sketches.
    """
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "metric", "value").filter(
        F.col("value").isNotNull()
    )
    if approximate:
        basic = [
            F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        ]
        quartiles = F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000)
        return (
            long.groupBy("metric")
            .agg(*basic, quartiles.alias("_q"), F.approx_count_distinct("value").alias("n_distinct"))
            .withColumns({name: F.col("_q")[i] for i, name in enumerate(("p25", "p50", "p75"))})
            .drop("_q")
        )
    # Moments are merged task by task around their own means, so that large values do not swallow a small spread.
    moments = long.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    # Distinct values are counted in two steps, so no task keeps one metric's whole value set.
    counts = settle(long.groupBy("metric", "value").agg(F.count("*").alias("c")), "counts")
    distinct = counts.groupBy("metric").agg(F.count("*").alias("n_distinct"))
    quartiles = exact_quantiles(counts, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, hot)
    return moments.join(distinct, "metric").join(quartiles, "metric")


def profile_text(df: DataFrame, cols: Sequence[str], top: int = 5) -> DataFrame:
    """One row per column of any type that reads as text: rows with a value, without, distinct values, and the ``top`` most frequent
    values with their numbers, the most frequent first, then by value."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "value")
    counts = settle(long.groupBy("column", "value").agg(F.count("*").alias("c")), "counts")
    given = F.col("value").isNotNull()
    sums = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(given, F.col("c"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~given, F.col("c"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
    )
    by_number = Window.partitionBy("column").orderBy(F.desc("c"), "value")
    first = counts.filter(given).withColumn("_n", F.row_number().over(by_number)).filter(F.col("_n") <= top)
    told = F.array_sort(F.collect_list(F.struct("_n", "value", "c")))
    tops = first.groupBy("column").agg(F.transform(told, lambda t: F.struct(t["value"], t["c"])).alias("top"))
    return sums.join(tops, "column", "left")
