"""A third of all rows share one key: every join back to the rows must be split by adaptive execution."""

import pytest
from pyspark.sql import functions as F

from limnos.operators import bookings, changes, forecast, joins, limits
from limnos.session import settle

ROWS = 200_000
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture(scope="module")
def small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows(small):
    base = small.range(0, ROWS, 1, 12)
    hot = F.col("id") % 3 == 0
    micros = F.lit(1_600_000_000_000_000)
    return settle(
        base.select(
            "id",
            F.when(hot, 1).otherwise(F.col("id") % 5000 + 2).alias("room_id"),
            F.timestamp_micros(F.when(hot, micros).otherwise(micros + F.col("id") * 10**9)).alias("check_in"),
            F.timestamp_micros(F.when(hot, micros).otherwise(micros + F.col("id") * 10**9) + 10**11).alias("check_out"),
            F.when(hot, "hot").otherwise(F.concat(F.lit("u"), F.xxhash64("id").cast("string"))).alias("name"),
            F.xxhash64("id", F.lit(1)).cast("string").alias("pad"),
        ),
        "skewed",
    )


def splits(df):
    """Joins of the final plan that were split."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan")[0].count("skew=true")


def test_insert_unique(small, rows):
    base = settle(small.range(100).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("name")))
    accepted, rejected = changes.insert_unique(base, rows, {"name": ["name"]}, "id")
    assert splits(rejected) == 1
    assert rejected.count() == (ROWS + 2) // 3 - 1
    assert accepted.filter("name = 'hot'").first().id == 0


def test_overlaps(small, rows):
    counted = bookings.overlaps(rows, rows)
    assert splits(counted) == 2
    assert counted.filter("room_id = 1").agg(F.min("n_overlaps"), F.max("n_overlaps")).first() == ((ROWS + 2) // 3,) * 2


def test_clusters(small, rows):
    assert splits(bookings.clusters(rows)) == 1


def test_children(small, rows):
    parents = settle(small.range(6000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("n")))
    kids = rows.select("id", F.col("room_id").alias("parent"), "pad")
    found = joins.children_of(parents, "n", parents.select(F.col("n").alias("name")), kids, "parent")
    assert splits(found) >= 1
    assert found.filter(F.col("child_id").isNotNull()).count() == ROWS


def test_limits(small, rows):
    requests = rows.select(
        F.col("id").alias("event_id"), F.col("room_id").alias("user_id"), F.col("check_in").alias("ts"),
        F.lit("/a/").alias("path"), "pad",
    )
    users = settle(small.range(6000).select("id", F.lit("t").alias("tier")))
    rules = settle(small.createDataFrame([("t", "a", 5, 60)], "tier string, path string, limit int, period int"))
    ruled = limits.with_limits(requests, users, rules)
    assert splits(ruled) >= 1
    flagged = limits.flag_limited(ruled, hot=1000)
    assert flagged.filter("user_id = 1 and not limited").count() == 5


def test_split(small, rows):
    obs = rows.select("id", F.col("room_id").cast("string").alias("place"), F.col("check_in").alias("time"), "pad")
    split = forecast.chrono_split(obs, hot=1000)
    hot = (ROWS + 2) // 3
    assert split.filter("place = '1' and part = 'history'").count() == int(hot * 0.8)
