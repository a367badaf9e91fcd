"""What the plans must look like, whatever the size of the data."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from limnos.functions.wqi import with_wqi
from limnos.operators import catalog, cleaning, correlate, forecast, joins, ordered, paging, stations
from limnos.operators.cleaning import clean
from limnos.schemas import METRICS, SOURCE_COLUMNS
from limnos.session import settle
from limnos.sources import readings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range|Single)", text))


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(i, f"{i % 3}.0", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *[1.0] * 9) for i in range(60)]
    fields = "id long, place string, time timestamp, " + ", ".join(f"{m} double" for m in METRICS)
    return settle(spark.createDataFrame(rows, fields), "obs")


def test_index_is_native_and_narrow(obs):
    text = plan(with_wqi(obs).select("id", "wqi"))
    assert "Python" not in text and exchanges(text) == 0
    assert text.lstrip().startswith("*(1)")


def test_index_reads_only_its_columns(obs):
    text = plan(with_wqi(obs).select("wqi"))
    assert "place" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_pivot_shuffles_once_and_combines_first(obs):
    text = plan(correlate.correlate(readings.to_readings(obs), latest=None))
    assert exchanges(text) == 1 and "partial_max" in text and "SortAggregate" not in text


def test_latest_by_offset_stays_a_hash_aggregate(obs):
    long = readings.to_readings(obs).withColumn("offset", F.lit(1))
    assert "SortAggregate" not in plan(correlate.correlate(long, latest="offset"))


def test_cleaning_is_narrow_and_parses_once(spark):
    raw = spark.createDataFrame(
        [tuple("1" for _ in SOURCE_COLUMNS)], ", ".join(f"{c} string" for c in SOURCE_COLUMNS.values())
    )
    text = plan(cleaning.clean(settle(raw, "raw").withColumn("src_line", F.lit(1))))
    assert exchanges(text) == 0 and "Python" not in text
    assert text.count("try_cast(replace(cod#") <= 1
    assert clean(raw).count() == 0


def test_search_reaches_the_scan(spark):
    rooms = settle(
        spark.createDataFrame([(1, 5.0, [1], [1])], "id long, price double, feature_ids array<int>, badge_ids array<int>")
    )
    text = plan(catalog.search_rooms(rooms, 1, 9, features=[1]))
    assert "GreaterThanOrEqual(price" in text and "LessThanOrEqual(price" in text


def test_station_and_keyset_filters_reach_the_scan(obs):
    assert "EqualTo(place,24.0)" in plan(stations.station_rows(obs, 24))
    deep = paging.keyset_page(obs, ["time", "id"], [dt.datetime(2020, 2, 1), 3], 5)
    assert "GreaterThanOrEqual(time" in plan(deep) and "TakeOrderedAndProject" in plan(deep)


def test_station_list_sorts_no_rows(obs):
    table = stations.station_list(obs.withColumn("location", F.col("place")))
    text = plan(table)
    below = text[text.rindex("HashAggregate(keys") :]
    assert "partial_min(id" in below and "Sort" not in below


def test_lookup_reaches_the_scan(obs):
    assert "EqualTo(id,7)" in plan(stations.lookup(obs, id=7))


def test_split_of_bounded_groups_shuffles_once(obs):
    assert exchanges(plan(forecast.chrono_split(obs))) == 1


def test_small_groups_are_not_counted_one_by_one(obs, monkeypatch):
    """Where sums over hashes are small, no table of groups is written."""
    made = []
    own = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df, label="": made.append(label) or own(df, label))
    ordered.ranked(obs, ["place", "id"], ["time"]).collect()
    assert made == []
    ordered.ranked(obs, ["place"], ["time", "id"], hot=5).collect()
    assert made[0] == "hot"


def test_split_of_hot_groups_sorts_ranges_only(obs):
    """Windows over rows of hot groups are cut by range; only per-group sums of ranges are windowed by group alone."""
    text = plan(forecast.chrono_split(obs, hot=5))
    windows = re.findall(r"Window \[sum\(_w#\d+L?\) .*?\], \[([^\]]*)\]", text)
    assert windows and all("_range" in keys for keys in windows)


def test_deep_page_is_a_filter_on_the_scan(obs):
    text = plan(paging.page(obs, ["time", "id"], number=4, items=10, shallow=0))
    assert "GreaterThanOrEqual(time" in text and "Window" not in text


def test_decode_has_one_generator(spark):
    messages = settle(spark.createDataFrame([("t", "k", "{}", 1)], "topic string, key string, value string, offset long"))
    text = plan(readings.good(readings.decode(messages)))
    assert len(re.findall(r"Generate ", text)) == 1 and exchanges(text) == 0


def test_no_broadcast_beyond_the_threshold(spark, obs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(joins.only_existing(obs, obs.withColumnRenamed("id", "x").select("place"), ["place"]))
        split = plan(forecast.chrono_split(obs, hot=5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in text and "Broadcast" not in split
