"""The registered queries. Each reads whole tables and gives flat rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import wqi as index
from limnos.functions.text import around, iso_text
from limnos.operators import bookings as stay
from limnos.operators import (
    bitmaps, catalog, changes, cleaning, correlate, forecast, joins, limits, paging, quality, sketches, stations,
)
from limnos.operators.ordered import forward_fill, sort_columns
from limnos.plans import fixtures as fx
from limnos.schemas import METRICS, SOURCE_COLUMNS, WATER_QUALITY
from limnos.session import new_path, settle, spread
from limnos.sources import files, pages, readings, seed, warehouse
from limnos.streaming import fates, jobs, keyed, limiter, sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _obs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fixture(spark, sf, fx.OBS)


# --- index -------------------------------------------------------------------------------


@query
def wqi_subindices(spark, sf):
    obs = _obs(spark, sf)
    return obs.select("id", *[index.sub_index(m, m).alias(f"q_{m}") for m in METRICS])


@query
def wqi_scalar(spark, sf):
    return index.with_wqi(_obs(spark, sf)).select("id", "place", "time", "wqi")


@query
def wqi_by_station(spark, sf):
    scored = index.with_wqi(_obs(spark, sf))
    # The index has four decimals, so its sum as a decimal is exact in any order.
    total = F.sum(F.col("wqi").cast("decimal(18,4)")).cast("double")
    return scored.groupBy("place").agg(
        F.count("*").alias("n_rows"),
        F.count("wqi").alias("n_index"),
        (total / F.count("wqi")).alias("avg_wqi"),
        F.min("wqi").alias("min_wqi"),
        F.max("wqi").alias("max_wqi"),
    )


# --- cleaning ----------------------------------------------------------------------------


@query
def clean_detection_limits(spark, sf):
    cols = ["ph", "aeromonas_total"]
    df = cleaning.require(fx.fixture(spark, sf, fx.RAW_OBS), cols)
    df = cleaning.replace_tokens(df, cleaning.BELOW_DETECTION, ["ph"])
    df = cleaning.replace_tokens(df, cleaning.BELOW_DETECTION_BACTERIA, ["aeromonas_total"])
    return cleaning.require(cleaning.parse_numbers(df, cols), cols).select("src_line", *cols)


@query
def clean_dates(spark, sf):
    df = cleaning.parse_date(fx.fixture(spark, sf, fx.RAW_OBS), "obs_date")
    return df.select("src_line", F.col("date").cast("string").alias("obs_day"), "year", "month", "day")


@query
def clean_coordinates(spark, sf):
    df = cleaning.parse_coordinates(fx.fixture(spark, sf, fx.RAW_OBS), "coord")
    return df.select("src_line", "latitude", "longitude")


@query
def ffill_global(spark, sf):
    raw = fx.fixture(spark, sf, fx.RAW_OBS)
    filled = forward_fill(raw, ["ph", "aeromonas_total"], ["src_line"], bucket=4096)
    return filled.select("src_line", "ph", "aeromonas_total")


@query
def ffill_per_station(spark, sf):
    raw = fx.fixture(spark, sf, fx.RAW_OBS)
    filled = forward_fill(raw, ["ph", "aeromonas_total"], ["src_line"], by=["place"], bucket=4096)
    return filled.select("src_line", "place", "ph", "aeromonas_total")


@query
def ingest_observations(spark, sf):
    rows = cleaning.to_warehouse(cleaning.clean(fx.fixture(spark, sf, fx.RAW_WIDE)))
    return rows.withColumn("time", F.col("time").cast("string"))


@query
def ingest_csv(spark, sf):
    """The same through three CSV files with the source's own headers. A row is known by its file and its place there."""
    headers = {new: old for old, new in SOURCE_COLUMNS.items()}
    path = new_path(spark, "raw-csv")
    wide = fx.fixture(spark, sf, fx.RAW_WIDE).withColumn("part", F.col("src_line") % 3)
    # One partition per part, so that a part is one file.
    parts = wide.repartition(3, "part").sortWithinPartitions("part", "src_line")
    files.write_raw(parts.select("part", *[F.col(c).alias(headers[c]) for c in headers]), path, by=["part"])
    name = F.regexp_extract("_metadata.file_path", "part=([0-9]+)/", 1)
    rows = cleaning.to_warehouse(cleaning.clean(files.read_raw(spark, f"{path}/*/", name=name)))
    return rows.withColumn("time", F.col("time").cast("string"))


@query
def keyset_walk(spark, sf):
    """All pages of the cleaned observations in both directions, numbered at once; rows without a time come last."""
    rows = settle(cleaning.to_warehouse(cleaning.clean(fx.fixture(spark, sf, fx.RAW_WIDE))).select("id", "time"), "walked")
    walks = [
        paging.numbered(rows, order, 2500).select("id", F.lit(name).alias("direction"), F.col("page").cast("int").alias("page"))
        for name, order in (("up", ["time", "id"]), ("down", ["-time", "-id"]))
    ]
    return reduce(DataFrame.unionByName, walks)


@query
def warehouse_station_page(spark, sf):
    """Saved by year, read back, and a page of one station's rows of some years."""
    target = new_path(spark, "warehouse")
    warehouse.save(_obs(spark, sf), target)
    recent = warehouse.load(spark, target).filter(F.col("year").between(1995, 1997)).drop("year")
    return stations.station_page(recent, 24, number=2, items=10)


@query
def profile(spark, sf):
    table = quality.profile(_obs(spark, sf), METRICS)
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query
def profile_of_loads(spark, sf):
    """Three loads summarised one by one and merged: exact where it is exact, and whether the sketches keep their stated errors."""
    obs, target = _obs(spark, sf), new_path(spark, "profiles")
    for load in range(3):
        sketches.store(sketches.summary(obs.filter(F.col("id") % 3 == load), METRICS), target, str(load))
    merged = sketches.told(sketches.merge(sketches.stored(spark, target).drop("load")))
    values = obs.unpivot([], [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "value")
    near = []
    for name, rank in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        below, upto = F.count_if(F.col("value") < F.col(name)) / F.count("*"), F.count_if(F.col("value") <= F.col(name)) / F.count("*")
        near.append(((below - sketches.RANK_ERROR <= rank) & (upto + sketches.RANK_ERROR >= rank)).alias(f"{name}_near"))
    told = merged.select("metric", "p25", "p50", "p75", F.col("n_distinct").alias("_distinct"))
    distinct = F.count_distinct("value")
    near.append((F.abs(F.first("_distinct") - distinct) <= sketches.DISTINCT_ERROR * distinct + 1).alias("n_distinct_near"))
    judged = values.join(told, "metric").groupBy("metric").agg(*near)
    exact = merged.select("metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")
    return exact.join(judged, "metric")


@query
def profile_text_of_loads(spark, sf):
    """Text columns in the same way, with their most frequent values."""
    raw = fx.fixture(spark, sf, fx.RAW_OBS)
    parts = [sketches.text_summary(raw.filter(F.col("src_line") % 3 == load), ["coord", "ph"]) for load in range(3)]
    table = sketches.told_text(sketches.merge_text(reduce(DataFrame.unionByName, parts)), top=3)
    tops = F.array_join(F.transform("top", lambda t: F.concat_ws("=", t["value"], t["c"].cast("string"))), ";")
    return table.select("column", "n", "n_null", tops.alias("top"))


def _unbounded(spark, sf, **options):
    table = quality.profile(fx.fixture(spark, sf, fx.UNBOUNDED), ["level", "depth"], **options)
    return table.select("metric", "n", "n_distinct", "min", "max", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


@query
def profile_with_infinity(spark, sf):
    return _unbounded(spark, sf)


@query
def profile_with_infinity_hot(spark, sf):
    """The same with every column treated as too large for one task."""
    return _unbounded(spark, sf, hot=50)


@query
def profile_text(spark, sf):
    """Coordinates as they come, with the most frequent ones."""
    table = quality.profile_text(fx.fixture(spark, sf, fx.RAW_OBS), ["coord", "ph"], top=3)
    tops = F.array_join(F.transform("top", lambda t: F.concat_ws("=", t["value"], t["c"].cast("string"))), ";")
    return table.withColumn("top", tops)


@query
def user_field_rules(spark, sf):
    checked = quality.check(fx.fixture(spark, sf, fx.USER_FORMS), quality.user_rules())
    return checked.select("id", F.size("broken").alias("n_broken"), F.array_join("broken", ",").alias("broken"))


@query
def booking_field_rules(spark, sf):
    checked = quality.check(fx.fixture(spark, sf, fx.BOOKING_FORMS), quality.booking_rules())
    return checked.select("id", F.size("broken").alias("n_broken"), F.array_join("broken", ",").alias("broken"))


@query
def booking_update_rules(spark, sf):
    """Rules for changes of bookings, and fields that a change may not carry."""
    changes_ = fx.fixture(spark, sf, fx.BOOKING_CHANGES).withColumn("payload", F.create_map("field", F.lit("x")))
    checked = quality.check(changes_, quality.booking_update_rules())
    extra = quality.extra_fields("payload", quality.BOOKING_UPDATABLE)
    return checked.select("id", F.array_join("broken", ",").alias("broken"), F.array_join(extra, ",").alias("extra"))


@query
def room_field_rules(spark, sf):
    rooms = fx.rooms(spark, sf).withColumn("description", F.when(F.col("id") % 3 > 0, F.col("name")))
    checked = quality.check(rooms, quality.room_rules(), allowed=[*quality.ROOM_UPDATABLE, "id"])
    return checked.select("id", F.array_join("broken", ",").alias("broken"))


# --- readings ----------------------------------------------------------------------------


@query
def unpivot_readings(spark, sf):
    return readings.to_readings(_obs(spark, sf), ids=["id", "place", "time"])


@query
def publish_decode_roundtrip(spark, sf):
    sent = readings.to_messages(readings.to_readings(spread(_obs(spark, sf))))
    got = readings.good(readings.decode(sent)).drop("location")
    return got.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def correlate_pivot(spark, sf):
    long = readings.to_readings(_obs(spark, sf), ids=["id", "place", "time"])
    return correlate.correlate(long, key=["id", "place", "time"])


@query
def correlate_join_chain(spark, sf):
    long = readings.to_readings(_obs(spark, sf), ids=["id", "place", "time"])
    return correlate.correlate(long, key=["id", "place", "time"], mode="join")


@query
def correlate_latest(spark, sf):
    """Every seventh observation has its pH sent again, once corrected and once stale; the highest offset wins."""
    long = readings.to_readings(_obs(spark, sf), ids=["id", "place", "time"]).withColumn("offset", F.col("id") * 10 + 1)
    again = long.filter("id % 7 = 0 and topic = 'ph_topic'")
    corrected = again.select(*[c for c in long.columns if c not in ("value", "offset")], (F.col("value") + 1).alias("value"), (F.col("offset") + 1).alias("offset"))
    stale = again.select(*[c for c in long.columns if c not in ("value", "offset")], F.lit(99.0).alias("value"), (F.col("offset") - 1).alias("offset"))
    return correlate.correlate(long.unionByName(corrected).unionByName(stale), key=["id", "place", "time"], latest="offset")


@query
def correlate_ambiguous(spark, sf):
    """Observations of a station share their day: without an order such readings are listed and not mixed."""
    long = readings.to_readings(_obs(spark, sf), ids=["id", "place", "time"])
    return correlate.ambiguous(long, ["place", "time"])


def _ingested(spark, sf, write):
    """Messages, read as a stream, become rows of the warehouse table; what comes later than the watermark is dropped. ``write`` makes the
    writer of a folder; returns the folder."""
    obs = fx.fixture(spark, sf, fx.OBS_TIMED).withColumn("time", F.col("time").cast("timestamp"))
    messages, target, state = (new_path(spark, x) for x in ("messages", "warehouse", "warehouse-state"))
    border = F.lit("1995-01-01").cast("timestamp")
    for sent in (F.col("time") >= border, F.col("time") < border):
        batch = readings.to_readings(obs.filter(sent), ids=["place", "location", "time"])
        readings.publish_files(readings.to_messages(batch), messages)
        decoded = readings.good(readings.decode(readings.read_files(spark, messages)))
        rows = jobs.warehouse_stream(decoded, watermark="10 days")
        # The second round's messages are older than the first round's watermark.
        sink.start(rows, write(target), state, available_now=True).awaitTermination()
    return target


@query
def stream_ingest(spark, sf):
    """All rows that the stream loaded, by batch and year; readers take the last row of each key."""
    target = _ingested(spark, sf, lambda path: sink.batch_sink(path, "time"))
    loaded = sink.read_latest(spark, target, ["id"], WATER_QUALITY).drop("year")
    return loaded.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def stream_ingest_all(spark, sf):
    """The same as a table by key, which readers scan."""
    target = _ingested(spark, sf, lambda path: keyed.keyed_sink(path, ["id"], buckets=8))
    return keyed.read_keyed(spark, target, WATER_QUALITY).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def warehouse_both_ways(spark, sf):
    """The same observations as a cleaned file and as messages, into one table by key: each is there once."""
    clean = settle(cleaning.clean(fx.fixture(spark, sf, fx.RAW_WIDE)), "clean")
    messages, target, state = (new_path(spark, x) for x in ("messages", "warehouse", "warehouse-state"))
    sent = clean.orderBy("src_line").select("place", "location", F.col("date").cast("timestamp").alias("time"), *METRICS)
    readings.publish_files(readings.to_messages(readings.to_readings(sent, ids=["place", "location", "time"])).coalesce(1), messages)
    decoded = readings.good(readings.decode(readings.read_files(spark, messages)))
    write = keyed.keyed_sink(target, ["id"], buckets=8)
    sink.start(jobs.warehouse_stream(decoded), write, state, available_now=True).awaitTermination()
    streamed = keyed.read_keyed(spark, target).select("id", F.lit(True).alias("streamed"))
    streamed = settle(streamed, "streamed")
    write(cleaning.to_observations(clean), keyed.manifest(spark, target)["batch"] + 1)
    rows = keyed.read_keyed(spark, target).join(streamed, "id", "left")
    return rows.withColumns({"time": F.col("time").cast("string"), "streamed": F.coalesce("streamed", F.lit(False))})


@query
def stream_reading_fates(spark, sf):
    """All readings of a stream that lacks some metrics and brings its first years last, with what became of each."""
    obs = fx.fixture(spark, sf, fx.OBS_TIMED).withColumn("time", F.col("time").cast("timestamp"))
    messages, target, state = (new_path(spark, x) for x in ("messages", "fates", "fates-state"))
    border = F.lit("1995-01-01").cast("timestamp")
    lacking = obs.withColumns({m: F.when(F.col("id") % 11 != 0, F.col(m)) for m in ("ph", "tss")})
    for sent in (F.col("time") >= border, F.col("time") < border):
        readings.publish_files(readings.to_messages(readings.to_readings(lacking.filter(sent))), messages)
        decoded = readings.good(readings.decode(readings.read_files(spark, messages))).drop("location")
        stream = fates.fate_stream(decoded, watermark="10 days")
        sink.start(stream, fates.fate_sink(target), state, "append", available_now=True).awaitTermination()
    told = fates.fates(spark, target)
    return told.select("place", F.col("time").cast("timestamp_ntz").alias("time"), "topic", "value", "fate")


@query
def stream_rate_limit_flags(spark, sf):
    """Every request flagged as it arrives, in four parts by time, with a restart between."""
    requests = settle(_requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "requests")
    path, target, state = (new_path(spark, x) for x in ("requests", "flags", "flags-state"))
    first, last = requests.select(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    part = F.floor((F.unix_seconds("ts") - first) * 4 / (last - first + 1))
    for number in range(4):
        requests.filter(part == number).write.mode("append").parquet(path)
        arriving = spark.readStream.schema(requests.schema).parquet(path)
        sink.run_available(limiter.flag_stream(arriving, limit=2, period=604_800, watermark="1 day"), target, state, mode="append")
    return spark.read.parquet(target).select("event_id", "user_id", "path", "window_start", "limited")


@query
def stream_correlate_wqi(spark, sf):
    """Readings as a file stream, through watermark and keyed pivot into the batch sink."""
    schema = fx.table(spark, sf, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    obs = orders.selectExpr(*fx.OBS[1]).withColumn("time", F.col("time").cast("timestamp"))
    key = ["id", "place", "time"]
    # The replay is not in time order, so the watermark has to span the whole history.
    stream = jobs.index_stream(readings.to_readings(obs, ids=key), watermark="10000 days", key=key)
    target = new_path(spark, "observations")
    sink.run_available(stream, target, new_path(spark, "observations-state"))
    return sink.read_latest(spark, target, key).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def stream_request_windows(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    requests = events.selectExpr(*fx.REQUESTS[1]).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = jobs.window_counts(requests, period=3600, watermark="10000 days")
    target = new_path(spark, "windows")
    sink.run_available(stream, target, new_path(spark, "windows-state"))
    latest = sink.read_latest(spark, target, ["user_id", "path", "window_start"])
    return latest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- stations ----------------------------------------------------------------------------


@query
def station_list(spark, sf):
    return stations.station_list(_obs(spark, sf))


@query
def station_page(spark, sf):
    return stations.station_page(_obs(spark, sf), 24, number=2, items=10)


@query
def rows_in_places(spark, sf):
    return joins.rows_in(_obs(spark, sf), "place", ["1.0", "24.0", "37.0"]).select("id", "place", "time")


@query
def observations_in_order(spark, sf):
    """The whole table by time, with the calendar parts of each row."""
    ordered = _obs(spark, sf).orderBy(*sort_columns(["time", "id"]))
    return ordered.select("id", F.year("time").alias("year"), F.month("time").alias("month"), F.dayofmonth("time").alias("day"))


@query
def station_page_header(spark, sf):
    return paging.page_header(stations.station_rows(_obs(spark, sf), 24), 2, 10)


@query
def keyset_page(spark, sf):
    after = ["1998-01-01 00:00:00", 0]
    obs = _obs(spark, sf)
    after[0] = F.lit(after[0]).cast(obs.schema["time"].dataType)
    return paging.keyset_page(obs, ["time", "id"], after, 25)


@query
def deep_page(spark, sf):
    """A page far into the whole table, reached by searching its first key."""
    return paging.page(_obs(spark, sf), ["time", "id"], number=41, items=20, shallow=0)


@query
def deep_page_text_id(spark, sf):
    """The same for observations known by a text."""
    return paging.page(fx.fixture(spark, sf, fx.OBS_TEXT_ID), ["-time", "id"], number=41, items=20, shallow=0)


@query
def directory_pages(spark, sf):
    """Pages from all over a table that three loads wrote, found through its directory."""
    obs, target, order = _obs(spark, sf), new_path(spark, "paged"), ["-time", "id"]
    for load in range(3):
        pages.append(obs.filter(F.col("id") % 3 == load), target, order, step=50)
    last = -(-pages.count(spark, target) // 20)
    wanted = sorted({1, 2, last // 3, last // 2, last - 1, last, last + 1})
    found = [pages.page(spark, target, order, number, 20).withColumn("page", F.lit(number)) for number in wanted]
    return reduce(DataFrame.unionByName, found).select("page", "id", "time", "place")


@query
def observation_by_id(spark, sf):
    return stations.lookup(_obs(spark, sf), id=7)


# --- forecast ----------------------------------------------------------------------------


@query
def chrono_split(spark, sf):
    return forecast.chrono_split(_obs(spark, sf)).select("id", "place", "time", "n", "part")


@query
def chrono_split_hot(spark, sf):
    """The same with every station treated as too large for one task."""
    return forecast.chrono_split(_obs(spark, sf), hot=50).select("id", "place", "time", "n", "part")


@query
def chrono_split_text_id(spark, sf):
    split = forecast.chrono_split(fx.fixture(spark, sf, fx.OBS_TEXT_ID))
    return split.select("id", "place", "time", "n", "n_history", "part")


@query
def chrono_split_text_id_hot(spark, sf):
    split = forecast.chrono_split(fx.fixture(spark, sf, fx.OBS_TEXT_ID), hot=50)
    return split.select("id", "place", "time", "n", "n_history", "part")


@query
def split_status(spark, sf):
    return forecast.split_status(forecast.chrono_split(_obs(spark, sf)))


@query
def last_history(spark, sf):
    split = forecast.chrono_split(_obs(spark, sf))
    return forecast.last_history(split).select("place", "id", "time", "location", *METRICS)


@query
def feature_vector(spark, sf):
    vector = _obs(spark, sf).select("id", forecast.feature_vector().alias("v"))
    return vector.select("id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query
def forecast_index(spark, sf):
    return forecast.forecast(_obs(spark, sf), index.wqi())


@query
def forecast_mean(spark, sf):
    return forecast.forecast(index.with_wqi(_obs(spark, sf)), forecast.mean_scorer("wqi"))


@query
def forecast_trend(spark, sf):
    return forecast.forecast(index.with_wqi(_obs(spark, sf)), forecast.trend_scorer("wqi"))


@query
def forecast_mean_share(spark, sf):
    """A quarter of each station's rows is history."""
    return forecast.forecast(index.with_wqi(_obs(spark, sf)), forecast.mean_scorer("wqi"), share=0.25)


@query
def forecast_mean_share_all(spark, sf):
    """The same over all observations, of stations from half of all rows down to one; those of up to three have no history."""
    obs = fx.fixture(spark, sf, fx.OBS_TAIL)
    return forecast.forecast(index.with_wqi(obs), forecast.mean_scorer("wqi"), share=0.25)


@query
def forecast_trend_share(spark, sf):
    return forecast.forecast(index.with_wqi(_obs(spark, sf)), forecast.trend_scorer("wqi"), share=0.25)


def oxygen_balance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in model over feature vectors: a weighted sum of oxygen, demand and ammonium, in 32 bits."""
    weights = np.zeros(10, dtype=np.float32)
    weights[[2, 5, 8]] = [8.0, -4.0, -0.5]
    for batch in batches:
        vectors = np.stack(batch["features"].to_numpy())
        score = vectors[:, 2] * weights[2] + vectors[:, 5] * weights[5] + vectors[:, 8] * weights[8]
        yield batch[["place", "time", "id"]].assign(predicted_wqi=score.astype("float64"))


@query
def forecast_model(spark, sf):
    return forecast.forecast(_obs(spark, sf), forecast.batch_scorer(oxygen_balance))


# --- catalog -----------------------------------------------------------------------------


def _names(col: str):
    return F.array_join(F.transform(col, lambda d: F.concat_ws(":", d["id"].cast("string"), d["name"])), ";")


def _enriched(spark: SparkSession, rooms: DataFrame) -> DataFrame:
    rooms = catalog.enrich(rooms, "feature_ids", seed.dimension(spark, seed.FEATURES), "features")
    rooms = catalog.enrich(rooms, "badge_ids", seed.dimension(spark, seed.BADGES), "badges")
    return rooms.select(
        "id", "name", "price", _names("features").alias("features"), _names("badges").alias("badges")
    )


@query
def room_search(spark, sf):
    found = catalog.search_rooms(fx.rooms(spark, sf), 910, 980, features=[3], badges=[4])
    return found.select("id", "name", "price")


# Lower bounds of price bands.
PRICE_BANDS = [900.0 + 20 * k for k in range(60)]


def _by_bitmaps(spark, sf, **asked):
    rooms = settle(fx.rooms(spark, sf), "rooms")
    index = settle(bitmaps.room_index(rooms, PRICE_BANDS), "room-index")
    return bitmaps.matching(index, rooms, PRICE_BANDS, **asked), rooms


@query
def room_search_bitmaps(spark, sf):
    """The search by bits: all rooms found, with their number."""
    found, rooms = _by_bitmaps(spark, sf, min_price=910, max_price=980, features=[3], badges=[4])
    hits = rooms.join(bitmaps.ids(found), "id", "left_semi").select("id", "name", "price")
    return hits.select("*", F.lit(bitmaps.total(found).first()[0]).alias("total_count"))


@query
def room_search_bitmaps_page(spark, sf):
    """The second page of a search by bits, and the total, without reading other rooms."""
    found, rooms = _by_bitmaps(spark, sf, min_price=915, max_price=1501.5, features=[3])
    return bitmaps.page(found, rooms, 2, 10).select("id", "name", "price", "total_count")


@query
def room_search_live(spark, sf):
    """Rooms that are not deleted, those included that do not say; no price bound."""
    return catalog.search_rooms(fx.fixture(spark, sf, fx.ROOMS_STATE)).select("id", "name", "price")


@query
def room_search_page(spark, sf):
    found = catalog.search_rooms(fx.rooms(spark, sf), 910, 980, features=[3])
    return _enriched(spark, paging.page(found, ["id"], 2, 10))


@query
def room_enriched(spark, sf):
    return _enriched(spark, fx.rooms(spark, sf))


@query
def room_enriched_odd(spark, sf):
    """Ids that are listed twice, unknown or null, and a dimension that holds an id twice."""
    rooms = fx.rooms(spark, sf).withColumn(
        "feature_ids", F.concat("feature_ids", F.slice("feature_ids", 1, 1), F.array(F.lit(99), F.lit(None).cast("int")))
    )
    features = seed.dimension(spark, seed.FEATURES)
    twice = features.unionByName(features.filter("id = 3").withColumn("name", F.lit("again")))
    return catalog.enrich(rooms, "feature_ids", twice, "features").select("id", _names("features").alias("features"))


@query
def dimension_list(spark, sf):
    features = paging.full_list(seed.dimension(spark, seed.FEATURES))
    return catalog.dimension_usage(features, fx.rooms(spark, sf), "feature_ids").select("id", "name", "n_rooms")


# --- bookings ----------------------------------------------------------------------------


def _bookings(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fixture(spark, sf, fx.BOOKINGS)


@query
def booking_conflicts(spark, sf):
    return stay.conflicts(_bookings(spark, sf)).select("id", "room_id", "n_overlaps")


@query
def booking_conflicts_hot(spark, sf):
    """The same with every room treated as too large for one task."""
    return stay.conflicts(_bookings(spark, sf), hot=5).select("id", "room_id", "n_overlaps")


def _witnesses(spark, sf, **options):
    return stay.conflict_witness(_bookings(spark, sf), **options).select("id", "room_id", "witness")


@query
def booking_conflict_witness(spark, sf):
    """For every booking that overlaps others, one of them."""
    return _witnesses(spark, sf)


@query
def booking_conflict_witness_hot(spark, sf):
    """The same with every room treated as too large for one task."""
    return _witnesses(spark, sf, hot=5)


@query
def booking_blocked_by(spark, sf):
    """All requests with the booking that stands in their way, if any."""
    asked = fx.fixture(spark, sf, fx.BOOKING_REQUESTS)
    return stay.blocked_by(asked, _bookings(spark, sf)).select("id", "room_id", "witness")


@query
def booking_admission_in_order(spark, sf):
    """One room's requests in the order of their stays, all linked, with small blocks."""
    asked = fx.fixture(spark, sf, fx.REQUESTS_IN_ORDER)
    return stay.admit(_bookings(spark, sf).limit(0), asked, block=500).select("id", "outcome")


@query
def booking_clashes(spark, sf):
    """Moving every booking to its room's next name and three days on: which moves would clash?"""
    moves = fx.fixture(spark, sf, fx.BOOKING_REQUESTS).filter(stay.valid_stay())
    return stay.clashes(moves, _bookings(spark, sf)).select("id", "room_id", "clash")


@query
def booking_admission(spark, sf):
    asked = fx.fixture(spark, sf, fx.BOOKING_REQUESTS)
    return stay.admit(_bookings(spark, sf), asked).select("id", "room_id", "outcome")


@query
def booking_cancel(spark, sf):
    asked = fx.table(spark, sf, "events").selectExpr("event_id as id")
    done = stay.cancel(_bookings(spark, sf), asked)
    return done.select("id", "status", F.coalesce("outcome", F.lit("none")).alias("outcome"))


@query
def user_bookings(spark, sf):
    return stay.user_bookings(_bookings(spark, sf), 42).drop("deleted_at")


@query
def room_bookings(spark, sf):
    return stay.room_bookings(
        _bookings(spark, sf), 35, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")
    ).drop("deleted_at")


@query
def booking_joined(spark, sf):
    full = joins.with_user_and_room(
        _bookings(spark, sf), fx.fixture(spark, sf, fx.USERS), fx.fixture(spark, sf, fx.ROOMS_FLAT)
    )
    return full.select("id", "user__username", "user__is_deleted", "room__name", "room__price")


@query
def joined_prefixed(spark, sf):
    """Users with the bookings of superusers only, one page."""
    users = fx.fixture(spark, sf, fx.USERS)
    on = (F.col("id") == F.col("booking_user_id")) & F.col("is_superuser")
    rows = joins.joined(users, _bookings(spark, sf), on, prefix="booking_", where=~F.col("is_deleted"))
    rows = rows.select("id", "username", F.coalesce("booking_id", F.lit(-1)).alias("booking_id"))
    return paging.page(rows, ["id", "booking_id"], number=1, items=100)


@query
def children_of_parent(spark, sf):
    wanted = fx.table(spark, sf, "events").selectExpr("concat('user', cast(user_id * 11 as string)) as name").distinct()
    found = joins.children_of(
        fx.fixture(spark, sf, fx.USERS), "username", wanted, _bookings(spark, sf), "user_id"
    )
    return found.select(
        "name",
        "found",
        F.coalesce("parent_id", F.lit(-1)).alias("parent_id"),
        F.coalesce("child_id", F.lit(-1)).alias("child_id"),
    )


# --- changes -----------------------------------------------------------------------------


@query
def insert_unique(spark, sf):
    accepted, rejected = changes.insert_unique(
        fx.fixture(spark, sf, fx.USERS),
        fx.fixture(spark, sf, fx.SIGN_UPS),
        {"username not available": ["username"]},
        "seq",
    )
    return accepted.withColumn("reason", F.lit("accepted")).unionByName(rejected)


@query
def insert_unique_unplaced(spark, sf):
    """Some sign-ups do not say where they come in the order."""
    accepted, rejected = changes.insert_unique(
        fx.fixture(spark, sf, fx.USERS), fx.fixture(spark, sf, fx.SIGN_UPS_UNPLACED), {"username not available": ["username"]}, "seq"
    )
    return accepted.withColumn("reason", F.lit("accepted")).unionByName(rejected)


def _with_two_keys(spark, sf, sign_ups):
    accepted, rejected = changes.insert_unique(
        fx.fixture(spark, sf, fx.USERS),
        fx.fixture(spark, sf, sign_ups),
        {"email is already registered": ["email"], "username not available": ["username"]},
        "seq",
    )
    return accepted.withColumn("reason", F.lit("accepted")).unionByName(rejected)


@query
def insert_unique_two_keys(spark, sf):
    return _with_two_keys(spark, sf, fx.SIGN_UPS_TWO)


@query
def insert_unique_chained(spark, sf):
    """Each sign-up hangs on the one before."""
    return _with_two_keys(spark, sf, fx.SIGN_UPS_CHAINED)


@query
def new_booking_defaults(spark, sf):
    """New bookings by user, room and day; rows without a day, and repeats, are set apart."""
    forms = fx.fixture(spark, sf, fx.BOOKING_FORMS).withColumnRenamed("id", "seq")
    filled = changes.with_defaults(forms, {"status": F.lit(stay.BOOKED), "number_of_guests": F.lit(1)})
    named, apart = changes.keyed(filled, ["user_id", "room_id", "check_in"], "seq")
    rows = named.withColumn("reason", F.lit("new")).unionByName(apart, allowMissingColumns=True)
    return rows.select(F.coalesce("id", F.lit("none")).alias("id"), "seq", "user_id", "room_id", "status", "number_of_guests", "reason")


@query
def partial_update(spark, sf):
    base = fx.fixture(spark, sf, fx.USERS)
    return changes.apply_updates(base, fx.fixture(spark, sf, fx.USER_CHANGES), "id", "seq").select(
        "id", "name", "username", "email"
    )


@query
def unique_update(spark, sf):
    kept, refused = changes.without_duplicates(
        fx.fixture(spark, sf, fx.USERS),
        fx.fixture(spark, sf, fx.USERNAME_CHANGES),
        "id",
        "seq",
        {"username not available": ["username"]},
    )
    return kept.withColumn("reason", F.lit("kept")).unionByName(refused)


@query
def soft_delete(spark, sf):
    keys = fx.table(spark, sf, "events").selectExpr("event_id as id")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    done = changes.soft_delete(_bookings(spark, sf), keys, "id", at)
    return done.select("id", "status", F.coalesce(F.col("deleted_at").cast("string"), F.lit("live")).alias("deleted"))


@query
def hard_delete(spark, sf):
    keys = fx.table(spark, sf, "events").selectExpr("event_id as id")
    return changes.hard_delete(_bookings(spark, sf), keys, "id").select("id", "user_id", "room_id")


@query
def existence_check(spark, sf):
    """Bookings whose room number is a room of the catalog."""
    rooms = fx.rooms(spark, sf).select(F.col("id").alias("room_id"))
    return joins.only_existing(_bookings(spark, sf), rooms, ["room_id"]).select("id", "room_id")


# --- limits ------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fixture(spark, sf, fx.REQUESTS)


@query
def rate_limit_flags(spark, sf):
    flagged = limits.flag_limited(_requests(spark, sf), limit=2, period=604_800)
    return flagged.select("event_id", "user_id", "path", "window_start", "limited")


@query
def rate_limit_audit(spark, sf):
    return limits.audit(_requests(spark, sf), limit=2, period=604_800)


@query
def rate_limit_tiers(spark, sf):
    ruled = limits.with_limits(
        _requests(spark, sf), fx.fixture(spark, sf, fx.USERS), fx.tier_limits(spark, sf), limit=5, period=86_400
    )
    return limits.flag_limited(ruled).select("event_id", "tier", "path", "limit", "period", "window_start", "limited")


@query
def time_functions(spark, sf):
    """ISO text of each request, and the range of days its listing covers by default."""
    requests = _requests(spark, sf)
    first, last = around("ts")
    return requests.select(
        "event_id",
        iso_text("ts").alias("iso"),
        first.cast("string").alias("first_day"),
        last.cast("string").alias("last_day"),
    )


@query
def token_list(spark, sf):
    """Tokens of all requests, valid for a week after the user's last one."""
    used = fx.table(spark, sf, "events").select(
        F.concat(F.lit("token"), F.col("user_id").cast("string")).alias("token"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + 604_800).alias("exp"),
    )
    return joins.listed_tokens(used).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query
def blacklist_filter(spark, sf):
    token = "concat('token', cast({} as string)) as token"
    requests = fx.table(spark, sf, "events").selectExpr("event_id", token.format("user_id"))
    listed = fx.fixture(spark, sf, fx.USERS).filter("tier = 'BUILDING'").selectExpr(token.format("id"))
    return joins.without_listed(requests, listed, "token")
