"""Table shapes and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Headers of the raw observation file and the unified column each one feeds.
SOURCE_COLUMNS = {
    "Ngày quan trắc": "obs_date",
    "Place": "place",
    "Điểm Quan Trắc": "location",
    "Tọa độ": "coord",
    "Nhiệt độ": "temperature",
    "pH": "ph",
    "DO": "do_",
    "Độ dẫn": "conductivity",
    "Độ kiềm": "alkalinity",
    "N-NO2": "n_no2",
    "N-NH4": "n_nh4",
    "P-PO4": "p_po4",
    "TSS": "tss",
    "COD": "cod",
    "H2S": "h2s",
    "Aeromonas tổng số": "aeromonas_total",
    "Coliform": "coliform",
    "WQI": "wqi",
}

# The nine metrics of an observation, in feature-vector order.
METRICS = [
    "ph",
    "do_",
    "conductivity",
    "n_no2",
    "n_nh4",
    "p_po4",
    "tss",
    "cod",
    "aeromonas_total",
]

# Topic of each metric.
METRIC_TOPICS = {
    "ph": "ph_topic",
    "do_": "do_topic",
    "conductivity": "conductivity_topic",
    "n_no2": "n_no2_topic",
    "n_nh4": "n_nh4_topic",
    "p_po4": "p_po4_topic",
    "tss": "tss_topic",
    "cod": "cod_topic",
    "aeromonas_total": "aeromonas_total_topic",
}

# Columns with decimal commas, besides the nine metrics.
OTHER_NUMBERS = ["temperature", "alkalinity", "h2s", "coliform"]

# Every value arrives as text: inference would hide the dirt and cost a second pass.
RAW = T.StructType([T.StructField(name, T.StringType()) for name in SOURCE_COLUMNS])

READING = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)

WATER_QUALITY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("time", T.TimestampType()),
        T.StructField("place", T.StringType()),
        T.StructField("location", T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("actual_wqi", T.DoubleType()),
        T.StructField("predicted_wqi", T.DoubleType()),
    ]
)

DIMENSION = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
    ]
)

ROOM = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("image_2d", T.StringType()),
        T.StructField("image_3d", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("from_date", T.TimestampType()),
        T.StructField("to_date", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("feature_ids", T.ArrayType(T.IntegerType())),
        T.StructField("badge_ids", T.ArrayType(T.IntegerType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)

BOOKING = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType()),
        T.StructField("room_id", T.LongType()),
        T.StructField("check_in", T.TimestampType()),
        T.StructField("check_out", T.TimestampType()),
        T.StructField("guest_name", T.StringType()),
        T.StructField("guest_email", T.StringType()),
        T.StructField("number_of_guests", T.IntegerType()),
        T.StructField("total_price", T.DoubleType()),
        T.StructField("guest_contact_number", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)
