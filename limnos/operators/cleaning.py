"""Cleaning of raw observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.text import (
    COORDINATE_PATTERN,
    DATE_FORMAT_READ,
    clean_coordinate,
    compute_once,
    natural_id,
    parse_day,
    parse_decimal,
    station_key,
)
from limnos.schemas import METRICS, OTHER_NUMBERS, SOURCE_COLUMNS

# Tokens for "below the detection limit" and what they count as.
BELOW_DETECTION = {"KPH": "0"}
BELOW_DETECTION_BACTERIA = {"KPH": "0", "< 1": "0", "<1": "0"}
BACTERIA = "aeromonas_total"
# Columns whose below-detection tokens are replaced, bacteria aside.
DETECTION_COLUMNS = [
    "h2s",
    "ph",
    "do_",
    "conductivity",
    "n_no2",
    "n_nh4",
    "p_po4",
    "tss",
    "cod",
    "coliform",
]


def rename_source(raw: DataFrame) -> DataFrame:
    """Source headers to unified column names; other columns are kept."""
    return raw.withColumnsRenamed({old: new for old, new in SOURCE_COLUMNS.items() if old in raw.columns})


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in every one of ``cols`` (NaN counts as missing)."""
    return df.dropna(subset=list(cols))


def replace_tokens(df: DataFrame, tokens: Mapping[str, str], cols: Sequence[str]) -> DataFrame:
    """Whole values only: a substring rule would turn ``<10`` into ``00``."""
    return df.replace(dict(tokens), subset=list(cols))


def parse_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return compute_once(df, {c: parse_decimal(c) for c in cols})


def parse_date(df: DataFrame, col: str, fmt: str = DATE_FORMAT_READ) -> DataFrame:
    """Adds ``date``, ``year``, ``month``, ``day``; all null for a bad date."""
    dated = df.withColumn("date", parse_day(col, fmt))
    return dated.withColumns(
        {"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date")}
    )


def parse_coordinates(df: DataFrame, col: str) -> DataFrame:
    """Keeps well-formed ``lat lon`` pairs and adds ``latitude`` and ``longitude``."""
    good = compute_once(df, {col: clean_coordinate(col)}).filter(F.col(col).rlike(COORDINATE_PATTERN))
    pair = F.split(col, " ")
    return good.withColumns({"latitude": parse_decimal(pair[0]), "longitude": parse_decimal(pair[1])})


def clean(raw: DataFrame) -> DataFrame:
    """All cleaning steps over unified raw columns, one narrow pass without a shuffle.

    A bacteria count that is no number becomes null and its row is dropped; a bad date keeps
    its row with a null time.
    """
    numbers = [*METRICS, "wqi", *[c for c in OTHER_NUMBERS if c in raw.columns]]
    df = parse_coordinates(require(raw, METRICS), "coord")
    df = replace_tokens(df, BELOW_DETECTION, [c for c in DETECTION_COLUMNS if c in raw.columns])
    df = replace_tokens(df, BELOW_DETECTION_BACTERIA, [BACTERIA])
    df = parse_numbers(df, numbers)
    return parse_date(require(df, [*METRICS, "wqi"]), "obs_date")


def to_observations(clean_rows: DataFrame, order: Sequence[str] = ("src_file", "src_line")) -> DataFrame:
    """Cleaned rows as observations of the warehouse table, known by station and time as those of the stream are
    (:func:`limnos.streaming.jobs.warehouse_stream`): one loaded both ways is one row.

    Rows without a date or a station name no observation and are left out, as their messages are. Of rows of one station and time the last in ``order`` counts, as the last message does. Where a file holds several observations of a station on one day,
    which a date does not tell apart, use :func:`to_warehouse`, which knows rows by their place in the file, and keep its table apart.
    """
    placed = clean_rows.filter("date is not null and place is not null").select(
        F.col("date").cast("timestamp").alias("time"),
        station_key("place").alias("place"),
        F.struct(*[c for c in order if c in clean_rows.columns]).alias("_order"),
        F.struct("location", *METRICS, F.col("wqi").alias("actual_wqi"), F.col("wqi").alias("predicted_wqi")).alias("_row"),
    )
    last = placed.groupBy("time", "place").agg(F.max_by("_row", "_order").alias("_row"))
    return last.select(natural_id("time", "place").alias("id"), "time", "place", "_row.*")


def to_warehouse(clean_rows: DataFrame) -> DataFrame:
    """Cleaned rows in the shape of the warehouse table; the prediction starts as the measured index.

    A row is known by its file, if there is one, and its place there. Its id is not that of the same observation on the stream; see :func:`to_observations`.
    """
    source = [c for c in ("src_file", "src_line") if c in clean_rows.columns]
    return clean_rows.select(
        natural_id("date", station_key("place"), *source).alias("id"),
        F.col("date").cast("timestamp").alias("time"),
        station_key("place").alias("place"),
        "location",
        *METRICS,
        F.col("wqi").alias("actual_wqi"),
        F.col("wqi").alias("predicted_wqi"),
    )
