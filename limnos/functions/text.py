"""Column functions for dirty text: numbers, dates, station keys, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text forms.
DATE_FORMAT = "dd/MM/yyyy"
# The form that is read: a leading zero may be missing.
DATE_FORMAT_READ = "d/M/yyyy"
NOT_NUMBER_PATTERN = r"[^0-9eE+., -]"
COORDINATE_PATTERN = r"^\d{1,2},\d+\s\d{1,3},\d+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns behind a generator of one row.

    A filter on a plain projected column is pushed below it with a second copy of its expression; it cannot
    pass a generator, so costly parsing in front of a filter runs once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def parse_decimal(c: Column | str) -> Column:
    """Decimal comma or point to double; anything else is null.

    The pattern keeps out what the cast alone would let through: ``NaN``, ``Infinity``, ``1d``.
    """
    c = _col(c)
    return F.when(~c.rlike(NOT_NUMBER_PATTERN), F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))


def parse_day(c: Column | str, fmt: str = DATE_FORMAT_READ) -> Column:
    """Text to date; null where it is not a date in ``fmt``."""
    return F.try_to_date(_col(c), fmt)


def station_key(c: Column | str) -> Column:
    """Station number as stored: 24 -> ``"24.0"``."""
    return _col(c).try_cast("double").cast("string")


def station_number(c: Column | str) -> Column:
    """``"24.0"`` -> 24."""
    return _col(c).try_cast("double").cast("int")


def clean_coordinate(c: Column | str) -> Column:
    """Blanks out first, then line breaks to single blanks, white space off both ends."""
    spaced = F.replace(F.replace(_col(c), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.btrim(spaced, F.lit(" \t\r\f\v"))


def sanitize_path(c: Column | str) -> Column:
    """``/api/v1/users/`` -> ``api_v1_users``."""
    return F.replace(F.btrim(_col(c), F.lit("/")), F.lit("/"), F.lit("_"))


def iso_text(c: Column | str) -> Column:
    """Timestamp as ISO text."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def natural_id(*cols: Column | str) -> Column:
    """A 128-bit id of the natural key: the same row gets the same id when a load is replayed.

    Every part goes in with its length, and a null as a mark of its own, so keys that differ anywhere differ in
    what is hashed.
    """
    parts = [_col(c).cast("string") for c in cols]
    told = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.md5(F.concat(*told))


def epoch_time(c: Column | str) -> Column:
    """Epoch seconds to a timestamp."""
    return F.timestamp_seconds(_col(c))


def around(day: Column | str, days: int = 30) -> tuple[Column, Column]:
    """The default range of a listing: ``days`` days to either side of ``day``."""
    day = _col(day)
    return F.date_sub(day, days), F.date_add(day, days)
