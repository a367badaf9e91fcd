"""Raw observation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.cleaning import rename_source
from limnos.schemas import RAW
from limnos.session import settle


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = RAW,
    order_cols: tuple[str, str] = ("src_file", "src_line"),
    name: Column | None = None,
    split: bool = True,
) -> DataFrame:
    """Observation CSV with unified column names, plus file name and the row's place in its file (from 0).

    Coordinates hold line breaks, so a line is not a row. With ``split`` a file is read in byte ranges by many tasks all the same, see
    :func:`records`; quotes must then stand around whole values only, doubled inside them. Without it one file is one task, and a quote inside an unquoted value is
    read as it is. Rows are written to the shared folder once; a place counts from the first row of its file, so it does not depend on which files are loaded
    together. ``name`` tells a file's name from its path (``_metadata.file_path``); the path itself by default.
    """
    if split:
        return _read_split(spark, path, schema, order_cols, name)
    file_col, line_col = order_cols
    path_of = F.col("_metadata.file_path")
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
        .withColumns({file_col: path_of if name is None else name, "_path": path_of, "_at": F.monotonically_increasing_id()})
    )
    rows = settle(raw, "raw")
    # One row per file.
    first = rows.groupBy("_path").agg(F.min("_at").alias("_first"))
    placed = rows.join(settle(first, "files"), "_path").withColumn(line_col, F.col("_at") - F.col("_first"))
    return rename_source(placed.drop("_path", "_at", "_first"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``number`` (from 0) and ``text`` of the records of CSV files whose quoted values may hold line breaks.

    Lines are read in byte ranges. A line lies inside a quoted value if the quotes before it are odd in number: those of the ranges before its own
    are summed over one row for each range, those before it in its range by a window over that range. Lines that do not are the starts of
    records, which are counted in the same way. No task sees more than a range or a record. Empty lines between records are no records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value"),
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes"),
    )
    lines = settle(lines, "csv-lines")
    ranges = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    sums = lines.groupBy("path", "block").agg(F.sum("quotes").alias("_in_range"))
    before = settle(sums.select("path", "block", F.coalesce(F.sum("_in_range").over(ranges), F.lit(0)).alias("_before")), "csv-quotes")
    quoted = (F.col("_before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2 == 1
    told = lines.join(before, ["path", "block"]).withColumn("_quoted", quoted).drop("_before", "quotes")
    bare = F.btrim("value", F.lit(" \t\r")) == ""
    told = settle(told.filter(F.col("_quoted") | ~bare).withColumn("_starts", F.when(F.col("_quoted"), 0).otherwise(1)), "csv-starts")
    counts = told.groupBy("path", "block").agg(F.sum("_starts").alias("_in_range"))
    earlier = settle(counts.select("path", "block", F.coalesce(F.sum("_in_range").over(ranges), F.lit(0)).alias("_before")), "csv-counts")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("_before") + F.sum("_starts").over(upto) - 1
    numbered = told.join(earlier, ["path", "block"]).select("path", number.alias("number"), "at", "value")
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    return numbered.groupBy("path", "number").agg(F.rtrim(F.array_join(F.transform(parts, lambda p: p["value"]), "\n"), F.lit("\r")).alias("text"))


def _read_split(
    spark: SparkSession, path: str | list[str], schema: T.StructType, order_cols: tuple[str, str], name: Column | None
) -> DataFrame:
    file_col, line_col = order_cols
    # The first record of a file is its header.
    rows = records(spark, path).filter("number > 0")
    parsed = F.from_csv("text", F.lit(schema.toDDL()), {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    if name is None:
        named = F.col("path")
    else:
        # ``name`` reads the metadata of a scan; here the path is a column.
        rows = rows.withColumn("_metadata", F.struct(F.col("path").alias("file_path")))
        named = name
    placed = rows.select(parsed.alias("row"), named.alias(file_col), (F.col("number") - 1).cast("long").alias(line_col))
    return rename_source(settle(placed.select("row.*", file_col, line_col), "raw"))


def write_raw(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Observation rows as CSV with a header, all values quoted; a folder per value of ``by``."""
    df.write.partitionBy(*by).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
