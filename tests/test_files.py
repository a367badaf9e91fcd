"""CSV files whose values hold line breaks, read in ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from limnos.schemas import RAW
from limnos.session import new_path
from limnos.sources import files

NAMES = [f.name for f in RAW.fields]


def written(folder, name, rows, end="\n"):
    """All values quoted, quotes doubled."""
    lines = [",".join('"' + (v or "").replace('"', '""') + '"' if v is not None else "" for v in row) for row in [NAMES, *rows]]
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as file:
        file.write(end.join(lines) + end)


def odd_rows(n, seed):
    rng = random.Random(seed)
    values = ["10,1 \n106,2", "a,b", 'say "x"', "\n\n", "é 漢", None, "plain", " blank ", '"', "x\n", "1,5"]
    return [tuple(f"{k}" if i == 0 else rng.choice(values) for i in range(len(NAMES))) for k in range(n)]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranges_give_the_rows_of_one_task(spark, tmp_path, small_ranges):
    folder = str(tmp_path / "csv")
    written(folder, "a.csv", odd_rows(400, 1))
    written(folder, "b.csv", odd_rows(3, 2))
    written(folder, "only-header.csv", [])
    name = F.regexp_extract("_metadata.file_path", "([^/]+)$", 1)
    split = files.read_raw(spark, folder, name=name)
    one = files.read_raw(spark, folder, name=name, split=False)
    assert split.columns == one.columns
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    want = sorted(map(tuple, one.collect()), key=key)
    assert sorted(map(tuple, split.collect()), key=key) == want
    assert len(want) == 403 and {(r[-2], r[-1]) for r in want} == {("a.csv", k) for k in range(400)} | {("b.csv", k) for k in range(3)}
    lines = spark.read.option("lineSep", "\n").text(f"{folder}/a.csv")
    assert lines.rdd.getNumPartitions() >= 4


def test_line_ends_and_empty_lines(spark, tmp_path):
    folder = str(tmp_path / "csv")
    written(folder, "a.csv", [tuple(f"{k}" for _ in NAMES) for k in range(3)], end="\r\n")
    with open(f"{folder}/a.csv", "a", newline="") as file:
        file.write("\r\n\r\n" + ",".join(["4"] * len(NAMES)))
    got = files.read_raw(spark, folder)
    assert sorted((r.place, r.src_line) for r in got.collect()) == [("0", 0), ("1", 1), ("2", 2), ("4", 3)]
    assert files.read_raw(spark, folder, split=False).count() == 4


def test_no_files(spark):
    path = new_path(spark, "empty-csv")
    files.write_raw(spark.createDataFrame([], RAW), path)
    assert files.read_raw(spark, path).count() == 0
