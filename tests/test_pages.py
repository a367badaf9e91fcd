"""Pages through a directory against slices of the sorted rows."""

import datetime as dt
import random

import pytest

from limnos.session import new_path
from limnos.sources import pages

SHAPE = "id long, time timestamp, name string"


def some_rows(n, seed, first):
    rng = random.Random(seed)
    return [
        (first + k, dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(200)) if rng.random() > 0.1 else None, rng.choice(["a", "é", None, "zz"]))
        for k in range(n)
    ]


def sliced(rows, order):
    for name in reversed(order):
        i = {"id": 0, "time": 1, "name": 2}[name.removeprefix("-")]
        if name.startswith("-"):
            rows = sorted(rows, key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0 if i == 0 else dt.datetime.min if i == 1 else ""), reverse=True)
        else:
            rows = sorted(rows, key=lambda r: (r[i] is None, r[i] if r[i] is not None else 0 if i == 0 else dt.datetime.min if i == 1 else ""))
    return rows


@pytest.mark.parametrize("order", [["time", "id"], ["-time", "name", "-id"]])
@pytest.mark.parametrize("loads", [[157], [90, 0, 61, 40]])
def test_pages_are_slices(spark, order, loads):
    target, rows = new_path(spark, "paged"), []
    for k, n in enumerate(loads):
        part = some_rows(n, k, 1000 * k)
        pages.append(spark.createDataFrame(part, SHAPE).repartition(3), target, order, step=7)
        rows += part
    want = sliced(rows, order)
    assert pages.count(spark, target) == len(want)
    assert sorted(map(tuple, pages.read(spark, target).collect()), key=str) == sorted(rows, key=str)
    for number in (1, 2, 5, len(rows) // 10, len(rows) // 10 + 1, len(rows) // 10 + 2):
        got = [tuple(r) for r in pages.page(spark, target, order, number, 10).collect()]
        assert got == want[(number - 1) * 10 : number * 10], number


def test_a_deep_page_reads_a_bounded_range(spark):
    target = new_path(spark, "paged")
    pages.append(spark.range(5000).selectExpr("id"), target, ["id"], step=100)
    found = pages.page(spark, target, ["id"], 401, 10)
    assert [r.id for r in found.collect()] == list(range(4000, 4010))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in text and "LessThanOrEqual(id" in text
