"""Search by bitmaps against the plain search, and merged profiles against whole ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from limnos.operators import bitmaps, catalog, sketches
from limnos.session import new_path, settle

ROOM = "id long, name string, price double, feature_ids array<int>, badge_ids array<int>, is_deleted boolean"
BANDS = [10.0, 20.0, 30.0]


@pytest.fixture(scope="module")
def rooms(spark):
    rng = random.Random(3)
    some = lambda n: None if rng.random() < 0.1 else [rng.choice([*range(1, n), None]) for _ in range(rng.randrange(4))]
    rows = [
        (1 + k * 701, f"r{k}", None if rng.random() < 0.1 else float(rng.randrange(0, 41)), some(5), some(4), rng.choice([None, False, False, True]))
        for k in range(300)
    ]
    return settle(spark.createDataFrame(rows, ROOM), "rooms")


@pytest.mark.parametrize(
    "asked",
    [{}, {"features": [1]}, {"features": [1, 2], "badges": [3]}, {"min_price": 10}, {"max_price": 29.5, "features": [2]}, {"min_price": 12, "max_price": 17},
     {"min_price": 10, "max_price": 30}, {"min_price": 35}, {"max_price": 3}, {"min_price": 50}, {"min_price": 20, "max_price": 20}, {"min_price": 30, "max_price": 5},
     {"badges": [99]}],
)
def test_bitmaps_find_what_the_search_finds(rooms, asked):
    index = settle(bitmaps.room_index(rooms, BANDS), "room-index")
    found = bitmaps.matching(index, rooms, BANDS, **asked)
    want = sorted(r.id for r in catalog.search_rooms(rooms, **asked).collect())
    assert bitmaps.total(found).first().total_count == len(want)
    assert sorted(r.id for r in bitmaps.ids(found).collect()) == want
    got = bitmaps.page(found, rooms, 2, 10).collect()
    assert [r.id for r in got] == want[10:20] and {r.total_count for r in got} <= {len(want)}


def test_a_page_reads_its_rooms_only(rooms):
    index = settle(bitmaps.room_index(rooms, BANDS), "room-index")
    text = bitmaps.page(bitmaps.matching(index, rooms, BANDS, features=[1]), rooms, 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in text


def test_profiles_of_loads_add_up(spark):
    """Three loads, one of them done twice, merged; moments exactly, quantiles and distinct numbers within their errors."""
    rows = settle(spark.range(30_000).select("id", (F.col("id") % 997 * 1.5).alias("a"), F.expr("if(id % 3 = 0, null, id * id)").cast("double").alias("b"),
                                             F.expr("if(id % 2 = 0, double('NaN'), -0.0)").alias("c"), F.lit(None).cast("double").alias("d")), "profiled")
    target, cols = new_path(spark, "profiles"), ["a", "b", "c", "d"]
    for load in (0, 1, 2, 1):
        sketches.store(sketches.summary(rows.filter(F.col("id") % 3 == load), cols), target, str(load))
    got = {r.metric: r for r in sketches.told(sketches.merge(sketches.stored(spark, target).drop("load"))).collect()}
    for c in ("a", "b"):
        values = sorted(r[0] for r in rows.select(c).dropna().collect())
        n, row = len(values), got[c]
        mean = sum(values) / n
        assert (row.n, row.n_null, row.min, row.max) == (n, 30_000 - n, values[0], values[-1])
        assert row["mean"] == pytest.approx(mean) and row["std"] == pytest.approx((sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5)
        for name, rank in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            at = [k for k, v in enumerate(values) if v == row[name]]
            assert (at[0] / n) - sketches.RANK_ERROR <= rank <= (at[-1] + 1) / n + sketches.RANK_ERROR
        assert abs(row.n_distinct - len(set(values))) <= sketches.DISTINCT_ERROR * len(set(values)) + 1
    assert (got["c"].n, got["c"].n_nan, got["c"].n_distinct, got["c"].p50) == (15_000, 15_000, 1, 0.0)
    assert (got["d"].n, got["d"].n_null, got["d"]["mean"], got["d"].p50) == (0, 30_000, None, None)


def test_text_profiles_of_loads_add_up(spark):
    rows = [(k, None if k % 5 == 0 else f"v{k % 7 * (k % 3)}") for k in range(900)]
    df = spark.createDataFrame(rows, "id int, x string")
    parts = [sketches.text_summary(df.filter(F.col("id") % 3 == load), ["x"]) for load in range(3)]
    row = sketches.told_text(sketches.merge_text(parts[0].unionByName(parts[1]).unionByName(parts[2])), top=4).first()
    counts = Counter(x for _, x in rows if x is not None)
    assert (row.n, row.n_null, row.n_distinct) == (720, 180, len(counts))
    assert [(t.value, t.c) for t in row.top] == sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:4]
