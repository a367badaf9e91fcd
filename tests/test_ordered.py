"""Split operators against brute force, with limits low enough to force every group apart."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from limnos.operators import forecast, paging, quality
from limnos.operators.ordered import forward_fill, mark_first, running_sums, sort_columns
from limnos.operators.quantiles import exact_quantiles
from limnos.plans import fixtures as fx
from limnos.plans.queries import QUERIES


def skewed_rows(n=600, seed=1):
    """One group has half of all rows, and half of those share one time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 2 else rng.choice(["a", "b", None])
        time = dt.datetime(2020, 1, 1) if i % 4 == 1 else dt.datetime(2020, 1, 1) + dt.timedelta(
            seconds=rng.randrange(10**7), microseconds=rng.randrange(10**6)
        )
        rows.append((i, group, None if i % 97 == 0 else time))
    return rows


def first_by_hand(rows, share=None, k=None, desc=False):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    wanted = {}
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is None, (-1 if desc else 1) * (r[2] or dt.datetime(1970, 1, 1)).timestamp(), r[0]))
        take = int(len(members) * share) if share is not None else k
        for rank, row in enumerate(members):
            wanted[row[0]] = rank < take
    return wanted


@pytest.mark.parametrize("hot", [10**6, 40, 3])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_mark_first_share(spark, hot, kind):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id long, g string, t timestamp").withColumn("t", F.col("t").cast(kind))
    got = mark_first(df, ["g"], ["t", "id"], F.floor(F.col("n") * F.lit(0.8)), hot=hot)
    assert {r.id: r.is_first for r in got.collect()} == first_by_hand(rows, share=0.8)
    assert got.columns == ["id", "g", "t", "n", "is_first"]


@pytest.mark.parametrize("k", [0, 1, 7, 10**5])
def test_mark_first_fixed_number(spark, k):
    rows = skewed_rows(seed=2)
    df = spark.createDataFrame(rows, "id long, g string, t timestamp")
    got = {r.id: r.is_first for r in mark_first(df, ["g"], ["t", "id"], k, hot=5).collect()}
    assert got == first_by_hand(rows, k=k)


def test_mark_first_descending(spark):
    rows = skewed_rows(seed=3)
    df = spark.createDataFrame(rows, "id long, g string, t timestamp")
    got = {r.id: r.is_first for r in mark_first(df, ["g"], ["-t", "id"], 20, hot=5).collect()}
    assert got == first_by_hand(rows, k=20, desc=True)


def test_mark_first_on_large_numbers(spark):
    ids = [2**61 + i for i in range(50)] + [-(2**61) + i for i in range(50)]
    df = spark.createDataFrame([(1, i) for i in ids], "g int, id long")
    got = {r.id: r.is_first for r in mark_first(df, ["g"], ["id"], 60, hot=4).collect()}
    assert got == {i: rank < 60 for rank, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("split", [False, True])
def test_running_sums(spark, split):
    rng = random.Random(5)
    base = dt.datetime(2020, 2, 28, 23, 59, 58)
    rows = [
        (rng.choice("ab"), base + dt.timedelta(microseconds=rng.randrange(4 * 10**6)), 1, rng.randrange(3))
        for _ in range(300)
    ] + [("a", base, 5, 5)] * 40
    df = spark.createDataFrame(rows, "g string, t timestamp, x int, y int")
    got = running_sums(df, ["g"], "t", ["x", "y"], split)
    for r in got.collect():
        assert r.cum_x == sum(x for g, t, x, _ in rows if g == r.g and t <= r.t)
        assert r.cum_y == sum(y for g, t, _, y in rows if g == r.g and t <= r.t)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("bucket", [7, 1000])
def test_forward_fill(spark, by, bucket):
    rng = random.Random(9)
    rows = [
        (f"f{i // 120}", i, rng.choice("ab"), None if rng.random() < 0.8 else f"v{i}", None if i < 50 else float(i % 9 or 0))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "f string, line long, g string, s string, x double")
    got = forward_fill(df, ["s", "x"], ["f", "line"], by=by, bucket=bucket)
    assert got.columns == df.columns
    last = {}
    want = {}
    for f, line, g, s, x in sorted(rows, key=lambda r: (r[0], r[1])):
        key = g if by else None
        old = last.get(key, (None, None))
        last[key] = (s if s is not None else old[0], x if x is not None else old[1])
        want[line] = last[key]
    if not by:
        assert {r.line: (r.s, r.x) for r in got.collect()} == want
    else:
        # Files are filled through in order for each group as well.
        assert {r.line: (r.s, r.x) for r in got.collect()} == want


@pytest.mark.parametrize("n,history", [(1, 0), (4, 3), (5, 4), (10, 8)])
def test_split_sizes(spark, n, history):
    rows = [(i, "1.0", dt.datetime(2020, 1, 1 + i)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, place string, time timestamp")
    status = forecast.split_status(forecast.chrono_split(df)).first()
    assert (status.n_history, status.n_predict) == (history, n - history)
    assert status.status == ("ok" if history else "insufficient data")


def test_first_rows(spark):
    rows = [(i, "1.0", dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, place string, time timestamp")
    assert sorted(r.id for r in forecast.first_rows(df, 10).collect()) == list(range(10))


KEYS = {
    "string": ["b", "", "a", None, "aa", "B", "é", "z"],
    "double": [1.5, float("inf"), float("-inf"), float("nan"), None, -0.5, 1e300],
    "decimal(20,2)": [Decimal("1.50"), Decimal("-7.25"), None, Decimal("99999999999.99")],
    "date": [dt.date(2020, 1, 1), dt.date(1900, 5, 5), None, dt.date(2199, 1, 1)],
    "boolean": [True, False, None],
    "binary": [b"x", b"", None, b"\xff"],
}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", list(KEYS))
def test_ranking_means_the_same_at_every_size(spark, kind, descending):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 else "cold", rng.choice(KEYS[kind])) for i in range(90)]
    df = spark.createDataFrame(rows, f"id int, g string, k {kind}")
    order = ["-k" if descending else "k", "id"]
    results = []
    for hot in (10**6, 40, 5):
        marked = mark_first(df, ["g"], order, F.floor(F.col("n") * 0.5), kth="last", hot=hot)
        results.append({(r.id, r.n, r.is_first, r["last"]) for r in marked.collect()})
    assert results[0] == results[1] == results[2]
    shallow = [[r.id for r in paging.page(df, order, number, 20).collect()] for number in range(1, 6)]
    deep = [[r.id for r in paging.page(df, order, number, 20, shallow=0).collect()] for number in range(1, 6)]
    walked = [[r.id for r in page.orderBy(*sort_columns(order)).collect()] for page in paging.keyset_walk(df, order, 20)]
    assert shallow == deep == walked
    assert sum(map(len, walked)) == 90


@pytest.mark.parametrize("order", [["k", "id"], ["-k", "-id"]])
def test_numbered_pages_are_those_of_the_walk(spark, order):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else i * 7 % 5) for i in range(53)], "id long, k int").repartition(3)
    walked = {(r.id, number) for number, page in enumerate(paging.keyset_walk(df, order, 10)) for r in page.collect()}
    assert {(r.id, r.page) for r in paging.numbered(df, order, 10).collect()} == walked
    assert len(walked) == 53 and paging.numbered(df.limit(0), order, 10).count() == 0


@pytest.mark.parametrize("hot", [10**6, 5])
def test_quantiles_of_unbounded_values(spark, hot):
    values = [float("-inf"), 1.0, 2.0, 3.0, 4.0, float("inf"), float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values] * 5, "x double")
    got = quality.profile(df, ["x"], hot=hot).first()
    assert (got.n, got.n_distinct, got.min) == (40, 7, float("-inf"))
    assert (got.p25, got.p50, got.p75) == (1.75, 3.5, float("inf"))


def test_forecast_skips_stations_without_history(spark):
    rows = [(0, "1.0", dt.datetime(2020, 1, 1))] + [(i, "2.0", dt.datetime(2020, 1, i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id long, place string, time timestamp")
    got = forecast.forecast(df, F.lit(5.0)).collect()
    assert sorted(r.id for r in got) == [9, 10]


def test_scorers_honour_the_share(spark):
    rows = [(i, "1.0", dt.datetime(2020, 1, 1 + i), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, place string, time timestamp, wqi double")
    for scorer in (F.lit(1.0), forecast.mean_scorer("wqi"), forecast.trend_scorer("wqi")):
        assert forecast.forecast(df, scorer, share=0.25).count() == 0
        assert forecast.forecast(df, scorer, share=0.34).count() == 2


def test_tail_keeps_all_rows_and_has_stations_without_history(spark, tmp_path):
    """The fixture loses no order, and stations of one to three rows give no score."""
    orders = [(i, i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(1, 41)]
    fields = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
    spark.createDataFrame(orders, fields).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = Counter(r.place for r in fx.fixture(spark, str(tmp_path), fx.OBS_TAIL).collect())
    assert sizes == {"1.0": 20, "2.0": 10, "4.0": 5, "8.0": 3, "16.0": 1, "32.0": 1}
    scored = QUERIES["forecast_mean_share_all"](spark, str(tmp_path)).collect()
    assert Counter(r.place for r in scored) == {"1.0": 15, "2.0": 8, "4.0": 4}


def test_trend_predicts_a_line_exactly(spark):
    rows = [(i, "1.0", dt.datetime(2020, 1, 1 + i), 10.0 + 2 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, place string, time timestamp, wqi double")
    got = {r.id: r.predicted_wqi for r in forecast.forecast(df, forecast.trend_scorer("wqi")).collect()}
    assert got == pytest.approx({8: 26.0, 9: 28.0})


def test_feature_vector_missing_is_zero(spark):
    df = spark.createDataFrame([("24.0", 7.5, None)], "place string, ph double, cod double")
    assert df.select(forecast.feature_vector(["place", "ph", "cod"])).first()[0] == [24.0, 7.5, 0.0]


@pytest.mark.parametrize("shallow", [10**6, 0])
def test_pages_tile_the_order(spark, shallow):
    rows = [(i, dt.date(2020, 1, 1 + i * 7 % 5)) for i in range(53)]
    df = spark.createDataFrame(rows, "id long, d date").repartition(3)
    seen = []
    for number in range(1, 8):
        seen += [r.id for r in paging.page(df, ["-d", "id"], number, 10, shallow=shallow).collect()]
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (-r[1].toordinal(), r[0]))]


def test_keyset_pages_tile_the_order(spark):
    rows = [(i, i * 7 % 5) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, k int")
    after, seen = None, []
    while True:
        got = paging.keyset_page(df, ["-k", "id"], after, 4).collect()
        if not got:
            break
        seen += [r.id for r in got]
        after = [got[-1].k, got[-1].id]
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_page_header(spark):
    df = spark.range(25)
    assert paging.page_header(df, 2, 10).first() == (25, True, 2, 10)
    assert paging.page_header(df, 3, 10).first() == (25, False, 3, 10)
    assert paging.page_header(df.limit(0), 1, 10).first() == (0, False, 1, 10)


@pytest.mark.parametrize("hot", [10**6, 5])
def test_exact_quantiles(spark, hot):
    import numpy as np

    rng = random.Random(4)
    values = {"m": [rng.gauss(0, 1) for _ in range(101)], "k": [1.0] * 60 + [2.0, 5.0]}
    rows = [(m, v, vs.count(v)) for m, vs in values.items() for v in sorted(set(vs))]
    counts = spark.createDataFrame(rows, "metric string, value double, c long")
    got = exact_quantiles(counts, {"p25": 0.25, "p50": 0.5, "p90": 0.9}, hot=hot)
    for r in got.collect():
        want = np.quantile(values[r.metric], [0.25, 0.5, 0.9])
        assert [r.p25, r.p50, r.p90] == pytest.approx(list(want))


def test_profile(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, None)], "a double, b double")
    got = {r.metric: r for r in quality.profile(df, ["a", "b"]).collect()}
    assert (got["a"].n, got["a"].n_distinct, got["a"].p50, got["a"].max) == (3, 3, 2.0, 4.0)
    assert (got["b"].n, got["b"].n_distinct, got["b"].std) == (2, 1, 0.0)
    rough = {r.metric: r for r in quality.profile(df, ["a", "b"], approximate=True).collect()}
    assert rough["a"].p50 == 2.0 and rough["b"].n_distinct == 1
