"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``queries`` has the median seconds of warm runs into the noop sink. ``pairs`` sets a naive form (row function, chained
joins, one-partition window, deep offset, lookup per row, one task) against ours; both sides are medians of the same number of runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions import wqi as index
from limnos.operators import catalog, cleaning, paging
from limnos.operators.ordered import forward_fill
from limnos.plans import fixtures as fx
from limnos.plans.queries import QUERIES
from limnos.schemas import METRICS
from limnos.session import local_session, new_path, settle
from limnos.sources import pages, seed

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "wqi_scalar",
    "wqi_by_station",
    "ingest_observations",
    "ffill_per_station",
    "publish_decode_roundtrip",
    "correlate_pivot",
    "station_list",
    "station_page",
    "keyset_page",
    "deep_page",
    "chrono_split",
    "chrono_split_hot",
    "forecast_index",
    "forecast_trend",
    "room_search",
    "room_enriched",
    "booking_conflicts",
    "booking_admission",
    "booking_cancel",
    "insert_unique",
    "partial_update",
    "rate_limit_flags",
    "profile",
    "stream_correlate_wqi",
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(run, runs: int = RUNS) -> float:
    run()
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def row_index(*values):
    """The index one row at a time, as a Python function."""
    row = dict(zip(METRICS, values, strict=True))
    product = 1.0
    for metric, weight in index.WEIGHTS.items():
        score = 1.0
        for upper, closed, slope, offset in index.BANDS[metric]:
            if row[metric] < upper or (closed and row[metric] == upper):
                score = slope * row[metric] + offset
                break
        if score < 0:
            return None
        product *= round(score**weight, 8)
    return round(product, 4)


def room_page(spark):
    """A page of ten rooms with features and badges: two lookups per room, or in the page's own plan."""
    rooms = fx.rooms(spark, SF_DIR)
    features = settle(seed.dimension(spark, seed.FEATURES), "features")
    badges = settle(seed.dimension(spark, seed.BADGES), "badges")

    def lookups():
        for room in paging.page(rooms, ["id"]).collect():
            features.filter(F.col("id").isin(room.feature_ids)).collect()
            badges.filter(F.col("id").isin(room.badge_ids)).collect()

    def one_plan():
        page = catalog.enrich(paging.page(rooms, ["id"]), "feature_ids", features, "features")
        drain(catalog.enrich(page, "badge_ids", badges, "badges"))

    return lookups, one_plan


def pairs(spark) -> dict[str, dict[str, float]]:
    wide = new_path(spark, "bench-raw")
    fx.fixture(spark, SF_DIR, fx.RAW_WIDE).repartition(int(CPUS)).write.parquet(wide)
    raw = spark.read.parquet(wide)

    renamed = {"l_orderkey * 10 + l_linenumber": "o_orderkey", "l_suppkey": "o_custkey", "l_shipdate": "o_orderdate"}
    bulk = fx.table(spark, SF_DIR, "lineitem").selectExpr(*[f"{old} as {new}" for old, new in renamed.items()])
    path = new_path(spark, "bench-obs")
    bulk.selectExpr(*fx.OBS[1]).repartition(int(CPUS)).write.parquet(path)
    obs = spark.read.parquet(path)
    count = obs.count()
    slow_index = F.udf(row_index, "double")

    one_window = Window.orderBy("src_line").rowsBetween(Window.unboundedPreceding, 0)
    fill = ["ph", "aeromonas_total"]
    key = obs.orderBy("time", "id").offset(count * 9 // 10 - 1).limit(1).select("time", "id").first()
    ordered = new_path(spark, "bench-paged")
    pages.append(obs, ordered, ["time", "id"])

    def pair(naive, ours) -> dict[str, float]:
        return {"naive": seconds(naive), "ours": seconds(ours)}

    return {
        "index": pair(
            lambda: drain(obs.select(slow_index(*METRICS))), lambda: drain(obs.select(index.wqi()))
        ),
        "correlate": pair(
            lambda: drain(QUERIES["correlate_join_chain"](spark, SF_DIR)),
            lambda: drain(QUERIES["correlate_pivot"](spark, SF_DIR)),
        ),
        "room_page": pair(*room_page(spark)),
        "forward_fill": pair(
            lambda: drain(raw.withColumns({c: F.last(c, ignorenulls=True).over(one_window) for c in fill})),
            lambda: drain(forward_fill(raw, fill, ["src_line"], bucket=20_000)),
        ),
        "deep_page": pair(
            lambda: drain(obs.orderBy("time", "id").offset(count * 9 // 10).limit(10)),
            lambda: drain(paging.keyset_page(obs, ["time", "id"], list(key), 10)),
        ),
        "page": pair(
            lambda: drain(obs.orderBy("time", "id").offset(count * 9 // 10).limit(10)),
            lambda: drain(paging.page(obs, ["time", "id"], count * 9 // 100 + 1, 10, shallow=0)),
        ),
        "page_directory": pair(
            lambda: drain(obs.orderBy("time", "id").offset(count * 9 // 10).limit(10)),
            lambda: drain(pages.page(spark, ordered, ["time", "id"], count * 9 // 100 + 1, 10)),
        ),
        "ingest": pair(
            lambda: drain(cleaning.to_warehouse(cleaning.clean(raw.coalesce(1)))),
            lambda: drain(cleaning.to_warehouse(cleaning.clean(raw))),
        ),
    }


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS), app="limnos-bench")
    spark.sparkContext.setLogLevel("ERROR")
    timed = {name: seconds(lambda q=QUERIES[name]: drain(q(spark, SF_DIR))) for name in HEADLINE}
    result = {
        "metric": "sum of median seconds over the headline queries",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": CPUS,
        "pairs": pairs(spark),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
