import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnos.operators import catalog, changes, graph, joins, limits, quality
from limnos.plans.queries import QUERIES
from limnos.session import settle
from limnos.sources import seed


def accept_by_hand(base, new, keys):
    """Rows in order; ``keys`` are column positions."""
    seen = [{r[k] for r in base if r[k] is not None} for k in keys]
    result = {}
    for row in sorted(new):
        if any(row[k] in s for k, s in zip(keys, seen, strict=True)):
            result[row[0]] = False
        else:
            result[row[0]] = True
            for k, s in zip(keys, seen, strict=True):
                if row[k] is not None:
                    s.add(row[k])
    return result


@pytest.mark.parametrize("keys", [["u"], ["u", "e"]])
def test_insert_unique(spark, keys):
    rng = random.Random(3)
    base = [(i, f"u{i}", f"e{i}") for i in range(5)]
    new = [
        (i, "u0" if i % 3 == 0 else f"u{rng.randrange(40)}", None if i % 11 == 0 else f"e{rng.randrange(40)}")
        for i in range(120)
    ]
    schema = "seq long, u string, e string"
    accepted, rejected = changes.insert_unique(
        spark.createDataFrame(base, schema), spark.createDataFrame(new, schema), {k: [k] for k in keys}, "seq"
    )
    want = accept_by_hand(base, new, [{"u": 1, "e": 2}[k] for k in keys])
    got = {r.seq: True for r in accepted.collect()} | {r.seq: False for r in rejected.collect()}
    assert got == want
    assert accepted.count() + rejected.count() == len(new)
    assert rejected.filter(F.col("reason").isNull()).count() == 0


def test_insert_unique_composite_key(spark):
    base = spark.createDataFrame([(0, "free", "users")], "seq long, tier string, path string")
    new = spark.createDataFrame(
        [(1, "free", "users"), (2, "free", "rooms"), (3, "pro", "users"), (4, "free", "rooms")], base.schema
    )
    accepted, _ = changes.insert_unique(base, new, {"path": ["tier", "path"]}, "seq")
    assert sorted(r.seq for r in accepted.collect()) == [2, 3]


def test_partial_update(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, email string")
    change = spark.createDataFrame(
        [(1, 1, "c", None), (1, 2, None, "z"), (1, 3, "d", None), (9, 4, "e", "e")],
        "id long, seq long, name string, email string",
    )
    got = changes.apply_updates(base, change, "id", "seq")
    assert sorted(map(tuple, got.collect())) == [(1, "d", "z"), (2, "b", "y")]
    assert [r.id for r in changes.unknown_keys(base, change, "id").collect()] == [9]


def test_unique_updates(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    change = spark.createDataFrame(
        [(1, 1, "a"), (2, 2, "a"), (1, 3, "n"), (3, 4, "n"), (3, 5, None)], "id long, seq long, name string"
    )
    kept, refused = changes.without_duplicates(base, change, "id", "seq", {"name": ["name"]})
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 5]
    assert sorted(r.seq for r in refused.collect()) == [2, 4]


def test_deletes(spark):
    stamp = dt.datetime(2020, 1, 1)
    base = spark.createDataFrame(
        [(1, False, None), (2, True, stamp), (3, False, None)], "id long, is_deleted boolean, deleted_at timestamp"
    )
    keys = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    later = dt.datetime(2021, 1, 1)
    got = changes.soft_delete(base, keys, "id", F.lit(later))
    assert sorted(map(tuple, got.collect())) == [(1, True, later), (2, True, stamp), (3, False, None)]
    assert [r.id for r in joins.live(got).collect()] == [3]
    assert [r.id for r in changes.hard_delete(base, keys, "id").collect()] == [3]


def test_search_rooms(spark):
    rows = [(1, 100.0, [1, 2], [1], None), (2, 200.0, [1], [], None), (3, 201.0, [1], [1], None),
            (4, 150.0, None, None, None), (5, 150.0, [1, 2], [1], dt.datetime(2020, 1, 1))]
    rooms = spark.createDataFrame(
        rows, "id long, price double, feature_ids array<int>, badge_ids array<int>, deleted_at timestamp"
    )

    def ids(**kw):
        return sorted(r.id for r in catalog.search_rooms(rooms, **kw).collect())

    assert ids() == [1, 2, 3, 4]
    assert ids(max_price=200) == [1, 2, 4]
    assert ids(features=[1], max_price=200) == [1, 2]
    assert ids(features=[2, 1], badges=[1]) == [1]
    assert ids(min_price=150, max_price=300) == [2, 3, 4]


def test_enrich(spark):
    rooms = spark.createDataFrame([(1, [3, 1, 3, 99]), (2, []), (3, None)], "id long, feature_ids array<int>")
    got = catalog.enrich(rooms, "feature_ids", seed.dimension(spark, seed.FEATURES), "features")
    names = {r.id: [(f.id, f.name) for f in r.features] for r in got.collect()}
    assert names == {1: [(1, seed.FEATURES[0]), (3, seed.FEATURES[2])], 2: [], 3: []}


def test_enrich_with_odd_ids(spark):
    rooms = spark.createDataFrame([(1, [3, None, 3]), (None, [1])], "id long, feature_ids array<int>")
    dim = spark.createDataFrame([(3, "a"), (3, "b"), (None, "c"), (1, "d")], "id int, name string")
    got = {r.id: [(f.id, f.name) for f in r.features] for r in catalog.enrich(rooms, "feature_ids", dim, "features").collect()}
    assert got == {1: [(3, "a"), (3, "b")], None: []}


def test_enriching_runs_no_job(spark):
    rooms = spark.createDataFrame([(1, [3])], "id long, feature_ids array<int>")
    dim = seed.dimension(spark, seed.FEATURES)
    spark.sparkContext.setJobGroup("enrich", "plan only")
    try:
        catalog.enrich(rooms, "feature_ids", dim, "features")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("enrich")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("known", [True, False])
def test_enriching_broadcasts_nothing_that_grows_with_the_rooms(spark, known):
    """Neither the links nor the gathered lists, though the files of many rooms are small; a dimension of unknown size changes nothing."""
    rooms = settle(spark.range(20_000).withColumn("feature_ids", F.expr("array(cast(id % 22 + 1 as int), 99)")), "rooms")
    dim = seed.dimension(spark, seed.FEATURES) if known else spark.createDataFrame([(3, "a"), (3, "b"), (4, "c")], "id int, name string")
    got = catalog.enrich(rooms, "feature_ids", dim, "features")
    by_id = {r.id: [(f.id, f.name) for f in r.features] for r in got.filter("id in (2, 3, 4)").collect()}
    assert by_id == ({k: [(k + 1, seed.FEATURES[k])] for k in (2, 3, 4)} if known else {2: [(3, "a"), (3, "b")], 3: [(4, "c")], 4: []})
    # Only the known dimension itself.
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("BroadcastExchange") == int(known)


def test_null_flags_are_live(spark):
    rows = spark.createDataFrame([(1, None), (2, False), (3, True)], "id int, is_deleted boolean")
    assert sorted(r.id for r in joins.live(rows).collect()) == [1, 2]


def test_keyed_ids_are_unique(spark):
    rows = spark.createDataFrame(
        [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, "", "c"), (5, "a", "b|c")], "seq int, x string, y string"
    )
    good, apart = changes.keyed(rows, ["x", "y"], "seq")
    assert sorted(r.seq for r in good.collect()) == [1, 2, 4]
    assert good.select("id").distinct().count() == 3
    assert {(r.seq, r.reason) for r in apart.collect()} == {(3, "no natural key"), (5, "natural key repeated")}


def test_two_keys_one_after_another(spark):
    rng = random.Random(12)
    base = [("u1", "m1"), ("u2", "m2")]
    new = [(i, rng.choice([None, *(f"u{k}" for k in range(1, 40))]), rng.choice([f"m{k}" for k in range(1, 40)])) for i in range(120)]
    names, mails, want = {u for u, _ in base}, {m for _, m in base}, {}
    for seq, name, mail in new:
        want[seq] = "mail" if mail in mails else "name" if name is not None and name in names else "ok"
        if want[seq] == "ok":
            names.add(name)
            mails.add(mail)
    accepted, rejected = changes.insert_unique(
        spark.createDataFrame(base, "name string, mail string"), spark.createDataFrame(new, "seq int, name string, mail string"),
        {"mail": ["mail"], "name": ["name"]}, "seq",
    )
    got = {r.seq: "ok" for r in accepted.collect()} | {r.seq: r.reason for r in rejected.collect()}
    assert got == want


def test_fields_beyond_a_closed_list(spark):
    rows = spark.createDataFrame([({"status": "x", "role": "y", "a": None},), ({},)], "payload map<string,string>")
    assert [r[0] for r in rows.select(quality.extra_fields("payload", ["status"])).collect()] == [["a", "role"], []]


def test_profile_of_texts(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 2), (None, 2)], "s string, n int")
    got = {r.column: (r.n, r.n_null, r.n_distinct, [tuple(t) for t in r.top]) for r in quality.profile_text(rows, ["s", "n"], 1).collect()}
    assert got == {"s": (3, 1, 2, [("a", 2)]), "n": (4, 0, 2, [("2", 3)])}


def test_seed_sizes():
    assert (len(seed.FEATURES), len(seed.BADGES)) == (22, 23)


def test_children_tell_no_parent_from_no_children(spark):
    parents = spark.createDataFrame([(1, "ann", False), (2, "bob", False), (3, "cy", True)], "id long, n string, is_deleted boolean")
    kids = spark.createDataFrame([(10, 1), (11, 1)], "id long, parent long")
    wanted = spark.createDataFrame([("ann",), ("bob",), ("cy",), ("dee",)], "name string")
    got = joins.children_of(parents, "n", wanted, kids, "parent").collect()
    assert sorted((r.name, r.found, r.child_id or 0) for r in got) == [
        ("ann", True, 10), ("ann", True, 11), ("bob", True, 0), ("cy", False, 0), ("dee", False, 0),
    ]


def test_joined_and_listed(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    tiers = spark.createDataFrame([(1, "gold")], "user long, name string")
    on = F.col("id") == F.col("tier_user")
    assert joins.joined(users, tiers, on, prefix="tier_").columns == ["id", "name", "tier_user", "tier_name"]
    assert joins.joined(users, tiers, on, prefix="tier_").count() == 2
    assert joins.joined(users, tiers, on, prefix="tier_", how="inner").count() == 1
    assert joins.joined(users, tiers, on, prefix="tier_", where=F.col("id") == 2).count() == 1
    assert [r.id for r in joins.without_listed(users, users.filter("id = 1"), "id").collect()] == [2]
    assert [r.id for r in joins.only_existing(users, users.filter("id = 1"), ["id"]).collect()] == [1]


@pytest.mark.parametrize("hot", [10**6, 4])
def test_rate_limits(spark, hot):
    rng = random.Random(8)
    start = dt.datetime(2021, 5, 1)
    rows = [
        (i, 1 if i % 2 else rng.randrange(2, 5), start + dt.timedelta(seconds=rng.randrange(3 * 3600)), "/a/b/")
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, path string")
    flagged = limits.flag_limited(df, limit=5, period=3600, hot=hot)
    got = {r.event_id: r.limited for r in flagged.collect()}
    counts, want = {}, {}
    for event, user, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (user, ts.replace(minute=0, second=0))
        counts[key] = counts.get(key, 0) + 1
        want[event] = counts[key] > 5
    assert got == want
    audit = limits.audit(df, limit=5, period=3600)
    assert audit.agg(F.sum("n_requests"), F.sum("n_limited")).first() == (200, sum(want.values()))
    assert {r.path for r in audit.collect()} == {"a_b"}


def test_tier_limits_fall_back_to_defaults(spark):
    requests = spark.createDataFrame(
        [(1, 1, dt.datetime(2021, 1, 1), "/a/"), (2, 1, dt.datetime(2021, 1, 1), "/b/"), (3, 9, dt.datetime(2021, 1, 1), "/a/")],
        "event_id long, user_id long, ts timestamp, path string",
    )
    users = spark.createDataFrame([(1, "free")], "id long, tier string")
    rules = spark.createDataFrame([("free", "a", 2, 60)], "tier string, path string, limit int, period int")
    got = {r.event_id: (r["limit"], r.period) for r in limits.with_limits(requests, users, rules).collect()}
    assert got == {1: (2, 60), 2: (10, 3600), 3: (10, 3600)}


def test_user_rules(spark):
    good = ("Ann Lee", "annlee", "ann.lee@example.com", "+1234567890", "Str1ngst!")
    rows = [good, ("A", "Ann_Lee", "ann@", "12", "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, username string, email string, phone_number string, password string")
    got = [r.broken for r in quality.check(df, quality.user_rules()).collect()]
    assert got[0] == []
    assert got[1] == ["name_length", "username_pattern", "email_pattern", "phone_length"]
    assert got[2] == ["name_required", "username_required", "email_required", "phone_required", "password_required"]
    with pytest.raises(ValueError):
        quality.check(df, quality.user_rules(), allowed=["name"])


def test_update_rules_allow_missing_fields(spark):
    df = spark.createDataFrame(
        [(None, None, None, "ftp://x.y/z", None), (None, None, None, "x.y", None)],
        "name string, username string, email string, profile_image_url string, phone_number string",
    )
    got = [r.broken for r in quality.check(df, quality.user_update_rules()).collect()]
    assert got == [[], ["image_url_pattern"]]


def test_room_and_booking_rules(spark):
    room = spark.createDataFrame([("n", None, 1.0, [1], None)], "name string, description string, price double, feature_ids array<int>, badge_ids array<int>")
    assert quality.check(room, quality.room_rules()).first().broken == ["description_required", "badge_ids_required"]
    assert "interval" in quality.booking_rules()


def test_query_names_are_plain():
    assert not [n for n in QUERIES if n == "pipeline" or n.startswith("op")]


def in_order(new):
    """Verdicts of rows (seq, name, mail) one after another."""
    names, mails, want = set(), set(), {}
    for seq, name, mail in sorted(new, key=lambda r: r[0]):
        want[seq] = "mail" if mail is not None and mail in mails else "name" if name is not None and name in names else "ok"
        if want[seq] == "ok":
            names.add(name)
            mails.add(mail)
    return want


SIGN_UP = "seq int, name string, mail string"
UNIQUE = {"mail": ["mail"], "name": ["name"]}


def settled_rows(spark, new, **options):
    accepted, rejected = changes.insert_unique(
        spark.createDataFrame([], "name string, mail string"), spark.createDataFrame(new, SIGN_UP), UNIQUE, "seq", **options
    )
    return {r.seq: "ok" for r in accepted.collect()} | {r.seq: r.reason for r in rejected.collect()}


@pytest.mark.parametrize("block", [200_000, 40])
def test_a_chain_of_sign_ups_takes_few_rounds(spark, monkeypatch, block):
    """Every sign-up shares its mail or its name with the one before: each verdict hangs on the last."""
    n = 120
    new = [(k, f"n{(k + 1) // 2}", f"m{k // 2}") for k in range(n)] + [(n + k, f"a{k % 9}", f"b{k % 7}") for k in range(40)]
    rounds = []
    own = changes._in_components
    monkeypatch.setattr(changes, "_in_components", lambda *args: rounds.append(1) or own(*args))
    assert settled_rows(spark, new, block=block) == in_order(new)
    assert len(rounds) == 1 if block > n else 1 < len(rounds) <= 4


def test_a_chain_of_many_blocks_takes_two_rounds(spark, monkeypatch):
    """Keys are forgotten after their last row, so a chain is walked to its end whatever its length; keys that stay open send the rest round again."""
    rounds = []
    own = changes._in_components
    monkeypatch.setattr(changes, "_in_components", lambda *args: rounds.append(1) or own(*args))
    chain = [(k, f"n{(k + 1) // 2}", f"m{k // 2}") for k in range(200)]
    assert settled_rows(spark, chain, block=20) == in_order(chain)
    assert len(rounds) == 2


def test_a_task_stops_before_it_holds_too_many_keys():
    """Rows of component, place, first and last place of two keys, over batches; copies of a row stay together."""
    rows = [(1, 1, 1, 4, None, None), (1, 2, 2, 5, 2, 2), (1, 2, 2, 5, 2, 2), (1, 3, 3, 6, None, None), (1, 4, 1, 4, None, None), (7, 7, 7, 7, 7, 8), (7, 8, 8, 9, 7, 8)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("cpabyz", (c, p, f0, f1, l0, l1), strict=True)) for c, p, f0, l0, f1, l1 in part]) for part in (rows[:4], rows[4:])]

    def verdicts(*limits):
        return [(r["seq"], r["wins"]) for b in changes._one_by_one(2, *limits)(iter(batches)) for r in b.to_pylist()]

    whole = [(1, True), (2, True), (2, False), (3, True), (4, False), (7, True), (8, False)]
    assert verdicts(None, 100) == whole
    assert verdicts(None, 2) == whole[:3] + whole[5:]
    assert verdicts(1, 100) == [(1, True), (7, True)]


def test_components_by_range(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 300)] + [(k, k + 7) for k in range(500, 600)] + [(5, 900), (900, 7), (7, 7), (None, 3)]
    links += [tuple(rng.sample(range(1000, 1200), 2)) for _ in range(90)]
    table = spark.createDataFrame(links, "a bigint, b bigint")
    want = sorted(map(tuple, graph.components(table).collect()))
    for block in (16, 10_000):
        assert sorted(map(tuple, graph.components_by_range(table, block).select("id", "component").collect())) == want


def test_rows_without_a_place_in_the_order_are_rejected(spark):
    one = [(1, "a"), (None, "a"), (None, "a"), (2, "b"), (None, None)]
    accepted, rejected = changes.insert_unique(
        spark.createDataFrame([], "name string"), spark.createDataFrame(one, "seq int, name string"), {"name": ["name"]}, "seq"
    )
    assert sorted((r.seq, r.name) for r in accepted.collect()) == [(1, "a"), (2, "b")]
    assert [r.reason for r in rejected.collect()] == [changes.UNORDERED] * 3
    two = [(1, "a", "x"), (None, "a", "y"), (None, "c", "z"), (2, "b", "x"), (3, None, None)]
    accepted, rejected = changes.insert_unique(
        spark.createDataFrame([], "name string, mail string"), spark.createDataFrame(two, SIGN_UP), UNIQUE, "seq"
    )
    assert sorted(r.seq for r in accepted.collect()) == [1, 3]
    assert sorted((r.seq or 0, r.reason) for r in rejected.collect()) == [(0, changes.UNORDERED), (0, changes.UNORDERED), (2, "mail")]


def test_updates_without_a_place_in_the_order_are_refused(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, "w")], "id int, name string")
    asked = spark.createDataFrame([(1, None, "z"), (2, None, "z"), (3, 7, "z"), (2, 7, "z")], "id int, seq int, name string")
    kept, refused = changes.without_duplicates(base, asked, "id", "seq", {"taken": ["name"]})
    assert [(r.id, r.seq) for r in kept.collect()] == [(2, 7)]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [(1, changes.UNORDERED), (2, changes.UNORDERED), (3, "taken")]
