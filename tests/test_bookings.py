"""Overlaps and admission against brute force, with limits low enough to force rooms and clusters apart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from limnos.operators import bookings as b

DAY = dt.timedelta(days=1)
BASE = dt.datetime(2021, 1, 1)
STAY = "id long, room_id long, check_in timestamp, check_out timestamp, status string, deleted_at timestamp"


def stays(seed, n=150, first_id=0):
    """Half of all stays are in one room."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = BASE + rng.randrange(120) * DAY + dt.timedelta(hours=rng.randrange(3))
        status = rng.choice(["booked", "booked", "booked", "cancelled", "checked_out"])
        rows.append(
            (first_id + i, 1 if i % 2 else rng.randrange(2, 6), start, start + rng.randrange(1, 5) * DAY, status,
             BASE if i % 10 == 0 else None)
        )
    return rows


def overlap(a, c):
    return a[1] == c[1] and a[2] <= c[3] and a[3] >= c[2]


def is_active(r):
    return r[4] == "booked" and r[5] is None


@pytest.mark.parametrize("hot", [10**6, 3])
def test_conflicts(spark, hot):
    rows = stays(1)
    got = b.conflicts(spark.createDataFrame(rows, STAY), hot=hot).collect()
    active = [r for r in rows if is_active(r)]
    want = {r[0]: sum(overlap(r, o) for o in active if o[0] != r[0]) for r in active}
    assert {r.id: r.n_overlaps for r in got} == {k: v for k, v in want.items() if v}


def test_closed_intervals(spark):
    rows = [
        (1, 1, BASE, BASE + DAY, "booked", None),
        (2, 1, BASE + DAY, BASE + 2 * DAY, "booked", None),  # touches 1
        (3, 1, BASE + 3 * DAY, BASE + 9 * DAY, "booked", None),
        (4, 1, BASE + 4 * DAY, BASE + 5 * DAY, "booked", None),  # inside 3
        (5, 1, BASE + 4 * DAY, BASE + 5 * DAY, "cancelled", None),
        (6, 2, BASE + 4 * DAY, BASE + 5 * DAY, "booked", None),  # other room
    ]
    got = {r.id for r in b.conflicts(spark.createDataFrame(rows, STAY)).collect()}
    assert got == {1, 2, 3, 4}


@pytest.mark.parametrize("hot", [10**6, 3])
def test_clashes_leave_out_the_booking_itself(spark, hot):
    rows = stays(2)
    moved = [(r[0], r[1], r[2] + DAY, r[3] + DAY) for r in stays(3)]
    candidates = spark.createDataFrame(moved, "id long, room_id long, check_in timestamp, check_out timestamp")
    got = {r.id: r.clash for r in b.clashes(candidates, spark.createDataFrame(rows, STAY), hot=hot).collect()}
    active = [r for r in rows if is_active(r)]
    assert got == {m[0]: any(overlap(m, o) for o in active if o[0] != m[0]) for m in moved}


@pytest.mark.parametrize("hot", [10**6, 3])
def test_every_conflict_has_a_witness(spark, hot):
    rows = stays(5) + [(900, None, BASE, BASE + 200 * DAY, "booked", None), (901, 1, BASE + 50 * DAY, BASE, "booked", None)]
    active = [r for r in rows if is_active(r) and r[1] is not None and r[2] <= r[3]]
    by_id = {r[0]: r for r in active}
    got = {r.id: r for r in b.conflict_witness(spark.createDataFrame(rows, STAY), hot=hot).collect()}
    assert set(got) == {r[0] for r in active if any(overlap(r, o) for o in active if o[0] != r[0])}
    for id_, row in got.items():
        assert row.witness != id_ and overlap(by_id[id_], by_id[row.witness])
    assert set(next(iter(got.values())).asDict()) == {"id", "room_id", "check_in", "check_out", "status", "deleted_at", "witness"}


@pytest.mark.parametrize("hot", [10**6, 3])
def test_requests_learn_what_blocks_them(spark, hot):
    rows, asked = stays(6), stays(7, n=90, first_id=2000) + [(3000, None, BASE, BASE + DAY, "x", None), (3001, 1, BASE + 9 * DAY, BASE, "x", None)]
    active = {r[0]: r for r in rows if is_active(r) and r[2] <= r[3]}
    got = {r.id: r.witness for r in b.blocked_by(spark.createDataFrame(asked, STAY), spark.createDataFrame(rows, STAY), hot=hot).collect()}
    assert set(got) == {r[0] for r in asked}
    for r in asked:
        blocked = r[1] is not None and r[2] <= r[3] and any(overlap(r, o) for o in active.values())
        assert (got[r[0]] is not None) == blocked
        assert not blocked or overlap(r, active[got[r[0]]])


@pytest.mark.parametrize("hot", [10**6, 3])
def test_witnesses_take_one_pass_over_a_room(spark, hot):
    """No frame reaches to the end of a room, which would be read anew for every row; the next stay is found behind requests, of equal starts by id."""
    rows = stays(9, n=60) + [(500 + i, 1, BASE + 300 * DAY, BASE + (301 + i % 2) * DAY, "booked", None) for i in range(4)]
    asked = [(2000 + i, 1, BASE + (290 + i % 3) * DAY, BASE + (299 + i % 2) * DAY, "x", None) for i in range(6)]
    bookings, requests = spark.createDataFrame(rows, STAY), spark.createDataFrame(asked, STAY)
    for found in (b.conflict_witness(bookings, hot=hot), b.blocked_by(requests, bookings, hot=hot)):
        plan = found._jdf.queryExecution().executedPlan().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    blocked = {r.id: r.witness for r in b.blocked_by(requests, bookings, hot=hot).collect()}
    assert blocked == {2000 + i: 500 if i % 2 else None for i in range(6)}
    active = sorted((r for r in rows if is_active(r)), key=lambda r: (r[2], r[0]))
    want = {}
    for k, r in enumerate(active):
        earlier = max(((o[3], o[0]) for o in active[:k] if o[1] == r[1]), default=None)
        later = next(((o[2], o[0]) for o in active[k + 1 :] if o[1] == r[1]), None)
        if earlier and earlier[0] >= r[2]:
            want[r[0]] = earlier[1]
        elif later and later[0] <= r[3]:
            want[r[0]] = later[1]
    assert {r.id: r.witness for r in b.conflict_witness(bookings, hot=hot).collect()} == want


@pytest.mark.parametrize("hot", [10**6, 3])
def test_clusters(spark, hot):
    rows = stays(4, n=80)
    df = spark.createDataFrame(rows, STAY)
    got = {r.id: (r.room_id, r.cluster) for r in b.clusters(df, hot=hot).collect()}
    # Linked stays share a cluster; clusters partition the room.
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        for o in rows:
            if overlap(r, o):
                parent[root(r[0])] = root(o[0])
    for r in rows:
        for o in rows:
            assert (got[r[0]] == got[o[0]]) == (root(r[0]) == root(o[0]))


def admitted_by_hand(existing, asked):
    taken = [r for r in existing if is_active(r)]
    result, accepted = {}, []
    for r in sorted(asked):
        if not r[2] < r[3]:
            result[r[0]] = b.INVALID
        elif any(overlap(r, o) for o in taken):
            result[r[0]] = b.TAKEN
        elif any(overlap(r, o) for o in accepted):
            result[r[0]] = b.TAKEN_IN_BATCH
        else:
            result[r[0]] = b.ACCEPTED
            accepted.append(r)
    return result, accepted


@pytest.mark.parametrize("block,hot", [(10**6, 10**6), (4, 10**6), (1, 5)])
def test_admission(spark, block, hot):
    existing = stays(5, n=40)
    rng = random.Random(6)
    asked = []
    for i in range(120):
        start = BASE + rng.randrange(150) * DAY
        asked.append((1000 + i, 1 if i % 2 else rng.randrange(2, 6), start, start + rng.randrange(0, 4) * DAY))
    requests = spark.createDataFrame(asked, "id long, room_id long, check_in timestamp, check_out timestamp")
    got = b.admit(spark.createDataFrame(existing, STAY), requests, block=block, hot=hot)
    want, accepted = admitted_by_hand(existing, asked)
    rows = got.collect()
    assert {r.id: r.outcome for r in rows} == want and len(rows) == len(asked)
    assert not any(overlap(x, y) for x in accepted for y in accepted if x[0] < y[0])
    new = b.accepted_bookings(got)
    assert {r.status for r in new.collect()} == {"booked"} and new.count() == len(accepted)


def test_cancel(spark):
    rows = [(1, "booked", None), (2, "cancelled", None), (3, "checked_out", None), (4, "booked", BASE), (5, "booked", None)]
    df = spark.createDataFrame(rows, "id long, status string, deleted_at timestamp")
    asked = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 99)], "id long")
    got = {r.id: (r.status, r.outcome) for r in b.cancel(df, asked).collect()}
    assert got == {
        1: ("cancelled", b.CANCEL_DONE),
        2: ("cancelled", b.CANCEL_ALREADY),
        3: ("checked_out", b.CANCEL_TOO_LATE),
        4: ("booked", None),
        5: ("booked", None),
    }


def test_reads(spark):
    rows = [(i, 7, 1 + i % 2, BASE + i * DAY, BASE + (i + 2) * DAY, "booked", None) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, user_id long, " + STAY[len("id long, "):])
    assert [r.id for r in b.user_bookings(df, 7, items=3).collect()] == [7, 6, 5]
    got = b.room_bookings(df, 1, F.lit(BASE + 4 * DAY), F.lit(BASE + 8 * DAY))
    assert [r.id for r in got.collect()] == [2, 4, 6]


def test_a_cluster_in_stay_order_is_settled_at_once(spark, monkeypatch):
    """Requests by start, each linked with the next: pointers settle them, not a round for each block. Another room's come in no order."""
    rng = random.Random(8)
    at, sorted_rows = BASE, []
    for k in range(300):
        at += dt.timedelta(hours=rng.choice([0, 1, 2]))
        sorted_rows.append((k, 1, at, at + dt.timedelta(hours=rng.randrange(3, 30)), "booked", None))
    other = [(1000 + k, 2, *row[2:]) for k, row in enumerate(rng.sample(sorted_rows, 60))]
    rounds = []
    own = b.mark_first
    monkeypatch.setattr(b, "mark_first", lambda *args, **kw: rounds.append(1) or own(*args, **kw))
    asked = sorted_rows + other
    empty = spark.createDataFrame([], STAY)
    got = {r.id: r.outcome for r in b.admit(empty, spark.createDataFrame(asked, STAY), block=50).collect()}
    held, want = [], {}
    for r in asked:
        free = not any(overlap(r, o) for o in held)
        want[r[0]] = b.ACCEPTED if free else b.TAKEN_IN_BATCH
        held += [r] if free else []
    assert got == want
    assert len(rounds) <= 4
