"""Bookings: overlaps, admission, cancellation, reads.

Stays are closed intervals: a stay that ends when another one starts overlaps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.joins import live
from limnos.operators.ordered import largest_group, mark_first, micros, ranked_in_ranges, running_sums, sort_columns
from limnos.operators.paging import page
from limnos.session import HOT, settle

# States of a booking and the messages of a cancellation.
BOOKED = "booked"
CANCELLED = "cancelled"
CHECKED_OUT = "checked_out"
CANCEL_DONE = "Booking cancelled successfully"
CANCEL_ALREADY = "Booking already cancelled"
CANCEL_TOO_LATE = "Booking already checked out"

# Outcomes of an admission.
ACCEPTED = "accepted"
INVALID = "invalid interval"
TAKEN = "room already booked"
TAKEN_IN_BATCH = "room taken by an earlier request"
UNORDERED = "no place in the order of requests"

# Requests of one cluster of overlapping stays that one task admits at a time.
BLOCK = 200_000


def valid_stay():
    return F.col("check_in") < F.col("check_out")


def active(bookings: DataFrame) -> DataFrame:
    return live(bookings).filter(F.col("status") == BOOKED)


def _points(df: DataFrame, weight: int) -> DataFrame:
    """Both ends of every stay as ``(room_id, at, starts, ends)``, in one pass over ``df``."""

    def point(at: str, starts: int, ends: int):
        return F.struct(F.col(at).alias("at"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))

    return df.select(
        "room_id", F.inline(F.array(point("check_in", weight, 0), point("check_out", 0, weight)))
    )


def _too_large(stays: DataFrame, asked: DataFrame | None, hot: int) -> bool:
    """Has a room more ends of stays than one window may see?"""
    rooms = stays.select("room_id")
    return largest_group(rooms if asked is None else rooms.unionByName(asked.select("room_id")), ["room_id"]) * 2 > hot


def _counts(stays: DataFrame, asked: DataFrame | None, split: bool) -> DataFrame:
    """Per room and time of interest: how many stays started by then, and how many ended before then."""
    points = _points(stays, 1)
    if asked is not None:
        points = points.unionByName(_points(asked, 0))
    sums = running_sums(points, ["room_id"], "at", ["starts", "ends"], split)
    return sums.select(
        "room_id",
        "at",
        "starts",
        F.col("cum_starts").alias("started"),
        (F.col("cum_ends") - F.col("ends")).alias("ended_before"),
    )


def overlaps(asked: DataFrame, stays: DataFrame, hot: int = HOT) -> DataFrame:
    """``asked`` plus ``n_overlaps``: how many of ``stays`` in the same room overlap each row.

    Started by my end minus ended before my start: two running counts replace the pairs, so a
    room with very many stays costs no more per row than any other. ``asked`` may be ``stays``
    itself; a valid stay then counts itself once. Every stay must start no later than it ends.
    """
    proper = stays.filter(F.col("check_in") <= F.col("check_out"))
    others = None if asked is stays else asked
    # Written once, read twice: the joins know its size and the counting is not done for each of them.
    counts = settle(_counts(proper, others, _too_large(proper, others, hot)).drop("starts"), "counts")
    at_end = counts.select("room_id", F.col("at").alias("check_out"), "started")
    at_start = counts.select("room_id", F.col("at").alias("check_in"), "ended_before")
    found = asked.join(at_end, ["room_id", "check_out"], "left").join(at_start, ["room_id", "check_in"], "left")
    return found.withColumn("n_overlaps", F.coalesce(F.col("started") - F.col("ended_before"), F.lit(0))).select(
        *asked.columns, "n_overlaps"
    )


def conflicts(bookings: DataFrame, hot: int = HOT) -> DataFrame:
    """Active bookings that overlap others of their room, with the number of those others."""
    stays = active(bookings).filter(F.col("check_in") <= F.col("check_out"))
    return (
        overlaps(stays, stays, hot)
        .withColumn("n_overlaps", F.col("n_overlaps") - 1)
        .filter(F.col("n_overlaps") > 0)
    )


def clashes(candidates: DataFrame, bookings: DataFrame, hot: int = HOT) -> DataFrame:
    """``candidates`` plus ``clash``: does an active booking of the room overlap?

    Where candidate and booking carry the same ``id`` (an update), the booking itself does not count.
    """
    stays = active(bookings).filter(F.col("check_in") <= F.col("check_out"))
    counted = overlaps(candidates, stays, hot)
    own = stays.select(
        F.col("id"),
        F.col("room_id").alias("_room"),
        F.col("check_in").alias("_in"),
        F.col("check_out").alias("_out"),
    )
    itself = (
        (F.col("_room") == F.col("room_id"))
        & (F.col("_in") <= F.col("check_out"))
        & (F.col("_out") >= F.col("check_in"))
    )
    mine = F.when(itself, 1).otherwise(0)
    return (
        counted.join(own, "id", "left")
        .withColumn("clash", F.col("n_overlaps") - mine > 0)
        .select(*candidates.columns, "clash")
    )


def _next(name: str) -> Column:
    """The next value after this row that is not null, found in one pass over the group."""
    return F.expr(f"lead({name}) ignore nulls")


def _neighbours(stays: DataFrame, asked: DataFrame | None, hot: int) -> DataFrame:
    """Rows to be judged (``room_id``, ``row``, ``at``, ``until``) with ``before``: of the stays that come earlier in a room, by start, the one
    that ends last (until, id); and ``after``: the first stay that comes later (at, id).

    One running maximum and one look ahead, so no pair of stays is made. A large room is cut into ranges of its order; each takes the maximum of the
    ranges before it and the first stay of those after it. Of equal ends the highest id counts.
    """

    def points(df: DataFrame, is_stay: bool) -> DataFrame:
        row = F.struct(*[F.col(c) for c in df.columns]) if is_stay == (asked is None) else F.lit(None)
        return df.select(
            "room_id", F.col("check_in").alias("at"), F.col("check_out").alias("until"), F.lit(0 if is_stay else 1).alias("late"),
            F.col("id").alias("own"), row.alias("row"),
        )

    rows = points(stays, True) if asked is None else points(stays, True).drop("row").unionByName(points(asked, False), allowMissingColumns=True)
    order = ["at", "late", "own"]
    ends = F.when(F.col("late") == 0, F.struct("until", F.col("own").alias("id")))
    starts = F.when(F.col("late") == 0, F.struct("at", F.col("own").alias("id")))

    def swept(df: DataFrame, by: Sequence[str]) -> DataFrame:
        group = Window.partitionBy(*by).orderBy(*sort_columns(order))
        earlier = group.rowsBetween(Window.unboundedPreceding, -1)
        # Rows come by start, so the least start that follows is the next one: a frame up to the group's end would be read anew for every row.
        return df.withColumns({"_start": starts, "before": F.max(ends).over(earlier)}).withColumn("after", _next("_start").over(group)).drop("_start")

    if not _too_large(stays, asked, hot):
        return swept(rows, ["room_id"]).filter(F.col("row").isNotNull())
    ranged = rows.repartitionByRange("room_id", *sort_columns(order)).withColumn("_range", F.spark_partition_id())
    ranged = settle(ranged, "swept")
    sums = ranged.groupBy("room_id", "_range").agg(F.max(ends).alias("last"), F.min(starts).alias("first"))
    group = Window.partitionBy("room_id").orderBy("_range")
    carried = sums.select(
        F.col("room_id").alias("_room"), F.col("_range").alias("_in"),
        F.max("last").over(group.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        _next("first").over(group).alias("_after"),
    )
    inside = swept(ranged, ["room_id", "_range"]).filter(F.col("row").isNotNull())
    on = F.col("room_id").eqNullSafe(F.col("_room")) & (F.col("_range") == F.col("_in"))
    return inside.join(settle(carried, "carried"), on).withColumns(
        {"before": F.greatest("before", "_before"), "after": F.least("after", "_after")}
    )


def _witnessed(swept: DataFrame) -> DataFrame:
    """The judged rows with ``witness``: a stay that overlaps, or null. If any earlier stay overlaps, the one that ends last does; if any later one does,
    the next does."""
    earlier = F.when(F.col("before.until") >= F.col("at"), F.col("before.id"))
    later = F.when(F.col("after.at") <= F.col("until"), F.col("after.id"))
    return swept.select("row.*", F.coalesce(earlier, later).alias("witness"))


def conflict_witness(bookings: DataFrame, hot: int = HOT) -> DataFrame:
    """Active bookings that overlap others of their room, with the id of one that they overlap: the earlier one that ends last, else the next one.

    Ids are unique; bookings without room, or with ends out of order, overlap nothing.
    """
    stays = active(bookings).filter("room_id is not null and check_in <= check_out")
    return _witnessed(_neighbours(stays, None, hot)).filter(F.col("witness").isNotNull())


def blocked_by(requests: DataFrame, bookings: DataFrame, hot: int = HOT) -> DataFrame:
    """``requests`` plus ``witness``: the id of an active booking of the room that stands in the way, or null. Requests are new, so none of the
    bookings is their own; one without room or with ends out of order is in nobody's way and gets null."""
    stays = active(bookings).filter("room_id is not null and check_in <= check_out")
    proper = F.coalesce(F.col("room_id").isNotNull() & (F.col("check_in") <= F.col("check_out")), F.lit(False))
    found = _witnessed(_neighbours(stays, requests.filter(proper), hot))
    kind = stays.schema["id"].dataType
    return found.unionByName(requests.filter(~proper).withColumn("witness", F.lit(None).cast(kind)))


def clusters(stays: DataFrame, hot: int = HOT) -> DataFrame:
    """``stays`` plus ``cluster``: stays of a room that are linked by overlaps share a number.

    A cluster starts where every stay that started earlier has ended.
    """
    split = _too_large(stays, None, hot)
    first = (F.col("starts") > 0) & (F.col("started") - F.col("starts") == F.col("ended_before"))
    flagged = _counts(stays, None, split).withColumn("first", first.cast("int"))
    numbered = running_sums(flagged, ["room_id"], "at", ["first"], split).select(
        "room_id", F.col("at").alias("check_in"), F.col("cum_first").alias("cluster")
    )
    return stays.join(numbered, ["room_id", "check_in"])


def _first_come(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First come, first served per cluster, over rows sorted by cluster and then by request order.

    The accepted stays of the cluster at hand are kept sorted and disjoint.
    """
    at, starts, ends = None, [], []
    for batch in batches:
        free = np.zeros(len(batch), dtype=bool)
        rows = zip(batch["room_id"], batch["cluster"], batch["check_in"], batch["check_out"], strict=True)
        for row, (room, cluster, start, end) in enumerate(rows):
            if (room, cluster) != at:
                at, starts, ends = (room, cluster), [], []
            i = bisect_left(ends, start)
            if i == len(starts) or starts[i] > end:
                free[row] = True
                starts.insert(i, start)
                ends.insert(i, end)
        yield pd.DataFrame({"seq": batch["seq"], "outcome": np.where(free, ACCEPTED, TAKEN_IN_BATCH)})


def _settle_clusters(pending: DataFrame) -> DataFrame:
    """Outcome per request; every cluster lies in one partition, many clusters share one."""
    seq_type = pending.schema["seq"].dataType.simpleString()
    return (
        pending.repartition("room_id", "cluster")
        .sortWithinPartitions("room_id", "cluster", "seq")
        .select("seq", "room_id", "cluster", *[micros(pending, c).alias(c) for c in ("check_in", "check_out")])
        .mapInPandas(_first_come, f"seq {seq_type}, outcome string")
    )


_CLUSTER = ["room_id", "cluster"]


def _in_stay_order(pending: DataFrame, block: int) -> tuple[DataFrame, DataFrame] | None:
    """Clusters of more than ``block`` requests that come in the order of their stays, with ``_pos`` (place in that order) and ``n``; and all other
    requests. None if there are no such clusters."""
    large = settle(pending.groupBy(*_CLUSTER).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block).drop("_rows"), "large")
    rows = pending.join(large, _CLUSTER, "left_semi")
    by_seq = ranked_in_ranges(rows, _CLUSTER, ["seq"]).withColumnRenamed("_upto", "_asked").drop("n")
    ranked = settle(ranked_in_ranges(by_seq, _CLUSTER, ["check_in", "seq"]).withColumnRenamed("_upto", "_pos"), "ranked")
    mixed = settle(ranked.filter("_asked != _pos").select(*_CLUSTER).distinct(), "mixed")
    chosen = settle(ranked.join(mixed, _CLUSTER, "left_anti").drop("_asked"), "in-order")
    if chosen.isEmpty():
        return None
    return chosen, settle(pending.join(chosen.select(*_CLUSTER).distinct(), _CLUSTER, "left_anti"), "pending")


def _settle_in_order(rows: DataFrame) -> DataFrame:
    """Outcome per request of clusters in stay order.

    After an accepted stay the next one that starts when it has ended is accepted, and none between: its place is one above the number of stays
    that started by then. Those pointers are doubled until they leave the cluster, and the chain from the first request is walked by the
    doubled pointers, longest first; so rounds grow with the logarithm of what is accepted.
    """
    points = rows.select(
        *_CLUSTER, F.inline(F.array(*[F.struct(F.col(c).alias("at"), F.lit(n).alias("starts")) for c, n in (("check_in", 1), ("check_out", 0))]))
    )
    started = running_sums(points, _CLUSTER, "at", ["starts"]).select(*_CLUSTER, F.col("at").alias("check_out"), "cum_starts")
    following = rows.join(started, [*_CLUSTER, "check_out"]).filter(F.col("cum_starts") < F.col("n"))
    jump = settle(following.select(*_CLUSTER, "_pos", (F.col("cum_starts") + 1).alias("_next")), "jumps")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        beyond = jump.select(*_CLUSTER, F.col("_pos").alias("_next"), F.col("_next").alias("_after"))
        jump = settle(jump.join(beyond, [*_CLUSTER, "_next"]).select(*_CLUSTER, "_pos", F.col("_after").alias("_next")), "jumps")
    reached = settle(rows.filter("_pos = 1").select(*_CLUSTER, "_pos"), "reached")
    for jump in reversed(jumps):
        further = reached.join(jump, [*_CLUSTER, "_pos"]).select(*_CLUSTER, F.col("_next").alias("_pos"))
        reached = settle(reached.unionByName(further), "reached")
    told = rows.join(reached.withColumn("_free", F.lit(True)), [*_CLUSTER, "_pos"], "left")
    return told.select("seq", F.when(F.col("_free"), ACCEPTED).otherwise(TAKEN_IN_BATCH).alias("outcome"))


def admit(
    bookings: DataFrame, requests: DataFrame, seq: str = "id", block: int = BLOCK, hot: int = HOT
) -> DataFrame:
    """``requests`` plus ``outcome``: accepted, or why not.

    A request needs a valid stay and a room free of active bookings and of earlier accepted
    requests, in the order of ``seq``, which must be unique; a request without one is not accepted. Clusters of linked stays are
    independent and run in parallel. Of a cluster above ``block`` requests the first ``block`` are settled,
    those that overlap the accepted ones fall out, and what is left, now in smaller clusters, goes
    round again; each round settles at least the earliest request of every cluster. A cluster above ``block`` whose requests come in the order of
    their stays, which would need a round for each ``block`` of them, is settled at once by pointers.
    """
    asked = requests.select(F.col(seq).alias("seq"), "room_id", "check_in", "check_out")
    good = F.coalesce(valid_stay() & F.col("seq").isNotNull(), F.lit(False))
    invalid = asked.filter(~good & F.col("seq").isNotNull()).select("seq", F.lit(INVALID).alias("outcome"))
    checked = overlaps(
        asked.filter(good),
        active(bookings).select("room_id", "check_in", "check_out"),
        hot,
    )
    checked = settle(checked, "checked")
    taken = checked.filter(F.col("n_overlaps") > 0).select("seq", F.lit(TAKEN).alias("outcome"))
    pending = settle(clusters(checked.filter(F.col("n_overlaps") == 0).drop("n_overlaps"), hot), "pending")
    outcomes = [invalid, taken]

    while largest_group(pending, _CLUSTER) > block:
        in_order = _in_stay_order(pending, block)
        if in_order is not None:
            outcomes.append(settle(_settle_in_order(in_order[0]), "admitted"))
            pending = in_order[1]
            continue
        pending = settle(mark_first(pending, ["room_id", "cluster"], ["seq"], block, hot=hot), "pending")
        settled = settle(_settle_clusters(pending.filter("is_first")), "admitted")
        outcomes.append(settled)
        won = pending.join(settled.filter(F.col("outcome") == ACCEPTED), "seq").select(
            "room_id", "check_in", "check_out"
        )
        rest = pending.filter(~F.col("is_first")).select("seq", "room_id", "check_in", "check_out")
        rest = settle(overlaps(rest, won, hot), "rest")
        outcomes.append(rest.filter(F.col("n_overlaps") > 0).select("seq", F.lit(TAKEN_IN_BATCH).alias("outcome")))
        pending = settle(clusters(rest.filter(F.col("n_overlaps") == 0).drop("n_overlaps"), hot), "pending")

    outcomes.append(_settle_clusters(pending))
    verdicts = outcomes[0]
    for part in outcomes[1:]:
        verdicts = verdicts.unionByName(part)
    told = verdicts.withColumnRenamed("seq", "_seq")
    return (
        requests.join(told, requests[seq] == told["_seq"], "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit(UNORDERED)))
        .drop("_seq")
    )


def accepted_bookings(admitted: DataFrame) -> DataFrame:
    """Accepted requests as new bookings with the default state."""
    new = admitted.filter(F.col("outcome") == ACCEPTED).drop("outcome")
    status = F.coalesce(F.col("status"), F.lit(BOOKED)) if "status" in new.columns else F.lit(BOOKED)
    return new.withColumn("status", status)


def cancel(bookings: DataFrame, asked: DataFrame) -> DataFrame:
    """All bookings after the cancellations in ``asked`` (``id``), with ``outcome`` where one was asked for.

    Only a booked one changes, and only in its state.
    """
    ids = asked.select("id").distinct().withColumn("_asked", F.lit(True))
    hit = F.col("_asked") & (F.col("deleted_at").isNull() if "deleted_at" in bookings.columns else F.lit(True))
    outcome = (
        F.when(hit & (F.col("status") == CANCELLED), CANCEL_ALREADY)
        .when(hit & (F.col("status") == BOOKED), CANCEL_DONE)
        .when(hit, CANCEL_TOO_LATE)
    )
    return (
        bookings.join(ids, "id", "left")
        .withColumn("outcome", outcome)
        .withColumn("status", F.when(F.col("outcome") == CANCEL_DONE, CANCELLED).otherwise(F.col("status")))
        .drop("_asked")
    )


def user_bookings(
    bookings: DataFrame, user_id: int, number: int = 1, items: int | None = None
) -> DataFrame:
    """A user's live bookings, latest check-in first; a page of them when ``items`` is given."""
    mine = live(bookings).filter(F.col("user_id") == user_id)
    return _ordered(mine, ["-check_in", "id"], number, items)


def room_bookings(
    bookings: DataFrame,
    room_id: int,
    start,
    end,
    status: str = BOOKED,
    number: int = 1,
    items: int | None = None,
) -> DataFrame:
    """A room's live bookings in a state whose check-out lies in a closed range, by check-out."""
    mine = live(bookings).filter(
        (F.col("room_id") == room_id) & (F.col("status") == status) & F.col("check_out").between(start, end)
    )
    return _ordered(mine, ["check_out", "id"], number, items)


def _ordered(df: DataFrame, order: Sequence[str], number: int, items: int | None) -> DataFrame:
    return df.orderBy(*sort_columns(order)) if items is None else page(df, order, number, items)
