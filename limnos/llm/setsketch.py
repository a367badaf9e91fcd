"""Near duplicates by SetSketch registers.

A document is the set of its shingles: five words in a row, lower-cased. Register i holds the smallest of the set's i-th exponential hash values on
a logarithmic scale, cut off at both ends. Registers of a union are the larger ones of its parts, and two sets agree in a
register about as often as they overlap. Work goes in steps:

1. Documents with equal sets form a class; only one text per class goes on, whatever the number of copies.
2. Bands of registers are hashed. In each bucket the class with the lowest id is the pivot; every class is tried against the pivot that it shares most bands
   with. What the likelihood of the registers rules out is left out, the rest is confirmed on the full sets.
3. Links give components. In large buckets that still hold several components, the classes outside the bucket's largest component are tried against
   further members of it, other ones each round, as long as that finds links: a large group of near copies comes together without its pairs.
4. What is then outside the largest component of its bucket is compared with all members of other components. In small buckets a join makes these
   pairs; what the likelihood lets pass is confirmed, best estimates first, until no untried pair joins two components. In large buckets tasks compare
   block with block, estimate and full sets, and hand on links only. Pairs within a component change nothing and are never made.

Two documents whose sets overlap by 0.75 miss all bands with a probability of 2.5e-7; closer ones miss less.

Null and blank texts have no shingles, link with nothing and are kept. Rows without id take no part, have no component and are kept. An id on several rows
is one document with several texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.files import ship
from limnos.llm.words import whole
from limnos.operators.graph import components
from limnos.operators.ordered import ranked_in_ranges
from limnos.session import settle

WIDTH = 5
PERCENT = 75

ROWS, BANDS = 4, 40
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65_534
# Pairs go on unless 0.75 and more is exp(14) times less likely than the best estimate (about five standard deviations).
SLACK = 14.0
# Members up to which a bucket is joined with itself; members of a block; rounds of further pivots, and the part of a round's pairs that must be links for
# another round to pay. The rounds only spare work: what they leave is compared in full.
SMALL, BLOCK, ROUNDS = 32, 256, 6
WORTH = 0.1
# Words whose hashes a task keeps.
KEPT = 200_000

_FACTORS = np.random.default_rng(20).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, parts), np.uint64, n)
    width = min(n, WIDTH)
    mixed = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        mixed = _mixed(mixed * _STEP + hashes[k : n - width + 1 + k])
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _FACTORS[None, :]).min(axis=0), out=least)
    uniform = np.minimum((least.astype(np.float64) + 1.0) / 2.0**64, 1 - 2.0**-53)
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely resemblance of sets with registers ``a`` and ``b`` (a row each) and known sizes, and whether PERCENT or more can be."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    total = (n_a + n_b).astype(np.float64)
    u, v = (n_a / total)[:, None], (n_b / total)[:, None]
    grid = np.linspace(0.0, 1.0, 101)[None, :]
    only_a, only_b = np.maximum(u - v * grid, 0.0), np.maximum(v - u * grid, 0.0)
    possible = grid <= np.minimum(u / v, v / u) + 1e-9
    p_above, p_below = _p(only_a), _p(only_b)
    floor = 1e-12
    logs = (
        above * np.log(np.maximum(p_above, floor)) + below * np.log(np.maximum(p_below, floor))
        + equal * np.log(np.maximum(1.0 - p_above - p_below, floor))
    )
    logs = np.where(possible, logs, -np.inf)
    best = logs.max(axis=1)
    wanted = logs[:, PERCENT:].max(axis=1)
    return grid[0][logs.argmax(axis=1)], wanted >= best - SLACK


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set and ``registers`` (both null without shingles) of every row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = [], [], []
            for raw in batch.column(1):
                hashes = shingles(raw.as_py())
                sizes.append(len(hashes))
                digests.append(xxhash.xxh128_digest(hashes.tobytes()) if len(hashes) else None)
                found.append(registers(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "registers"],
            )
        # Workers live on; the words would stay beside whatever the next stage holds.
        _words().clear()

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole(text).cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {kind}, n_shingles bigint, digest binary, registers binary"
    )


def _both(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``side`` (by id) of both ends, as x_a and x_b."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(*[F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in side.columns]), end)
    return pairs


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that may reach the threshold, with their most likely ``estimate``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                np.frombuffer(b"".join(batch.column(f"registers_{e}").to_pylist()), "<u2").reshape(-1, REGISTERS) for e in ("a", "b")
            ]
            sizes = [batch.column(f"n_shingles_{e}").to_numpy() for e in ("a", "b")]
            estimate, keep = likely(*sides, *sizes)
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimate)], names=["a", "b", "estimate"])
            yield found.filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    both = _both(pairs.select("a", "b"), classes.select("id", "n_shingles", "registers"))
    return both.mapInArrow(rows, f"a {kind}, b {kind}, estimate double")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets overlap by PERCENT or more."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                text = right.as_py()
                if text != last[0]:
                    last = text, shingles(text)
                own = shingles(left.as_py())
                both = len(np.intersect1d(own, last[1], assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(own) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return _both(pairs.select("a", "b"), texts).mapInArrow(rows, f"a {kind}, b {kind}").distinct()


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    known = labels.select(F.col("id").alias(of), F.col("component").alias("_component"))
    return rows.join(known, of, "left").withColumn(name, F.coalesce("_component", of)).drop("_component")


def _mixed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, band, id, n_shingles, component) of buckets with several components, with the bucket's ``main`` one and its number of ``members``."""
    members = settle(_labelled(shared.select("bucket", "band", "id", "n_shingles"), labels, "id", "component"), "near-members")
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("n"), F.sum("n").alias("members")
    )
    main = settle(main.filter("n > 1").select("bucket", "main", "members"), "near-main")
    return settle(members.join(main, "bucket"), "near-mixed")


def _pivots(mixed: DataFrame, turn: int) -> DataFrame:
    """For classes outside the largest component of a large bucket, two members of such components that they share most buckets with.
    ``turn`` decides which member of a component stands for it."""
    large = mixed.filter(F.col("members") > SMALL)
    order = F.struct(F.xxhash64(F.lit(turn), F.col("id")).alias("order"), "id")
    chosen = large.filter("component = main").groupBy("bucket").agg(F.min(order)["id"].alias("pivot"))
    outside = large.filter("component != main").join(settle(chosen, "near-pivots"), "bucket")
    counted = outside.groupBy("id", "pivot").agg(F.count("*").alias("bands"))
    best = Window.partitionBy("id").orderBy(F.desc("bands"), "pivot")
    return counted.withColumn("_n", F.row_number().over(best)).filter("_n <= 2").select(*_ordered(F.col("id"), F.col("pivot"))).distinct()


def _other(rows: DataFrame) -> DataFrame:
    return rows.filter("component != main").select(
        "bucket", F.col("id").alias("x"), F.col("component").alias("_x"), F.col("n_shingles").alias("_n")
    )


def _small_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of different components within buckets of up to SMALL members."""
    small = mixed.filter(F.col("members") <= SMALL)
    apart = (F.col("component") != F.col("_x")) & ((F.col("component") == F.col("main")) | (F.col("id") < F.col("x")))
    size = 100 * F.least("n_shingles", "_n") >= PERCENT * F.greatest("n_shingles", "_n")
    return small.join(_other(small), "bucket").filter(apart & size).select(*_ordered(F.col("id"), F.col("x"))).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """``id`` and its sorted shingle hashes (unsigned 64-bit)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(raw.as_py()).tobytes() for raw in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.binary())], names=["id", "hashes"])

    return texts.select("id", "text").mapInArrow(rows, f"id {texts.schema['id'].dataType.simpleString()}, hashes binary")


def _large_links(mixed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components within larger buckets.

    Classes outside the largest component make rows of blocks, all members make columns; a task compares one block with another. A pair that shares
    several buckets is looked at in that of its first band. Of a class's links to one component the task hands on one.
    """
    large = mixed.filter(F.col("members") > SMALL)
    outside = large.filter("component != main")
    sizes = large.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("main")).alias("n_outside"))
    sizes = settle(
        sizes.select("bucket", F.ceil(F.col("n") / BLOCK).alias("columns"), F.ceil(F.col("n_outside") / BLOCK).alias("rows")), "near-blocks"
    )
    wanted = settle(large.select("id").distinct(), "near-wanted")
    held = settle(_sets(texts.join(wanted, "id", "left_semi")).join(classes.select("id", "registers"), "id"), "near-sets")

    def spread(members: DataFrame, own: str, other: str, side: int) -> DataFrame:
        placed = members.select("bucket", "band", "id", "component").join(sizes, "bucket").withColumn(
            f"_{own}", F.pmod(F.xxhash64("id"), F.col(own))
        )
        return placed.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).select(
            "bucket", "band", "_rows", "_columns", F.lit(side).alias("side"), "id", "component"
        )

    both = spread(outside, "rows", "columns", 0).unionByName(spread(large, "columns", "rows", 1))
    kind = classes.schema["id"].dataType.simpleString()

    def compare(block: pa.Table) -> pa.Table:
        row, column = (block.filter(pc.equal(block["side"], side)) for side in (0, 1))
        links: list[tuple] = []
        if row.num_rows and column.num_rows:
            band = block["band"][0].as_py()
            ids, groups = (column[name].to_numpy() for name in ("id", "component"))
            own = np.frombuffer(b"".join(column["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS)
            sets = [np.frombuffer(raw, np.uint64) for raw in column["hashes"].to_pylist()]
            sizes_ = np.array([len(s) for s in sets])
            for x in row.select(["id", "component", "registers", "hashes"]).to_pylist():
                mine, full = np.frombuffer(x["registers"], "<u2"), np.frombuffer(x["hashes"], np.uint64)
                n = len(full)
                near = (groups != x["component"]) & (100 * np.minimum(sizes_, n) >= PERCENT * np.maximum(sizes_, n))
                at = np.flatnonzero(near)
                agree = (own[at] == mine).reshape(len(at), BANDS, ROWS).all(axis=2)
                at = at[agree.argmax(axis=1) == band] if len(at) else at
                if not len(at):
                    continue
                _, keep = likely(np.broadcast_to(mine, (len(at), REGISTERS)), own[at], np.full(len(at), n), sizes_[at])
                at = at[keep]
                if not len(at):
                    continue
                flat, starts = np.concatenate([sets[i] for i in at]), np.cumsum([0, *(len(sets[i]) for i in at[:-1])])
                spot = np.minimum(np.searchsorted(full, flat), n - 1)
                shared = np.add.reduceat((full[spot] == flat).astype(np.int64), starts)
                linked = at[100 * shared >= PERCENT * (n + sizes_[at] - shared)]
                for i in {int(groups[i]): int(i) for i in linked}.values():
                    links.append((min(x["id"], int(ids[i])), max(x["id"], int(ids[i]))))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, id_type), "b": pa.array(b, id_type)})

    id_type = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    grouped = both.join(held, "id").groupBy("bucket", "_rows", "_columns")
    return grouped.applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_links(classes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Labels (id, component) of the classes that have links. ``classes`` has whole-number ``id``, ``n_shingles`` and ``registers``."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.xxhash64(band, F.substring("registers", 1 + 2 * ROWS * band, F.lit(2 * ROWS))),
    )
    members = classes.select("id", "n_shingles", F.posexplode(bands).alias("band", "bucket"))
    pivots = members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    shared = settle(members.join(settle(pivots.select("bucket", "pivot"), "near-pivots"), "bucket"), "near-shared")

    wanted = shared.select("id").distinct()
    raw = docs.select(F.col("doc_id").alias("id"), whole(text).cast("binary").alias("text"))
    texts = settle(raw.join(settle(wanted, "near-wanted"), "id", "left_semi"), "near-texts")

    stars = shared.filter("id != pivot").groupBy("id", "pivot").agg(F.count("*").alias("bands"))
    nearest = stars.groupBy("id").agg(F.min(F.struct((-F.col("bands")).alias("_few"), "pivot"))["pivot"].alias("pivot"))
    tried = settle(nearest.select(*_ordered(F.col("id"), F.col("pivot"))), "near-tried")
    links = settle(confirmed(estimated(tried, classes), texts), "near-links")
    labels = components(links)

    mixed = _mixed_buckets(shared, labels)
    for turn in range(ROUNDS):
        now = settle(_pivots(mixed, turn).join(tried, ["a", "b"], "left_anti"), "near-tried")
        found = settle(confirmed(estimated(now, classes), texts), "near-links")
        tried, links = tried.unionByName(now), links.unionByName(found)
        hits = found.count()
        if hits <= WORTH * now.count():
            break
        labels = components(links)
        mixed = _mixed_buckets(shared, labels)

    links = links.unionByName(settle(_large_links(mixed, classes, texts), "near-links"))
    labels = components(links)
    crossing = settle(_small_pairs(mixed).join(tried, ["a", "b"], "left_anti"), "near-crossing")
    left = settle(estimated(crossing, classes), "near-left")
    per_pair = 4
    while not left.isEmpty():
        # Of the pairs between two components the likeliest are tried first; once two are one, their other pairs say nothing new.
        now = _labelled(_labelled(left, labels, "a", "of_a"), labels, "b", "of_b").filter("of_a != of_b")
        best = Window.partitionBy(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).orderBy(F.desc("estimate"), "a", "b")
        ranked = settle(now.withColumn("_n", F.row_number().over(best)).select("a", "b", "estimate", "_n"), "near-ranked")
        found = settle(confirmed(ranked.filter(F.col("_n") <= per_pair), texts), "near-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        left = settle(ranked.filter(F.col("_n") > per_pair).select("a", "b", "estimate"), "near-left")
        per_pair *= 16
    return labels


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``. Ids are of any type that sorts."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("int", "bigint"):
        return _by_number(docs, text)
    rows = settle(sketched(docs, text), "near-sketches")
    usable = rows.filter("digest is not null and doc_id is not null")
    classes = settle(
        usable.groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
        ),
        "near-classes",
    )
    by_id = classes.select("id", "n_shingles", "registers")
    labels = near_links(by_id, docs, text)
    homes = settle(_labelled(classes.select("digest", "id"), labels, "id", "component_id").select("digest", "component_id"), "near-homes")
    own = rows.select("doc_id", "n_shingles", "digest").join(homes, "digest", "left")
    home = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return own.select("doc_id", "n_shingles", home.alias("component_id"), F.coalesce(F.col("doc_id") == home, F.lit(True)).alias("kept"))


def _by_number(docs: DataFrame, text: str) -> DataFrame:
    """The same for ids that are no whole numbers: they are numbered in their order, so that the smallest id has the smallest number."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    numbers = settle(ranked_in_ranges(ids, [], ["doc_id"]).select("doc_id", F.col("_upto").alias("number")), "near-numbers")
    rows = docs.select("doc_id", F.col(text).alias("text")).join(numbers, "doc_id", "left")
    found = near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"))
    for name in ("doc_id", "component_id"):
        found = found.join(numbers.select(F.col("number").alias(name), F.col("doc_id").alias(f"_{name}")), name, "left").drop(name)
    return found.select(F.col("_doc_id").alias("doc_id"), "n_shingles", F.col("_component_id").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id, nulls last, and of several with that id the one with the smallest hash.

    Rows are judged one by one, so rows without id and repeats of an id are thinned too, and a second text of an id stays where it is
    no copy. Texts without shingles are all kept.
    """
    hashed = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("own"), F.xxhash64(*hashed).alias("hash"), F.struct("*").alias("row")
    )
    rows = settle(rows, "near-rows")
    homes = settle(near_duplicates(rows.select("doc_id", F.col("row")[text].alias("text"))).select("doc_id", "component_id"), "near-found")
    order = F.struct(F.col("own").isNull(), "own", "hash", "doc_id")
    first = rows.select("doc_id", "own", "hash").join(homes, "doc_id").groupBy("component_id").agg(F.min(order)["doc_id"].alias("doc_id"))
    dropped = settle(homes.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti"), "near-dropped")
    return rows.join(dropped, "doc_id", "left_anti").select("row.*")
