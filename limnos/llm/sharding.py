"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` cells. Every shard owns virtual nodes at hashed cells; a key hashes to a cell and belongs to the
first virtual node clockwise. No shard takes more rows than its share, so counts differ by one at most: keys that find
their shard full go on clockwise to the next shard with room. Placing is planned on the counts of cells, a table
whose size is the parameter ``cells``; rows only look up the range of their cell that they fall in.

Null keys hash like any value, equal keys lie in one cell, and rows that agree in key, size and checksum are interchangeable.
Empty input gives empty output.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.words import lane_of, whole
from limnos.session import settle

CELLS = 4096
NODES = 64


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[list[int]]:
    """Shards that own a virtual node, by cell. Nodes of a shard do not depend on how many shards there are."""
    owners: list[list[int]] = [[] for _ in range(cells)]
    for shard in range(shards):
        for node in range(nodes):
            owners[zlib.crc32(f"shard {shard} node {node}".encode()) % cells].append(shard)
    return owners


def plan(counts: dict[int, int], shards: int, nodes: int = NODES, cells: int = CELLS) -> list[dict[str, int]]:
    """Ranges of each cell's rows with their shard and first slot.

    All cells first fill their own shard, in ring order; then what found it full walks on, again in ring order.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    owners = ring(shards, nodes, cells)
    after: list[int] = [0] * cells  # the first cell at or after this one that has a node
    nearest = next(c for c in range(cells) if owners[c])
    for cell in reversed(range(cells)):
        nearest = cell if owners[cell] else nearest
        after[cell] = nearest
    ranges: list[dict[str, int]] = []

    def put(cell: int, start: int, rows: int, shard: int) -> int:
        fits = min(rows, room[shard] - used[shard])
        if fits:
            ranges.append({"cell": cell, "start": start, "stop": start + fits, "shard": shard, "slot": used[shard]})
            used[shard] += fits
        return fits

    placed = {c: put(c, 0, counts[c], owners[after[c]][0]) for c in sorted(counts)}
    for cell in sorted(counts):
        at, seen = after[cell], set()
        while placed[cell] < counts[cell]:
            for shard in owners[at]:
                if shard not in seen and placed[cell] < counts[cell]:
                    seen.add(shard)
                    placed[cell] += put(cell, placed[cell], counts[cell] - placed[cell], shard)
            at = after[(at + 1) % cells]
    return ranges


def assign(rows: DataFrame, key: list[str], order: list[str], shards: int = 16, lanes: int = 16) -> DataFrame:
    """Add ``shard`` and ``slot``, in place of columns of that name. ``order`` names the columns that tell rows of a cell apart.

    ``rows`` is read several times and should be a settled table. A cell is ranked in ``lanes`` slices.
    """
    spark = rows.sparkSession
    order_hash = F.xxhash64(*key, *order)
    on_ring = rows.select(
        F.struct("*").alias("_row"),
        F.struct(*key, *order).alias("_tie"),
        F.pmod(F.xxhash64(*key), F.lit(CELLS)).cast("int").alias("_cell"),
        lane_of(F.lit("lane"), *key, *order, lanes=lanes).cast("int").alias("_lane"),
        order_hash.alias("_order"),
    )
    lane_rows = settle(on_ring.groupBy("_cell", "_lane").agg(F.count("*").alias("_rows")), "ring-lanes")
    # One row per cell: CELLS rows at most, whatever the input.
    counts = {r["_cell"]: r["_rows"] for r in lane_rows.groupBy("_cell").agg(F.sum("_rows").alias("_rows")).collect()}
    earlier = Window.partitionBy("_cell").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = lane_rows.select("_cell", "_lane", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_at"))
    ranges = spark.range(1).select(
        F.inline(
            F.from_json(
                F.lit(json.dumps(plan(counts, shards))),
                "array<struct<cell:int,start:long,stop:long,shard:int,slot:long>>",
            )
        )
    )
    within = Window.partitionBy("_cell", "_lane").orderBy("_order", "_tie")
    ranked = on_ring.withColumn("_n", F.row_number().over(within) - 1)
    place = F.col("_at") + F.col("_n")
    hit = (F.col("_cell") == F.col("cell")) & (F.col("_place") >= F.col("start")) & (F.col("_place") < F.col("stop"))
    return (
        ranked.join(starts, ["_cell", "_lane"])
        .withColumn("_place", place)
        .join(settle(ranges, "ring-ranges"), hit)
        .select(*[F.col("_row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")], "shard", (F.col("slot") + F.col("_place") - F.col("start")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows of ``docs`` by id: ``doc_id``, ``size`` (bytes and one), ``text_crc32``, ``shard``, ``slot``."""
    text = whole("text")
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(settle(base, "ring-rows"), ["doc_id"], ["size", "text_crc32"], shards)
