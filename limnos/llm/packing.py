"""Best-fit packing of token documents by minimum bin slack.

Lengths are whole numbers up to the capacity, so a packing is planned on counts of lengths, a table of at most ``capacity``
rows, however many documents there are. For each bin the longest open length is set, and a subset-sum table over the open
lengths, kept as the bits of one integer, finds the fullest combination that goes with it. The combination is removed as often as the
counts allow. A bin that is full but for a few tokens may do, if it spares short lengths that later bins need: the plan is made
for several such allowances, and the one with the fewest bins is taken. Rows then look up where the copy of their length with their number went.

Null texts are empty: one end mark. Documents longer than the capacity are cut; the first piece takes the rest. Repeated rows
are packed as often as they occur. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.files import ship
from limnos.llm.tokens import blocks, encoder
from limnos.llm.words import whole
from limnos.session import settle

CAPACITY = 1024
END = 2
# Slack that a bin may keep, one plan each.
ALLOWED = (0, 1, 2, 4, 8, 16, 32, 64)

Pattern = list[tuple[int, int]]


def fullest(counts: list[int], first: int, capacity: int, allowed: int = 0) -> Pattern:
    """Lengths with numbers of the fullest bin that holds one of ``first``; longer lengths are taken where sums tie.

    Lengths are tried from the longest down, and no more once a bin with ``allowed`` slack or less is found.
    """
    space = capacity - first
    everything = (1 << (space + 1)) - 1
    goal = everything ^ ((1 << max(0, space - allowed)) - 1)
    steps: list[tuple[int, int, int]] = []  # length, number, sums reachable before it
    sums = 1
    for length in range(min(first, space), 0, -1):
        left = counts[length] - (length == first)
        part = 1
        while left > 0 and length * part <= space and not sums & goal:
            part = min(part, left)
            steps.append((length, part, sums))
            sums |= (sums << (length * part)) & everything
            left -= part
            part *= 2
        if sums & goal:
            break
    at = sums.bit_length() - 1
    pattern = {first: 1}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            pattern[length] = pattern.get(length, 0) + part
    return sorted(pattern.items(), reverse=True)


def filled(counts: dict[int, int], capacity: int, allowed: int) -> list[tuple[Pattern, int]]:
    """Patterns with the number of bins that follow each, for all of ``counts`` (length to number)."""
    left = [0] * (capacity + 1)
    for length, number in counts.items():
        left[length] = number
    bins = []
    for first in range(capacity, 0, -1):
        while left[first]:
            pattern = fullest(left, first, capacity, allowed)
            times = min(left[length] // number for length, number in pattern)
            for length, number in pattern:
                left[length] -= number * times
            bins.append((pattern, times))
    return bins


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """The plan with the fewest bins; of equal ones, that with the least allowance."""
    return min((filled(counts, capacity, allowed) for allowed in ALLOWED), key=lambda bins: sum(times for _, times in bins))


def places(bins: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For runs of equal pieces by length and first number: first bin, pieces per bin, offset of the first one."""
    runs, used, first_bin = [], {}, 0
    for pattern, times in bins:
        offset = 0
        for length, number in pattern:
            start = used.get(length, 0)
            runs.append((length, start, first_bin, number, offset))
            used[length] = start + number * times
            offset += length * number
        first_bin += times
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "start", "bin", "number", "offset"), columns, strict=True))


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), and ``part`` and ``nth``, which number
    the pieces of a length within the task that cut them."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), {}
        mark = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            keys = batch.column(0)
            for lo, texts in blocks(batch.column(1)):
                out: dict[str, list] = {name: [] for name in ("piece", "start", "length", "ids", "nth")}
                rows = []
                for row, ids in enumerate(encode(texts), lo):
                    ids += mark
                    total = len(ids) // 4
                    at, stop, piece = 0, (total - 1) % capacity + 1, 0
                    while at < total:
                        length = stop - at
                        rows.append(row)
                        out["piece"].append(piece)
                        out["start"].append(at)
                        out["length"].append(length)
                        out["ids"].append(ids[4 * at : 4 * stop])
                        out["nth"].append(seen.get(length, 0))
                        seen[length] = seen.get(length, 0) + 1
                        at, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()), pa.array(out["ids"], pa.binary()),
                        pa.array([part] * len(rows), pa.int32()), pa.array(out["nth"], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"],
                )

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, nth bigint"
    return docs.select("doc_id", whole(text).alias("text")).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``, in place of columns of that name, to rows with ``length``, ``part`` and ``nth``; all other columns are
    carried along.

    ``pieces`` is read twice and must be a settled table, as its numbers come from tasks.
    """
    counts = settle(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("_rows")), "pack-counts")
    # One row per length, so as many as the capacity at most.
    lengths = {r["length"]: r["_rows"] for r in counts.groupBy("length").agg(F.sum("_rows").alias("_rows")).collect()}
    runs = places(plan(lengths, capacity))
    span = max(1, sum(lengths.values())) + 1
    keys = runs["length"] * span + runs["start"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("at"))
    kept = [c for c in pieces.columns if c not in ("part", "nth", "sequence_id", "offset")]
    carried = pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "length", "part", "nth")
    numbered = carried.join(settle(starts, "pack-starts"), ["length", "part"]).select("row", "length", (F.col("at") + F.col("nth")).alias("n"))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, length * span + n, side="right") - 1
            nth = n - runs["start"][run]
            sequence = runs["bin"][run] + nth // runs["number"][run]
            offset = runs["offset"][run] + nth % runs["number"][run] * length
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    ship(pieces.sparkSession)
    schema = T.StructType([numbered.schema["row"], *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])
    return numbered.mapInArrow(placed, schema).select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids of each sequence's pieces (column ``ids``) by offset, at most the capacity."""
    by_offset = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(by_offset.alias("pieces"))
