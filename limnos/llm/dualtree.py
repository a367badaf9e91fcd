"""Ranked lexical search with two trees.

An item is a vector of its terms' weights, a document a vector of the values of its terms, and a score is their product. Items and documents
each stand in a tree whose nodes hold, for every term, the largest value below them. The product of two nodes' maxima bounds every score between
their items and documents, so a pair of nodes is dropped, with all pairs below it, when that bound is less than the weakest k-th score among the node's items. What is
left at the leaves is scored with whole numbers, most promising leaves first.

Items go in blocks of bounded size (``ITEMS`` rows, ``CHARS`` characters on average), and each block goes over all documents. A first pass opens only the best leaf
of each item leaf; the k-th best scores that it finds, over all tasks, are what the second pass starts from. They are scores of documents that are there, so
nothing is lost by them. The second pass drops only what lies strictly below.

Texts are read whole. Terms are runs of ASCII digits and letters and of all characters beyond ASCII, with only A to Z made small. Null and blank texts have
no terms; documents without terms do not count. Rows are ranked one by one: a repeated document takes a rank of its own, rows without id come last among equal scores,
and an item that stands on several rows is ranked for each. Without items or documents there are no rows. Extra columns are left out. Ids
are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.files import ship
from limnos.llm.words import whole
from limnos.session import settle

TOP = 10
# Rows and characters of a block of items.
ITEMS, CHARS = 512, 1_000_000
# Items and documents of a leaf; children of a node.
ITEM_LEAF, LEAF, FAN = 8, 16, 8
# Numbers that the leaves of one document tree hold.
HELD = 4_000_000
# Scores up to this are exact as floating-point sums.
EXACT = 2**53

# Bytes that are no part of a term become blanks, A to Z become small.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode().translate(_BYTES).split()


def value(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to a document of ``n`` terms, per unit of weight."""
    m = 25 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Level:
    """Nodes of one level: coordinate maxima, and the first child of each (and one past the last)."""

    def __init__(self, maxima: np.ndarray, first: np.ndarray):
        self.maxima, self.first = maxima, first


def _starts(n: int, size: int) -> np.ndarray:
    return np.arange(0, n, size)


def tree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int, leaf: int) -> list[Level]:
    """Levels of a tree over ``n`` vectors, leaves first; the last level is one node. Vectors are given by row, column and value."""
    leaves = -(-n // leaf)
    maxima = np.zeros((leaves, width))
    np.maximum.at(maxima, (rows // leaf, columns), values)
    levels = [Level(maxima, np.append(_starts(n, leaf), n))]
    while len(levels[-1].maxima) > 1:
        below = levels[-1].maxima
        starts = _starts(len(below), FAN)
        levels.append(Level(np.maximum.reduceat(below, starts, axis=0), np.append(starts, len(below))))
    return levels


class Items:
    """A block of items: their vectors, tree, and the best documents found so far."""

    def __init__(self, weights: list[int], vectors: list[dict[int, int]], floors: np.ndarray, top: int):
        # Items with the same weightiest term stand together.
        lead = [max(((weights[t], t) for t in v), default=(0, -1)) for v in vectors]
        self.order = sorted(range(len(vectors)), key=lambda i: (lead[i][1], i))
        self.width, self.top = max(1, len(weights)), top
        self.vectors = [(np.array(list(vectors[i]), np.int64), np.array([weights[t] * c for t, c in vectors[i].items()], np.int64)) for i in self.order]
        rows = np.repeat(np.arange(len(self.order)), [len(t) for t, _ in self.vectors])
        columns = np.concatenate([t for t, _ in self.vectors]) if self.order else np.empty(0, np.int64)
        values = np.concatenate([q for _, q in self.vectors]) if self.order else np.empty(0, np.int64)
        self.levels = tree(rows, columns, values.astype(float), len(self.order), self.width, ITEM_LEAF)
        self.floors = floors[self.order]
        self.exact = all(int(q.sum()) * 1_000_000 < EXACT for _, q in self.vectors)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in self.order]
        self.kth = self.floors.copy()
        self.leaves = [self._leaf(a, b) for a, b in zip(self.levels[0].first[:-1], self.levels[0].first[1:], strict=True)]

    def _leaf(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Column of each term within a leaf (-1: not there) and the leaf's item vectors."""
        own = np.unique(np.concatenate([self.vectors[i][0] for i in range(start, stop)]))
        column = np.full(self.width, -1)
        column[own] = np.arange(len(own))
        dense = np.zeros((stop - start, len(own)), float if self.exact else np.int64)
        for row, i in enumerate(range(start, stop)):
            dense[row, column[self.vectors[i][0]]] = self.vectors[i][1]
        return column, dense

    def weakest(self, level: int) -> np.ndarray:
        """The weakest k-th score among each node's items."""
        least = self.kth
        for below in self.levels[: level + 1]:
            least = np.minimum.reduceat(least, below.first[:-1])
        return least

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.kth[item])
        if not good.any():
            return
        joined = [np.concatenate([old, new[good]]) for old, new in zip(self.best[item], (scores, ids, nulls), strict=True)]
        order = np.lexsort((joined[1], joined[2], -joined[0]))[: self.top]
        self.best[item] = tuple(part[order] for part in joined)
        if len(order) == self.top:
            self.kth[item] = max(self.floors[item], int(joined[0][order[-1]]))


class Documents:
    """A tree over a batch of documents, those with the same weightiest terms beside each other."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, columns: np.ndarray, values: np.ndarray, weights: np.ndarray, width: int):
        starts = np.cumsum(counts) - counts
        worth = weights[columns] * (columns.max(initial=0) + 1) + columns
        order = np.lexsort((ids, -np.maximum.reduceat(worth, starts)))
        self.ids, self.nulls, counts = ids[order], nulls[order], counts[order]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        spots = np.repeat(starts[order] - self.first[:-1], counts) + np.arange(self.first[-1])
        self.columns, self.values = columns[spots], values[spots]
        self.levels = tree(np.repeat(np.arange(len(ids)), counts), self.columns, self.values.astype(float), len(ids), width, LEAF)

    def scores(self, start: int, stop: int, column: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Scores of documents ``start`` to ``stop`` (columns) for a leaf's items (rows), as whole numbers."""
        lo, hi = self.first[start], self.first[stop]
        at = column[self.columns[lo:hi]]
        dense = np.zeros((stop - start, items.shape[1]), items.dtype)
        rows = np.repeat(np.arange(stop - start), np.diff(self.first[start : stop + 1]))
        dense[rows[at >= 0], at[at >= 0]] = self.values[lo:hi][at >= 0]
        return (items @ dense.T).astype(np.int64)


def search(items: Items, docs: Documents, seed: bool = False) -> int:
    """Offer the batch's documents to all items. With ``seed`` each item leaf opens its best document leaf only. Returns the leaf pairs opened."""
    left, right = len(items.levels) - 1, len(docs.levels) - 1
    pairs = np.zeros((1, 2), np.int64)
    bounds = np.zeros(1)
    while True:
        above, below = items.levels[left].maxima, docs.levels[right].maxima
        bounds = np.empty(len(pairs))
        for node in np.unique(pairs[:, 0]):
            mine = np.flatnonzero(pairs[:, 0] == node)
            active = np.flatnonzero(above[node])
            bounds[mine] = below[pairs[mine, 1]][:, active] @ above[node, active]
        # Sums of floating-point bounds may fall short by rounding; scores themselves are whole.
        open_ = bounds * (1 + 1e-9) >= np.maximum(items.weakest(left)[pairs[:, 0]], 1)
        pairs, bounds = pairs[open_], bounds[open_]
        if left == 0 and right == 0 or not len(pairs):
            break
        # The side that is further from its leaves goes down.
        if right >= left:
            pairs, right = _down(pairs, 1, docs.levels[right].first), right - 1
        else:
            pairs, left = _down(pairs, 0, items.levels[left].first), left - 1
    opened, done = 0, set()
    for at in np.argsort(-bounds, kind="stable"):
        leaf, node = pairs[at]
        if seed and leaf in done:
            continue
        done.add(leaf)
        a, b = items.levels[0].first[leaf : leaf + 2]
        if bounds[at] * (1 + 1e-9) < items.kth[a:b].min():
            continue
        start, stop = docs.levels[0].first[node : node + 2]
        found = docs.scores(start, stop, *items.leaves[leaf])
        opened += 1
        for row, item in enumerate(range(a, b)):
            items.offer(item, found[row], docs.ids[start:stop], docs.nulls[start:stop])
    return opened


def _down(pairs: np.ndarray, side: int, first: np.ndarray) -> np.ndarray:
    """Pairs with one side's nodes replaced by their children."""
    nodes = pairs[:, side]
    counts = first[nodes + 1] - first[nodes]
    down = np.repeat(pairs, counts, axis=0)
    down[:, side] = np.repeat(first[nodes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return down


def vectors(docs: DataFrame, number: dict[bytes, int], text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (terms of the whole text), and ``terms`` and ``tfs``: numbers of the terms that ``number`` has, with their occurrences."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, tfs, ends = [], [], [], [0]
            for raw in batch.column(1):
                found = terms(raw.as_py())
                own = Counter(k for k in map(number.get, found) if k is not None)
                sizes.append(len(found))
                numbers += own.keys()
                tfs += own.values()
                ends.append(len(numbers))
            edges = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(edges, pa.array(tfs, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), whole(text).alias("text")).mapInArrow(
        rows, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
    )


def _found(held: DataFrame, weights: list[int], own: list[dict[int, int]], n_docs: int, n_terms: int, floors: np.ndarray, top: int, seed: bool) -> DataFrame:
    """The best documents of each item among a task's: ``item`` (number in the block), ``doc_id``, ``score``."""
    width = max(1, len(weights))
    size = max(LEAF, HELD // width * LEAF)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_term = Items(weights, own, floors, top), np.array(weights or [0], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists, keys = part.column("terms"), part.column("doc_id")
                counts = lists.value_lengths().to_numpy()
                columns = lists.flatten().to_numpy().astype(np.int64)
                n = np.repeat(part.column("n").to_numpy(), counts)
                values = value(part.column("tfs").flatten().to_numpy(), n, n_docs, n_terms)
                nulls = keys.is_null().to_numpy(zero_copy_only=False)
                docs = Documents(keys.fill_null(0).to_numpy(), nulls, counts, columns, values, by_term, width)
                search(items, docs, seed)
        for item, (scores, ids, nulls) in zip(items.order, items.best, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item), pa.int64()), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return held.mapInArrow(rows, "item bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(docs: DataFrame, rows: list, top: int, text: str) -> DataFrame:
    """Ranked documents of a block of items: ``item`` (number in ``rows``), ``rank``, ``doc_id``, ``score``."""
    counted = [Counter(terms(row.text)) for row in rows]
    number = {term: k for k, term in enumerate(sorted(set().union(*counted)))}
    held = settle(vectors(docs, number, text), "search-vectors")
    n_docs, n_terms = held.select(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of the block at most.
    seen = {r.term: r.df for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = [weight(seen.get(k, 0), n_docs) for k in range(len(number))]
    own = [{number[term]: n for term, n in item.items()} for item in counted]
    with_terms = held.filter(F.size("terms") > 0)

    def found(floors: np.ndarray, seed: bool) -> DataFrame:
        return _found(with_terms, weights, own, n_docs, n_terms, floors, top, seed)

    floors = np.zeros(len(rows), np.int64)
    seeded = settle(_ranked(found(floors, True), top), "search-seeds")
    for row in seeded.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == top).collect():
        floors[row["item"]] = row["least"]
    return _ranked(found(floors, False), top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` best documents of every row of ``items`` (``item_id``, ``text``)."""
    spark = docs.sparkSession
    wanted = settle(items.select("item_id", whole(text).alias("text"), F.monotonically_increasing_id().alias("_row")), "search-items")
    n, chars = wanted.select(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    blocks = max(-(-n // ITEMS), -(-chars // CHARS))
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == block).orderBy("_row").collect()
        if not rows:
            continue
        names = spark.createDataFrame([(k, row.item_id) for k, row in enumerate(rows)], f"item bigint, item_id {kind}")
        best = _block(docs, rows, top, text).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(settle(best, "search-block"))
    return out
