"""Connected components of a table of links. No component is gathered; only tables move."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.session import settle


def _roots(parents: DataFrame) -> DataFrame:
    """``parents`` (node, parent) with every parent replaced by the last one of its chain: each round doubles the reach."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        jumped = settle(
            parents.join(above, "parent", "left").select(
                "node", F.coalesce("_next", "parent").alias("parent"), F.col("_next").isNotNull().alias("_moved")
            ),
            "links-jump",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("_moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every end of ``links`` (columns ``a`` and ``b``).

    Every component that has a smaller neighbour joins the smallest of them and follows it to its end, so at least half of the components that
    still have links go in each round, and a round takes as many steps as the logarithm of its longest chain. Null ends link nothing.
    """
    ends = links.filter("a is not null and b is not null and a != b").select("a", "b")
    labels = settle(ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().withColumn("component", F.col("id")), "links-labels")
    open_links = settle(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-open")
    while not open_links.isEmpty():
        hooks = settle(open_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "links-hooks")
        roots = _roots(hooks)
        by_label = roots.select(F.col("node").alias("component"), F.col("parent").alias("_root"))
        labels = settle(
            labels.join(by_label, "component", "left").select("id", F.coalesce("_root", "component").alias("component")), "links-labels"
        )
        for end, other in (("a", "b"), ("b", "a")):
            at = roots.select(F.col("node").alias(end), F.col("parent").alias("_root"))
            open_links = open_links.join(at, end, "left").select(F.coalesce("_root", end).alias(end), other)
        open_links = settle(
            open_links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-open"
        )
    return labels


def components_by_range(links: DataFrame, block: int) -> DataFrame:
    """As :func:`components`, for links most of whose ends lie near each other: a chain of any length takes a few rounds.

    Tasks bring together what the links of one range of ``b`` connect, about ``block`` of them. What is left are the ends that several ranges have; a link for
    each of those connects what the ranges found.
    """
    ends = settle(links.filter("a is not null and b is not null and a != b").select("a", "b"), "links-ends")
    kind = ends.schema["a"].dataType.simpleString()
    ranges = -(-ends.count() // block)
    if ranges > 1:
        ends = ends.repartitionByRange(ranges, "b")
    else:
        ends = ends.coalesce(1)
    local = ends.mapInArrow(_connected, f"id {kind}, root {kind}")
    if ranges <= 1:
        return settle(local.withColumnRenamed("root", "component"), "links-local")
    local = settle(local, "links-local")
    own = settle(local.groupBy("id").agg(F.min("root").alias("_root"), F.max("root").alias("_top")), "links-own")
    shared = own.filter("_root != _top").select("id", "_root")
    labels = components(local.join(shared, "id").select(F.col("_root").alias("a"), F.col("root").alias("b")))
    return settle(
        own.join(labels.withColumnRenamed("id", "_root"), "_root", "left").select("id", F.coalesce("component", "_root").alias("component")), "links-labels"
    )


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` and ``root``, the smallest end that the links of a task connect it with."""
    above: dict = {}

    def top(end):
        while above[end] != end:
            above[end] = end = above[above[end]]
        return end

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(above.setdefault(a, a)), top(above.setdefault(b, b))
            if a < b:
                above[b] = a
            elif b < a:
                above[a] = b
    if above:
        ids = pa.array(above, kind)
        yield pa.RecordBatch.from_arrays([ids, pa.array([top(end) for end in above], kind)], ["id", "root"])
