"""Bottom-k sketches of word shingles.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles (five words in a row; fewer
words are one shingle). The sketch of a union follows from the sketches of its parts, so sketches merge. Two sketches tell the
resemblance and containment of the texts, and one tells how many distinct shingles there are.

Null and empty texts have an empty sketch. Two empty sketches are equal, likeness 1; an empty and another one have 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.words import lane_of, let, whole, words
from limnos.session import settle

K = 64
WIDTH = 5


def shingle_hashes(parts: Column, width: int = WIDTH) -> Column:
    """Hash of every run of ``width`` words."""

    def runs(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - width, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    some = let(F.transform(parts, lambda w: F.xxhash64(w)), runs)
    return F.when(F.size(parts) == 0, F.array().cast("array<bigint>")).otherwise(some)


def lowest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return let(words(text), lambda parts: lowest(shingle_hashes(parts, width), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, keys: list[str], sketch_column: str = "sketch", k: int = K, lanes: int = 64) -> DataFrame:
    """One sketch per group of rows. Hashes are made distinct before they move, and a group is cut down in ``lanes`` slices."""
    hashes = df.select(*keys, F.explode(sketch_column).alias("_hash")).distinct()
    in_lane = Window.partitionBy(*keys, "_lane").orderBy("_hash")
    in_group = Window.partitionBy(*keys).orderBy("_hash")
    least = (
        hashes.withColumn("_lane", lane_of(F.col("_hash"), lanes=lanes))
        .withColumn("_n", F.row_number().over(in_lane)).filter(F.col("_n") <= k)
        .withColumn("_n", F.row_number().over(in_group)).filter(F.col("_n") <= k)
    )
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch_column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of the union's shingles: of the k smallest hashes of both, those that both hold."""
    shared = let(merge(a, b, k), lambda low: F.size(F.array_intersect(low, F.array_intersect(a, b))) / F.size(low))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)
    ).otherwise(shared)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Part of ``a``'s shingles that ``b`` holds: the intersection by resemblance, over the size of ``a``."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) over the share of hashes up to the k-th."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def as_text(a: Column) -> Column:
    """A sketch as base64 of its hashes."""
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.base64(F.unhex(digits))


def _third(chars: Column) -> Column:
    return F.floor(chars / 3).cast("int")


def neighbours(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``before_id`` and ``before_chars`` of every id: the document whose next one it is, by descending id; the highest id comes after the lowest.

    ``docs`` has the id and ``n_chars``. Ids are ranked within ranges; ranges hand their highest id down. Null ids have no place, a repeated one has
    one place with its longest text.
    """
    ids = docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max("n_chars").alias("n_chars"))
    ranges = settle(ids.repartitionByRange(doc_id).select("*", F.spark_partition_id().alias("_range")), "ids-in-ranges")
    up = Window.partitionBy("_range").orderBy(doc_id)
    # One row per range.
    edges = ranges.groupBy("_range").agg(F.min(F.struct(doc_id, "n_chars")).alias("_low"))
    by_range = Window.orderBy("_range")
    edges = edges.select(
        "_range",
        F.coalesce(F.lead("_low").over(by_range), F.first("_low").over(by_range.rowsBetween(Window.unboundedPreceding, 0))).alias("_above"),
    )
    held = F.struct(doc_id, "n_chars")
    return (
        ranges.withColumn("_before", F.lead(held).over(up))
        .join(edges, "_range")
        .withColumn("_before", F.coalesce("_before", "_above"))
        .select(doc_id, F.col(f"_before.{doc_id}").alias("before_id"), F.col("_before.n_chars").alias("before_chars"))
    )


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Texts with their edited texts, whose last third is the start of the next document, and the sketches of both and of the next text.

    Next is the document with the next lower id. Rows with a null id have no next document, and their last third goes. Texts are shuffled once, by
    id: the join that finds whose next document a row is and the join that brings its start there read the same exchange.
    """
    texts = docs.select("doc_id", whole("text").alias("text"))
    sized = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    order = settle(neighbours(sized), "fingerprint-order")
    named = texts.filter("doc_id is not null")
    heads = named.join(order, "doc_id").select(
        F.col("before_id").alias("doc_id"),
        F.substring("text", F.lit(1), _third(F.col("before_chars"))).alias("head"),
        sketch(F.col("text"), k).alias("next_sketch"),
    )
    if named.count() > order.count():  # of a repeated id's texts, the first in order
        heads = heads.groupBy("doc_id").agg(F.min(F.struct("head", "next_sketch")).alias("_first")).select("doc_id", "_first.*")
    none = F.array().cast("array<bigint>")
    alone = texts.filter("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), none.alias("next_sketch"))
    both = named.join(heads, "doc_id").select("doc_id", "text", "head", "next_sketch").unionByName(alone)
    chars = F.length("text")
    cut = _third(chars)
    new = F.concat(F.substring("text", F.lit(1), chars - cut), F.substring("head", F.lit(1), cut))
    told = both.select("doc_id", "text", chars.cast("long").alias("n_chars"), new.alias("edited_text"), "next_sketch")
    return told.withColumns({"sketch": sketch(F.col("text"), k), "edited_sketch": sketch(F.col("edited_text"), k)})
