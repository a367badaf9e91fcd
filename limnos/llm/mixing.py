"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source is a stream: its documents one after another, in the order of a seeded hash. The stream is cut into blocks
of ``block`` words. ``quotas`` deals as many blocks as the corpus has to the sources, one after another to the highest
quotient target / (2 * blocks so far + 1), and splits each source's quota over shards. Shards then
take consecutive blocks of the stream, which starts over at its end, so a quota above the number of blocks repeats documents.
``dealt`` tells which words of a document go to which shard, and in which blocks they lie.

Null texts have size 0; a null source is a source of its own and comes last. Rows that agree in id and size are
interchangeable: either may stand first. Empty input gives empty output. Columns of the input are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.words import WORD, lane_of, whole
from limnos.session import settle

# Weights in turn, and how often a source may be repeated.
WEIGHTS = (1, 2, 3)
REPEATS = 3


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _key(source: Column) -> Column:
    """Text that joins as the source does, null included."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Targets share the sum of all sizes by weight. One above ``repeats`` times its size stops there, and the rest is
    shared again. In the order of cap / weight the capped sources come first, so running sums find the last one.
    The windows hold one row per source.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(in_turn) - 1) % len(weights))
    ranked = sources.select("*", weight.cast("double").alias("_w"), (F.col("source_size") * repeats).alias("_cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    open_level = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level"))
    # The level rises while capped sources leave, so the first open source has the highest of the open ones.
    share = F.max(open_level).over(everything) * F.col("_w")
    return (
        ranked.select("*", level.alias("_level"))
        .select("*", F.coalesce(F.least(F.col("_cap").cast("double"), share), F.col("_cap").cast("double")).alias("target"))
        .drop("_w", "_cap", "_level")
    )


def quotas(sources: DataFrame, block: int, shards: int = 16, repeats: int = REPEATS) -> DataFrame:
    """Add ``n_blocks`` and ``quota`` (blocks to take) to one row per source with ``target``, and ``shard_quotas``.

    Between total / (2 N + S) and total / (2 N - S) lies the last of the N highest quotients of S sources. What is above
    is granted at once, and only the few quotients between are ranked.
    """
    everything = Window.partitionBy()
    total, rows = F.sum("target").over(everything), F.sum(F.when(F.col("target") > 0, 1).otherwise(0)).over(everything)
    seats = F.ceil(total / block)
    sized = sources.select(
        "*",
        F.ceil(F.col("source_size") / block).alias("n_blocks"),
        seats.alias("_seats"),
        F.when(2 * seats > rows, F.floor((F.col("target") * (2 * seats - rows) / total + 1) / 2) - 1).alias("_sure"),
        (F.floor((F.col("target") * (2 * seats + rows) / total + 1) / 2) + 1).alias("_most"),
    ).withColumn("_sure", F.greatest(F.coalesce(F.col("_sure"), F.lit(0)), F.lit(0)))
    open_seats = F.explode(F.sequence(F.col("_sure"), F.col("_most")))
    quotient = F.col("target") / (2 * F.col("_seat") + 1)
    contested = (
        sized.filter("target > 0")
        .select("source", "target", "_seats", "_sure", open_seats.alias("_seat"))
        .select("*", F.row_number().over(Window.orderBy(quotient.desc(), F.col("source").asc_nulls_last(), "_seat")).alias("_n"))
        .join(sized.agg(F.sum("_sure").alias("_granted")))
        .filter(F.col("_n") <= F.col("_seats") - F.col("_granted"))
        .groupBy(_key(F.col("source")).alias("_key"))
        .agg(F.count("*").alias("_won"))
    )
    won = F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))
    granted = sized.join(contested, _key(sized["source"]) == contested["_key"], "left").withColumn(
        "quota", F.least(won, repeats * F.col("n_blocks"))
    )
    # The odd blocks of one source go on at the shard where those of the source before it ended.
    odd = F.col("quota") % shards
    turn = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per_shard = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(F.col("quota") / shards) + F.when(F.pmod(s - F.col("_turn"), F.lit(shards)) < odd, 1).otherwise(0),
    )
    return (
        granted.withColumn("_turn", F.coalesce(F.sum(odd).over(turn), F.lit(0)))
        .withColumn("shard_quotas", per_shard)
        .drop("_seats", "_sure", "_most", "_key", "_won", "_turn")
    )


def _placed(docs: DataFrame, size: Column, source: str, doc_id: str, seed: int, lanes: int) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col(doc_id))
    return docs.select(
        F.struct("*").alias("_row"),
        F.col(doc_id).alias("_id"),
        size.alias("_size"),
        _key(F.col(source)).alias("_key"),
        order.alias("_order"),
        lane_of(F.lit(seed + 1), F.col(doc_id), size, lanes=lanes).alias("_lane"),
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    block: int = 1024,
    seed: int = 7,
    shards: int = 16,
    lanes: int = 1024,
    repeats: int = REPEATS,
) -> DataFrame:
    """``docs`` as ``_row`` with ``size``, ``source_size``, ``target``, ``first`` (place in its source's stream),
    ``rounds`` (times that the whole stream is taken), ``edge`` (end of the part that is taken once more), ``block``, ``n_blocks`` of the
    stream and ``ends``: the block at which each shard stops, counted on when the stream starts over; the next shard starts there.

    A stream is summed in ``lanes`` slices, so no source is sorted by one task.
    """
    size = word_count("text") if size is None else size
    placed = _placed(docs, size, source, doc_id, seed, lanes)
    sums = settle(
        placed.groupBy("_key", F.col(f"_row.{source}").alias("source"), "_lane").agg(F.sum("_size").alias("lane_size")),
        "mix-lanes",
    )
    sources = targets(sums.groupBy("source").agg(F.sum("lane_size").alias("source_size")), repeats=repeats)
    plan = settle(quotas(sources, block, shards, repeats), "mix-plan")
    earlier = Window.partitionBy("_key").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes_at = sums.select("_key", "_lane", F.coalesce(F.sum("lane_size").over(earlier), F.lit(0)).alias("_at"))
    rounds = F.floor(F.coalesce(F.col("quota") / F.nullif(F.col("n_blocks"), F.lit(0)), F.lit(0.0)))
    ends = F.transform(
        "shard_quotas", lambda _, s: F.aggregate(F.slice("shard_quotas", F.lit(1), s + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    )
    plan = plan.select(
        _key(F.col("source")).alias("_key"), "source_size", "target", "quota",
        rounds.alias("rounds"),
        F.least((F.col("quota") - rounds * F.col("n_blocks")) * block, F.col("source_size")).alias("edge"),
        "n_blocks", ends.alias("ends"),
    )
    lane_plan = settle(lanes_at.join(plan, "_key"), "mix-starts")
    within = Window.partitionBy("_key", "_lane").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in_lane", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(lane_plan, ["_key", "_lane"])
        .select(
            "_row", F.col("_size").alias("size"), "source_size", "target", "rounds", "edge",
            F.lit(block).cast("long").alias("block"), "n_blocks", "ends",
            (F.col("_at") + F.col("_in_lane")).alias("first"),
        )
    )


def dealt() -> Column:
    """Parts of a document that shards take, in order: ``shard``, ``round`` (from 0), ``start`` and ``stop`` in words of the document,
    ``first_block`` and ``last_block`` of its source's stream."""
    block = F.col("block")

    def of_round(r: Column) -> Column:
        at = r * F.col("n_blocks") * block + F.col("first")

        def part(end: Column, s: Column) -> Column:
            begin = F.when(s > 0, F.get("ends", s - 1)).otherwise(0)
            start = F.greatest(begin * block - at, F.lit(0))
            stop = F.least(end * block - at, F.col("size"))
            return F.struct(
                s.alias("shard"), r.alias("round"), start.alias("start"), stop.alias("stop"),
                F.floor((F.col("first") + start) / block).alias("first_block"), F.floor((F.col("first") + stop - 1) / block).alias("last_block"),
            )

        return F.filter(F.transform("ends", part), lambda p: p["stop"] > p["start"])

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds").cast("long")), of_round))


def taken() -> Column:
    """Words of a document that the shards take, repeats counted."""
    return F.aggregate(dealt(), F.lit(0).cast("long"), lambda total, p: total + p["stop"] - p["start"])


def copies() -> Column:
    """Times that the whole document is taken, when documents are not cut: those whose middle word is."""
    return (F.col("rounds") + F.when(F.col("first") + F.col("size") / 2 < F.col("edge"), 1).otherwise(0)).cast("int")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    mixed = mix(docs, **options).withColumn("_copies", copies()).filter("_copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def shard_parts(docs: DataFrame, **options) -> DataFrame:
    """``_row``, the columns of ``docs``, with one row per part of :func:`dealt`: a shard's blocks are its rows."""
    return mix(docs, **options).select("_row", F.explode(dealt()).alias("_part")).select("_row", "_part.*")
