"""Conversations out of reply trees.

A message names the message it answers. ``paths`` enumerates the paths from roots to leaves by self-joins that double their reach:
after round k every message knows its ancestor 2^k steps up and the score of the steps between, so rounds grow with the logarithm
of the depth. Branches are ranked by the sum of their scores, and chosen ones are walked from the leaf by the same jumps, which
meets every message of a path exactly once. ``formatted`` writes a path as one conversation.

Template: per turn ``<turn:role``, a line break, the text, a line break, ``</turn>``, a line break. In roles and texts ``\\`` is written
``\\s``, ``<`` is ``\\l``; in roles a line break is ``\\n``. So no text holds a mark, and ``read_back`` gives the turns as they were.

Defined cases: null texts and roles are empty; a message whose parent is null or missing is a root; a null score is 0; messages on a cycle
are below no root and belong to no path. Message ids are unique and not null (``from_turns`` makes such ids for any rows). One conversation
is one row of output, so its texts meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.words import let
from limnos.session import settle

# Fixed values of the template.
OPEN, CLOSE = "<turn:", "\n</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Each backslash of an escaped text starts a pair, so pairs can be put back one kind after the other."""
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def from_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of linear conversations: every turn answers the one before it.

    Null keys form one conversation, null turns come first, equal turns are ordered by role and text.
    """
    by_turn = Window.partitionBy(key).orderBy(F.col(turn).asc_nulls_first(), "role", "text")
    place = F.row_number().over(by_turn)
    # A key that reads "null", or anything else, is none that is null.
    tree = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    return rows.select(key, "role", "text", place.alias("_at")).select(
        F.concat_ws(":", tree, F.col("_at")).alias("message_id"),
        F.when(F.col("_at") > 1, F.concat_ws(":", tree, F.col("_at") - 1)).alias("parent_id"),
        F.col(key).alias("conv_id"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Chosen paths as ``path_id`` (the leaf), ``message_id`` and ``up`` (steps from the leaf).

    ``branches`` paths of each root stay, the best sums of scores first, then the lowest leaf id; None keeps all.
    """
    nodes = messages.select("message_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("message_id").alias("parent_id"))
    linked = nodes.join(known, "parent_id", "left_semi")
    parents = settle(linked, "chat-parents")
    start = nodes.join(parents.select("message_id", F.col("parent_id").alias("up_id")), "message_id", "left")
    # Per message: ancestor up_id at 2^k steps, or top: the root that lies nearer, and the sum of scores below up_id or down to the root.
    level = settle(
        start.select(
            "message_id", "up_id", F.col("score").alias("sum"), F.when(F.col("up_id").isNull(), F.col("message_id")).alias("top")
        ),
        "chat-jumps",
    )
    jumps, done, climbing = [], [level.filter("up_id is null")], level.filter("up_id is not null")
    limit = max(1, nodes.count()).bit_length()
    while len(jumps) <= limit and not climbing.isEmpty():
        # Only messages that have not met their root go on.
        jumps.append(climbing.select("message_id", "up_id"))
        above = reduce(DataFrame.unionByName, [*done, climbing]).select(
            F.col("message_id").alias("up_id"), F.col("up_id").alias("_next"), F.col("sum").alias("_sum"), F.col("top").alias("_top")
        )
        level = settle(
            climbing.join(above, "up_id", "left").select(
                "message_id",
                F.col("_next").alias("up_id"),
                (F.col("sum") + F.coalesce("_sum", F.lit(0.0))).alias("sum"),
                F.coalesce("top", "_top").alias("top"),
            ),
            "chat-jumps",
        )
        done.append(level.filter("up_id is null"))
        climbing = level.filter("up_id is not null")
    level = reduce(DataFrame.unionByName, done)
    leaves = level.filter("top is not null").join(parents.select(F.col("parent_id").alias("message_id")), "message_id", "left_anti")
    if branches is not None:
        best = Window.partitionBy("top").orderBy(F.desc("sum"), "message_id")
        leaves = leaves.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= branches)
    reached = settle(leaves.select(F.col("message_id").alias("path_id"), "message_id", F.lit(0).alias("up")), "chat-paths")
    for k in reversed(range(len(jumps))):
        further = reached.join(jumps[k], "message_id").select(
            "path_id", F.col("up_id").alias("message_id"), (F.col("up") + 2**k).alias("up")
        )
        reached = settle(reached.unionByName(further), "chat-paths")
    return reached


def formatted(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per path: ``path_id``, ``conv_id`` of its leaf, ``formatted`` and ``loss_spans``, the (first, length) in code points
    of every trained text in it."""
    turn = F.struct(
        -F.col("up"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "conv_id"
    )
    turns = F.array_sort(F.collect_list(turn))
    head = F.transform("_turns", lambda t: F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
    body = F.transform("_turns", lambda t: escaped(t["text"]))
    whole_text = F.concat(F.array_join(F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b)), CLOSE), F.lit(CLOSE))
    trained = F.transform("_turns", lambda t: t["role"] == TRAINED_ROLE)
    # Ends of the turns so far, each text lying between its head and the closing mark.
    parts = F.arrays_zip(
        F.transform("_heads", lambda h: F.length(h)).alias("head"), F.transform("_bodies", lambda b: F.length(b)).alias("body"),
        trained.alias("trained"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,length:int>>").alias("spans"))

    def step(so_far: Column, part: Column) -> Column:
        first = so_far["at"] + part["head"]
        span = F.array(F.struct(first.alias("first"), part["body"].alias("length")))
        spans = F.when(part["trained"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct((first + part["body"] + len(CLOSE)).alias("at"), spans.alias("spans"))

    return (
        chosen.join(messages.select("message_id", "role", "text", "conv_id"), "message_id")
        .groupBy("path_id")
        .agg(turns.alias("_turns"))
        .withColumn("_heads", head)
        .withColumn("_bodies", body)
        .select(
            "path_id",
            F.element_at("_turns", -1)["conv_id"].alias("conv_id"),
            whole_text.alias("formatted"),
            F.aggregate(parts, empty, step)["spans"].alias("loss_spans"),
        )
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and trained texts out of what ``formatted`` wrote: ``turns`` (role, text) and ``loss_text``."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    turns = F.transform(
        pieces,
        lambda t: let(
            F.instr(t, "\n"),
            lambda end: F.struct(
                unescaped(F.substring(t, F.lit(len(OPEN) + 1), end - (len(OPEN) + 1))).alias("role"),
                unescaped(F.substring(t, end + 1, F.length(t))).alias("text"),
            ),
        ),
    )
    trained = F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["first"] + 1, s["length"])))
    return conversations.withColumn("turns", turns).withColumn("loss_text", F.array_join(trained, ""))
