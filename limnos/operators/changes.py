"""Applying change sets to base tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.text import natural_id
from limnos.operators.graph import components_by_range
from limnos.session import settle

ACCEPTED = "accepted"
# The reason of a row that does not say where it comes in the order.
UNORDERED = "no place in the order"

# Rounds in which rows that are first for all their keys go ahead, and rows of one component that a task settles at a time.
ROUNDS = 2
BLOCK = 200_000


def with_defaults(df: DataFrame, defaults: Mapping[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """New rows with defaults where a column is missing or null, and an ``id`` from the natural ``key``.

    ``defaults`` holds columns, so that a load time or a random id is named by the caller.
    """
    filled = {
        name: F.coalesce(F.col(name), value) if name in df.columns else value for name, value in defaults.items()
    }
    named = df.withColumns(filled)
    return named.withColumn("id", natural_id(*key)) if key else named


def keyed(new: DataFrame, key: Sequence[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Split ``new`` into rows with an ``id`` from their natural ``key`` and rows set apart with a ``reason``.

    A key with a null in it names nothing, and of rows with one key only the first by ``seq`` gets its id, so ids are unique.
    """
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    unnamed = new.filter(missing).withColumn("reason", F.lit("no natural key"))
    first, again = insert_unique(new.limit(0), new.filter(~missing), {"natural key repeated": key}, seq)
    return first.withColumn("id", natural_id(*key)), unnamed.unionByName(again)


def insert_unique(
    base: DataFrame, new: DataFrame, keys: Mapping[str, Sequence[str]], seq: str, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Split ``new`` into accepted rows and rejected rows with a ``reason``.

    ``keys`` maps a reason to the columns that must be unique, checked in that order. A row is
    rejected when ``base`` or an earlier accepted row (by ``seq``, which is unique) has the same key; a
    key with a null in it is free. A row without ``seq`` has no place in the order: it is rejected, whatever its keys.

    With one key the first row of each key decides everything. With several, rows that are first for all their keys are accepted and those
    that these rule out rejected, ``ROUNDS`` times; that settles nearly all of a usual batch. What is left are chains, in which each row
    waits for the one before: components of rows that share keys are independent, and a task settles them row by row. Of a component above
    ``block`` rows the first ``block`` are settled, which rules out rows that need not be looked at one by one; what is left goes round again, in one piece
    unless its task comes to hold ``block`` keys that are taken and asked for by later rows.
    """
    columns = new.columns
    unplaced = new.filter(F.col(seq).isNull()).select(*columns, F.lit(UNORDERED).alias("reason"))
    new = new.filter(F.col(seq).isNotNull())
    if len(keys) == 1:
        ((reason, cols),) = keys.items()
        known = base.select(*cols).dropna().distinct().withColumn("_known", F.lit(True))
        judged = _look_up(new, _firsts(new, cols, seq).join(known, list(cols), "left"), cols)
        refused = F.coalesce("_known", F.lit(False)) | F.coalesce(F.col("_first") != F.col(seq), F.lit(False))
        return (
            judged.filter(~refused).select(*columns),
            judged.filter(refused).select(*columns, F.lit(reason).alias("reason")).unionByName(unplaced),
        )

    accepted: list[DataFrame] = []
    rejected: list[DataFrame] = []
    pending = new
    for cols in keys.values():
        known = base.select(*cols)
        rejected.append(pending.join(known, list(cols), "left_semi").select(*columns))
        pending = pending.join(known, list(cols), "left_anti").select(*columns)
    pending = settle(pending, "pending")
    turn, told = 0, None
    while not pending.isEmpty():
        if turn < ROUNDS:
            judged = _first_of_all(pending, keys, seq)
        else:
            told = _told_apart(pending, keys, seq, block) if told is None else told
            judged = _in_components(pending, told, seq, block if turn == ROUNDS else None, block)
        turn += 1
        won = judged.filter("_wins").select(*columns)
        accepted.append(won)
        rejected.append(judged.filter(~F.col("_wins")).select(*columns))
        rest = judged.filter(F.col("_wins").isNull()).select(*columns)
        hit = F.lit(False)
        for i, cols in enumerate(keys.values()):
            taken = won.select(*cols).dropna().withColumn(f"_taken{i}", F.lit(True))
            rest = rest.join(taken, list(cols), "left")
            hit = hit | F.col(f"_taken{i}").isNotNull()
        rest = settle(rest.withColumn("_hit", hit).select(*columns, "_hit"), "rest")
        rejected.append(rest.filter("_hit").drop("_hit"))
        pending = rest.filter(~F.col("_hit")).drop("_hit")
    taken = settle(_union(accepted or [pending]), "accepted")
    return taken, _with_reason(_union(rejected), base, taken, keys, seq).unionByName(unplaced)


def _first_of_all(pending: DataFrame, keys: Mapping[str, Sequence[str]], seq: str) -> DataFrame:
    """``pending`` with ``_wins``: true for rows that are first for all their keys, null for others."""
    ranked, wins = pending, F.lit(True)
    for i, cols in enumerate(keys.values()):
        ranked = _look_up(ranked, _firsts(pending, cols, seq), cols).withColumnRenamed("_first", f"_first{i}")
        wins = wins & F.coalesce(F.col(f"_first{i}") == F.col(seq), F.lit(True))
    return settle(ranked.withColumn("_wins", F.when(wins, True)).select(*pending.columns, "_wins"), "ranked")


def _told_apart(pending: DataFrame, keys: Mapping[str, Sequence[str]], seq: str, block: int) -> DataFrame:
    """For each of ``pending``: ``seq``, ``_component`` of rows that share keys and for each key its first and last ``seq``, null where it is free."""
    told = pending
    for i, cols in enumerate(keys.values()):
        ends = pending.dropna(subset=list(cols)).groupBy(*cols).agg(F.min(seq).alias(f"_first{i}"), F.max(seq).alias(f"_last{i}"))
        told = _look_up(told, ends, cols)
    told = settle(told.select(seq, *[f"_{end}{i}" for end in ("first", "last") for i in range(len(keys))]), "told")
    # Every row of a key is linked with the key's first, so a key with many rows makes as many links and no pairs.
    links = _union([told.select(F.col(f"_first{i}").alias("a"), F.col(seq).alias("b")) for i in range(len(keys))])
    labels = components_by_range(links, block).withColumnRenamed("id", seq)
    # Rows that share no key any more stay independent, so labels hold for what is left of a component.
    return settle(told.join(labels, seq, "left").withColumn("_component", F.coalesce("component", seq)).drop("component"), "components")


def _in_components(pending: DataFrame, told: DataFrame, seq: str, rows: int | None, block: int) -> DataFrame:
    """``pending`` with ``_wins``: the verdict for the first rows of every component, null for others. A component is settled up to ``rows`` rows, if given,
    and as long as its task holds fewer than ``block`` keys that later rows ask for."""
    part = "_component"
    left = told.join(pending.select(seq).distinct(), seq, "left_semi")
    number = (len(told.columns) - 2) // 2
    held = [f"_{end}{i}" for end in ("first", "last") for i in range(number)]
    kind = pending.schema[seq].dataType.simpleString()
    verdicts = (
        left.repartition(part).sortWithinPartitions(part, seq).select(part, F.col(seq).alias("seq"), *held)
        .mapInArrow(_one_by_one(number, rows, block), f"seq {kind}, wins boolean")
    )
    verdicts = settle(verdicts.select(F.col("seq").alias(seq), F.col("wins").alias("_wins")), "verdicts")
    return settle(pending.join(verdicts, seq, "left").select(*pending.columns, "_wins"), "judged")


def _one_by_one(number: int, rows: int | None, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verdicts in order, over rows sorted by component and then by their place in it: a row wins if nobody before it took one of its keys.
    A key is forgotten once its last row has been judged."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, judged, full = None, None, 0, False
        taken: set[tuple] = set()
        ending: list[tuple] = []
        for batch in batches:
            if full and batch.num_rows and batch.column(0)[-1].as_py() == at:
                continue
            told, wins = [], []
            components, places, *held = (column.to_pylist() for column in batch.columns)
            firsts, lasts = zip(*held[:number], strict=True), zip(*held[number:], strict=True)
            for row, (component, place, first, last) in enumerate(zip(components, places, firsts, lasts, strict=True)):
                if component != at:
                    at, now, judged, full = component, None, 0, False
                    taken.clear()
                    ending.clear()
                if place != now:
                    taken.difference_update(ending)
                    ending.clear()
                    now, full = place, full or len(taken) >= block or judged == rows
                    judged += 1
                if full:
                    continue
                mine = [key for key in enumerate(first) if key[1] is not None]
                won = taken.isdisjoint(mine)
                if won:
                    taken.update(mine)
                ending += [(i, key) for i, key in mine if last[i] == place]
                told.append(row)
                wins.append(won)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(told, pa.int64())), pa.array(wins, pa.bool_())], ["seq", "wins"])

    return walk


def _with_reason(
    refused: DataFrame, base: DataFrame, accepted: DataFrame, keys: Mapping[str, Sequence[str]], seq: str
) -> DataFrame:
    """The first key, in the order of ``keys``, that the base or a row accepted earlier has."""
    judged, reason = refused, None
    for i, (name, cols) in enumerate(keys.items()):
        held = base.select(*cols).dropna().distinct().withColumn(f"_by{i}", F.lit(None).cast(accepted.schema[seq].dataType))
        own = accepted.dropna(subset=list(cols)).select(*cols, F.col(seq).alias(f"_by{i}"))
        holders = held.unionByName(own).withColumn(f"_held{i}", F.lit(True))
        judged = judged.join(settle(holders, "holders"), list(cols), "left")
        hit = F.col(f"_held{i}") & (F.col(f"_by{i}").isNull() | (F.col(f"_by{i}") < F.col(seq)))
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return judged.withColumn("reason", reason).select(*refused.columns, "reason")


def _firsts(df: DataFrame, cols: Sequence[str], seq: str) -> DataFrame:
    """The lowest ``seq`` of every key without a null: a key that many rows share is combined before the shuffle."""
    return df.dropna(subset=list(cols)).groupBy(*cols).agg(F.min(seq).alias("_first"))


def _look_up(df: DataFrame, table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the row of ``table`` for its key.

    The table is written first. Joined straight from its aggregate it would lend the join its
    partitioning, and adaptive execution could not split a key that many rows of ``df`` share.
    """
    return df.join(settle(table, "lookup"), list(cols), "left")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def apply_updates(
    base: DataFrame, changes: DataFrame, key: str, seq: str, fields: Sequence[str] | None = None
) -> DataFrame:
    """``base`` after partial updates: per field the last given (non-null) value by ``seq`` wins.

    Changes of unknown keys are ignored; see :func:`unknown_keys`. Changes of one key are combined before the shuffle.
    """
    fields = fields or [c for c in changes.columns if c not in (key, seq)]
    last = changes.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f"_new_{f}") for f in fields]
    )
    updated = base.join(last, key, "left")
    return updated.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).select(*base.columns)


def unknown_keys(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes whose key is not in ``base``."""
    return changes.join(base.select(key), key, "left_anti")


def without_duplicates(
    base: DataFrame, changes: DataFrame, key: str, seq: str, unique: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, DataFrame]:
    """Split updates into those that keep the unique columns unique and those that do not, with ``reason``.

    The new key is the given value where there is one, else the row's current one. A change may keep its
    own value; it may not take one that another row holds or that an earlier change of another row asks for. A change without ``seq``
    has no place in the order and is refused; of changes with one ``seq`` the smallest ``key`` comes first.
    """
    unplaced = changes.filter(F.col(seq).isNull()).withColumn("reason", F.lit(UNORDERED))
    changes = changes.filter(F.col(seq).isNotNull())
    current = base.select(key, *{c for cols in unique.values() for c in cols})
    columns = changes.columns
    verdict = None
    for reason, cols in unique.items():
        own = current.select(key, *[F.col(c).alias(f"_own_{c}") for c in cols])
        wanted = changes.join(own, key, "left")
        for c in cols:
            given = F.col(c) if c in columns else F.lit(None)
            wanted = wanted.withColumn(f"_want_{c}", F.coalesce(given, f"_own_{c}"))
        wants = [f"_want_{c}" for c in cols]
        keeps = reduce(lambda a, b: a & b, [F.col(f"_want_{c}").eqNullSafe(F.col(f"_own_{c}")) for c in cols])
        wanted = wanted.withColumn("_keeps", keeps)
        holders = current.select(*[F.col(c).alias(f"_want_{c}") for c in cols], F.lit(True).alias("_held")).dropna()
        asks = (
            wanted.filter(~F.col("_keeps"))
            .dropna(subset=wants)
            .groupBy(*wants)
            .agg(F.min_by(key, F.struct(seq, key)).alias("_winner"))
        )
        decided = _look_up(wanted, asks.join(holders.distinct(), wants, "left"), wants)
        bad = ~F.col("_keeps") & (F.coalesce("_held", F.lit(False)) | (F.col("_winner") != F.col(key)))
        changes = decided.withColumn(f"_bad_{reason}", F.coalesce(bad, F.lit(False))).select(
            *changes.columns, f"_bad_{reason}"
        )
        flag = F.col(f"_bad_{reason}")
        verdict = F.when(flag, reason) if verdict is None else verdict.when(flag, reason)
    judged = changes.withColumn("reason", verdict).select(*columns, "reason")
    refused = judged.filter(F.col("reason").isNotNull()).unionByName(unplaced)
    return judged.filter(F.col("reason").isNull()).drop("reason"), refused


def soft_delete(base: DataFrame, keys: DataFrame, key: str, at: Column) -> DataFrame:
    """``base`` with the rows named in ``keys`` stamped; rows already deleted keep their stamp."""
    named = keys.select(key).distinct().withColumn("_named", F.lit(True))
    marked = base.join(named, key, "left")
    hit = F.coalesce("_named", F.lit(False))
    stamp = F.when(hit, F.coalesce(F.col("deleted_at"), at)).otherwise(F.col("deleted_at"))
    result = marked.withColumn("deleted_at", stamp)
    if "is_deleted" in base.columns:
        result = result.withColumn("is_deleted", F.col("is_deleted") | hit)
    return result.select(*base.columns)


def hard_delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``base`` without the rows named in ``keys``."""
    return base.join(keys.select(key).distinct(), key, "left_anti")
