"""Spelling variants by a dictionary of pairs of trie nodes.

A word's beginnings are nodes of a trie of all words, its ends are nodes of the trie of the reversed words. Nodes are numbered, and a word enters the
dictionary under pairs of numbers (node of a beginning, node of an end): once for each position that is skipped between the two, and once for each
gap at which a character could be inserted. Words that meet in a pair differ there in one character, and only there:

* two words that skip the same position differ by a replacement,
* a word that skips a position and a word with a gap there differ by an insertion. In a run of equal characters only the first is
  skipped for this, so a pair of words meets once.

What a beginning and an end leave open is one character, so no more words meet in a pair than the alphabet has characters, and one word at most has
its gap there. Nodes of depth ``SHALLOW`` and less, which many words share, are numbered by their characters; deeper ones by a table. Deeper nodes that one word
alone has cannot meet another and are left out. Counting is the only Python here; all else is joins on numbers.

Null texts have no words, null ids read as an empty id, repeated rows count as often as they occur, words that occur in other columns play no part, and an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.files import ship
from limnos.llm.words import whole
from limnos.session import settle

LEAST_CHARS, LEAST_COUNT = 6, 5
# One run in so many, by hash, loses a character.
EVERY = 199
# A form occurs so many times as often as its variant, at least.
RATIO = 5
# Depth up to which nodes are numbered by their characters: three of 21 bits fit a whole number.
SHALLOW = 3
# Distinct words that a task counts before it hands them on.
HELD = 200_000


def noisy(run: str, start: int) -> str:
    """The run, or the run without one character if its hash says so. ``start`` is the hash of what stands before it."""
    value = zlib.crc32(run.encode(), start)
    if value % EVERY:
        return run
    at = value % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n``, its occurrences, for words of LEAST_CHARS characters and LEAST_COUNT occurrences or more."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs only get shorter.
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}")
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # Lower case of bytes changes A to Z only.
                for run, n in Counter(runs.findall(raw.as_py().encode().lower().decode())).items():
                    word = noisy(run, start)
                    if len(word) >= LEAST_CHARS:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    ship(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string"), whole(text).alias("text")).mapInArrow(rows, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _packed(part: Column) -> Column:
    """The number of a node of depth SHALLOW or less: its characters, 21 bits each."""
    number = F.lit(0).cast("bigint")
    for at in range(1, SHALLOW + 1):
        char = F.substring(part, at, 1)
        number = F.when(char == "", number).otherwise(F.shiftleft(number, 21) + F.ascii(char) + 1)
    return number


def _numbered(keys: DataFrame, part: str, nodes: DataFrame, name: str) -> DataFrame:
    """``keys`` with the node number of their ``part`` in place of it. Deep nodes are negative, shallow ones are not."""
    shallow = keys.filter(F.length(part) <= SHALLOW).withColumn(name, _packed(F.col(part)))
    deep = keys.filter(F.length(part) > SHALLOW).join(nodes.select(F.col("node").alias(part), F.col("number").alias(name)), part)
    return shallow.drop(part).unionByName(deep.drop(part))


def _nodes(words: DataFrame, beginning: bool) -> DataFrame:
    """Deep nodes (``node``, ``number``) that two words or more share. Settled, so that every reader sees the same numbers."""
    depth = F.sequence(F.lit(SHALLOW + 1), F.length("word"))
    own = words.filter(F.length("word") > SHALLOW).select("word", F.explode(depth).alias("depth"))
    node = F.expr("left(word, depth)" if beginning else "right(word, depth)").alias("node")
    shared = own.groupBy(node).agg(F.count("*").alias("n")).filter("n > 1")
    return settle(shared.select("node", (-1 - F.monotonically_increasing_id()).alias("number")), "spell-nodes")


def dictionary(words: DataFrame) -> DataFrame:
    """Entries (``head``, ``tail``, ``word``, ``n``, ``skips``, ``first``): pairs of node numbers, whether the word skips a position there, and whether
    that is the first of a run of equal characters."""
    long = F.length("word")
    skip = F.transform(
        F.sequence(F.lit(0), long - 1),
        lambda i: F.struct(i.alias("at"), (i + 1).alias("on"), ((i == 0) | (F.substr("word", i + 1, F.lit(1)) != F.substr("word", i, F.lit(1)))).alias("first")),
    )
    gap = F.transform(F.sequence(F.lit(0), long), lambda i: F.struct(i.alias("at"), i.alias("on"), F.lit(False).alias("first")))
    entries = words.select("word", "n", F.explode(F.concat(skip, gap)).alias("e"))
    keys = entries.select(
        "word", "n", (F.col("e.on") > F.col("e.at")).alias("skips"), "e.first",
        F.expr("left(word, e.at)").alias("_head"), F.expr("right(word, length(word) - e.on)").alias("_tail"),
    )
    heads = _numbered(keys, "_head", _nodes(words, True), "head")
    return _numbered(heads, "_tail", _nodes(words, False), "tail")


def _better(a: Column, b: Column) -> Column:
    """The more frequent of two (n, word), the smaller word of equal ones; null is worst."""
    wins = (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["word"] < b["word"]))
    return F.when(b.isNull() | (a.isNotNull() & wins), a).otherwise(b)


def neighbours(words: DataFrame) -> DataFrame:
    """For words with near words: ``word``, ``n_near``, and the most frequent near word as ``best`` (n, word)."""
    met = dictionary(words).groupBy("head", "tail").agg(F.collect_list(F.struct("word", "n", "skips", "first")).alias("met")).filter(F.size("met") > 1)

    def near(mine: Column) -> Column:
        # A word can have its gap beside its own skipped run; that is the word itself with a character less or more, never the word.
        return F.filter("met", lambda x: (x["skips"] & mine["skips"] & (x["word"] != mine["word"])) | (x["first"] & ~mine["skips"]) | (~x["skips"] & mine["first"]))

    nothing = F.lit(None).cast("struct<word:string,n:bigint>")
    told = F.transform(
        "met",
        lambda mine: F.struct(
            mine["word"].alias("word"), F.size(near(mine)).alias("n_near"),
            F.aggregate(near(mine), nothing, lambda best, x: _better(F.struct(x["word"].alias("word"), x["n"].alias("n")), best)).alias("best"),
        ),
    )
    each = met.select(F.explode(told).alias("t")).select("t.*").filter("n_near > 0")
    # Larger is better under (n, word in descending order); the smallest word of the largest n.
    order = F.struct((-F.col("best.n")).alias("few"), F.col("best.word").alias("word"))
    found = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("o"))
    return found.select("word", "n_near", F.struct((-F.col("o.few")).alias("n"), F.col("o.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of its chain of forms, for rows ``word``, ``form`` with a form. Counts grow along a chain, so it ends; every round
    doubles the reach of each word."""
    reach = settle(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spell-reach")
    while True:
        above = reach.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        jumped = reach.join(above, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved"))
        jumped = settle(jumped, "spell-reach")
        reach = jumped.select("word", "root")
        if jumped.filter("_moved").isEmpty():
            return reach


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of ``docs``."""
    words = settle(counted(docs, text), "spell-words")
    near = words.join(neighbours(words), "word", "left")
    fits = F.col("best.n") >= RATIO * F.col("n")
    judged = settle(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(fits, F.col("best.word")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n"),
        ),
        "spell-judged",
    )
    return judged.join(roots(judged), "word", "left").withColumn("root", F.coalesce("root", "word"))
