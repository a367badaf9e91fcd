"""Quality rules as a short-circuit cascade.

``measured`` adds what rules look at. A ``Rule`` says which rows it rejects. ``estimate`` times every rule on a bounded
sample and counts what it rejects there; ``cascade`` asks the rules in order of rejection per second and leaves a row
at the first that rejects it. The order decides how long this takes and never which rows stay: a row is kept if no rule rejects it.

Null texts are empty texts and have no words. Texts of any length are measured whole. An empty table has no sample, and
rules keep the given order. Repeated rows are judged alike.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.words import BLANKS, let, whole, words
from limnos.session import settle

# Symbols that count, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Letters of scripts that are written without blanks between words.
UNPARTED = r"[\p{L}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]]"

# Rows of the sample that costs and rejections are estimated on; seconds that a rule's job should take, and how often a row is asked at most.
SAMPLE_ROWS = 2000
LONG, MOST = 0.2, 16
# The least cost of a rule, as a part of the time that a row takes without any.
LEAST = 0.25


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def repeat_words(parts: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in ``parts``.

    Windows are 64-bit hashes. Only a text that repeats one is sorted: hash and place share a long, with as many low bits for
    the place as the text needs; neighbours count as equal if their whole hashes are.
    """

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - width
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def places(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def packed(h: Column, i: Column) -> Column:
            high = F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
            return F.coalesce(high.bitwiseOR(i.cast("long")), F.lit(0).cast("long"))

        def place(x: Column) -> Column:
            return x.bitwiseAND(mask).cast("int")

        def repeated(ordered: Column) -> Column:
            def like(x: Column, other: Column) -> Column:
                return F.coalesce(F.get(hashes, place(x)) == F.get(hashes, place(other)), F.lit(False))

            twice = F.filter(ordered, lambda x, i: like(x, F.get(ordered, i - 1)) | like(x, F.get(ordered, i + 1)))
            return F.sort_array(F.transform(twice, place))

        return let(F.sort_array(F.transform(hashes, packed)), repeated)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(places(hashes), covered))

    counted = let(let(F.transform(parts, lambda w: F.xxhash64(w)), windows), count)
    return F.when(F.size(parts) < width, F.lit(0).cast("long")).otherwise(counted)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``_row`` with ``_text``, ``_words`` and the five measures."""
    parts = docs.select(F.struct("*").alias("_row"), whole(text).alias("_text")).withColumn("_words", words("_text"))
    bare = F.length(F.translate("_text", BLANKS, ""))
    symbols = F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))
    duplicates = let(lines_with_words(F.col("_text")), lambda rows: F.size(rows) - F.size(F.array_distinct(rows)))
    return parts.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        duplicates.cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for rows to drop; null keeps the row."""

    name: str
    rejects: Column


def standard_rules() -> list[Rule]:
    """Rules over ``measured`` rows: symbol soup, odd word lengths, copied lines, capitals, words without letters.

    Where most letters belong to scripts without blanks between words, what stands between blanks is no word and may be long.
    """
    letters = F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}")))
    lines = F.size(lines_with_words(F.col("_text")))
    mean = F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0))
    upper, lower = (F.regexp_count("_text", F.lit(kind)) for kind in (r"\p{Lu}", r"\p{Ll}"))
    parted = 2 * F.regexp_count("_text", F.lit(UNPARTED)) <= F.regexp_count("_text", F.lit(r"\p{L}"))
    return [
        Rule("capitals", upper > lower),
        Rule("few_letters", 10 * letters < 7 * F.col("n_words")),
        Rule("copied_lines", 2 * F.col("n_dup_lines") > lines),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("word_length", (mean < 2.5) | ((mean > 14) & parted)),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / self.seconds


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Cost (seconds for the whole sample) and rejection of each rule on a settled sample of ``measured`` rows, best first.

    A rule is asked of every row again and again within one job, ever more often, until that takes ``LONG`` more seconds than a job of as many rows that
    asks nothing, or ``MOST`` times. Costs that even so cannot be told from nothing count as ``LEAST`` of a row's bare cost, all alike; so
    what decides between cheap rules is what they reject. Rules whose rank is equal keep the given order.
    """

    def seconds(condition: Column, times: int) -> tuple[float, int, int]:
        rows = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        start = time.perf_counter()
        hits, n = rows.agg(F.count_if(condition & (F.col("_again") > 0)), F.count("*")).first()
        return time.perf_counter() - start, hits, n

    def best(condition: Column, times: int) -> tuple[float, int, int]:
        return min(seconds(condition, times) for _ in range(2))

    @cache
    def idle(times: int) -> float:
        return best(F.length("_text") < 0, times)[0]

    found = []
    for rule in rules:
        times, condition = 4, F.coalesce(rule.rejects, F.lit(False))
        spent, hits, n = best(condition, times)
        while spent - idle(times) < LONG and times < MOST:
            times *= 4
            spent, hits, n = best(condition, times)
        cost = (spent - idle(times)) / times
        found.append(Estimate(rule, max(cost, LEAST * idle(MOST) / MOST), hits / max(1, n)))
    return sorted(found, key=lambda e: -e.rank)


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Rule]:
    """``rules`` in the order that a sample of about ``rows`` rows suggests."""
    total = docs.count()
    part = docs.sample(rows / total, seed) if total > rows else docs
    sample = settle(measured(part, text).drop("_row").repartition(4), "rules-sample")
    return [e.rule for e in estimate(sample, rules)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, or null. Later rules are not evaluated for it."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.rejects, rule.name) if verdict is None else verdict.when(rule.rejects, rule.name)
    return F.lit(None).cast("string") if verdict is None else verdict


def judged(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``measured`` rows with ``base_failed``, ``rejected_by`` and ``kept``. Rules are asked only where the base rules pass."""
    order = ordered(docs, standard_rules() if rules is None else rules, text)
    rejected_by = F.when(F.col("base_failed"), "base").otherwise(cascade(order))
    return (
        measured(docs, text)
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", rejected_by)
        .withColumn("kept", F.col("rejected_by").isNull())
    )


def keep_documents(docs: DataFrame) -> DataFrame:
    return judged(docs).filter("kept").select("_row.*")
