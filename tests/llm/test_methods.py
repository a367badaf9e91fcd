"""Parts of the methods on their own."""

import bisect
import math
import platform
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from limnos import session
from limnos.llm import bitplanes, fingerprints, mixing, packing, rules, setsketch, sharding
from limnos.llm.tokens import encoder
from limnos.operators.graph import components
from limnos.session import new_path, settle


def reachable(counts, first, space):
    sums = {0}
    for length, number in enumerate(counts):
        for _ in range(number - (length == first)):
            sums |= {s + length for s in sums if s + length <= space}
    return max(sums)


def test_fullest_combination_leaves_least_slack():
    pick = random.Random(5)
    for _ in range(200):
        counts = [0] + [pick.choice((0, 0, 1, 2, 5)) for _ in range(30)]
        open_lengths = [k for k, n in enumerate(counts) if n]
        if not open_lengths:
            continue
        first = max(open_lengths)
        pattern = packing.fullest(counts, first, 30)
        assert all(number <= counts[length] for length, number in pattern) and first in dict(pattern)
        assert sum(length * number for length, number in pattern) == first + reachable(counts, first, 30 - first)


def fewest(counts, capacity):
    """Bins that any packing needs: long pieces stand apart, and what is left beside the middle ones is filled without loss."""
    best = 0
    for short in range(capacity // 2 + 1):
        long = sum(n for k, n in counts.items() if k > capacity - short)
        middle = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - short]
        room = sum(n * (capacity - k) for k, n in middle)
        rest = sum(n * k for k, n in counts.items() if short <= k <= capacity // 2)
        best = max(best, long + sum(n for _, n in middle) + max(0, math.ceil((rest - room) / capacity)))
    return best


def test_plan_places_every_piece():
    pick = random.Random(6)
    counts = {k: pick.randint(1, 40) for k in pick.sample(range(1, 1025), 300)}
    bins = packing.plan(counts, 1024)
    used = {}
    for pattern, times in bins:
        assert sum(length * number for length, number in pattern) <= 1024
        for length, number in pattern:
            used[length] = used.get(length, 0) + number * times
    assert used == counts
    assert sum(times for _, times in bins) <= 1.005 * fewest(counts, 1024)


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits, tmp_path):
    pick = np.random.default_rng(1)
    docs = [(k, pick.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")) for k, n in enumerate((0, 1, 700, 65, 0, 333))]
    with open(tmp_path / "x", "wb") as out:
        writer = bitplanes.Writer(out, block=64, bits=bits)
        for doc, ids in docs:
            writer.add(doc, ids.tobytes())
        writer.close()
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "x")) as file:
        reader = bitplanes.Reader(file)
        assert [(d, n) for d, _, n in ((d, at, len(ids) // 4) for d, at, ids in reader.documents())] == [(d, len(i)) for d, i in docs]
        assert [ids for _, _, ids in reader.documents()] == [ids.tobytes() for _, ids in docs]
        flat = np.concatenate([ids for _, ids in docs])
        assert reader.ids(60, 200) == flat[60:260].tobytes()
        assert len(reader.footer["chunks"][0]["sizes"]) == (32 if bits else 4)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(vocabulary):
    own = encoder(public_tokenizers.path(vocabulary))
    pick = random.Random(3)
    letters = list("ab'sÉé \n\t́‍|<>12.!?Σσ　\U0001f642ﬁ\x85") + [" "] * 8 + [" w", " word.", " It's"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(1500)]
    texts += ["a\n\t\tb c\n\td", "a \t\n\n b", "a\r\nb\r\n\r\nc", "x\u2003\u2003\ny z", "\na b", "a b\n", "a\nb\n\nc d"]
    texts += ["x <|endoftext|> y <|startoftext|>", " a", "a ", "ΟΔΟΣ ΟΔΟΣ. ΟΔΟΣ", "don't 's it's 're"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_are_listed_once(spark, monkeypatch):
    """The list of the token files is the only table that writing them leaves, in one file."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    tables = []
    monkeypatch.setattr(session, "new_path", lambda *to: tables.append(new_path(*to)) or tables[-1])
    base, listed = bitplanes.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert len([part for table in tables for part in Path(table.removeprefix("file:")).rglob("part-*.parquet")]) == 1
    assert [tuple(row) for row in bitplanes.read_tokens(base, listed).select("doc_id").orderBy("doc_id").collect()] == [(k,) for k in range(40)]


HELD = """
import ctypes, random, re, sys
import pyarrow as pa
from limnos.llm import tokens

def held():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"\\nAnonymous: +(\\d+) kB", file.read())[1]) // 1024

pick = random.Random(8)
words = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 7))) for _ in range(60_000)]
column = pa.array([" ".join(pick.choices(words, k=500)) for _ in range(3000)])
own, seen, most = tokens.encoder(sys.argv[1]), 0, 0
for _, texts in tokens.blocks(column):
    seen += len(own.encode(texts))
    most = max(most, held())
del texts
after = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(seen, most, after, held())
"""


@pytest.mark.skipif(
    platform.libc_ver()[0] != "glibc" or not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's account of a process with glibc"
)
def test_blocks_leave_no_freed_memory_behind():
    """What encoding blocks of texts has freed is not held by the worker that waits for its next task."""
    run = [sys.executable, "-c", HELD, public_tokenizers.path("word_bpe_49k.json")]
    out = subprocess.run(run, capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2]).stdout
    seen, most, after, least = map(int, out.split())
    assert seen == 3000 and most > after
    assert after - least < 10, (most, after, least)


def test_ring_moves_little():
    """A shard more takes rows from all; few others move."""
    pick = random.Random(4)
    counts = {cell: pick.randint(5, 15) for cell in range(sharding.CELLS)}

    def owner(shards):
        return {(r["cell"], k): r["shard"] for r in sharding.plan(counts, shards) for k in range(r["start"], r["stop"])}

    before, after = owner(16), owner(17)
    moved = sum(before[k] != after[k] for k in before)
    assert len(before) == sum(counts.values())
    assert moved < 0.3 * len(before)
    per_shard = [list(after.values()).count(s) for s in range(17)]
    assert max(per_shard) - min(per_shard) <= 1


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 0, 77], [0, 0], [3], [100] * 40 + [1] * 9])
def test_quotas_are_highest_quotients(spark, sizes):
    names = [f"s{k:02d}" for k in range(len(sizes))]
    sources = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint")
    rows = {r.source: r for r in mixing.quotas(mixing.targets(sources), block=3, shards=4).collect()}
    seats = math.ceil(sum(r.target for r in rows.values()) / 3 - 1e-9)
    won = dict.fromkeys(names, 0)
    for _ in range(seats):
        best = max(names, key=lambda s: (rows[s].target / (2 * won[s] + 1), [-ord(c) for c in s]))
        won[best] += 1
    for name in names:
        assert rows[name].quota == min(won[name], 3 * rows[name].n_blocks)
        assert sum(rows[name].shard_quotas) == rows[name].quota
        assert max(rows[name].shard_quotas) - min(rows[name].shard_quotas) <= 1
    totals = [sum(r.shard_quotas[k] for r in rows.values()) for k in range(4)]
    assert max(totals) - min(totals) <= 1


def test_shards_take_consecutive_blocks(spark):
    """Each shard has its quota of blocks, one after another in the stream, which starts over at its end."""
    pick = random.Random(12)
    docs = [(k, "abc"[k % 3] if k % 7 else "a", pick.randint(0, 40)) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, size bigint")
    options = {"size": F.col("size"), "block": 16, "shards": 5}
    plan = {r.source: r for r in mixing.quotas(mixing.targets(df.groupBy("source").agg(F.sum("size").alias("source_size"))), 16, 5).collect()}
    firsts = {r.doc_id: r.first for r in mixing.mix(df, **options).select("_row.doc_id", "first").collect()}
    sources = {doc: source for doc, source, _ in docs}
    words = {}
    for r in mixing.shard_parts(df, **options).select("_row.doc_id", "shard", "round", "start", "stop", "first_block", "last_block").collect():
        stream = [firsts[r.doc_id] + k for k in range(r.start, r.stop)]
        assert (stream[0] // 16, stream[-1] // 16) == (r.first_block, r.last_block)
        for w in stream:
            words.setdefault((sources[r.doc_id], r.shard), []).append((r["round"], w))
    for source, row in plan.items():
        at = 0
        for shard, quota in enumerate(row.shard_quotas):
            blocks = [divmod(b, row.n_blocks) for b in range(at, at + quota)]
            want = [(n, w) for n, b in blocks for w in range(16 * b, min(16 * b + 16, row.source_size))]
            assert sorted(words.get((source, shard), [])) == want
            at += quota
        assert at == row.quota
    parts = mixing.mix(df, **options)
    once_more = F.greatest(F.lit(0), F.least(F.col("first") + F.col("size"), F.col("edge")) - F.col("first"))
    assert parts.filter(mixing.taken() != F.col("rounds") * F.col("size") + once_more).count() == 0


def test_word_length_asks_scripts_with_blanks(spark):
    lines = {1: "清潔的文字沒有空格所以一行就是一個很長的詞", 2: "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำ", 3: "unbrokenlatinlettersarenowords", 4: "1234567890123456789"}
    docs = spark.createDataFrame([(k, "\n".join(f"{line}{n}" for n in range(60))) for k, line in lines.items()], "doc_id int, text string")
    rule = next(r for r in rules.standard_rules() if r.name == "word_length")
    got = {r.doc_id: r.out for r in rules.measured(docs).select("_row.doc_id", rule.rejects.alias("out")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    assert {r.doc_id for r in rules.keep_documents(docs).collect()} == {1, 2}


def test_sketches_merge(spark):
    a, b = " ".join(f"w{k}" for k in range(900)), " ".join(f"w{k}" for k in range(600, 1500))
    df = spark.createDataFrame([(1, a), (1, b), (2, None), (2, "x")], "key int, text string")
    sketched = df.withColumn("sketch", fingerprints.sketch(F.coalesce("text", F.lit(""))))
    merged = {r.key: r.sketch for r in fingerprints.merge_rows(sketched, ["key"]).collect()}
    both = spark.createDataFrame([(f"{a}",)], "text string").select(fingerprints.sketch(F.lit(a)).alias("a"), fingerprints.sketch(F.lit(b)).alias("b"))
    row = both.select(
        fingerprints.merge(F.col("a"), F.col("b")).alias("m"), fingerprints.distinct_shingles(F.col("a")).alias("n"),
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
    ).first()
    assert merged[1] == row.m and len(merged[2]) == 1
    assert row.n == pytest.approx(896, rel=0.4)
    assert row.r == pytest.approx(296 / 1496, abs=0.18) and row.c == pytest.approx(296 / 896, abs=0.25)


def test_registers_merge_and_tell_resemblance():
    pick = np.random.default_rng(2)
    for overlap in (0.0, 0.3, 0.75, 0.9, 1.0):
        n = 3000
        shared = round(2 * n * overlap / (1 + overlap))
        pool = pick.integers(0, 2**64 - 1, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - shared : 2 * n - shared]
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()
        found, keep = setsketch.likely(ra[None], rb[None], np.array([n]), np.array([n]))
        assert abs(found[0] - overlap) < 0.15
        if overlap >= 0.75:
            assert keep[0]
        if overlap <= 0.3:
            assert not keep[0]


def test_components(spark):
    pick = random.Random(8)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, 900), (900, 7), (7, 7), (None, 3)]
    links += [tuple(pick.sample(range(1000, 1200), 2)) for _ in range(90)]
    parent = {x: x for link in links for x in link if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for link in links if None not in link and link[0] != link[1] for x in link}
    assert got == {x: find(x) for x in linked}


def test_cascade_order_never_changes_the_verdict(spark):
    docs = spark.createDataFrame([(k, "word " * k + "### $$$ " * (k % 7)) for k in range(40, 90)], "doc_id int, text string")
    own = rules.standard_rules()
    rows = rules.measured(docs)
    verdicts = [
        [r[0] is None for r in rows.orderBy("_row.doc_id").select(rules.cascade(order).alias("v")).collect()] for order in (own, own[::-1])
    ]
    assert verdicts[0] == verdicts[1]
    assert len(rules.ordered(docs, own)) == len(own)


def test_a_dear_rule_comes_last_each_time(spark):
    """Of rules that reject the same rows the dear one is asked last, and cheap ones follow what they reject, in every run."""
    docs = spark.createDataFrame([(k, f"{k} " + "word " * 400) for k in range(400)], "doc_id int, text string")
    sample = settle(rules.measured(docs).drop("_row").repartition(2))
    odd = F.col("_text").rlike("^[0-9]*[13579] ")
    dear = odd & (F.size(F.filter("_words", lambda w: F.regexp_replace(w, "[aeiou]+|w(o|x)", "")[0:1].rlike("^z"))) == 0)
    cheap = F.col("n_words") < 0
    own = [rules.Rule("dear", dear), rules.Rule("never", cheap), rules.Rule("odd", odd), rules.Rule("some", F.col("_text").startswith("1"))]
    orders = [[e.rule.name for e in rules.estimate(sample, own)] for _ in range(3)]
    for order in orders:
        assert order.index("odd") < order.index("dear") < order.index("never") == 3


def walked(counts, shards):
    """Rows by (cell, shard), placed one at a time: at home while there is room, then clockwise to the first shard that has some."""
    nodes = sorted((zlib.crc32(f"shard {s} node {n}".encode()) % sharding.CELLS, s, n) for s in range(shards) for n in range(sharding.NODES))
    ring = [(cell, s) for cell, s, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]

    def clockwise(cell):
        at = bisect.bisect_left(ring, (cell, -1))
        return (s for _, s in ring[at:] + ring[:at])

    held, left = Counter(), []
    for cell in sorted(counts):
        home = next(clockwise(cell))
        fits = min(room[home], counts[cell])
        room[home] -= fits
        held[cell, home] += fits
        left.append((cell, counts[cell] - fits))
    for cell, rows in left:
        for _ in range(rows):
            shard = next(s for s in clockwise(cell) if room[s])
            room[shard] -= 1
            held[cell, shard] += 1
    return +held


@pytest.mark.parametrize("hot", [0, 9000])
def test_the_ring_is_walked_row_by_row(hot):
    pick = random.Random(11)
    counts = {cell: pick.randint(0, 9) for cell in pick.sample(range(sharding.CELLS), 1500)}
    counts[77] = counts.get(77, 0) + hot
    placed, slots = Counter(), {}
    for r in sharding.plan({c: n for c, n in counts.items() if n}, 16):
        placed[r["cell"], r["shard"]] += r["stop"] - r["start"]
        slots.setdefault(r["shard"], []).extend(range(r["slot"], r["slot"] + r["stop"] - r["start"]))
    assert placed == walked({c: n for c, n in counts.items() if n}, 16)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_a_key_goes_to_its_cell(spark):
    """Rows are placed by the cell of their key's hash, whichever rows of a cell come first."""
    docs = settle(spark.range(500).selectExpr("id as doc_id", "id % 3 as size"))
    got = sharding.assign(docs, ["doc_id"], ["size"], 16).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.CELLS)).cast("int"))
    counts = Counter(r.cell for r in got.collect())
    assert Counter((r.cell, r.shard) for r in got.collect()) == walked(dict(counts), 16)
