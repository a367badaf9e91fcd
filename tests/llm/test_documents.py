"""Queries over documents against plain Python: the small table, odd rows, and no rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from limnos.llm import mixing, packing, rules, sharding
from limnos.llm.queries import QUERIES
from limnos.llm.setsketch import drop_near_duplicates, near_duplicates
from limnos.session import settle
from tests.llm import brute
from tests.llm.tables import odd_documents, sentence, write_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["small", "odd"])
def corpus(request, spark, tmp_path_factory):
    if request.param == "odd":
        rows = odd_documents()
        return write_documents(spark, str(tmp_path_factory.mktemp("odd")), rows), rows
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_documents(spark, str(tmp_path_factory.mktemp("none")), [])


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", [q for q in QUERIES if q.split("_")[0] in ("op2", "op3", "op5", "op6", "op7", "op9", "op10")])
def test_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_packing(spark, corpus):
    folder, docs = corpus
    df = QUERIES["op2_best_fit_packing"](spark, folder).persist()
    got = rows_of(df, "doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(got) == brute.pieces(docs)
    bins = defaultdict(list)
    for sequence, offset, length in rows_of(df, "sequence_id", "offset", "length"):
        bins[sequence].append((offset, length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(length for held in bins.values() for _, length in held)
    assert len(bins) <= 1.03 * total / 1024 + 1


def test_fingerprints(spark, corpus):
    folder, docs = corpus
    got = {r.doc_id: r for r in QUERIES["op3_document_fingerprints"](spark, folder).collect()}
    assert len(got) == len(docs)
    edited = brute.edited_texts(docs)
    by_text, errors = defaultdict(set), []
    order = sorted(edited, reverse=True)
    texts = {doc: text or "" for doc, text, _ in docs}
    for k, doc in enumerate(order):
        row, text = got[doc], texts[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited[doc].encode()).hexdigest())
        by_text[text].add(row.fingerprint)
        for value, other in ((row.near_edited, edited[doc]), (row.near_next, texts[order[(k + 1) % len(order)]])):
            a, b = brute.word_shingles(text), brute.word_shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= value <= 1
            errors.append(abs(true - value))
            if len(a | b) <= 64:
                assert value == pytest.approx(true)
    assert all(len(found) == 1 for found in by_text.values())
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.3


def test_mixing(spark, corpus):
    folder, docs = corpus
    df = QUERIES["op5_mixing_sources"](spark, folder).persist()
    sizes, held = defaultdict(int), {}
    for doc, text, source in docs:
        held[doc] = (source, len(brute.WORD.findall(text or "")))
        sizes[source] += held[doc][1]
    wanted, taken = brute.targets(sizes), defaultdict(int)
    for row in df.collect():
        source, size = held[row.doc_id]
        assert (row.size, row.source_size) == (size, sizes[source])
        assert row.target == pytest.approx(wanted[source])
        assert 0 <= row.taken <= 3 * size
        taken[source] += row.taken
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 2
    again = QUERIES["op5_mixing_sources"](spark, folder)
    assert Counter(rows_of(again, "doc_id", "taken")) == Counter(rows_of(df, "doc_id", "taken"))


def test_sharding(spark, corpus):
    folder, docs = corpus
    texts = {doc: (text or "").encode() for doc, text, _ in docs}
    slots = defaultdict(list)
    for row in QUERIES["op6_sharding"](spark, folder).collect():
        raw = texts.pop(row.doc_id)
        assert (row.size, row.text_crc32, row.law, row.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[row.shard].append(row.slot)
    assert not texts and set(slots) <= set(range(16))
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_token_files(spark, corpus):
    folder, docs = corpus
    at, want = 0, []
    for doc, text, _ in sorted(docs, key=lambda d: d[0]):
        ids = brute.token_ids("word_bpe_49k.json", text)
        want.append((doc, at, len(ids), brute.crc(ids)))
        at += len(ids)
    df = QUERIES["op7_token_output"](spark, folder)
    assert sorted(rows_of(df, "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_quality(spark, corpus):
    folder, docs = corpus
    df = QUERIES["op9_quality_rules"](spark, folder).persist()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(rows_of(df, *columns)) == brute.quality(docs)
    assert df.filter("base_failed and kept").count() == 0
    if folder == SF:
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        judged = df.join(labels, "doc_id").filter("not base_failed")
        assert judged.filter("quality = 1 and not kept").count() == 0
        assert judged.filter("quality = 0 and kept").count() == 0


def test_near_duplicates(spark, corpus):
    folder, docs = corpus
    df = QUERIES["op10_minhash_near_dedup"](spark, folder)
    assert Counter(rows_of(df, "doc_id", "n_shingles", "component_id", "kept")) == brute.near(docs)


@pytest.fixture(scope="module")
def odd_ids(spark, tmp_path_factory):
    """Null ids, and one id on rows with different texts and on equal rows."""
    a, b, c = sentence(21, 90), sentence(22, 90), sentence(23, 90)
    rows = [(5, a, "x"), (5, b, "x"), (7, a + " more", None), (9, b + " more", "y"), (None, a, "x"), (None, c, "y"), (11, c, "y"), (11, c, "y"), (None, None, None)]
    return write_documents(spark, str(tmp_path_factory.mktemp("ids")), rows), rows


@pytest.mark.parametrize("name", [q for q in QUERIES if q.split("_")[0] in ("op2", "op3", "op5", "op6", "op7", "op9", "op10")])
def test_every_row_of_odd_ids_comes_back(spark, odd_ids, name):
    folder, rows = odd_ids
    got = Counter(r.doc_id for r in QUERIES[name](spark, folder).collect())
    assert got == Counter(doc for doc, _, _ in rows)


def test_near_duplicates_of_odd_ids(spark, odd_ids):
    folder, rows = odd_ids
    df = QUERIES["op10_minhash_near_dedup"](spark, folder)
    assert Counter(rows_of(df, "doc_id", "n_shingles", "component_id", "kept")) == brute.near(rows)


def test_near_duplicates_of_text_ids(spark, odd_ids):
    """Ids of any type that sorts; the smallest in their own order names the component."""
    _, rows = odd_ids
    named = [(None if doc is None else f"d{doc}", text, source) for doc, text, source in rows]
    df = near_duplicates(spark.createDataFrame(named, "doc_id string, text string, source string"))
    assert Counter(rows_of(df, "doc_id", "n_shingles", "component_id", "kept")) == brute.near(named)


CLASHING = "doc_id bigint, text string, source string, _own string, _hash int, hash string, `row` int, own int, slot int, start int, part string, sequence_id int, at int, n int, `odd name` int"


def test_clashing_columns_come_back_as_they_were(spark):
    rows = [(k, sentence(40 + k // 2, 60), "ab"[k % 2], "o", k, "h", 1, 2, 3, 4, "p", 5, 6, 7, 8) for k in range(8)]
    docs = spark.createDataFrame(rows, CLASHING)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 2 == 0]
    placed = sharding.assign(docs, ["doc_id"], ["text"], 3)
    others = [c for c in docs.columns if c != "slot"]
    assert sorted(rows_of(placed, *[f"`{c}`" for c in others])) == sorted(rows_of(docs, *[f"`{c}`" for c in others]))
    assert Counter(r["slot"] for r in placed.filter("shard = 0").collect()) == Counter(range(3))
    parts = mixing.shard_parts(docs, block=8, shards=2)
    assert parts.columns.count("start") == 1 and {r["_row"]["start"] for r in parts.collect()} == {4}
    assert mixing.repeat_documents(docs, block=8).columns == docs.columns
    pieces = docs.withColumns({"length": F.col("doc_id") * 100 + 1, "part": F.lit(0), "nth": F.lit(0).cast("long")})
    packed = packing.pack(settle(pieces), 1024)
    want = [c for c in pieces.columns if c not in ("part", "nth", "sequence_id")]
    assert packed.columns == [*want, "sequence_id", "offset"]
    assert sorted(rows_of(packed, *[f"`{c}`" for c in want])) == sorted(rows_of(pieces, *[f"`{c}`" for c in want]))
    assert {tuple(r.asDict(True)) for r in rules.keep_documents(docs).collect()} <= {tuple(docs.columns)}


def test_a_large_group_of_near_copies(spark, tmp_path):
    """More copies than a small bucket holds, some linked with few others only."""
    pick = random.Random(9)
    base = sentence(30, 150).split(" ")
    rows = []
    for k in range(160):
        words = list(base)
        for spot in pick.sample(range(150), pick.choice((1, 2, 4, 7, 9))):
            words[spot] = f"new{k}x{spot}"
        rows.append((1000 - k, " ".join(words), "s"))
    df = QUERIES["op10_minhash_near_dedup"](spark, write_documents(spark, str(tmp_path), rows))
    assert Counter(rows_of(df, "doc_id", "n_shingles", "component_id", "kept")) == brute.near(rows)


def test_dropping_decides_by_row(spark, odd_ids):
    """Repeats and rows without id are thinned, and the second text of an id stays."""
    _, rows = odd_ids
    a, b, c, d = rows[0][1], rows[1][1], rows[5][1], sentence(24, 90)
    docs = spark.createDataFrame([*rows, (None, d, "x"), (None, d + " more", "x")], "doc_id bigint, text string, source string")
    kept = drop_near_duplicates(docs.repartition(3))
    assert kept.columns == docs.columns
    left = Counter(rows_of(kept, "doc_id", "text"))
    last = {key for key in left if key[0] is None and key[1] is not None}
    assert last < {(None, d), (None, d + " more")} and len(last) == 1
    assert left == Counter([(5, a), (5, b), (11, c), (None, None), *last])
