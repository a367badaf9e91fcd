"""Pieces, ranked search and spelling variants against plain Python: the small tables, odd rows, and no rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from limnos.llm import dualtree, pieces, spelling
from limnos.llm.queries import QUERIES
from tests.llm.tables import odd_documents, sentence, write_benchmark, write_documents

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["op11_sentencepiece", "op12_ranked_search", "op13_spelling_variants"]


def variants_of(word):
    spots = [word[:3] + word[4:], word + "e", "x" + word, word[:2] + "é" + word[3:], word[:4] + word[4] + word[4:]]
    return " ".join([word] * 40 + [w for n, w in enumerate(spots) for _ in range(5 + n)])


def rows_with_variants():
    words = ["ordinary", "ordinarily", "Wasser", "wassser", "straÃŸenbahn", "aaaaaa", "aaaaaaa", "abababab"]
    texts = [variants_of(word) for word in words] + [variants_of("ordinary").upper(), "bababa " * 7 + "bababab " * 3]
    odd = odd_documents()
    return odd + [(5000 + k, text, "s") for k, text in enumerate(texts)] + [odd[6], (None, texts[0], None), (5000, texts[1], "s")]


def odd_items():
    words = sentence(1, 120).split(" ")
    return [
        (1, " ".join(words[:40])), (2, None), (3, ""), (4, "§ --- !"), (5, "one"), (6, "line of words here line line"), (7, "Ünï cödé 漢字 x y"),
        (8, "nosuchterm"), (8, " ".join(words[50:80])), (None, "two words"), (9, sentence(7, 64)), (1, " ".join(words[:40])),
    ]


@pytest.fixture(scope="module", params=["small", "odd"])
def corpus(request, spark, tmp_path_factory):
    if request.param == "odd":
        rows = rows_with_variants()
        folder = write_documents(spark, str(tmp_path_factory.mktemp("odd")), rows)
        return write_benchmark(spark, folder, odd_items()), rows, odd_items()
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    return SF, docs, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, tmp_path, name):
    folder = write_benchmark(spark, write_documents(spark, str(tmp_path), []), [])
    assert QUERIES[name](spark, folder).collect() == []


def test_items_without_documents(spark, tmp_path):
    folder = write_benchmark(spark, write_documents(spark, str(tmp_path), []), odd_items())
    assert QUERIES["op12_ranked_search"](spark, folder).collect() == []
    folder = write_benchmark(spark, write_documents(spark, str(tmp_path), [(1, None, None), (2, "?", None)]), odd_items())
    assert QUERIES["op12_ranked_search"](spark, folder).collect() == []


def test_sentencepiece(spark, corpus):
    folder, docs, _ = corpus
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for doc, text, _ in docs:
        ids = model.encode(text or "")
        told = ",".join(map(str, ids))
        want[doc, len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256((model.decode(ids) or "").encode()).hexdigest()] += 1
    got = QUERIES["op11_sentencepiece"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_chunks_give_the_ids_of_whole_texts():
    own = pieces.Chunks(MODEL, kept=3000)
    assert not own.whole and own.lines
    pick = random.Random(1)
    letters = list("ab'É \n\t\ŕ<>▁▁12.s\U0001f642ﬁ漢\x00") + [" "] * 6 + [" the", "\n\n", "</s>", "<0x0A>", "<unk>"]
    for _ in range(30):
        texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(100)] + ["", " ", "▁", "\n", "a " * 500]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == own.model.encode(text), repr(text)
            assert own.decode(ids) == (own.model.decode(ids.tolist()) if len(ids) else "")
    # The table was cut back in between, and a model that cannot be taken apart encodes whole texts.
    assert own.chars < 30_000
    own.whole = True
    assert [ids.tolist() for ids in own.encode(["a b", ""])] == [own.model.encode("a b"), []]


def test_stored_ids_decode(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, None), (None, " x ")], "doc_id int, text string")
    encoded = pieces.encoded(docs, MODEL).withColumn("ids", F.expr("if(doc_id = 2, null, ids)"))
    assert {(r.doc_id, r.text) for r in pieces.decoded(encoded, MODEL).collect()} == {(1, "a b\nc"), (2, ""), (None, " x ")}


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def searched(docs, items, top=10):
    """(item_id, rank, doc_id, score) of every item."""
    held = [(doc, Counter(TERM.findall((text or "").translate(SMALL)))) for doc, text, _ in docs]
    sizes = [sum(own.values()) for _, own in held]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(term for _, own in held for term in own)
    rows = []
    for item, text in items:
        scores = []
        wanted = Counter(TERM.findall((text or "").translate(SMALL)))
        for (doc, own), n in zip(held, sizes, strict=True):
            score = 0
            for term, times in wanted.items():
                if own[term]:
                    m = 25 + 75 * n * n_docs // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * w * (1_000_000_000 * own[term] // (1000 * own[term] + 8 * m))
            if score:
                scores.append((-score, doc is None, doc))
        rows += [(item, k, doc, -score) for k, (score, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return Counter(rows)


def test_ranked_search(spark, corpus, monkeypatch):
    folder, docs, items = corpus
    want = searched(docs, items)
    columns = ("item_id", "rank", "doc_id", "score")
    assert Counter(map(tuple, QUERIES["op12_ranked_search"](spark, folder).select(*columns).collect())) == want
    # Items in several blocks, and trees of few documents, change nothing.
    monkeypatch.setattr(dualtree, "ITEMS", 9)
    monkeypatch.setattr(dualtree, "HELD", 1)
    assert Counter(map(tuple, QUERIES["op12_ranked_search"](spark, folder).select(*columns).collect())) == want


def test_trees_prune_and_lose_nothing():
    pick = random.Random(2)
    width, n = 300, 3000
    own = [{t: pick.randint(1, 2) for t in pick.sample(range(30 * (k % 10), 30 * (k % 10) + 30), 12)} for k in range(160)]
    weights = [pick.randint(100, 9000) for _ in range(width)]
    docs = [{t: pick.randint(1, 900_000) for t in pick.sample(range(30 * (k % 10), 30 * (k % 10) + 30), 8) + pick.sample(range(width), 2)} for k in range(n)]
    counts = np.array([len(d) for d in docs])
    columns = np.array([t for d in docs for t in d])
    values = np.array([v for d in docs for v in d.values()])
    items = dualtree.Items(weights, own, np.zeros(160, np.int64), 10)
    held = dualtree.Documents(np.arange(n), np.zeros(n, bool), counts, columns, values, np.array(weights), width)
    opened = dualtree.search(items, held)
    assert opened < 0.5 * len(items.leaves) * len(held.levels[0].maxima)
    for item, (scores, ids, _) in zip(items.order, items.best, strict=True):
        all_ = sorted((-sum(c * weights[t] * d.get(t, 0) for t, c in own[item].items()), k) for k, d in enumerate(docs))[:10]
        assert [(-s, k) for s, k in zip(scores.tolist(), ids.tolist(), strict=True)] == [r for r in all_ if r[0]]
    # Whole numbers where floating-point sums could round.
    items.exact = False
    leaf = items._leaf(0, 8)
    assert (held.scores(0, 50, *leaf) == held.scores(0, 50, *items.leaves[0])).all() and leaf[1].dtype == np.int64


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def grouped(docs):
    """(word, n, n_near, form, form_n, root) of every word."""
    n = Counter()
    for doc, text, _ in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    letters = {c for w in words for c in w}
    form, near = {}, {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        found = [v for v in edits if v in words and v != w]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        near[w], form[w] = len(found), best if best and words[best] >= 5 * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, words[w], near[w], form[w], words.get(form[w]), root))
    return Counter(rows)


def test_spelling_variants(spark, corpus):
    folder, docs, _ = corpus
    got = QUERIES["op13_spelling_variants"](spark, folder).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = grouped(docs)
    assert Counter(map(tuple, got)) == want
    assert len(want) > 20


def test_neighbours_of_dense_words(spark):
    """Words over a small alphabet have many neighbours and runs of equal characters."""
    pick = random.Random(4)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(1, 7))): pick.choice((5, 9, 50)) for _ in range(500)}
    got = {r.word: (r.n_near, r.best.n, r.best.word) for r in spelling.neighbours(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    want = {}
    for w, _ in words.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abé"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"}
        found = [v for v in edits if v in words and v != w]
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            want[w] = (len(found), words[best], best)
    assert got == want


def test_chains_end_at_their_root(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("w11", None), ("x", None), ("y", "w5")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w11" for k in range(11)}, "y": "w11"}
