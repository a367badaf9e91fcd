"""The queries' results by plain Python over whole tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def token_ids(vocabulary: str, text: str | None) -> list[int]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def archived(pages: list[tuple]) -> Counter:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of rows (page_id, url, html)."""
    first: dict[str, int | None] = {}
    for page, _, html in pages:
        known = first.get(html or "")
        first[html or ""] = page if known is None else known if page is None else min(known, page)
    rows = []
    for page, _, html in pages:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        repeat = first[html or ""] is not None and first[html or ""] != page
        rows.append((page, len(raw), digest, "revisit" if repeat else "response", first[html or ""] if repeat else None))
    return Counter(rows)


def pieces(docs: list[tuple], vocabulary: str = "byte_bpe_50k.json", capacity: int = 1024) -> Counter:
    """(doc_id, piece, start, length, ids_crc32) of rows (doc_id, text, source)."""
    rows = []
    for doc, text, _ in docs:
        ids = token_ids(vocabulary, text)
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        rows += [(doc, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return Counter(rows)


def word_shingles(text: str, width: int = 5) -> frozenset:
    words = WORD.findall(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def edited_texts(docs: list[tuple]) -> dict[int, str]:
    """Edited text by id, for unique ids."""
    texts = {doc: text or "" for doc, text, _ in docs if doc is not None}
    order = sorted(texts, reverse=True)
    out = {}
    for k, doc in enumerate(order):
        text, after = texts[doc], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        out[doc] = text[: len(text) - cut] + after[:cut]
    return out


def targets(sizes: dict) -> dict:
    """Target by source, reshared round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: float(3 * sizes[s]) if s in capped else share * weight[s] for s in order}
        capped |= above


def quality(docs: list[tuple]) -> Counter:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    rows = []
    for doc, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        grams = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(grams)
        covered = {i + k for i, gram in enumerate(grams) if seen[gram] > 1 for k in range(3)}
        n = len(words)
        failed = n < 50 or 100 * len(covered) > 50 * n
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        rows.append((doc, n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    return Counter(rows)


def near(docs: list[tuple]) -> Counter:
    """(doc_id, n_shingles, component_id, kept); ids on several rows are one document."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = [(doc, word_shingles((text or "").translate(small))) for doc, text, _ in docs]
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, (doc, own) in enumerate(sets):
        for shingle in own if doc is not None else ():
            holders[shingle].add(i)
    for doc, own in sets:
        if doc is None:
            continue
        for j, shared in Counter(j for shingle in own for j in holders[shingle]).items():
            other, theirs = sets[j]
            if 100 * shared >= 75 * (len(own) + len(theirs) - shared):
                a, b = find(doc), find(other)
                parent[max(a, b)] = min(a, b)
    return Counter((doc, len(own), None if doc is None else find(doc), doc is None or find(doc) == doc) for doc, own in sets)
