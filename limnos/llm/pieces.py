"""SentencePiece ids of whole texts by a table of distinct chunks.

Blanks become markers, and a text gets one in front. Where no piece of a model has a marker behind another character, pieces cannot cross from one marked
word to the next, so a text is the row of its marked words, and each can be segmented alone. The texts of a block are cut into marked words; those
that the table lacks are segmented by the library, once each; then every position of the block takes its ids from the table by number, for all texts
at once. A line break that is in no piece is a chunk of its own, too.

A task keeps its table from block to block, up to a bound on its characters; then words used once go and the rest stay. No words
move between tasks: a table of the whole corpus would shuffle most of the text to save a few microseconds a word.

Models that change texts beforehand, or whose pieces cross markers, are recognised and encode whole texts. Null texts are empty, and empty texts have
no ids. Rows without id or with a repeated id come back as they are; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from limnos.llm.files import ship
from limnos.llm.tokens import blocks
from limnos.llm.words import whole

MARK = "▁"
# Characters of the chunks that a process keeps, each with some hundred bytes of table.
KEPT = 2_000_000
# What a model must leave as it is to be taken apart: ligatures, wide and combining letters, runs of blanks, control characters.
_PROBE = "  ﬁ Ａ é  \t　x\r​ ½ "


class Chunks:
    """Ids by chunk, for one model."""

    def __init__(self, model: str, kept: int = KEPT):
        import sentencepiece

        self.model, self.bound = sentencepiece.SentencePieceProcessor(model_file=model), kept
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(MARK in piece.lstrip(MARK) for piece in pieces)
        marked = MARK + _PROBE.replace(" ", MARK)
        self.whole = crossing or self.model.normalize(_PROBE) != marked
        self.lines = not self.whole and not any("\n" in piece for piece in pieces)
        self.chunk = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.lines else f"{MARK}+[^{MARK}]*")
        self.lead = self.model.encode("\n")
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used, self.chars = np.empty(0, np.int64), 0

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The library sets a marker before every text; chunks without one follow a line break."""
        texts = [chunk[1:] if chunk[0] == MARK else chunk if chunk == "\n" else "\n" + chunk for chunk in chunks]
        found = self.model.encode(texts, num_threads=1)
        for at, chunk in enumerate(chunks):
            if chunk == MARK:
                found[at] = self.lead[:1]
            elif chunk == "\n":
                found[at] = self.lead[1:]
            elif chunk[0] != MARK:
                found[at] = found[at][len(self.lead) :]
        return found

    def _add(self, chunks: list[str]) -> None:
        found = self._segment(chunks)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.ids) + np.cumsum(counts) - counts
        self.slots.update(zip(chunks, range(len(self.slots), len(self.slots) + len(chunks)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))])
        self.starts, self.counts = np.concatenate([self.starts, first]), np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])
        self.chars += sum(map(len, chunks))

    def _shrink(self) -> None:
        """Keep the chunks used more than once since the last time, the most used first, up to half of the bound."""
        names = list(self.slots)
        order, used = np.argsort(-self.used, kind="stable"), self.used
        self._clear()
        kept, chars = [], 0
        for slot in order:
            chars += len(names[slot])
            if used[slot] < 2 or 2 * chars > self.bound:
                break
            kept.append(names[slot])
        if kept:
            self._add(kept)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        if self.whole:
            return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]
        cut, ends = [], []
        for text in texts:
            if text:
                cut += self.chunk.findall(MARK + text.replace(" ", MARK))
            ends.append(len(cut))
        if self.chars > self.bound:
            self._shrink()
        self._add(list(set(cut).difference(self.slots)))
        slots = np.fromiter(map(self.slots.__getitem__, cut), np.int64, len(cut))
        self.used += np.bincount(slots, minlength=len(self.used))
        counts = self.counts[slots]
        stops = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(self.starts[slots] - stops[:-1], counts) + np.arange(stops[-1])]
        edges = stops[[0, *ends]]
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist()) if len(ids) else ""


@lru_cache(maxsize=1)
def _chunks(model: str) -> Chunks:
    return Chunks(model)


def encoded(docs: DataFrame, model: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row, and with ``decode`` the text that the library makes of them, as ``decoded``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _chunks(model)
        for batch in batches:
            for lo, texts in blocks(batch.column(1)):
                found = table.encode(texts)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                columns = [batch.column(0).slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
                if decode:
                    columns.append(pa.array(map(table.decode, found), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + (", decoded string" if decode else "")
    return docs.select("doc_id", whole(text).alias("text")).mapInArrow(rows, schema)


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``, for ids that were stored. Null ids give an empty text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _chunks(model)
        for batch in batches:
            texts = [table.decode(np.array(row or [], np.int32)) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ship(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(rows, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")
