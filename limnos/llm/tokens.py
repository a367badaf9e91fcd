"""Token ids of whole texts by the tokenizers library, for use inside tasks.

Most words come back again and again. A text is cut where the tokenizer is sure to cut, at a blank between two visible characters, and the
distinct pieces of a block of texts are looked up in a table of ids by number. Unknown pieces are encoded many in one text and parted again:
where tokens say that a word begins or ends, or at a separator word between them that comes out as a single id. Then every position
of the block takes its ids by number, for all texts at once. Texts that hold one of the tokenizer's own marks, or have other blanks at a cut, are encoded as
they are.

Two thirds of the distinct pieces of a corpus come once. When a process holds as many as it may, it keeps the half that was used most.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bound on kept pieces of a process (about 200 bytes each), pieces in one joined text, and such texts in one call.
KEPT = 400_000
JOINED = 500
CALL = 40
# Bytes of a block.
BLOCK = 2_000_000
# One of these parts joined pieces: the first that is a single id. Pieces that hold it are encoded alone.
_SEPARATORS = "¬¦¶§^|~"

# A letter and one of these are parted by every vocabulary here, so a word before it need not be learnt twice.
_ENDS = ".,;:!?"
_ENDED = r"^\n?\pL+[.,;:!?]$"

# Characters that a tokenizer may take for blanks or drop. Where a text has none but line breaks, only these pairs are unsure.
_ODD_RANGES = "\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_UNSURE = re.compile(f"(?:^|[\\s {_ODD_RANGES}]) | (?:[\\s {_ODD_RANGES}]|$)")


def sure(text: str) -> bool:
    """Whether every blank stands between two visible characters."""
    if text[:1] in " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text:
        return False
    # Printable texts have no other blanks and nothing invisible.
    return text.replace("\n", "").isprintable() or not _UNSURE.search(text)


def plain(text: str) -> bool:
    """Whether a text has no blanks but spaces and single line breaks inside it."""
    if not text or text[0] == "\n" or text[-1] == "\n" or "\n\n" in text:
        return False
    return text.replace("\n", "").isprintable()


class Pieces:
    """Ids of many pieces: a flat array, and the first and the number of each piece's ids."""

    __slots__ = ("flat", "starts", "counts")

    def __init__(self, flat: np.ndarray, counts: np.ndarray, starts: np.ndarray | None = None):
        self.flat, self.counts = flat, counts
        self.starts = np.cumsum(counts) - counts if starts is None else starts

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The ids of pieces by number, one after another."""
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), kept
        with open(path, encoding="utf-8") as file:
            self.marks = [mark["content"] for mark in json.load(file)["added_tokens"]]
        self.numbers: dict[str, int] = {}
        self.kept = Pieces(np.empty(0, np.uint32), np.empty(0, np.int64))
        self.used = np.empty(0, np.int64)
        self.line_break = self._whole("\n")
        self.small = np.array_equal(self._whole("AZ Z"), self._whole("az z"))
        word = len(self._whole("a"))
        ends = [self._whole("a" + end)[word:] for end in _ENDS]
        # Marks that are one id each; else words are learnt with their marks.
        self.ends = np.concatenate(ends) if all(len(ids) == 1 for ids in ends) else None
        self.separator = next((c for c in _SEPARATORS if len(self._whole(f"a {c}")) == word + 1), None)
        # Tokens that tell where a word begins or ends, by vocabulary: a blank in front of it, or a mark at its end.
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        self.begins, self.stops = np.zeros(names[-1][1] + 1, bool), np.zeros(names[-1][1] + 1, bool)
        for name, number in names:
            self.begins[number], self.stops[number] = name.startswith("Ġ"), name.endswith("</w>")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], before: str, separator: str, starts: Callable[[np.ndarray], np.ndarray], skip: int) -> Pieces:
        """Ids of pieces that each stand after ``before``. Many are encoded as one text; ``starts`` tells where in its ids pieces begin, and ``skip`` how many
        ids part them. A text that does not give as many parts as it has pieces is encoded piece by piece."""
        groups = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        flat, first, counts, size = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for at in range(0, len(groups), CALL):
            part = groups[at : at + CALL]
            for group, ids in zip(part, self._batch([before + separator.join(group) for group in part]), strict=True):
                begin = starts(ids)
                if len(begin) == len(group):
                    count = np.diff(begin, append=len(ids) + skip) - skip
                else:
                    alone = self._batch([before + piece for piece in group])
                    ids, count = np.concatenate(alone), np.array([len(own) for own in alone])
                    begin = np.cumsum(count) - count
                flat.append(ids)
                first.append(begin + size)
                counts.append(count)
                size += len(ids)
        return Pieces(np.concatenate(flat), np.concatenate(counts), np.concatenate(first))

    def _after_blank(self, pieces: list[str]) -> Pieces:
        if self.begins.sum() > 1000:
            return self._joined(pieces, " ", " ", lambda ids: np.flatnonzero(self.begins[ids]), 0)
        words = self.stops.sum() > 1000

        def kind(piece: str) -> int:
            return 0 if words and piece.isalpha() else 1 if self.separator and self.separator not in piece else 2

        kinds = np.fromiter(map(kind, pieces), np.int64, len(pieces))
        rows = [np.flatnonzero(kinds == k) for k in range(3)]
        single, parted, alone = ([pieces[row] for row in of] for of in rows)
        mark = self._whole(f"a {self.separator}")[-1] if self.separator else 0
        found = [
            self._joined(single, " ", " ", lambda ids: np.append(0, np.flatnonzero(self.stops[ids])[:-1] + 1), 0),
            self._joined(parted, " ", f" {self.separator} ", lambda ids: np.append(0, np.flatnonzero(ids == mark) + 1), 1),
            _pieces(self._batch([" " + piece for piece in alone])),
        ]
        return _merged(found, rows, len(pieces))

    def _learn(self, pieces: list[str]) -> Pieces:
        """Ids of pieces that stand after a blank or, as their first character says, after a line break."""
        of_line = np.fromiter((piece[:1] == "\n" for piece in pieces), bool, len(pieces))
        rows = [np.flatnonzero(of_line), np.flatnonzero(~of_line)]
        bare, others = [pieces[row][1:] for row in rows[0]], [pieces[row] for row in rows[1]]
        if len(self.line_break) == 1:
            first = self._joined(bare, "", "\n", lambda ids: np.append(0, np.flatnonzero(ids == self.line_break[0]) + 1), 1)
        else:
            first = _pieces(self._batch(bare))
        if len(bare):
            # Each with its line break in front.
            first = _pieces([np.concatenate([self.line_break, first.flat[a : a + n]]) for a, n in zip(first.starts, first.counts, strict=True)])
        return _merged([first, self._after_blank(others)], rows, len(pieces))

    def _shrink(self) -> None:
        """Keep the half of the pieces that was used most since the last time."""
        names = list(self.numbers)
        rows = np.sort(np.argsort(-self.used, kind="stable")[: self.bound // 2])
        self.kept = Pieces(self.kept.take(rows), self.kept.counts[rows])
        self.numbers = {names[row]: k for k, row in enumerate(rows.tolist())}
        self.used = np.zeros(len(rows), np.int64)

    def _of(self, words: list[str]) -> Pieces:
        """Ids of distinct pieces."""
        if len(self.numbers) > self.bound:
            self._shrink()
        rows = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        known, unknown = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        self.used[rows[known]] += 1
        if not len(unknown):
            return Pieces(self.kept.flat, self.kept.counts[rows], self.kept.starts[rows])
        new = [words[at] for at in unknown.tolist()]
        learnt = self._learn(new)
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[known], counts[known] = self.kept.starts[rows[known]], self.kept.counts[rows[known]]
        starts[unknown], counts[unknown] = learnt.starts + len(self.kept.flat), learnt.counts
        found = Pieces(np.concatenate([self.kept.flat, learnt.flat]), counts, starts)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.kept = Pieces(
            found.flat, np.concatenate([self.kept.counts, learnt.counts]), np.concatenate([self.kept.starts, starts[unknown]])
        )
        self.used = np.concatenate([self.used, np.ones(len(new), np.int64)])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. Repeated texts are encoded once."""
        found: dict[str, bytes] = {}
        ready: dict[str, None] = {}
        for text in texts:
            if text in ready or text in found:
                continue
            if plain(text) and self._known(text):
                ready[text] = None
            else:
                found[text] = self._parted(text)
        found.update(zip(ready, self._spaced(list(ready)), strict=True))
        return [found[text] for text in texts]

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without blanks but single ones and line breaks between visible characters."""
        if not texts:
            return []
        lines = len(self.line_break) > 0
        if lines:
            # Line breaks are cuts as well; the first word reads as one after a line break.
            spaced = pc.replace_substring(pa.array(["\n" + text for text in texts], pa.string()), "\n", " \n")
            spaced = pc.utf8_slice_codeunits(spaced, 1)
        else:
            # Line breaks are blanks then, and letters that the vocabulary makes small anyway need not be learnt twice.
            raw = pa.array([text.encode().lower() if self.small else text for text in texts], pa.binary()).cast(pa.string())
            spaced = pc.replace_substring(raw, "\n", " ")
        parts = pc.split_pattern(spaced, " ")
        coded = parts.flatten().dictionary_encode()
        names, slots = coded.dictionary, coded.indices.to_numpy()
        ends = np.full(len(names), -1)
        if self.ends is not None:
            ended = pc.match_substring_regex(names, _ENDED)
            last = pc.utf8_slice_codeunits(names.filter(ended), -1).to_numpy(zero_copy_only=False)
            ends[ended.to_numpy(zero_copy_only=False)] = np.fromiter(map(_ENDS.index, last), np.int64, len(last))
            words = pc.if_else(ended, pc.utf8_slice_codeunits(names, 0, -1), names).dictionary_encode()
            names, slots, ends = words.dictionary, words.indices.to_numpy()[slots], ends[slots]
        else:
            ends = ends[slots]
        own = self._of(names.to_numpy(zero_copy_only=False).tolist())
        counts = own.counts[slots]
        stops = np.cumsum(counts + (ends >= 0))
        ids = np.empty(stops[-1], "<u4")
        marked = stops[ends >= 0] - 1
        free = np.ones(len(ids), bool)
        free[marked] = False
        ids[free] = own.take(slots)
        if len(marked):
            ids[marked] = self.ends[ends[ends >= 0]]
        edges = np.append(0, stops)[parts.offsets.to_numpy()]
        extra = len(self.line_break)
        return [ids[a + extra : b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _known(self, text: str) -> bool:
        return sure(text) and not any(mark in text for mark in self.marks)

    def _parted(self, text: str) -> bytes:
        """A text that line breaks cannot cut: at its blanks if they are sure, else whole."""
        if not text or not self._known(text) or " " not in text:
            return self._whole(text).astype("<u4").tobytes()
        head, *pieces = text.split(" ")
        distinct = {piece: at for at, piece in enumerate(dict.fromkeys(pieces))}
        rows = np.fromiter(map(distinct.__getitem__, pieces), np.int64, len(pieces))
        return np.concatenate([self._whole(head), self._of(list(distinct)).take(rows)]).astype("<u4").tobytes()


def _pieces(found: list[np.ndarray]) -> Pieces:
    return Pieces(np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(ids) for ids in found], np.int64))


def _merged(parts: list[Pieces], rows: list[np.ndarray], n: int) -> Pieces:
    """Pieces of several parts by the rows that they stand in."""
    starts, counts, size = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for part, at in zip(parts, rows, strict=True):
        starts[at], counts[at] = part.starts + size, part.counts
        size += len(part.flat)
    return Pieces(np.concatenate([part.flat for part in parts]), counts, starts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per process: that of the vocabulary used last."""
    return Encoder(path)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's ``malloc_trim``; nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda keep: 0


def give_back() -> None:
    """Return freed memory to the system. A worker lives on from task to task, and Arrow's pool and the C heap would hold on to what its blocks took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in blocks of about ``size`` bytes, each with its first row; only one block at a time is Python text. What the work on
    a column has freed goes back to the system at its end: after each block it would cost a tenth more time."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = min(len(column), int(np.searchsorted(ends, before + size)) + 1)
        yield start, column.slice(start, stop - start).to_numpy(zero_copy_only=False).tolist()
        start = stop
    give_back()
