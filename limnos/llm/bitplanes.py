"""Token files of shuffled planes.

A file holds blocks of a fixed number of ids. A block's ids, unsigned 32-bit, are transposed into byte planes or bit planes, and each plane is
compressed with zstandard on its own: planes of high bytes are nearly constant and take almost no room. A footer holds the chunk
index (place and size of every plane of every block) and the documents with their numbers of ids, so any range of ids can be read alone.

File: ``LPLN1``, planes, footer (compressed JSON), footer length (8 bytes, little-endian), ``LPLN1``.

Documents are written in ascending id order, null ids first; equal ids keep any order. Null texts hold the end mark only. An empty table
gives no file and no rows.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm import files
from limnos.llm.tokens import blocks, encoder, give_back
from limnos.llm.words import whole
from limnos.session import settle

MAGIC = b"LPLN1"
BLOCK = 65_536
END = 2
LEVEL = 3


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids, lowest first."""
    by_byte = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [np.ascontiguousarray(row).tobytes() for row in by_byte]
    return [np.packbits(row >> bit & 1, bitorder="little").tobytes() for row in by_byte for bit in range(8)]


def joined(rows: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ids of ``planes``."""
    if bits:
        flat = [np.unpackbits(np.frombuffer(row, np.uint8), count=n, bitorder="little") for row in rows]
        rows = [sum(flat[8 * byte + bit] << bit for bit in range(8)).astype(np.uint8).tobytes() for byte in range(4)]
    by_byte = np.stack([np.frombuffer(row, np.uint8) for row in rows], axis=1)
    return np.ascontiguousarray(by_byte).view("<u4").reshape(-1)


class Writer:
    """Writes one file; holds one block of ids."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = LEVEL):
        self.out, self.block, self.bits = out, block, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.open, self.chunks, self.docs, self.at, self.n_ids = bytearray(), [], [], len(MAGIC), 0
        out.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        """One document's ids, little-endian unsigned 32-bit."""
        self.docs.append((doc_id, len(ids) // 4))
        self.open += ids
        self.n_ids += len(ids) // 4
        while len(self.open) >= 4 * self.block:
            self._flush(4 * self.block)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.open[:size]), dtype="<u4")
        del self.open[:size]
        sizes, start = [], self.at
        for plane in planes(ids, self.bits):
            packed = self.pack(plane)
            self.out.write(packed)
            sizes.append(len(packed))
            self.at += len(packed)
        self.chunks.append({"at": start, "sizes": sizes, "n": len(ids)})

    def close(self) -> None:
        if self.open:
            self._flush(len(self.open))
        footer = {"block": self.block, "bits": self.bits, "n_ids": self.n_ids, "chunks": self.chunks, "docs": self.docs}
        raw = self.pack(json.dumps(footer).encode())
        self.out.write(raw + struct.pack("<Q", len(raw)) + MAGIC)
        self.out.close()


class Reader:
    """Reads a file's footer and any range of its ids."""

    def __init__(self, file):
        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size, tail = file.size(), 8 + len(MAGIC)
        file.seek(size - tail)
        length, magic = struct.unpack(f"<Q{len(MAGIC)}s", file.read(tail))
        if magic != MAGIC:
            raise ValueError("not a file of planes")
        file.seek(size - tail - length)
        self.footer = json.loads(self.unpack(file.read(length)))
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def chunk(self, number: int) -> np.ndarray:
        if self.last[0] != number:
            entry, rows = self.footer["chunks"][number], []
            self.file.seek(entry["at"])
            raw, at = self.file.read(sum(entry["sizes"])), 0
            for size in entry["sizes"]:
                rows.append(self.unpack(raw[at : at + size]))
                at += size
            self.last = number, joined(rows, entry["n"], self.footer["bits"])
        return self.last[1]

    def ids(self, start: int, n: int) -> bytes:
        """``n`` ids from ``start`` on, as they were added."""
        block, parts = self.footer["block"], []
        while n:
            number, skip = divmod(start, block)
            part = self.chunk(number)[skip : skip + n]
            parts.append(part.tobytes())
            start, n = start + len(part), n - len(part)
        return b"".join(parts)

    def documents(self) -> Iterator[tuple[object, int, bytes]]:
        """Id, place of the first token and tokens of every document, in order."""
        at = 0
        for doc_id, n in self.footer["docs"]:
            yield doc_id, at, self.ids(at, n)
            at += n


def write_tokens(
    docs: DataFrame, tokenizer: str, end: int = END, block: int = BLOCK, bits: bool = False, text: str = "text"
) -> tuple[str, DataFrame]:
    """Encode and write all documents in ascending id order. Returns the folder and its files: ``file``, ``n_docs``, ``n_ids`` and ``start``,
    the number of ids in files before it."""
    files.ship(docs.sparkSession)
    base = files.folder(docs.sparkSession, "planes")

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        mark, writer, name = np.array([end], dtype="<u4").tobytes(), None, ""
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, texts in blocks(batch.column(1)):
                if writer is None:
                    out, name = files.write(base, f"part-{part:06d}", ".planes")
                    writer = Writer(out, block, bits)
                for key, ids in zip(keys[lo : lo + len(texts)], encode(texts), strict=True):
                    writer.add(key, ids + mark)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    # Rows without id, or with one id, are cut by their texts.
    order = [F.col("doc_id"), F.xxhash64("text")]
    in_order = docs.select("doc_id", whole(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    listed = in_order.mapInArrow(written, "part bigint, file string, n_docs bigint, n_ids bigint")
    # One row per file, all listed in one file: on a local file system Spark starts a process for each file that it writes.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return base, settle(listed.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start")), "planes-list")


def read_tokens(base: str, listed: DataFrame, kind: str = "bigint") -> DataFrame:
    """Documents out of the files: ``doc_id`` (of type ``kind``), ``start``, ``n_tokens`` and ``ids``."""

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.read(base, row["file"]) as file:
                    found: list[tuple] = []
                    size = 0
                    for doc_id, at, ids in Reader(file).documents():
                        found.append((doc_id, row["start"] + at, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 16_000_000:
                            yield rows(found)
                            found, size = [], 0
                    if found:
                        yield rows(found)
                    del found
                give_back()

    def rows(found: list[tuple]) -> pa.RecordBatch:
        keys, starts, numbers, ids = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), pa.array(starts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "n_tokens", "ids"],
        )

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    spread = listed.repartition(max(1, listed.count()), "file")
    return spread.mapInArrow(documents, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


