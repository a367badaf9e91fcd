"""Archives of web pages with a two-level capture index.

``write_archives`` writes WARC files: a response record per payload and revisit records for its repeats, every record a gzip member of its own, so that one can
be read alone. ``write_index`` sorts captures by URL key (host reversed), cuts them into compressed blocks and keeps a sparse
directory with the first key of every block: one directory per index file, and one row per index file as the top level. ``lookup``
finds the index files whose key range holds a wanted key, searches their directories by bisection, reads the blocks
in question and searches these. ``read_records`` reads records by place.

Null html is an empty payload, a null URL has the key ``-`` and no target header. Payloads of fewer than ``least`` bytes are always responses.
Of equal payloads the smallest page id is the response, and rows that repeat that id are responses too; with null ids only, all are.
Empty tables give no files and no rows. Columns besides ``page_id``, ``url`` and ``html`` are left out, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import files
from limnos.session import settle

# Captures per index block.
BLOCK = 1000
# Fixed date of capture: the tables hold none.
DATE = "1970-01-01T00:00:00Z"
NO_URL = "-"
# Index files that one read of the top level may list: its size bound.
INDEX_FILES = 1024

# Bytes of records that a task reads.
READ = 8_000_000
CAPTURE = "key string, page_id bigint, record_type string, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """Sort key of a URL: labels of the host in reverse order, then port, path and query as they are. User names, scheme and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), "#.*$", "")
    place = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), "^.*@", "")
    host, port = F.regexp_extract(place, r"^[^:]*", 0), F.regexp_extract(place, r":.*$", 0)
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    turned = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    return F.coalesce(F.concat(turned, port, F.lit(")"), F.when(rest == "", "/").otherwise(rest)), F.lit(NO_URL))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """One record as a gzip member. A revisit has no payload, but tells its length, its digest and the page that has it."""
    payload, response = row["payload"], row["record_type"] == "response"
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if response:
        http += payload
    else:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """What a record says: type, ids, payload (None for a revisit), its length and digest. Raises if a payload does not match its digest."""
    raw = zlib.decompress(member, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": None if refers is None else int(refers), "payload_bytes": length, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` with ``record_type`` and ``refers_to``. Only digests that several rows share are joined back."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("_digest", F.sha1("payload"))
    shared = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1 and _first is not null")
        .select("_digest", "_first")
    )
    repeat = (F.octet_length("payload") >= least) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        rows.join(settle(shared, "warc-shared"), "_digest", "left")
        .withColumn("record_type", F.when(repeat, "revisit").otherwise("response"))
        .select("page_id", "url", "payload", "record_type", F.when(repeat, F.col("_first")).alias("refers_to"))
    )


def write_archives(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Write all records. Returns the folder and one row per capture: key, page id, type, file, offset, length."""
    spark = pages.sparkSession
    files.ship(spark)
    base = files.folder(spark, "warc")

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, name, at = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, name = files.write(base, f"pages-{TaskContext.get().partitionId():06d}", ".warc.gz")
            offsets, lengths = [], []
            for row in batch.to_pylist():
                member = record(row)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("page_id"), batch.column("record_type"),
                    pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                ],
                names=["key", "page_id", "record_type", "file", "offset", "length"],
            )
        if out:
            out.close()

    rows = with_roles(pages, least).withColumn("key", url_key(F.col("url")))
    return base, settle(rows.mapInArrow(written, CAPTURE), "warc-captures")


@dataclass(frozen=True)
class Index:
    """Folder of the index files and the top level, sorted: first key, last key and name of each file."""

    base: str
    files: list[tuple[str, str, str]]


def write_index(captures: DataFrame, block: int = BLOCK) -> Index:
    """Sort captures by key into files of compressed blocks, each file followed by its directory.

    There are INDEX_FILES files at most, so the top level is small whatever the number of captures.

    File: zlib blocks of JSON lines; directory (zlib JSON: first key, last key, offset, length of each block); its length in 8 bytes.
    """
    spark = captures.sparkSession
    files.ship(spark)
    base = files.folder(spark, "index")

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, name, at, directory, lines = None, "", 0, [], []

        def flush() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(line) for line in lines).encode(), 6)
            out.write(raw)
            directory.append([lines[0][0], lines[-1][0], at, len(raw)])
            at += len(raw)
            lines.clear()

        for batch in batches:
            if batch.num_rows and out is None:
                out, name = files.write(base, f"index-{TaskContext.get().partitionId():06d}", ".idx")
            for line in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                lines.append(line)
                if len(lines) == block:
                    flush()
        if out:
            if lines:
                flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw + len(raw).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [directory[0][0]], "last_key": [directory[-1][1]]})

    order = ["key", "file", "offset"]
    number = min(INDEX_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = captures.repartitionByRange(number, *order).sortWithinPartitions(*order).select("key", "page_id", "record_type", "file", "offset", "length")
    listed = in_order.mapInArrow(written, "file string, first_key string, last_key string")
    return Index(base, sorted(tuple(row) for row in settle(listed, "index-files").select("first_key", "last_key", "file").collect()))


@lru_cache(maxsize=8)
def _directory(base: str, name: str) -> list[list]:
    with files.read(base, name) as file:
        size = file.size()
        file.seek(size - 8)
        length = int.from_bytes(file.read(8), "little")
        file.seek(size - 8 - length)
        return json.loads(zlib.decompress(file.read(length)))


@lru_cache(maxsize=8)
def _block(base: str, name: str, offset: int, length: int) -> list[list]:
    with files.read(base, name) as file:
        file.seek(offset)
        return [json.loads(line) for line in zlib.decompress(file.read(length)).split(b"\n")]


def captures_in(base: str, name: str, key: str) -> Iterator[list]:
    """Captures of a key in one index file: bisection in the directory, range reads of the blocks, bisection in each."""
    directory = _directory(base, name)
    at = bisect_left(directory, key, key=lambda entry: entry[1])
    while at < len(directory) and directory[at][0] <= key:
        lines = _block(base, name, directory[at][2], directory[at][3])
        lo = bisect_left(lines, key, key=lambda line: line[0])
        yield from lines[lo : bisect_right(lines, key, key=lambda line: line[0])]
        at += 1


def lookup(index: Index, urls: DataFrame, url: str = "url") -> DataFrame:
    """Captures of all distinct URLs in ``urls``.

    A key goes to every index file whose range holds it, so the captures of a very frequent key are read by several tasks. Keys are then
    sorted by file, so that a task reads its blocks one after another.
    """
    base, top = index.base, index.files
    schema = pa.schema(
        [("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def holders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                at = bisect_left(top, key, key=lambda entry: entry[1])
                while at < len(top) and top[at][0] <= key:
                    rows.append({"index_file": top[at][2], "key": key})
                    at += 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("index_file", pa.string()), ("key", pa.string())]))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for name, key in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for line in captures_in(base, name, key):
                    rows.append(line)
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    files.ship(urls.sparkSession)
    keys = urls.select(url_key(F.col(url)).alias("key")).distinct()
    wanted = settle(keys.mapInArrow(holders, "index_file string, key string"), "warc-wanted")
    order = ["index_file", "key"]
    return wanted.repartitionByRange(max(1, len(top)), *order).sortWithinPartitions(*order).mapInArrow(found, CAPTURE)


def read_records(spark: SparkSession, base: str, captures: DataFrame, payload: bool = False) -> DataFrame:
    """Records by file and place, in that order within each task. Payloads are checked against their digests; they are returned if ``payload``."""

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file:
                        file.close()
                    name, file = row["file"], files.read(base, row["file"])
                file.seek(row["offset"])
                rows.append({k: v for k, v in parsed(file.read(row["length"])).items() if k in names})
            yield pa.RecordBatch.from_pylist(rows, schema)
        if file:
            file.close()

    fields = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)
    names = set(schema.names)
    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    order = ["file", "offset"]
    # The rows are small and the records are not: tasks follow the bytes to be read.
    tasks = -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ) or 1
    placed = captures.select("file", "offset", "length").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(records, kinds + ", payload binary" * payload)
