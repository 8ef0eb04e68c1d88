"""WARC archives with a two-level capture index.

Writing: pages with equal payloads of at least ``min_revisit`` bytes are stored
once, as the response with the greatest id; the others become revisit records.
Tasks write gzip members, one a record, to files in the shared folder; file
names carry the task attempt, and only files that a finished attempt reports
enter the capture table, so a lost executor leaves garbage but no wrong record.

Index: capture lines sorted by reversed-host URL key are written in compressed
blocks; the sparse directory has one row for each block (first key, last key, file,
offset, length).  Lookups take a table of keys: sorted ranges of keys binary-search the
part of the directory that covers them, the blocks found are dealt out and range-read
once each, their lines are binary-searched, and the records range-read.  Reading
everything back is a lookup of all keys; a hot key is as many groups as it has blocks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, spread_join, write_read

BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """A file system that reads and writes below ``uri``, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed-host sort key: http://www.Example.com:80/a?b#c becomes com,example)/a?b."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = parts.port
    except ValueError:
        return "-)" + (url or "").lower().replace("\n", "%0a").replace(" ", "%20")
    key = ",".join(reversed(host.split(".")))
    if port not in (None, 80, 443):
        key += f":{port}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{key}){tail.lower()}".replace("\n", "%0a").replace(" ", "%20")


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def header_text(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def build_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, not compressed; revisits keep the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {header_text(url or 'urn:x-none')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP header block and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": http, "payload": payload}


def page_of(urn: str | None) -> int | None:
    """Page id of a record id."""
    value = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def with_roles(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Only ids and digests are grouped by digest, the hot ones spread; payloads meet their
    roles by page id, and those of pages without an id stay where they are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    known = F.col("page_id").isNotNull()
    large = write_read(base.where((F.length("payload") >= min_revisit) & known).select("page_id", "digest"), "digests")
    repeated = write_read(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n_")).where("n_ > 1"), "repeated")
    roles = spread_join(large, repeated.drop("n_"), ["digest"], F.col("page_id"), counts=repeated.select("digest", "n_")).where("page_id < refers_to").distinct()
    names = ["page_id", "url", "payload", "digest", "refers_to"]
    joined = base.where(known).join(write_read(roles, "roles").hint("merge"), ["page_id", "digest"], "left").select(*names)
    return joined.unionByName(base.where(~known).withColumn("refers_to", F.lit(None).cast("bigint")).select(*names))


def write_archives(records: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all records; returns the stored capture table (key, url, page_id, kind, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        out, name, number = None, "", 0
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or out.tell() >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{number}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    number += 1
                kind = "response" if refers is None else "revisit"
                member = gzip.compress(build_record(kind, page, url, payload, bytes.fromhex(digest), refers, date), level, mtime=0)
                rows.append((url_key(url), url, page, kind, name, out.tell(), len(member)))
                out.write(member)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "url", "page_id", "kind", "file", "offset", "length"])
        if out is not None:
            out.close()

    return write_read(map_batches(records, ["page_id", "url", "payload", "digest", "refers_to"], run, "key string, url string, page_id bigint, kind string, file string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> str:
    """Sort capture lines by key, write them in compressed blocks; returns the folder of the block directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.cdx.gz"
        out, held, directory = None, [], []

        def flush() -> None:
            nonlocal out, held
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            block = gzip.compress("".join(held).encode("utf-8"), 6, mtime=0)
            directory.append((held[0].partition(" ")[0], held[-1].partition(" ")[0], name, out.tell(), len(block), len(held)))
            out.write(block)
            held = []

        for batch in batches:
            for key, page, kind, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "kind", "file", "offset", "length")), strict=True):
                held.append(f"{key} {json.dumps([page, kind, file, offset, length])}\n")
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        columns = list(zip(*directory, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["first_key", "last_key", "file", "offset", "length", "n_lines"])

    # Keys are compared as UTF-8 bytes here and by code points below: the same order.
    ordered = captures.select("key", "page_id", "kind", "file", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    directory = shared_dir(captures.sparkSession, "block-directory")
    ordered.mapInArrow(run, "first_key string, last_key string, file string, offset bigint, length bigint, n_lines int").write.parquet(directory)
    return directory


def read_range(store, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_block(store, path: str, offset: int, length: int) -> list[str]:
    return gzip.decompress(read_range(store, path, offset, length)).decode("utf-8").split("\n")[:-1]


def find_blocks(keys: DataFrame, directory: str) -> DataFrame:
    """(key, file, offset, length) of the index blocks that can hold each distinct key.

    Keys are dealt in sorted ranges; each batch of them reads the directory rows that
    cover its range and binary-searches them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        store, path = filesystem(directory)
        rows = ds.dataset(path, filesystem=store, format="parquet")
        for batch in batches:
            wanted = batch.column("key").to_pylist()
            if not wanted:
                continue
            near = rows.to_table(filter=(ds.field("last_key") >= wanted[0]) & (ds.field("first_key") <= wanted[-1])).to_pylist()
            near.sort(key=lambda r: (r["first_key"], r["last_key"]))
            last = [r["last_key"] for r in near]  # as sorted as the first keys are
            found = []
            for key in wanted:
                at = bisect_left(last, key)
                while at < len(near) and near[at]["first_key"] <= key:
                    found.append((key, near[at]["file"], near[at]["offset"], near[at]["length"]))
                    at += 1
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "file", "offset", "length"])

    distinct = keys.select("key").where("key is not null").distinct()
    return distinct.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key string, file string, offset bigint, length bigint")


def lookup(keys: DataFrame, directory: str, index_folder: str, archive_folder: str) -> DataFrame:
    """(key, page_id, record_type, refers_to, digest, payload) of every capture of the given ``key`` values.

    Each block found is one group: it is read once, its lines are binary-searched for
    each key, and the records are read by ranges in the order of their files and
    offsets.  A payload that does not match its digest fails the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, archive_path = filesystem(archive_folder)
        _, index_path = filesystem(index_folder)
        block, wanted = None, []
        for batch in batches:
            for file, offset, length, key in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "key")), strict=True):
                if (file, offset, length) != block:
                    yield from records(store, archive_path, index_path, block, wanted)
                    block, wanted = (file, offset, length), []
                wanted.append(key)
        yield from records(store, archive_path, index_path, block, wanted)

    def records(store, archive_path: str, index_path: str, block: tuple | None, wanted: list[str]) -> Iterator[pa.RecordBatch]:
        if block is None:
            return
        lines = read_block(store, f"{index_path}/{block[0]}", *block[1:])
        keys = [line.partition(" ")[0] for line in lines]
        entries = [(key, json.loads(line.partition(" ")[2])) for key in wanted for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
        rows, opened, handle = [], None, None
        for key, (_, kind, name, at, size) in sorted(entries, key=lambda e: (e[1][2], e[1][3])):
            if name != opened:
                if handle is not None:
                    handle.close()
                opened, handle = name, store.open_input_file(f"{archive_path}/{name}")
            record = parse_record(zlib.decompress(handle.read_at(size, at), wbits=31))
            headers = record["headers"]
            digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
            payload = record["payload"] if kind == "response" else None
            if payload is not None and hashlib.sha1(payload).digest() != digest:
                raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
            rows.append((key, page_of(headers["warc-record-id"]), headers["warc-type"], page_of(headers.get("warc-refers-to")), digest.hex(), payload))
            if len(rows) == 500:
                yield to_batch(rows)
                rows = []
        if handle is not None:
            handle.close()
        yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "page_id", "record_type", "refers_to", "digest", "payload"])

    blocks = find_blocks(keys, directory).repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return blocks.mapInArrow(run, "key string, page_id bigint, record_type string, refers_to bigint, digest string, payload binary")


def lookup_urls(urls: DataFrame, directory: str, index_folder: str, archive_folder: str) -> DataFrame:
    """``lookup`` of the keys of a ``url`` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return lookup(map_batches(urls.distinct(), ["url"], run, "key string"), directory, index_folder, archive_folder)


def archive_and_read(pages: DataFrame, min_revisit: int = 1000, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write, index and read back all pages: one digest row for each page.

    Null html is an empty payload and always a response.  Pages without an id are
    responses.  Rows that repeat the greatest id of a payload are responses all.
    Null or malformed URLs are indexed under a key of their own.  No rows, no files.
    """
    spark = pages.sparkSession
    archives, index = shared_dir(spark, "warc"), shared_dir(spark, "cdx")
    captures = write_archives(with_roles(pages, min_revisit), archives)
    directory = write_index(captures, index, block_lines)
    found = lookup(captures, directory, index, archives)
    read = write_read(found.select("page_id", "record_type", "refers_to", "digest", F.length("payload").cast("long").alias("payload_bytes")), "records")
    names = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    responses, revisits = read.where("record_type = 'response'"), read.where("record_type = 'revisit'").drop("payload_bytes")
    sizes = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    return responses.select(*names).unionByName(spread_join(revisits, sizes, ["refers_to", "digest"], F.col("page_id")).select(*names))
