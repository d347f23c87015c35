"""WARC archives, written and read as a stream of chunks.

Writing: a page is a response record, or a revisit record if a page of a larger id has the same
payload.  The payload goes out in chunks through a gzip member per record.  Archives are rolled at a
size, named by the task's own token, and only those that the manifest lists are read, so a task that
runs twice after a lost executor does no harm.

Reading: an archive is decompressed in pieces and cut into a chunk table, a row per record and chunk
number, with the running length and digest; nothing holds a whole record, however long its payload.
The last chunk of a record carries its full length and digest, which is checked against the header.

Cases: a null payload is an empty one; a page with a null id is a response only if no page with an id
has its payload; rows that repeat the id and payload of a response are responses too; a null url
becomes urn:none; an empty table gives no archives; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import batch, cut, fan_out, new_folder, slices, texts_of

CHUNK = 1 << 18
DATE = "2020-01-01T00:00:00Z"
RECORD = "urn:page:"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def originals(pages: DataFrame) -> DataFrame:
    """page_id, digest (hex SHA-1), refers_to of the pages that revisit another."""
    p = pages.select("page_id", F.expr("sha1(coalesce(html, ''))").alias("digest"), F.expr("octet_length(html)").alias("n"))
    p = p.withColumn("n", F.coalesce("n", F.lit(0)))
    first = p.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    copies = p.join(first.drop("c"), ["digest", "n"]).where("NOT page_id <=> refers_to AND refers_to IS NOT NULL")
    return copies.select("page_id", "digest", "refers_to").distinct()


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def _record(page_id: int | None, url: str | None, data: bytes, refers_to: int | None, put: Callable) -> None:
    """One record through `put`, the payload in chunks."""
    digest = hashlib.sha1()
    for at in range(0, len(data), CHUNK):
        digest.update(memoryview(data)[at : at + CHUNK])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", f"<{RECORD}{'none' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")),
        ("WARC-Payload-Digest", "sha1:" + base32(digest.hexdigest())),
    ]
    if again:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{RECORD}{refers_to}>"),
        ]
    fields += [
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if again else len(data)))),
    ]
    put(_head(fields) + http)
    if not again:
        for at in range(0, len(data), CHUNK):
            put(memoryview(data)[at : at + CHUNK])
    put(b"\r\n\r\n")


def write(spark: SparkSession, pages: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages; returns the manifest: path, n_records, n_bytes."""
    folder = new_folder(spark, "warc")
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
    again = cut(spark, originals(pages)).select(
        F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to"
    )
    rows = pages.select("page_id", "url", "html", F.expr("sha1(coalesce(html, ''))").alias("digest")).join(
        again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        out = path = None
        count = size = 0
        for rows in batches:
            for piece in slices(rows, "html"):
                ids, urls, refers = (piece.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
                for page_id, url, data, refers_to in zip(ids, urls, texts_of(piece.column("html")), refers):
                    if out is None:
                        path = f"{uuid.uuid4().hex}.warc.gz"
                        out, count, size = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    done = 0

                    def put(part: bytes) -> None:
                        nonlocal done
                        z = member.compress(part)  # noqa: B023
                        out.write(z)  # noqa: B023
                        done += len(z)

                    _record(page_id, url, data, refers_to, put)
                    last = member.flush()
                    out.write(last)
                    count, size = count + 1, size + done + len(last)
                    if size >= most_bytes:
                        out.close()
                        yield batch(schema, [[f"{folder}/{path}"], [count], [size]])
                        out = None
        if out is not None:
            out.close()
            yield batch(schema, [[f"{folder}/{path}"], [count], [size]])

    table = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long")
    return cut(spark, table)


class _Stream:
    """Bytes of a file of gzip members, decompressed in pieces."""

    def __init__(self, file):
        self.file, self.packed, self.plain = file, b"", bytearray()
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.member.eof:
            self.packed = self.member.unused_data or self.packed
            self.member = zlib.decompressobj(31)
        if not self.packed:
            self.packed = self.file.read(CHUNK)
        if not self.packed:
            return False
        self.plain += self.member.decompress(self.packed, CHUNK)
        self.packed = self.member.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark) + 1)
            if not self._more():
                if self.plain:
                    raise ValueError("the archive breaks off")
                return None
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def some(self, most: int) -> bytes:
        while not self.plain:
            if not self._more():
                raise ValueError("the archive breaks off")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix(RECORD)
    return int(tail) if tail.lstrip("-").isdigit() else None


def chunks_of(file) -> Iterator[tuple]:
    """Rows of the chunk table: record, page_id, record_type, refers_to, chunk, data, last, payload_bytes, payload_digest."""
    stream, number = _Stream(file), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        http = stream.until(b"\r\n\r\n")
        left = int(f["content-length"]) - len(http) - 4
        named = (number, _page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")))
        told = f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-type"] == "revisit":
            yield (*named, 0, b"", True, int(_fields(http)["content-length"]), told)
        else:
            digest, size, chunk = hashlib.sha1(), 0, 0
            while True:
                data = stream.some(min(CHUNK, left)) if left else b""
                left -= len(data)
                size += len(data)
                digest.update(data)
                found = base32(digest.hexdigest()) if not left else None
                if found not in (None, told):
                    raise ValueError(f"record {named[1]}: the payload's digest isn't that of its header")
                yield (*named, chunk, data, not left, size, found)
                chunk += 1
                if not left:
                    break
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError("a record doesn't end where its length says")
        number += 1


def read(spark: SparkSession, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives of the manifest."""
    schema = pa.schema(
        [("path", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())]
        + [("refers_to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("last", pa.bool_())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(inner, compression=None) as file:
                    for row in chunks_of(file):
                        size += len(row[5]) + 200
                        held.append((path, *row) if with_data else (path, *row[:5], None, *row[6:]))
                        if size > 8 << 20:
                            yield batch(schema, zip(*held))
                            held, size = [], 0
                if held:
                    yield batch(schema, zip(*held))

    ddl = (
        "path string, record long, page_id long, record_type string, refers_to long, chunk long, data binary, "
        "last boolean, payload_bytes long, payload_digest string"
    )
    return manifest.select("path").repartition(fan_out(spark)).mapInArrow(run, ddl)


def records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and return a row per record."""
    table = read(spark, write(spark, pages), with_data=False)
    return table.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
