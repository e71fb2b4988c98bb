"""Operator 8, WARC: archives written as one gzip stream, normalised to a gzip member per record, indexed and read back.

`write_archives` writes the records of each partition to files of bounded size, each a single gzip stream. `normalise` inflates such
a file once, as a stream, writes every record as a member of its own and beside the file an index of offsets.
`read_records` takes rows of the index and inflates single members. No step holds more than one record in memory.
Files go to the folder that driver and executors share. Each attempt of a task writes files of its own names, and only
those of finished attempts are in the tables that the steps return; these are written before the next step begins.

Payloads that are equal and have `least_bytes` or more get one response record, that of the largest id; the others are
revisits that refer to it. Null payloads count as empty. Rows that repeat that largest id with the same payload are all
responses; rows with a null id revisit, if any id is known for their payload. An empty table gives no archives and no
rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinward.llm.common import bounded_batches, cut, shared_dir

_CONTROL = re.compile(rb"[\x00-\x20\x7f]")
_CHUNK = 1 << 18


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, record_type, refers_to): which rows are revisits, decided from digests alone."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    digest = F.sha1("payload")
    names = rows.where(F.length("payload") >= least_bytes).select("id", digest.alias("digest"))
    copies = names.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = names.join(copies, "digest").where("id IS NULL OR id < refers_to").groupBy("digest", "id").agg(F.first("refers_to").alias("refers_to"))
    rows = rows.withColumn("digest", digest)
    out = rows.alias("r").join(again.alias("a"), (F.col("r.digest") == F.col("a.digest")) & F.col("r.id").eqNullSafe(F.col("a.id")), "left")
    kind = F.when(F.col("a.digest").isNull(), "response").otherwise("revisit")
    return out.select("r.id", "r.url", "r.payload", kind.alias("record_type"), "a.refers_to")


def record_bytes(page: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP header only, whose Content-Length is that of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if kind == "response" else http
    target = _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str("" if page is None else page).encode(), b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + payload_digest(payload).encode()]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _create(uri: str):
    files, path = _place(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path, compression=None)


def write_archives(records: DataFrame, folder: str, *, archive_bytes: int = 1 << 30) -> DataFrame:
    """(archive, records) of the files written: gzip streams, each closed once it has `archive_bytes`, so that no later task
    reads more than that and one record."""
    bounded_batches(records.sparkSession, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, name, gzip = None, 0, 0, "", None

        def close() -> pa.RecordBatch:
            out.write(gzip.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name, gzip, n, size = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    out = _create(name)
                size += out.write(gzip.compress(record_bytes(*row))) or 0
                n += 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.select("id", "url", "payload", "record_type", "refers_to").mapInArrow(write, "archive string, records long")


def inflate_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of each record of a gzip file, however many members it has, inflated once as a stream."""
    gzip, held = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal gzip
        while True:
            data = gzip.unused_data if gzip.eof else b""
            data = data or source.read(_CHUNK)
            if not data:
                return False
            if gzip.eof:
                gzip = zlib.decompressobj(31)
            got = gzip.decompress(data)
            if got:
                held.extend(got)
                return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        header = parse_header(bytes(held[:end]))
        size = end + 4 + int(header["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield header, bytes(held[:size])
        del held[:size]


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(archives: DataFrame, folder: str, *, remove: bool = False) -> DataFrame:
    """(archive, offset, length, record_type, record_id, target) of every record, from one stream through each archive.

    Beside each new file NAME.warc.gz is NAME.idx, its lines (offset, length, type, id, target) parted by tabs.
    `remove` deletes the archives of one stream once they are rewritten.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"{folder}/records-{uuid.uuid4().hex}"
                files, path = _place(archive)
                at, rows = 0, []
                with files.open_input_stream(path, compression=None) as source, _create(f"{name}.warc.gz") as out, _create(f"{name}.idx") as index:
                    for header, record in inflate_records(source):
                        gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gzip.compress(record) + gzip.flush()
                        out.write(member)
                        rows.append((f"{name}.warc.gz", at, len(member), header["warc-type"], header["warc-record-id"], header.get("warc-target-uri", "")))
                        index.write("\t".join(map(str, rows[-1][1:])).encode() + b"\n")
                        at += len(member)
                        if len(rows) >= 5000:
                            yield _index(rows)
                            rows = []
                yield _index(rows)

    out = archives.select("archive").mapInArrow(rewrite, "archive string, offset long, length long, record_type string, record_id string, target string")
    if not remove:
        return out
    done = cut(out, "warc-index")
    archives.select("archive").foreachPartition(_delete)
    return done


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=["archive", "offset", "length", "record_type", "record_id", "target"])


def _delete(rows) -> None:
    for row in rows:
        files, path = _place(row.archive)
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_file(path)


def read_records(index: DataFrame) -> DataFrame:
    """(record_id, record_type, target, payload, payload_bytes, payload_digest, refers_to) of the rows of an index.

    The digest of a response is taken of the payload read and held against the record's own. A revisit has no payload of
    its own (null); its size and digest are those of its headers.
    """
    bounded_batches(index.sparkSession, 256)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            opened: dict[str, pa.NativeFile] = {}
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive not in opened:
                    for x in opened.values():
                        x.close()
                    files, path = _place(archive)
                    opened = {archive: files.open_input_file(path)}
                member = opened[archive].read_at(length, offset)
                head, _, body = zlib.decompress(member, 31).partition(b"\r\n\r\n")
                header = parse_header(head)
                http, _, payload = body[: int(header["content-length"])].partition(b"\r\n\r\n")
                digest = header["warc-payload-digest"].partition(":")[2]
                response = header["warc-type"] == "response"
                if response and payload_digest(payload) != digest:
                    raise ValueError(f"{archive}: the payload at {offset} differs from its digest")
                size = len(payload) if response else int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                out.append((header["warc-record-id"], header["warc-type"], header.get("warc-target-uri", ""), payload if response else None, size, digest, header.get("warc-refers-to")))
            for x in opened.values():
                x.close()
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            names = ["record_id", "record_type", "target", "payload", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)

    return index.select("archive", "offset", "length").mapInArrow(read, "record_id string, record_type string, target string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def round_trip(pages: DataFrame, *, least_bytes: int = 0, archive_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives, normalises the archives and returns what read_records reads of them."""
    folder = shared_dir(pages.sparkSession, "warc")
    archives = cut(write_archives(plan_records(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, least_bytes=least_bytes), folder, archive_bytes=archive_bytes), "warc-archives")
    files = max(1, archives.count())
    index = normalise(archives.repartition(files), folder, remove=True)
    return read_records(index.repartition(files, "archive").sortWithinPartitions("archive", "offset"))
