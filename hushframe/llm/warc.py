"""WARC archives, index first.

Writing: payload digests are grouped; of equal payloads of MIN_REVISIT bytes or more the smallest page_id is stored as a
response and the others as revisits that refer to it. Tasks write records, each its own gzip member, to archive files in the
shared folder, and return for each record its file, offset, length, URL and digest. The index is their Parquet table; it is
the commit: files of tasks that were lost or run twice are in no index row, so nobody reads them.

Reading: selected index rows go to tasks by file, sorted by offset; ranges that touch or nearly touch are read at once.

Files are opened with pyarrow's file systems, by the URI of the shared folder, so tasks need no folder of their own.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.batches import chunked, map_batches
from hushframe.llm.shared import broadcast_if_small, fresh_path, join_per_key, stored

#: Smaller payloads are always stored.
MIN_REVISIT = 100
#: Bytes of an archive file before the next is begun; of one read; between ranges that are read together.
FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10
#: Bytes of archives for a reading task, about.
TASK_BYTES = 32 << 20
#: WARC-Date of all records; pages have no time of their own.
DATE = "2025-01-01T00:00:00Z"

_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_SAFE)}"]), f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]), f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n", compresslevel=1, mtime=0)


_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def parse(data: bytes) -> dict:
    """Fields of a compressed record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    ValueError if a stored payload is not what its digest says.
    """
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(x) if name in fields and (x := fields[name][len("<urn:page:") : -1]) else None
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); the index: page_id, url, digest, record_type, file, offset, length.

    Null html is an empty payload. A row without page_id is always a response, and none refers to it. Rows
    that repeat a page_id and its payload are responses each if that page_id is the smallest. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    sizes = stored(rows.filter((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest"), "warc-digests")
    firsts = stored(sizes.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-firsts")
    revisits = stored(join_per_key(sizes, firsts, ["digest"], "n", sizes.count()).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    folder = fresh_path(pages.sparkSession, "archives")

    def write(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out = path = None
        at = 0
        for batch in chunked(batches, "payload"):
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(path, compression=None)
                    info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), mtime=0)
                    out.write(info)
                    at += len(info)
                data = record(page_id, url, payload, digest, refers_to)
                out.write(data)
                index.append((page_id, url, digest, "response" if refers_to is None else "revisit", path, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    ready = rows.join(broadcast_if_small(revisits), ["page_id", "digest"], "left")
    index = map_batches(ready, write, "page_id long, url string, digest string, record_type string, file string, offset long, length long")
    return stored(index, "warc-index").withColumn("folder", F.lit(folder))


def ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) of records joined to reads: (first record, one after the last, bytes from the first's offset)."""
    out: list[tuple[int, int, int]] = []
    for k, (offset, length) in enumerate(places):
        if out:
            first, end, size = out[-1]
            start = places[first][0]
            if offset - (start + size) <= gap and offset + length - start <= most:
                out[-1] = (first, k + 1, max(size, offset + length - start))
                continue
        out.append((k, k + 1, length))
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows: page_id, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload."""
    spark = index.sparkSession
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-int(size) // TASK_BYTES), min(spark.sparkContext.defaultParallelism, int(size) // (1 << 20)))
    places = index.select("folder", "file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / TASK_BYTES)).sortWithinPartitions("file", "offset")

    def read(batches):
        files = opened = source = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("folder", "file", "offset", "length")]
            start, n = 0, batch.num_rows
            while start < n:
                end = start + 1
                while end < n and cols[1][end] == cols[1][start]:
                    end += 1
                if opened != cols[1][start]:
                    if source is not None:
                        source.close()
                    files = pafs.FileSystem.from_uri(cols[0][start])[0]
                    opened, source = cols[1][start], files.open_input_file(cols[1][start])
                spots = list(zip(cols[2][start:end], cols[3][start:end]))
                for first, after, length in ranges(spots):
                    data, zero = source.read_at(length, spots[first][0]), spots[first][0]
                    found = [parse(data[o - zero : o - zero + k]) for o, k in spots[first:after]]
                    if not payloads:
                        for x in found:
                            x["payload"] = None
                    yield pa.RecordBatch.from_pylist(found, schema=_READ)
                start = end
        if source is not None:
            source.close()

    out = map_batches(places, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")
