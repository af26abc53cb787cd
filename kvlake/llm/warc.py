"""WARC archives: writing them, and normalising monolithic gzip.

A crawler may compress a whole archive as one gzip stream, in which no record
can be reached without inflating all before it.  The normaliser inflates such a
stream once, front to back, rewrites every record as a gzip member of its own,
and writes a sidecar index of the members' offsets.

Archives are rows ``(archive, data)`` of a table in the shared folder, so any
store that Spark can write serves; an archive is closed at a bounded size.  The
sidecar is a column of the same row: reading the index alone reads no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.storage import Scratch, prepare_workers

ARCHIVE_BYTES = 8 << 20
_LEVEL = 5
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that does not follow the format, or whose digest is wrong."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """One uncompressed WARC/1.1 record; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in (headers | {"Content-Length": str(len(block))}).items() if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that leaves the payload out."""
    key = "none" if page_id is None else str(page_id)
    digest = payload_digest(payload)
    target = None if url is None else url.encode("unicode_escape").decode()
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {target} {digest}')}>",
        "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": _REVISIT if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": None if page_id is None else key,
        "X-Payload-Length": str(len(payload)),
        "X-Refers-To-Page-ID": None if refers_to is None else str(refers_to),
    }
    return record_bytes(headers, _HTTP if kind == "revisit" else _HTTP + payload)


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """``(headers, block, record)`` of each record of inflated bytes, streaming.

    Holds one record and one chunk at a time.
    """
    source, held = iter(chunks), b""

    def more() -> bool:
        nonlocal held
        part = next(source, None)
        if part is None:
            return False
        held += part
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise WarcError("the archive ends inside a record's header")
                return
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"a record begins with {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = end + 4 + int(headers["Content-Length"])
        parts, have = [held], len(held)
        while have < size + 4:
            part = next(source, None)
            if part is None:
                raise WarcError("the archive ends inside a record")
            parts.append(part)
            have += len(part)
        held = b"".join(parts)
        if held[size : size + 4] != b"\r\n\r\n":
            raise WarcError("a record is longer than it says")
        yield headers, held[end + 4 : size], held[: size + 4]
        held = held[size + 4 :]


def inflate(stream: Iterable[bytes], chunk: int = 1 << 18) -> Iterator[bytes]:
    """Inflate gzip bytes of any number of members, in bounded chunks, once."""
    unzip = zlib.decompressobj(31)
    begun = False
    for data in stream:
        while data:
            begun = True
            out = unzip.decompress(data, chunk)
            if out:
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
    if begun:
        raise WarcError("the gzip stream is cut off")


def normalise(stream: Iterable[bytes]) -> Iterator[tuple[bytes, dict]]:
    """``(gzip member, index entry)`` of each record of a gzip stream."""
    offset = 0
    for headers, _, record in read_records(inflate(stream)):
        member = gzip.compress(record, _LEVEL, mtime=0)
        yield member, {
            "offset": offset,
            "length": len(member),
            "type": headers["WARC-Type"],
            "id": headers["WARC-Record-ID"],
            "url": headers.get("WARC-Target-URI"),
            "digest": headers.get("WARC-Payload-Digest"),
        }
        offset += len(member)


def normalise_file(source: str, target: str, index: str, chunk: int = 1 << 20) -> int:
    """Normalise a file on a mounted path; the index is one JSON object a line."""
    count = 0
    with open(source, "rb") as src, open(target, "wb") as dst, open(index, "w") as idx:
        for member, entry in normalise(iter(lambda: src.read(chunk), b"")):
            dst.write(member)
            idx.write(json.dumps(entry) + "\n")
            count += 1
    return count


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(archive, data)`` of files in any store that Spark reads, for ``normalise_archives``.

    ``archive`` is the file's path; a file of over 2 GB is more than a row can
    hold and raises.  Empty files give no row; a path without files raises.
    """
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def read_member(data: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, reached by its index entry alone."""
    found = list(read_records([gzip.decompress(data[offset : offset + length])]))
    if len(found) != 1:
        raise WarcError("a member does not hold one record")
    return found[0][0], found[0][1]


def mark_revisits(pages: DataFrame, least_bytes: int, scratch: Scratch) -> DataFrame:
    """``page_id, url, payload, kind, refers_to`` of each page.

    Only payloads that occur more than once are looked up; the pages themselves
    move once.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    long_enough = F.length("payload") >= least_bytes
    groups = rows.where(long_enough).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = scratch.table(groups.where("n > 1 and first is not null").select("key", "first"), "groups")
    found = rows.join(groups, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select(
        "page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to")
    )


def write_monolithic(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``(archive, data)``, each one gzip stream of whole records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            data = b"".join([*parts, pack.flush()])
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], ["archive", "data"])

        pack, parts, size = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), [], 0
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                record = page_record(row[0].as_py(), row[1].as_py(), row[2].as_py(), row[3].as_py(), row[4].as_py())
                if size and size + len(record) > archive_bytes:
                    yield close()
                    pack, parts, size = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), [], 0
                parts.append(pack.compress(record))
                size += len(record)
        if size:
            yield close()

    return records.select("page_id", "url", "payload", "kind", "refers_to").mapInArrow(write, "archive string, data binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rows ``(archive, data)`` in, ``(archive, data, index)`` out; one row at a time.

    A null or empty archive has no records; one that is cut off or follows no
    format raises ``WarcError``.  Repeated rows are each rewritten, a null name
    stays, other columns are ignored, and an empty table gives an empty result.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                members, entries = [], []
                for member, entry in normalise([data.as_py() or b""]):
                    members.append(member)
                    entries.append(json.dumps(entry))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([b"".join(members)], pa.binary()), pa.array(["\n".join(entries)])],
                    ["archive", "data", "index"],
                )

    return archives.select("archive", "data").mapInArrow(rewrite, "archive string, data binary, index string")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Each record of normalised archives, reached by the sidecar's offsets.

    Digests of responses are computed anew and must equal the header's; else
    ``WarcError`` is raised.  ``payload`` is null for revisits, and for all
    records without ``payloads``.  Archives without records, null ones included,
    give no row, repeated ones give theirs again, other columns are ignored, and
    an empty table gives an empty result.
    """
    schema = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset bigint, length bigint"
    arrow = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, index in zip(*batch.columns, strict=True):
                blob, rows = data.as_py(), []
                for entry in map(json.loads, filter(None, (index.as_py() or "").split("\n"))):
                    headers, block = read_member(blob, entry["offset"], entry["length"])
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise WarcError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
                    url = headers.get("WARC-Target-URI")
                    rows.append(
                        (number(headers.get("X-Page-ID")), url and url.encode().decode("unicode_escape"), kind, payload if payloads and kind == "response" else None,
                         int(headers["X-Payload-Length"]), digest, number(headers.get("X-Refers-To-Page-ID")), name.as_py(), entry["offset"], entry["length"])
                    )
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return archives.select("archive", "data", "index").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and return those.

    Result: ``(archive, data, index)``.  A null html is an empty payload, a null
    url gives no target header.  Of records with equal payloads of at least
    ``least_bytes``, the one with the largest page_id is a response and the
    others revisit it; rows that repeat this page_id are responses too, and so
    are all rows where every page_id is null.  Other columns are ignored; an
    empty table gives no archive.
    """
    prepare_workers(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc")
    raw = {"compression": "uncompressed"}
    monolithic = scratch.table(write_monolithic(mark_revisits(pages, least_bytes, scratch), archive_bytes), "monolithic", **raw)
    return scratch.table(normalise_archives(monolithic), "normalised", **raw)


# SHA-1 comes as 40 hex digits; base32 takes them five (20 bits, four letters) at a time.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST_SQL = " || ".join(
    f"substr('{_LETTERS}', (CAST('0x' || substr(hex, {5 * i + 1}, 5) AS INTEGER) >> {shift} & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_DIGEST_SQL} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""
