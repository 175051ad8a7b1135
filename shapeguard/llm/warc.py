"""WARC archives: a writer and a sequential reader.

Each page is one record in a gzip member of its own. Of pages with equal
payloads the one with the least page_id is stored as a response; the others
become revisit records that name it. The reader walks an archive member by
member with incremental zlib decompression, frames each block by its
Content-Length and verifies both digests.

Archives are written by tasks into a folder all executors share, under names of
their own for each attempt; the manifest, itself a table in the shared folder,
names only what finished, so lost or repeated tasks leave nothing that is read.
It says how many records each archive has, and the reader, a task an archive,
raises where it finds another number.

Payloads are not shuffled to learn what they repeat: the digests that occur twice
are a table that is broadcast after a check of its size, and beyond that size
only the rows of such digests meet it by shuffle, the hottest of them apart.

Defined cases: a null html is an empty payload; payloads under ``LEAST`` bytes
are always responses; payloads of any length are written whole; rows that repeat
the least page_id of a payload are all responses; a payload all of whose page_ids
are null has no revisits; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeguard.llm.common import cut, fresh_path, small, strings, utf8

LEAST = 100
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 16


class DigestError(ValueError):
    pass


class ManifestError(ValueError):
    pass


def record_id(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") or None


def sha256_base32(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def hex_digest(named: str) -> str:
    code = named.removeprefix("sha256:")
    return base64.b32decode(code + "=" * (-len(code) % 8)).hex()


def member(page_id: object, url: str, payload: bytes, refers_to: object = None) -> bytes:
    """One record, gzipped on its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", sha256_base32(block)),
        ("WARC-Payload-Digest", sha256_base32(payload)),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    rest = stream.read(CHUNK)
    while rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                raise EOFError("the archive ends inside a member")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else stream.read(CHUNK)
        yield b"".join(parts)
        rest = rest or stream.read(CHUNK)


def parse(data: bytes) -> dict:
    """A record's fields and payload; digests and framing are verified."""
    head, found, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block = body[:size]
    if len(block) != size or body[size:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as it says")
    if sha256_base32(block) != fields["WARC-Block-Digest"]:
        raise DigestError(fields["WARC-Record-ID"])
    http, _, payload = block.partition(b"\r\n\r\n")
    named = fields["WARC-Payload-Digest"]
    said = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and (sha256_base32(payload) != named or said != len(payload)):
        raise DigestError(fields["WARC-Record-ID"])
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": said,
        "payload_digest": hex_digest(named),
        "refers_to": page_of(fields.get("WARC-Refers-To", "")) if "WARC-Refers-To" in fields else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read(stream: BinaryIO) -> Iterator[dict]:
    return map(parse, members(stream))


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "archive string, records long, bytes long"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    done, stream, name, records, size, raw = [], None, "", 0, 0, 0
    for batch in small(batches):
        pages, urls = batch.column(0).to_pylist(), strings(batch.column(1))
        for page, url, payload, refers in zip(pages, urls, utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if stream is None:
                name, records, size, raw = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                stream = store.open_output_stream(f"{root}/{name}", compression=None)
            data = member(page, url, payload, refers)
            stream.write(data)
            records, size, raw = records + 1, size + len(data), raw + len(payload)
            if raw >= ARCHIVE_BYTES:
                stream.close()
                done.append({"archive": name, "records": records, "bytes": size})
                stream = None
    if stream is not None:
        stream.close()
        done.append({"archive": name, "records": records, "bytes": size})
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    yield pa.RecordBatch.from_pylist(done, schema)


#: Repeated digests (of some 100 bytes each) that are broadcast; a larger table meets the pages by shuffle.
BROADCAST_DIGESTS = 200_000


def with_originals(pages: DataFrame, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, html, refers_to: whom a page's payload repeats, else null."""
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("digest", F.when(F.octet_length("html") >= LEAST, F.sha2("html", 256)))
    # Page ids and digests alone; a payload's rows combine before the shuffle.
    first = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = cut(first.where("n > 1"), "repeated")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    if repeated.count() <= most:
        return keyed.join(F.broadcast(repeated), "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    # The most frequent digests, at most so many, are still broadcast, so no task holds one's pages.
    often = F.broadcast(repeated.orderBy(F.desc("n"), "digest").limit(most).select("digest", F.col("first").alias("often")))
    split = keyed.join(often, "digest", "left")
    rest = split.where("often IS NULL").drop("often").join(repeated.join(often, "digest", "left_anti"), "digest", "left")
    met = split.where("often IS NOT NULL").withColumnRenamed("often", "first").unionByName(rest.drop("n"))
    return met.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder``; the manifest: archive, records, bytes."""
    return cut(with_originals(pages).mapInArrow(partial(_write, folder=folder), MANIFEST), "manifest")


RECORD = pa.schema(
    [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
)
RECORD_SQL = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
READ_ROWS, READ_BYTES = 512, 8 << 20


def _read(batches: Iterator[pa.RecordBatch], folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    store, root = filesystem(folder)
    schema = pa.schema([RECORD.field(c) for c in columns])
    for batch in batches:
        for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                rows, held, found = [], 0, 0
                for record in read(stream):
                    rows.append({c: record[c] for c in columns})
                    found, held = found + 1, held + len(record["payload"] or b"")
                    if len(rows) >= READ_ROWS or held >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if found != records:
                    raise ManifestError(f"{name} has {found} records, the manifest says {records}")
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(manifest: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records of the archives that a manifest names, a task an archive."""
    columns = columns or RECORD.names
    own = manifest.select("archive", "records")
    # A given number of partitions, as small rows would be merged into one task by their bytes.
    spread = own.repartitionByRange(max(1, own.count()), "archive")
    kinds = dict(x.split() for x in RECORD_SQL.split(", "))
    return spread.mapInArrow(partial(_read, folder=folder, columns=columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder and read them back, payloads apart."""
    folder = fresh_path(pages.sparkSession, "warc")
    kept = [c for c in RECORD.names if c != "payload"]
    return read_archives(write(pages, folder), folder, kept)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
