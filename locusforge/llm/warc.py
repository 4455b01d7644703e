"""WARC archives: write, normalise and read.

Archives are first written the plain way, one gzip stream for a whole file.
The normaliser inflates such a stream once, rewrites every record as a gzip
member of its own and writes a sidecar index of the members' offsets, after
which any record can be read alone. Equal payloads are stored once: later
copies are revisit records that refer to the first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, bytes_of, open_shared, slices, spread, stored, table
from locusforge.session import scratch_path

# Payloads under this size are always stored.
MIN_REVISIT_BYTES = 100
# Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
# Records that the index hands out as one block to read.
BLOCK_RECORDS = 500
CHUNK = 1 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window setting for gzip streams


# --- records --------------------------------------------------------------
def record_bytes(page_id: str | None, url: str | None, payload: bytes, size: int, digest: str,
                 refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{_name(page_id)}>"), ("WARC-Date", date),
              ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")),
              ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{_name(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: str | None) -> str:
    return "" if page_id is None else "id:" + quote(page_id, safe="")


def _page(name: str | None) -> str | None:
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return unquote(inner[3:]) if inner else None


class RecordReader:
    """Cuts a stream of inflated bytes into (header fields, block, raw record)."""

    def __init__(self):
        self.rest = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        self.rest += data
        at = 0
        while (end := self.rest.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(self.rest[at:end]).decode().split("\r\n")
            if head[0].encode() != VERSION:
                raise ValueError(f"not a WARC record: {head[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in head[1:])
            stop = end + 4 + int(fields["Content-Length"]) + 4
            if stop > len(self.rest):
                break
            yield fields, bytes(self.rest[end + 4:stop - 4]), bytes(self.rest[at:stop])
            at = stop
        del self.rest[:at]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the archive ends inside a record")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, of one stream or many members, chunk by chunk."""
    stream = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            yield stream.decompress(data, CHUNK)
            while stream.unconsumed_tail:
                yield stream.decompress(stream.unconsumed_tail, CHUNK)
            data = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(GZIP)
            else:
                break


def member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(raw) + packer.flush()


# --- writing --------------------------------------------------------------
def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, refers_to) for each page.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response (every row of it, should it be repeated) and the others refer to
    it; a null page_id is never referred to. Null html is an empty payload.
    The table of repeated payloads is stored first: Spark then knows its size,
    and where it is small the pages are joined without being shuffled.
    """
    rows = pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"),
                        bytes_of("html").alias("payload"))
    rows = (rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha2("payload", 256)))
    firsts = stored(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                    .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                    .where("copies > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id"), "warc-firsts")
    return (rows.join(firsts, "payload_digest", "left")
            .withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")))
            .select("id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one-stream gzip archives; (path, n_records) of those that were finished."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packer = path = None
        size = count = 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": count}], ARCHIVES)

        for batch in batches:
            for part in slices(batch, "payload", 4 * CHUNK):
                for row in part.to_pylist():
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out, packer = open_shared(path, "wb"), zlib.compressobj(1, zlib.DEFLATED, GZIP)
                    raw = record_bytes(row["id"], row["url"], row["payload"], row["payload_bytes"],
                                       row["payload_digest"], row["refers_to"])
                    out.write(packer.compress(raw))
                    size, count = size + len(raw), count + 1
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        out, size, count = None, 0, 0
        if out is not None:
            yield close()

    named = records.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})
    return stored(bounded_batches(named).mapInArrow(run, "path string, n_records long"), "warc-archives")


ARCHIVES = pa.schema([("path", pa.string()), ("n_records", pa.int64())])


# --- normalising ----------------------------------------------------------
def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives with one gzip member per record, each with a sidecar index.

    An archive's stream is inflated once, chunk by chunk. Next to
    ``x.members.warc.gz`` stands ``x.members.idx``, one JSON line per record:
    offset, length, record id, type and digest. Returned are blocks of records,
    (path, index, offset, length, n_records), for reading in parallel.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = f"{row['path'].removesuffix('.warc.gz')}-{uuid.uuid4().hex}.members"
                reader, offset, blocks, begun, count = RecordReader(), 0, [], 0, 0
                with (open_shared(row["path"], "rb") as source, open_shared(f"{base}.warc.gz", "wb") as out,
                      open_shared(f"{base}.idx", "wb") as index):
                    for data in inflated(source):
                        for fields, _, raw in reader.feed(data):
                            packed = member(raw)
                            out.write(packed)
                            index.write(json.dumps({
                                "offset": offset, "length": len(packed), "id": fields["WARC-Record-ID"],
                                "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"]}).encode() + b"\n")
                            offset, count = offset + len(packed), count + 1
                            if count == BLOCK_RECORDS:
                                blocks.append((begun, offset - begun, count))
                                begun, count = offset, 0
                    reader.close()
                if count:
                    blocks.append((begun, offset - begun, count))
                yield pa.RecordBatch.from_pylist(
                    [{"path": f"{base}.warc.gz", "index": f"{base}.idx", "offset": o, "length": n, "n_records": c}
                     for o, n, c in blocks], BLOCKS)

    return stored(spread(archives, "path").mapInArrow(
        run, "path string, index string, offset long, length long, n_records long"), "warc-blocks")


BLOCKS = pa.schema([("path", pa.string()), ("index", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("n_records", pa.int64())])


def read_index(path: str) -> list[dict]:
    """The sidecar of an archive: one entry per record."""
    with open_shared(path, "rb") as source:
        return [json.loads(line) for line in source.read().splitlines()]


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, read alone by its index entry."""
    with open_shared(path, "rb") as source:
        source.seek(offset)
        raw = zlib.decompress(source.read(length), GZIP)
    fields, block, _ = next(RecordReader().feed(raw))
    return fields, block


# --- reading --------------------------------------------------------------
def read_archives(blocks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, ids as text.

    A response's size and digest are taken from its payload, and its stated
    digest must agree; a revisit's come from its header.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_shared(row["path"], "rb") as source:
                    source.seek(row["offset"])
                    packed = source.read(row["length"])
                out, reader = [], RecordReader()
                while packed:
                    stream = zlib.decompressobj(GZIP)
                    for fields, block, _ in reader.feed(stream.decompress(packed)):
                        out.append(_parsed(fields, block))
                    packed = stream.unused_data
                reader.close()
                yield pa.RecordBatch.from_pylist(out, RECORDS)

    # Blocks are many small rows: spread them, or one task would read them all.
    return spread(blocks, "path", "offset").mapInArrow(
        run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


RECORDS = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.string())])


def _parsed(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To"))}


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, normalised and read back. An empty table gives no archive and no row."""
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(plan_records(pages), scratch_path(spark, "warc"))
    found = read_archives(normalise(archives))
    id_type = pages.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
