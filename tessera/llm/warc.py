"""WARC archives: writer, monolithic gzip normaliser with sidecar index, indexed reader.

1. ``write_monolithic``: tasks write their rows as WARC records into archives, each
   one single gzip stream, and return a line per record (id, ordinal, payload
   digest). Archives close at ``archive_bytes`` of raw records, so none grows with
   the input.
2. ``normalise``: inflates each monolithic stream once, front to back, and rewrites
   every record as a gzip member of its own, beside an index file that holds each
   member's offset and length. A record whose payload occurs with a smaller id
   becomes a revisit; only digests and ids are shuffled for that, never payloads.
3. ``read_archives``: reads members by their index ranges and checks block and
   payload digests.

Attempts of a task write to names of their own and return them; later steps see
only the names that came back in the written manifest, so a lost executor or a
second attempt cannot mix files. Files go through ``pyarrow.fs`` to the shared
folder of the session.

Defined cases: a null payload is an empty one; a null or blank URL becomes
``urn:page:<id>``; blanks in URLs are percent-encoded; rows equal in id and payload
are all responses when that id is the smallest; a page without an id is a revisit of the
smallest id with its payload, if there is one; very long payloads are one record; an empty
table writes no archive and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh_dir, give_back, materialize, slices, spread_join

DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOR = b"\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: str, url: str, payload: bytes) -> bytes:
    """A response record: WARC header, HTTP header, payload."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {url}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        f"WARC-Block-Digest: sha1:{sha1_base32(http + payload)}\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    ).encode()
    return head + http + payload + EOR


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in a stream of inflated bytes."""
    buffer, chunks = bytearray(), iter(chunks)
    while True:
        while (end := buffer.find(EOR)) < 0:
            more = next(chunks, None)
            if more is None:
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
            buffer += more
        fields = parse_head(bytes(buffer[:end]))
        start, length = end + len(EOR), int(fields["content-length"])
        while len(buffer) < start + length + len(EOR):
            more = next(chunks, None)
            if more is None:
                raise ValueError("the archive ends inside a record's block")
            buffer += more
        block = bytes(buffer[start : start + length])
        del buffer[: start + length + len(EOR)]
        yield fields, block


def inflate(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """Inflates a file of one or more gzip members, front to back, once."""
    stream = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            if out := stream.decompress(data, 4 * chunk):
                yield out
            if stream.eof:
                data = stream.unused_data
                stream = zlib.decompressobj(31)
            else:
                data = stream.unconsumed_tail
    if out := stream.flush():
        yield out


def as_revisit(fields: dict[str, str], block: bytes, refers_to: str) -> bytes:
    """The revisit of a response: its HTTP header stays, its payload goes."""
    http = block[: block.index(EOR) + len(EOR)]
    head = (
        f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {fields['warc-record-id']}\r\nWARC-Date: {fields['warc-date']}\r\n"
        f"WARC-Target-URI: {fields['warc-target-uri']}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: {PROFILE}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: {fields['warc-payload-digest']}\r\n"
        f"WARC-Block-Digest: sha1:{sha1_base32(http)}\r\nContent-Length: {len(http)}\r\n\r\n"
    ).encode()
    return head + http + EOR


def as_response(fields: dict[str, str], block: bytes) -> bytes:
    names = (
        ("WARC-Type", "warc-type"), ("WARC-Record-ID", "warc-record-id"), ("WARC-Date", "warc-date"), ("WARC-Target-URI", "warc-target-uri"), ("Content-Type", "content-type"),
        ("WARC-Payload-Digest", "warc-payload-digest"), ("WARC-Block-Digest", "warc-block-digest"), ("Content-Length", "content-length"),
    )
    return b"WARC/1.1\r\n" + "".join(f"{n}: {fields[k]}\r\n" for n, k in names).encode() + b"\r\n" + block + EOR


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _batch(rows: list, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def write_monolithic(pages: DataFrame, directory: str, id_col: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Writes the archives; returns archive, ordinal, page_id, payload_sha256, payload_bytes by record."""
    slim = pages.select(column(id_col).cast("long").alias("page_id"), column(url).cast("string").alias("url"), column(payload).cast("string").alias("payload"))
    kinds = [("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("payload_sha256", pa.string()), ("payload_bytes", pa.int64())]

    def write(batches):
        where, base = pafs.FileSystem.from_uri(directory)
        out = z = None
        raw = ordinal = 0
        name = ""
        for batch in slices(batches):
            lines: list = []
            for page, url_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{base}/mono-{uuid.uuid4().hex}.warc.gz"
                    out, z, raw, ordinal = where.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = b"" if text is None else text.encode()
                key = "null" if page is None else str(page)
                target = "" if url_ is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url_.strip())
                row = record_bytes(key, target or f"urn:page:{key}", data)
                out.write(z.compress(row))
                lines.append((name, ordinal, page, hashlib.sha256(data).hexdigest(), len(data)))
                raw, ordinal = raw + len(row), ordinal + 1
                if raw >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
            yield _batch(lines, kinds)
        if out is not None:
            out.write(z.flush())
            out.close()
        give_back()

    return slim.mapInArrow(write, "archive string, ordinal long, page_id long, payload_sha256 string, payload_bytes long")


def first_of_equal(lines: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to to written lines: the smallest id with the same payload, null for that id itself and for payloads under min_bytes. Payloads that many pages share are not gathered."""
    firsts = lines.groupBy("payload_sha256", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = spread_join(lines, materialize(firsts, "warc-firsts"), ["payload_sha256", "payload_bytes"], "n", lines.count(), "left").drop("n")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= min_bytes)
    return joined.withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def normalise(lines: DataFrame, directory: str, level: int = 6) -> DataFrame:
    """Rewrites the archives of ``lines`` (with refers_to) member by member; returns archive, index, records, bytes."""

    def rewrite(pdf: pd.DataFrame) -> pd.DataFrame:
        where, base = pafs.FileSystem.from_uri(directory)
        source = pdf["archive"].iloc[0]
        refers = dict(zip(pdf["ordinal"], pdf["refers_to"], strict=True))  # ids as text: pandas has no whole numbers beside nulls
        name = f"{base}/members-{uuid.uuid4().hex}.warc.gz"
        offset, index = 0, []
        with where.open_input_stream(source, compression=None) as mono, where.open_output_stream(name, compression=None) as out:
            for ordinal, (fields, block) in enumerate(records(inflate(mono))):
                to = refers[ordinal]
                data = member(as_response(fields, block) if to is None else as_revisit(fields, block, to), level)
                out.write(data)
                index.append(f"{offset} {len(data)} {fields['warc-record-id']} {'response' if to is None else 'revisit'}\n")
                offset += len(data)
        if len(index) != len(pdf):
            raise ValueError(f"{source} holds {len(index)} records; its lines name {len(pdf)}")
        with where.open_output_stream(f"{name}.idx", compression=None) as out:
            out.write("".join(index).encode())
        return pd.DataFrame([(name, f"{name}.idx", len(index), offset)], columns=["archive", "index", "records", "bytes"])

    slim = lines.select("archive", "ordinal", F.col("refers_to").cast("string").alias("refers_to"))
    archives = max(1, min(slim.select("archive").distinct().count(), 10_000))
    return slim.repartition(archives, "archive").groupBy("archive").applyInPandas(rewrite, "archive string, index string, records long, bytes long")


def read_archives(manifest: DataFrame, directory: str, page_rows: int = 2000) -> DataFrame:
    """A row per record, read by index ranges: page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, offset, length."""
    text, whole = pa.string(), pa.int64()
    kinds = [("page_id", whole), ("payload_bytes", whole), ("payload_digest", text), ("record_type", text), ("refers_to", whole), ("url", text), ("archive", text), ("offset", whole), ("length", whole)]

    def key(field: str | None):
        return None if field is None or field == "<urn:page:null>" else int(field[len("<urn:page:") : -1])

    def read(batches):
        where, _ = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_stream(index, compression=None) as f:
                    entries = f.read().decode().splitlines()
                rows = []
                with where.open_input_file(archive) as f:
                    for line in entries:
                        offset, length, _, kind = line.split(" ")
                        f.seek(int(offset))
                        data = zlib.decompress(f.read(int(length)), 31)
                        end = data.index(EOR)
                        fields, block = parse_head(data[:end]), data[end + len(EOR) : -len(EOR)]
                        if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}" or fields["warc-type"] != kind:
                            raise ValueError(f"{archive}: the record at {offset} is not what its index says")
                        cut = block.index(EOR) + len(EOR)
                        digest = fields["warc-payload-digest"][len("sha1:") :]
                        size = int(block[:cut].lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        if kind == "response" and (len(block) - cut != size or sha1_base32(block[cut:]) != digest):
                            raise ValueError(f"{archive}: the payload at {offset} is damaged")
                        rows.append((key(fields["warc-record-id"]), size, digest, kind, key(fields.get("warc-refers-to")), fields["warc-target-uri"], archive, int(offset), int(length)))
                        if len(rows) >= page_rows:
                            yield _batch(rows, kinds)
                            rows = []
                yield _batch(rows, kinds)
        give_back()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"
    return manifest.select("archive", "index").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, directory: str | None = None, min_bytes: int = 0, **columns) -> DataFrame:
    """Writes, normalises and reads back; the rows of ``read_archives``."""
    spark = pages.sparkSession
    directory = directory or fresh_dir(spark, "warc")
    lines = materialize(write_monolithic(pages, directory, **columns), "warc-lines")
    manifest = materialize(normalise(first_of_equal(lines, min_bytes), directory), "warc-manifest")
    parts = max(1, min(manifest.count(), 10_000))
    return read_archives(manifest.repartition(parts), directory)
