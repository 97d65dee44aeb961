"""WARC records in seekable Zstandard bundles.

A bundle holds whole WARC/1.1 records. Records are grouped into frames that are compressed on their
own, and the file ends with the seek table of Zstandard's public seekable format (a skippable frame
with the compressed and plain size of each frame), so that any reader can decompress one frame without
the others. An index maps each record to its bundle, frame, offset within the plain frame and length.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, open_file, put_file, written

#: Fixed values of the seekable format: skippable frame, footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 25, 3
#: Payloads of at least so many bytes are kept once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null page_id within the archives.
NO_ID = -(2**63)
INDEX = "page_id long, bundle string, frame long, offset long, length long"


class BundleWriter:
    """Collects records into frames; ``close`` gives the bytes of the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frame_bytes, self.frames, self.sizes, self.open, self.size = frame_bytes, [], [], bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        if len(self.open) >= self.frame_bytes:
            self._close_frame()
        place = len(self.frames), len(self.open)
        self.open += record
        return place

    def _close_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.size += len(packed)
            self.open = bytearray()

    def close(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<2I", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<2I", SKIPPABLE, len(entries) + len(footer)), entries, footer])


class BundleReader:
    """Reads frames of a bundle by its seek table; keeps the last one."""

    def __init__(self, file):
        import zstandard

        self.file, self.decompressor, self.held = file, zstandard.ZstdDecompressor(), (-1, b"")
        end = file.seek(0, 2)
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 128 else 8
        file.seek(end - 9 - n * entry)
        table = file.read(n * entry)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<2I", table, k * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.held[0] != frame:
            at, packed, plain = self.frames[frame]
            self.file.seek(at)
            self.held = frame, self.decompressor.decompress(self.file.read(packed), max_output_size=plain)
        return self.held[1][offset : offset + length]


def record_urn(page_id: int) -> str:
    """A name-based UUID of the page, so that a repeated write gives the same record."""
    h = hashlib.sha1(f"page:{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def make_record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has headers and no payload. Control characters in the address become spaces."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Page-ID: {page_id}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else " " for c in url), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def planned(pages: DataFrame) -> DataFrame:
    """Each page with its payload, digest and, for revisits, the page that it refers to.

    Payloads stay where they are read: digests that occur twice or more meet the narrow columns alone,
    and the few pages that become revisits are then joined by page_id.
    """
    plain = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = plain.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = keyed.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(groups, "digest").where("page_id <> refers_to").distinct()
    return keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_bundles(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages as WARC records under ``folder``; returns the index, read from a written table.

    Null addresses and payloads count as empty; a null page_id is the smallest long in the archives and null again in reports. Pages of equal payload and equal page_id stay separate
    responses. A repeated task writes the same files again. An empty table gives no bundle.
    """
    uri = as_uri(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, rows, first, last = BundleWriter(), [], None, None

        def close() -> pd.DataFrame:
            path = f"{uri}/pages-{first}-{last}-{hashlib.sha1(repr(rows).encode()).hexdigest()[:12]}.warc.zst"
            put_file(path, writer.close())
            return pd.DataFrame([(p, path, f, o, n) for p, f, o, n in rows], columns=["page_id", "bundle", "frame", "offset", "length"])

        for frame in frames:
            for page_id, url, html, digest, refers_to in frame.itertuples(index=False):
                refers = None if pd.isna(refers_to) else int(refers_to)
                record = make_record(page_id, url, html.encode(), digest, refers)
                rows.append((page_id, *writer.add(record), len(record)))
                first, last = page_id if first is None else first, page_id
                if writer.size >= bundle_bytes:
                    yield close()
                    writer, rows, first = BundleWriter(), [], None
        if rows:
            yield close()

    records = planned(pages).withColumn("refers_to", F.col("refers_to").cast("string"))
    return written(records.mapInPandas(run, INDEX), "index")


def read_bundles(index: DataFrame) -> DataFrame:
    """What the archives hold of each page: type, payload's size and digest, the page referred to.

    A response's size and digest are computed from the payload that is read; a revisit takes both from
    the response that it refers to.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file, reader = None, None, None
        for frame in frames:
            rows = []
            for page_id, bundle, number, offset, length in frame.itertuples(index=False):
                if bundle != path:
                    if file:
                        file.close()
                    path, file = bundle, open_file(bundle)
                    reader = BundleReader(file)
                fields, payload = parse_record(reader.record(number, offset, length))
                if int(fields["WARC-Page-ID"]) != page_id:
                    raise ValueError(f"the index is wrong about page {page_id}")
                refers = fields.get("WARC-Refers-To-Page")
                rows.append((page_id, fields["WARC-Type"], None if refers else len(payload), hashlib.sha1(payload).hexdigest() if refers is None else fields["WARC-Payload-Digest"].partition(":")[2], refers))
            out = pd.DataFrame(rows, columns=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])
            yield out.astype({"payload_bytes": "Int64", "refers_to": object})
        if file:
            file.close()

    return index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInPandas(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder and report what is read back from them."""
    # read once into a table: the archives are decompressed a single time, and revisits look up their responses there
    read = written(read_bundles(write_bundles(pages, fresh_path(pages.sparkSession, "warc"))), "read").withColumn("refers_to", F.col("refers_to").cast("long"))
    wanted = read.where("refers_to is not null").select("refers_to").distinct()
    found = read.where("record_type = 'response'").join(wanted.withColumnRenamed("refers_to", "page_id"), "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("there"))
    joined = read.join(found, ["refers_to", "payload_digest"], "left")
    known = F.nullif(F.col("page_id"), F.lit(NO_ID)).alias("page_id")
    return joined.select(known, F.coalesce("payload_bytes", "there").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


WARC_SQL = f"""
with keyed as (
    select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), marked as (
    select *, max(page_id) over (partition by payload_digest) as first from keyed
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= {REVISIT_BYTES} and first <> page_id then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {REVISIT_BYTES} and first <> page_id then first end as refers_to
from marked
"""
