"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, closed by a seek
table in the public seekable format (a skippable frame with the sizes of all frames). A record's
place is its bundle, its frame and its offset inside the unpacked frame, so one record is read by
unpacking one frame.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id is the
response and the others are revisits that name it. Tasks write bundles under names of their own; only
the bundles of tasks that succeeded are named in the manifest, so a repeated task leaves no double.

Defined results: a null payload is empty. Rows that share id and a long payload are all responses if
their id is the largest. A null id is smaller than any other and comes back as null. A null url has no
target line. An empty table gives no bundle and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import parallel, small_batches, stored
from claimflow.session import scratch

REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10  # unpacked records per frame; a longer record has a frame of its own
BUNDLE_BYTES = 64 << 20
#: Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

MANIFEST = "bundle string, frame int, offset long, length long, page_id long"
RECORD = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string,"
          " refers_to long")


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields by lower-case name, and ``body``."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    out["body"] = data[end + 4 : end + 4 + int(out["content-length"])]
    return out


class BundleWriter:
    """One bundle: ``add`` returns a record's frame and its offset there; ``close`` adds the seek table."""

    def __init__(self, uri: str, level: int = 3):
        import zstandard

        fs, path = _files(uri)
        self.out, self.pack = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames, self.buffer, self.held, self.total = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.frames), self.held
        self.buffer.append(record)
        self.held += len(record)
        self.total += len(record)
        return place

    def _flush(self) -> None:
        raw = b"".join(self.buffer)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.buffer:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Frames of one bundle, found by its seek table."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = _files(uri)
        self.file, self.unpack = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri}: no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return self.unpack.decompress(self.file.read_at(packed, at), max_output_size=raw)

    def close(self) -> None:
        self.file.close()


def with_digests(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows to write: page_id, url, payload, digest, revisit, refers_to."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    top = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy(F.col("digest").alias("_digest")).agg(
        F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("top")) & F.col("_digest").isNotNull(), F.lit(False))
    joined = rows.join(top, rows["digest"] == top["_digest"], "left")
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"),
                         F.when(revisit, F.col("top")).alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``with_digests`` to bundles in ``folder``; returns the stored manifest."""
    small_batches(rows.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri, places = None, "", []

        def finish() -> pa.RecordBatch:
            writer.close()
            cols = list(zip(*places, strict=True))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                              names=["bundle", "frame", "offset", "length", "page_id"])

        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    uri, places = f"{folder}/{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(uri)
                record = record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"])
                places.append((uri, *writer.add(record), len(record), r["page_id"]))
                if writer.total >= BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Read the manifest's records back (``RECORD``); a frame is unpacked once for all its records."""
    small_batches(manifest.sparkSession)
    dealt = manifest.repartition(parallel(manifest), "bundle", "frame").sortWithinPartitions(
        "bundle", "frame", "offset")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bundle, frame, raw = None, None, None, b""
        names = re.findall(r"(\w+) (?:long|string|binary)", RECORD)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r in batch.to_pylist():
                if r["bundle"] != bundle:
                    if reader:
                        reader.close()
                    reader, bundle, frame = BundleReader(r["bundle"]), r["bundle"], None
                if r["frame"] != frame:
                    frame, raw = r["frame"], reader.frame(r["frame"])
                got = parse_record(raw[r["offset"] : r["offset"] + r["length"]])
                revisit = got["warc-type"] == "revisit"
                own = got["warc-record-id"][len("<urn:page:") : -1]
                body = got["body"]
                digest = got["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{bundle}: payload of {own} does not match its digest")
                for n, v in zip(names, (
                        int(own) if own else None, got.get("warc-target-uri"), body,
                        int(got["warc-payload-length"]) if revisit else len(body), digest, got["warc-type"],
                        int(got["warc-refers-to"][len("<urn:page:") : -1]) if revisit else None), strict=True):
                    out[n].append(v)
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)],
                                             names=names)

    return dealt.mapInArrow(read, RECORD)


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            folder: str | None = None) -> DataFrame:
    """Write all rows to bundles and read them back."""
    folder = folder or scratch(df.sparkSession, "warc")
    fs, path = _files(folder)
    fs.create_dir(path, recursive=True)
    return read_records(write_bundles(with_digests(df, id_col, url_col, payload_col), folder))
