"""Operator 7: WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of whole records (about FRAME_BYTES
of records each, at least one) followed by a seek table in a skippable frame, as in the
published seekable format: per frame its compressed and decompressed size, then the number of
frames, a descriptor byte and the footer magic.  An index table maps record identifiers to
(file, frame, offset within the decompressed frame, bytes), so a record costs one frame.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest id is
written as a response, the others as revisits that name it.  Payloads are compared by
SHA-256; who revisits whom is decided on narrow rows (digests of a hot payload meet a
bounded broadcast), then payloads meet the decisions by id and digest in one join, without any
hot key, and are written where they land.

A bundle is written under a new UUID and its index rows go through Spark's committer, so
bundles of lost or repeated attempts are never referenced.

Defined results: a null payload is empty; null ids are kept as ids of their own ("null");
rows that repeat an id and a payload get equal records; a null url leaves its header out;
control characters and spaces in a url are percent-encoded; an empty table writes no bundle.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import attach, id_column, materialise, store
from inkstone.sources.io import scratch_path

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 30, 3
# FIXED VALUES: magic numbers of skippable frame and seek table in the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
RECORD_URN = "urn:inkstone:page"
INDEX = "page_id long, record_id string, file string, frame int, offset long, bytes long"


def decide(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page_id, sha256, record_type, refers_to), one row per distinct id and payload."""
    payload = F.encode(F.coalesce(id_column(df, payload_col), F.lit("")), "UTF-8")
    rows = df.select(id_column(df, id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("sha256"),
                     F.octet_length(payload).alias("size")).distinct()
    rows = materialise(rows, "payload-digests")
    groups = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("sha256").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = attach(rows, materialise(groups, "payload-groups"), "sha256", "n", rows.count())
    # a null id is never the first; a group of null ids only has one distinct row
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "sha256", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, record_type: str, refers_to, date: str) -> tuple[str, bytes]:
    """(record id, WARC record); a revisit keeps the HTTP header only, with digest and size of its payload."""
    import base64
    import hashlib
    import re

    sha1 = hashlib.sha1(payload)
    name = lambda i: f"<{RECORD_URN}:{'null' if i is None else i}:{sha1.hexdigest()}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if record_type == "response" else http
    head = [("WARC-Type", record_type), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1.digest()).decode())]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(("WARC-Target-URI", safe))
    if record_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", name(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return name(page_id)[1:-1], text.encode() + block + b"\r\n\r\n"


class Bundle:
    """Writer of one bundle: frames, then the seek table."""

    def __init__(self, out):
        import zstandard

        self.out, self.pack, self.sizes, self.held, self.size, self.written = out, zstandard.ZstdCompressor(LEVEL), [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Append a record; returns (frame, offset in it)."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = (len(self.sizes), self.size)
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        frame = self.pack.compress(b"".join(self.held))
        self.out.write(frame)
        self.sizes.append((len(frame), self.size))
        self.written += len(frame)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(source) -> list[tuple[int, int]]:
    """(file offset, compressed bytes) of each frame, from the footer of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    source.seek(end - 9 - n * entry)
    data, at, out = source.read(n * entry), 0, []
    for i in range(n):
        size = struct.unpack_from("<I", data, i * entry)[0]
        out.append((at, size))
        at += size
    return out


def write(df: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record per row of ``df``; returns the folder with bundles and index."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, "warc")
    disk, folder = store(path)
    disk.create_dir(f"{folder}/data", recursive=True)
    payload = F.encode(F.coalesce(id_column(df, payload_col), F.lit("")), "UTF-8")
    pages = df.select(id_column(df, id_col).cast("long").alias("page_id"), id_column(df, url_col).alias("url"),
                      payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))
    types = decide(df, id_col, payload_col).withColumnsRenamed({"page_id": "k", "sha256": "h"})
    typed = pages.join(types, F.col("page_id").eqNullSafe(F.col("k")) & (F.col("sha256") == F.col("h")))
    typed = typed.select("page_id", "url", "payload", "record_type", "refers_to")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, bundle, name = store(path), None, ""
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows, part = [], batch.slice(start, 200)
                for page_id, url, data, kind, to in zip(*(c.to_pylist() for c in part.columns)):
                    if bundle is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        bundle = Bundle(there[0].open_output_stream(f"{there[1]}/data/{name}", compression=None))
                    key, data = record(page_id, url, data, kind, to, date)
                    rows.append((page_id, key, name, *bundle.add(data), len(data)))
                    if bundle.written >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["page_id", "record_id", "file", "frame", "offset", "bytes"])
        if bundle is not None:
            bundle.close()

    typed.mapInArrow(bundles, INDEX).write.parquet(f"{path}/index")
    return path


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Records by the index: page_id, record_type, refers_to, url, payload (null for revisits),
    payload_bytes and payload_digest (hex SHA-1).  ``wanted`` (a column record_id) restricts them."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    if wanted is not None:
        index = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").select(index.columns)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import re

        import zstandard

        there, unpack = store(path), zstandard.ZstdDecompressor()
        at, source, frames, data = (None, None), None, [], b""
        number = lambda urn: int(urn.split(":")[3]) if urn.split(":")[3] != "null" else None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string())
        names = ["page_id", "record_type", "refers_to", "url", "payload", "payload_bytes", "payload_digest"]
        for batch in batches:
            rows, held = [], 0
            for key, file, frame, offset, size in zip(*(batch.column(c).to_pylist() for c in ("record_id", "file", "frame", "offset", "bytes"))):
                if file != at[0]:
                    source = there[0].open_input_file(f"{there[1]}/data/{file}")
                    frames = seek_table(source)
                if (file, frame) != at:
                    source.seek(frames[frame][0])
                    data, at = unpack.decompress(source.read(frames[frame][1])), (file, frame)
                head, _, block = data[offset:offset + size - 4].partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                if fields["WARC-Record-ID"] != f"<{key}>" or len(block) != int(fields["Content-Length"]):
                    raise ValueError(f"{file}: another record than {key}")
                http, _, payload = block.partition(b"\r\n\r\n")
                full = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind, to = fields["WARC-Type"], fields.get("WARC-Refers-To")
                rows.append((number(key), kind, number(to[1:-1]) if to else None, fields.get("WARC-Target-URI"),
                             payload if kind == "response" else None, full, digest))
                held += len(payload)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return index.mapInArrow(fetch, "page_id long, record_type string, refers_to long, url string, payload binary, "
                                   "payload_bytes long, payload_digest string")
