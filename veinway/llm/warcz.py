"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the record index (record
identifier to frame and offset within it, in a skippable frame) and the seek table of the
public seekable format. Any Zstandard reader decodes the bundle as one WARC file; reading
one record decompresses one frame.

Cases: null html counts as empty; a null page id or url leaves its header out, and a row
without an id is never referred to; of equal payloads the row with the largest page id is
the response (rows that repeat that id with that payload are all responses) and the rest
revisit it; payloads are equal if SHA-1, length and a further hash are; a url that would not
fit on a header line is percent-encoded, which a header says, and comes back as it was; an
empty url is a header without value; an empty table gives no bundles; other columns do not
matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import skew_join, small_side
from ..session import work_dir
from .shared import filesystem, ship

#: Bytes of records gathered into a frame before it is compressed.
FRAME_BYTES = 256 << 10
# Fixed values of the Zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
# Fixed value of the WARC 1.1 format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:veinway:page:"
#: Columns of the record index: whether the record has an identifier, that, its frame, its offset in the frame, its bytes.
INDEX = ("known", "key", "frame", "offset", "size")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: The header of records whose url is percent-encoded to fit on its line.
ENCODED = "X-Target-URI-Encoded: percent"


def encoded(value: str) -> str:
    """A value without characters that cannot stand in a header; ``unquote`` gives it back."""
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit carries only the HTTP head."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        fits = url.isprintable()
        head.append(f"WARC-Target-URI: {url if fits else encoded(url)}")
        head += [] if fits else [ENCODED]
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset of decompressed bytes, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    split = data.index(b"\r\n\r\n", begin, end) + 4
    http = dict(x.split(": ", 1) for x in data[begin : split - 4].decode("latin-1").split("\r\n")[1:])
    name = head["WARC-Record-ID"][1 + len(URN) : -1]
    url = head.get("WARC-Target-URI")
    if ENCODED.split(": ")[0] in head:
        url = unquote(url)
    out = {"page_id": None if name == "null" else int(name), "url": url, "record_type": head["WARC-Type"], "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(http["Content-Length"]), "refers_to": int(head["WARC-Refers-To"][1 + len(URN) : -1]) if "WARC-Refers-To" in head else None, "payload": data[split:end] if head["WARC-Type"] == "response" else None}
    return out, end + 4


class Writer:
    """Streams records into frames of a bundle."""

    def __init__(self, uri: str, level: int = 3) -> None:
        import zstandard

        self.system, self.path = filesystem(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.system.open_output_stream(self.path + ".open")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open, self.bytes, self.frames, self.index = [], 0, [], []

    def add(self, key: int | None, raw: bytes) -> None:
        self.index.append((key is not None, key or 0, len(self.frames), self.bytes, len(raw)))
        self.open.append(raw)
        self.bytes += len(raw)
        if self.bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            packed = self.pack.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.bytes))
            self.open, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        rows = np.array(sorted(self.index), "<i8").reshape(-1, len(INDEX))
        raw = rows.tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(raw)) + raw)
        self.frames.append((len(raw) + 8, 0))
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.system.move(self.path + ".open", self.path)


class Bundle:
    """Reads a bundle by frame or by record."""

    def __init__(self, uri: str) -> None:
        import zstandard

        system, path = filesystem(uri)
        self.file, self.unpack = system.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 128 else 8
        table = np.frombuffer(self.file.read_at(n * width, size - 9 - n * width), "<u4").reshape(n, -1).astype(np.int64)
        self.packed, self.plain = table[:, 0], table[:, 1]
        self.start = np.concatenate(([0], np.cumsum(self.packed)))
        raw = self.file.read_at(int(self.packed[-1]), int(self.start[n - 1]))
        self.index = np.frombuffer(raw[8:], "<i8").reshape(-1, len(INDEX))
        self.unknown = int(np.searchsorted(self.index[:, 0], 1))  # records without an identifier come first

    def frame(self, k: int) -> bytes:
        return self.unpack.decompress(self.file.read_at(int(self.packed[k]), int(self.start[k])), max_output_size=int(self.plain[k]))

    def get(self, page_id: int) -> dict | None:
        at = self.unknown + int(np.searchsorted(self.index[self.unknown :, 1], page_id))
        if at == len(self.index) or self.index[at, 1] != page_id:
            return None
        _, _, frame, offset, _ = self.index[at].tolist()
        return parse(self.frame(frame), offset)[0]

    def records(self) -> Iterator[dict]:
        """Every record at the place that the index has for it, frame by frame."""
        held, data = -1, b""
        for known, key, frame, offset, size in self.index[np.lexsort((self.index[:, 3], self.index[:, 2]))].tolist():
            if frame != held:
                held, data = frame, self.frame(frame)
            out, end = parse(data, offset)
            if end != offset + size or out["page_id"] != (key if known else None):
                raise ValueError("the index and the records differ")
            yield out

    def scan(self) -> Iterator[dict]:
        """Every record in the order of the file, without the index."""
        for k in range(len(self.packed) - 1):
            data, at = self.frame(k), 0
            while at < len(data):
                out, at = parse(data, at)
                yield out


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for responses). Only keys and digests are grouped."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    marks = ["digest", "size", "mark"]
    hashed = rows.withColumn("size", F.octet_length("html")).withColumn("digest", F.when(F.col("size") >= least_bytes, F.sha1("html"))).withColumn("mark", F.xxhash64("html"))
    groups = hashed.where("digest is not null").groupBy(*marks).agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # no text is dealt out while the groups of copies are few
    joined = skew_join(hashed, small_side(groups, "groups"), marks, "left")
    revisits = (F.col("kept") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("kept").isNotNull())
    return joined.select("page_id", "url", "html", F.when(revisits, F.col("kept")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Write a record for each page; the paths of the bundles, one for each task that had rows."""
    spark = pages.sparkSession
    ship(spark)
    path = path or work_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri = None, f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in batch.slice(i, 256).to_pylist():
                    writer = writer or Writer(uri)
                    writer.add(row["page_id"], record(row["page_id"], row["url"], row["html"].encode("utf-8"), row["refers_to"], date))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [uri]})

    return sorted(r["path"] for r in with_revisits(pages, least_bytes).mapInArrow(run, "path string").collect())


def read_bundles(spark: SparkSession, paths: list[str], payloads: bool = False) -> DataFrame:
    """Every record of the bundles, by their index: page_id, url, record_type, refers_to, payload_digest, payload_bytes; with ``payloads`` the text of responses."""
    ship(spark)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for r in Bundle(path).records():
                    if r["payload"] is not None and (payload_digest(r["payload"]) != r["payload_digest"] or len(r["payload"]) != r["payload_bytes"]):
                        raise ValueError(f"{path}: a payload does not match its digest")
                    rows.append(r)
                    if len(rows) == 512:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    if not paths:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(len(paths), "path").mapInArrow(run, schema)
