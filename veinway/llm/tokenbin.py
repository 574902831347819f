"""Token-id shards with a minimal perfect hash index.

A shard holds the raw ids of documents in ascending key order, then the index: a minimal
perfect hash (cascaded bit arrays with ranks) that sends a key to a slot, and for each slot
a 32-bit fingerprint, which turns away keys that the shard doesn't hold, with the place and
number of the key's ids. The shard of a key is found by bisection. A lookup then reads the
shard's footer, at most one block of bits and one rank for each level of the hash, one slot
and its own ids, however large the shard is.

Cases: null text counts as empty (only the end id); a null key comes first and can be
scanned but not looked up; rows that repeat a key are all kept, ordered by text, and a
lookup gives the first; an empty table gives no shard and no rows; other columns do not
matter.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .bpe import Encoder, Vocabulary, byte_alphabet, load_vocabulary
from .shared import filesystem, ship, spread, text_of
from .textvec import mix, pieces

MAGIC = b"VWTOK002"
GAMMA = 2.0
LEVELS = 64
#: Words of 64 bits between two stored ranks.
BLOCK = 8
#: What the slot of a key holds; start and count are in ids.
SLOT = np.dtype([("mark", "<u4"), ("count", "<u4"), ("start", "<i8")])
#: Bytes of text in a shard, about.
SHARD_BYTES = 256 << 20


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, about 4 bits a key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes.astype(np.int64), bits.astype(np.uint64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(ones)))

    def block_ranks(self) -> np.ndarray:
        """The number of ones before each block of bits."""
        return self.rank[:-1:BLOCK]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, taken, base = keys.view(np.uint64), [], [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            m = max(64, int(len(left) * GAMMA) + 1)
            at = cls._place(left, level, m)
            alone = np.bincount(at, minlength=m)[at] == 1
            taken.append(base + at[alone])
            sizes.append(m)
            base += m
            left = left[~alone]
        if len(left):
            raise ValueError("keys are not distinct")
        bits = np.zeros(-(-(base // 64 + 1) // BLOCK) * BLOCK, np.uint64)
        for at in taken:
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return cls(np.array(sizes, np.int64), bits)

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that were not built in."""
        keys = keys.view(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = self.base[level] + self._place(keys[left], level, int(m))
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) > 0
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.rank[at >> 6] + np.bitwise_count(below).astype(np.int64))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


class Writer:
    """Streams ids to a shard file and ends it with its index."""

    def __init__(self, uri: str, width: np.dtype) -> None:
        self.system, self.path = filesystem(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.system.open_output_stream(self.path + ".open")
        self.width, self.keys, self.valid, self.sizes = width, [], [], []

    def add(self, keys: np.ndarray, valid: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.astype(self.width).tobytes())
        self.keys.append(keys)
        self.valid.append(valid)
        self.sizes.append(sizes)

    def close(self) -> tuple[int, int]:
        keys, valid, sizes = (np.concatenate(x) for x in (self.keys, self.valid, self.sizes))
        edge = np.concatenate(([0], np.cumsum(sizes)))
        known, record = np.unique(keys[valid], return_index=True)
        record = np.flatnonzero(valid)[record]
        index = PerfectHash.build(known)
        slots = np.zeros(len(known), SLOT)
        at = index.slots(known)
        slots["mark"][at], slots["count"][at], slots["start"][at] = fingerprint(known), sizes[record], edge[record]
        blocks = {"edge": edge.astype("<i8"), "keys": keys.astype("<i8"), "valid": valid.astype("<u1"), "bits": index.bits.astype("<u8"), "ranks": index.block_ranks().astype("<i8"), "slots": slots.view("<u8")}
        at, table = int(sizes.sum()) * self.width.itemsize, {}
        for name, b in blocks.items():
            pad = b"\0" * (-at % 8)
            self.out.write(pad + b.tobytes())
            at += len(pad)
            table[name] = [at, len(b), b.dtype.str]
            at += b.nbytes
        tail = json.dumps({"width": self.width.str, "tokens": int(sizes.sum()), "levels": index.sizes.tolist(), "blocks": table}).encode()
        self.out.write(tail + struct.pack("<q", len(tail)) + MAGIC)
        self.out.close()
        self.system.move(self.path + ".open", self.path)
        return len(keys), int(sizes.sum())


class Shard:
    """Random access to one shard file: opening it reads the footer only."""

    def __init__(self, uri: str) -> None:
        system, path = filesystem(uri)
        self.uri, self.file, self.read = uri, system.open_input_file(path), 0
        size = self.file.size()
        end = self._bytes(size - 16, 16)
        if end[8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n = struct.unpack("<q", end[:8])[0]
        spec = json.loads(self._bytes(size - 16 - n, n))
        self.width, self.tokens, self.blocks = np.dtype(spec["width"]), spec["tokens"], spec["blocks"]
        self.sizes = np.array(spec["levels"], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))

    def _bytes(self, at: int, n: int) -> bytes:
        self.read += n
        return self.file.read_at(n, at)

    def array(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        """A stored array, or ``n`` entries of it."""
        at, size, kind = self.blocks[name]
        width = np.dtype(kind).itemsize
        return np.frombuffer(self._bytes(at + first * width, (size - first if n is None else n) * width), kind)

    def slots(self) -> np.ndarray:
        return self.array("slots").view(SLOT)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of many keys (place -1 where the shard doesn't hold the key), by the whole index."""
        keys = np.asarray(keys, np.int64)
        slot = PerfectHash(self.sizes, self.array("bits")).slots(keys)
        slots = self.slots()
        ok = slot >= 0
        ok[ok] = slots["mark"][slot[ok]] == fingerprint(keys[ok])
        start, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        start[ok], count[ok] = slots["start"][slot[ok]], slots["count"][slot[ok]]
        return start, count

    def slot(self, key: int) -> int:
        """The slot of one key, or -1: a block of bits for each level until it is found, and one rank."""
        own = np.array([key], np.int64).view(np.uint64)
        for level, m in enumerate(self.sizes.tolist()):
            at = int(self.base[level] + PerfectHash._place(own, level, m)[0])
            block, word, bit = at // (64 * BLOCK), at // 64 % BLOCK, at % 64
            bits = self.array("bits", block * BLOCK, BLOCK)
            if int(bits[word]) >> bit & 1:
                before = int(np.bitwise_count(bits[:word]).sum()) + (int(bits[word]) & (1 << bit) - 1).bit_count()
                return int(self.array("ranks", block, 1)[0]) + before
        return -1

    def ids(self, start: int, count: int) -> np.ndarray:
        return np.frombuffer(self._bytes(start * self.width.itemsize, count * self.width.itemsize), self.width)

    def get(self, key: int) -> np.ndarray | None:
        slot = self.slot(key)
        if slot < 0:
            return None
        found = self.array("slots", 2 * slot, 2).view(SLOT)[0]
        if found["mark"] != fingerprint(np.array([key], np.int64))[0]:
            return None
        return self.ids(int(found["start"]), int(found["count"]))


@dataclass
class TokenStore:
    """Shards in key order: path, first and last key, records, tokens, and tokens before each."""

    shards: list[dict]

    def __post_init__(self) -> None:
        self.keyed = [s for s in self.shards if s["first"] is not None]
        self.firsts = [s["first"] for s in self.keyed]

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key: its shard by bisection, then one lookup in it."""
        at = bisect.bisect_right(self.firsts, key) - 1
        return Shard(self.keyed[at]["path"]).get(key) if at >= 0 and key <= self.keyed[at]["last"] else None


def library_words(spec: str):
    """A resolver of distinct pre-tokens that asks the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    model, alphabet = tokenizer.model, {b: c for c, b in byte_alphabet().items()}

    def resolve(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes().decode("latin-1").translate(alphabet)  # a character for each byte
        found = [[t.id for t in model.tokenize(raw[a:b])] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64)

    return resolve


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary, spec: str) -> Encoder:
    """One encoder for a worker process, kept between its tasks."""
    if hash(spec) not in _encoders:
        _encoders.clear()
        _encoders[hash(spec)] = Encoder(vocabulary, resolve=library_words(spec))
    return _encoders[hash(spec)]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", column: str = "text", path: str | None = None, shards: int | None = None) -> TokenStore:
    """Encode every whole text with the tokenizers library and write shards in key order.

    The library encodes each distinct pre-token once for a worker; whole documents are
    put together from these, which gives the library's ids for the whole text. Texts are
    dealt by ranges of keys, so many that a shard has about ``SHARD_BYTES`` of text at most
    (rows of one key stay together); a task streams its shard and holds only the index. A retried task writes a file of another name, and
    only the files of tasks that succeeded are named in the store.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or work_dir(spark, "tokens")
    vocabulary = load_vocabulary(tokenizer)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((vocabulary, f.read()))
    width = vocabulary.width if end_id is None or end_id < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        writer, uri = None, f"{path}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.vwt"
        first = last = None
        for batch in batches:
            key = batch.column(0)
            valid = np.asarray(key.is_valid())
            keys = np.asarray(key.fill_null(0)).astype(np.int64)
            for i, j, data, offsets in pieces(batch, "text"):
                ids, edge = encoder(data, offsets)
                sizes = np.diff(edge)
                if end_id is not None:
                    ids = np.insert(ids, edge[1:], end_id)
                    sizes = sizes + 1
                writer = writer or Writer(uri, width)
                writer.add(keys[i:j], valid[i:j], ids, sizes)
            if valid.any():
                first = int(keys[valid][0]) if first is None else first
                last = int(keys[valid][-1])
        if writer:
            n, tokens = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": uri, "first": first, "last": last, "records": n, "tokens": tokens}], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("records", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(docs[key].cast("long").alias("key"), text_of(docs, column).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(spread(spark), -(-size // SHARD_BYTES))
    dealt = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    # one row for each shard
    made = dealt.mapInArrow(run, "shard long, path string, first long, last long, records long, tokens long").collect()
    total, out = 0, []
    for r in sorted(made, key=lambda r: r["shard"]):
        out.append(r.asDict() | {"before": total})
        total += r["tokens"]
    return TokenStore(out)


def read_tokens(spark: SparkSession, store: TokenStore, digests: bool = False) -> DataFrame:
    """Every record of the shards, read at the place that the index has for its key.

    Only rows without a key and repeated rows of a key, which the index does not hold, are
    read by the order of records. Returns doc_id, start (ids before it in the store), n_tokens
    and ids (little-endian unsigned 32-bit), or with ``digests`` ids_crc32 instead of ids.
    """
    ship(spark)
    last = "ids_crc32 long" if digests else "ids binary"
    schema = f"doc_id long, start long, n_tokens long, {last}"
    places = spark.createDataFrame([(s["shard"], s["path"], s["before"]) for s in store.shards], "shard long, path string, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                keys, valid, edge = shard.array("keys"), shard.array("valid").astype(bool), shard.array("edge")
                start, count = edge[:-1].copy(), np.diff(edge)
                fresh = valid & np.concatenate(([True], (keys[1:] != keys[:-1]) | ~valid[:-1]))
                start[fresh], count[fresh] = shard.find(keys[fresh])
                if (start < 0).any():
                    raise ValueError(f"{row['path']}: the index does not hold a key of the shard")
                for i in range(0, len(keys), 2048):
                    a, n = start[i : i + 2048], count[i : i + 2048]
                    low, high = int(a.min()), int((a + n).max())
                    flat = shard.ids(low, high - low).astype("<u4")
                    raw = [flat[x : x + c].tobytes() for x, c in zip((a - low).tolist(), n.tolist(), strict=True)]
                    value = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digests else pa.array(raw, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2048], mask=~valid[i : i + 2048]), pa.array(row["before"] + a), pa.array(n), value], ["doc_id", "start", "n_tokens", last.split()[0]])

    if not store.shards:
        return spark.createDataFrame([], schema)
    return places.repartitionByRange(len(store.shards), "shard").mapInArrow(run, schema)
