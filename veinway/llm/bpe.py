"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent pre-tokens of the corpus, counted over all documents, are compiled
with their ids into an acyclic automaton whose equal suffixes are shared. Walking a word
adds up the numbers on its arcs; the sum is the word's rank among the entries and names
its ids. The file is mapped into memory by each worker. Words outside the lexicon get
their ids by the exact merges, so the result never depends on what the lexicon holds.

Cases: null text counts as empty and gives no ids; a special token's string in a text
becomes its id, as in the tokenizers library; rows are kept as they are, repeated ids
included; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .pretokens import split
from .shared import ship, text_of
from .textvec import pieces, span_hash

#: Entries of the lexicon: bounds what is broadcast (about 2 MB at this size).
LEXICON_WORDS = 1 << 16
#: Longer pre-tokens are merged with a heap instead of in rounds over a whole batch.
LONG = 256
#: Pre-tokens a worker remembers before it starts afresh.
REMEMBER = 1 << 20


# ---------------------------------------------------------------- vocabulary


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (256 + i for i in range(256))
    return {chr(b) if b in set(plain) else chr(next(spare)): b for b in range(256)}


@dataclass
class Vocabulary:
    """Arrays for merging and decoding; about 1.5 MB for 50,000 merges."""

    byte_id: np.ndarray  # id of each single byte
    pair_key: np.ndarray  # left << 32 | right, ascending
    pair_rank: np.ndarray
    pair_to: np.ndarray  # id of the merged token
    token_start: np.ndarray  # n + 1 offsets of token bytes
    token_bytes: np.ndarray
    special: dict[str, int]

    @property
    def width(self) -> np.dtype:
        return np.dtype("<u2") if len(self.token_start) - 1 <= 1 << 16 else np.dtype("<u4")


def _refuse_unknown(spec: dict) -> None:
    """Fail for a tokenizers file with a step that this module does not take, rather than give other ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    steps = [
        (spec.get("normalizer") is None, "a normalizer"),
        (model.get("type", "BPE") == "BPE", "a model other than BPE"),
        (split.get("type") == "ByteLevel" and split.get("use_regex", True), "a pre-tokenizer other than ByteLevel with its pattern"),
        (not split.get("add_prefix_space", False), "a space put before texts"),
        ((spec.get("decoder") or {}).get("type") == "ByteLevel", "a decoder other than ByteLevel"),
        (not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")), "an option of the model"),
        (not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")), "an option of an added token"),
    ]
    wrong = [what for ok, what in steps if not ok]
    if wrong:
        raise ValueError("this tokenizer has what is not supported: " + ", ".join(wrong))


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers file of a byte-level BPE model; others are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _refuse_unknown(spec)
    model, alphabet = spec["model"], byte_alphabet()
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    raw = [b""] * size
    for token, i in vocab.items():
        raw[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        raw[i] = token.encode()
    byte_id = np.zeros(256, np.int64)
    for c, b in alphabet.items():
        byte_id[b] = vocab[c]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    to = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(key, kind="stable")
    start = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    return Vocabulary(byte_id, key[order], order.astype(np.int64), to[order], start, np.frombuffer(b"".join(raw), np.uint8), special)


def _pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = left << 32 | right
    at = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
    known = v.pair_key[at] == key
    return np.where(known, v.pair_rank[at], np.iinfo(np.int64).max), v.pair_to[at]


def merge_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """Ids of one long pre-token: a heap of ranked pairs over a linked list."""
    sym = v.byte_id[np.frombuffer(word, np.uint8)]
    n = len(sym)
    rank, _ = _pairs(v, sym[:-1], sym[1:])
    none = np.iinfo(np.int64).max
    heap = [(int(r), i) for i, r in enumerate(rank) if r != none]
    heapq.heapify(heap)
    sym, after, before = sym.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
    table = _pair_table(v)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if sym[i] < 0 or j < 0 or table.get((sym[i], sym[j]), (none,))[0] != r:
            continue
        sym[i], sym[j] = table[sym[i], sym[j]][1], -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (found := table.get((sym[a], sym[b]))):
                heapq.heappush(heap, (found[0], a))
    return np.array([s for s in sym if s >= 0], np.int64)


_tables: dict[int, dict] = {}


def _pair_table(v: Vocabulary) -> dict[tuple[int, int], tuple[int, int]]:
    if id(v) not in _tables:
        _tables.clear()
        _tables[id(v)] = {(int(k >> 32), int(k & 0xFFFFFFFF)): (int(r), int(t)) for k, r, t in zip(v.pair_key, v.pair_rank, v.pair_to, strict=True)}
    return _tables[id(v)]


def merge(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some pre-tokens, flat, and their number for each, by the exact merges.

    Each round merges, in every word, all occurrences of its lowest-ranked pair from the
    left, which is the order in which the merges of a word take place.
    """
    length = end - start
    count = np.ones(len(start), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word, ids)
    for w in np.flatnonzero(length > LONG):
        parts.append((np.full(len(ids := merge_long(v, data[start[w] : end[w]].tobytes())), w), ids))
    short = np.flatnonzero(length <= LONG)
    length = length[short]
    begin = np.cumsum(length) - length
    where = np.arange(int(length.sum())) - np.repeat(begin - start[short], length)
    sym, word = v.byte_id[data[where]], np.repeat(short, length)
    none = np.iinfo(np.int64).max
    while len(sym):
        rank = np.full(len(sym), none)
        to = np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], to[inside] = _pairs(v, sym[inside], sym[inside + 1])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.concatenate((first, [len(sym)])))
        least = np.repeat(np.minimum.reduceat(rank, first), size)
        done = least == none
        if done.any():
            parts.append((word[done], sym[done]))
            go = ~done
            sym, word, rank, to, least = sym[go], word[go], rank[go], to[go], least[go]
            if not len(sym):
                break
        hit = rank == least
        # of occurrences that overlap, as in a run of one symbol, every other one counts
        at = np.flatnonzero(hit)
        fresh = np.concatenate(([True], np.diff(at) > 1))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        sym[at] = to[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
    word = np.concatenate([p[0] for p in parts])
    ids = np.concatenate([p[1] for p in parts])
    order = np.argsort(word, kind="stable")
    count = np.bincount(word, minlength=len(start))
    return ids[order], count


# ---------------------------------------------------------------- automaton


MAGIC = b"VWLEX001"


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over ``entries`` in one buffer.

    Words are added in byte order; once a branch can no longer grow, a state equal to an
    earlier one is replaced by it, so prefixes and suffixes are shared. An arc carries how
    many entries precede it at its state, so a path adds up to the entry's rank.
    """
    words = sorted(w for w in entries if w)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    below: list[int] = [0]
    register: dict[tuple, int] = {}
    path: list[int] = [0]  # states of the word added last

    def settle(depth: int, last: bytes) -> None:
        for d in range(len(path) - 1, depth, -1):
            s = path[d]
            key = (final[s], tuple(sorted(arcs[s].items())))
            known = register.setdefault(key, s)
            if known != s:
                arcs[path[d - 1]][last[d - 1]] = known
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
        del path[depth + 1 :]

    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        settle(same, last)
        for c in w[same:]:
            arcs.append({})
            final.append(False)
            below.append(0)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = w
    settle(0, last)
    number = {0: 0}
    queue = [0]
    for s in queue:
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(number)
                queue.append(t)
    key, to, skip = [], [], []
    for s in queue:
        before = int(final[s])
        for c, t in sorted(arcs[s].items()):
            key.append(number[s] << 8 | c)
            to.append(number[t])
            skip.append(before)
            before += below[t]
    order = np.argsort(key, kind="stable") if key else np.zeros(0, np.int64)
    ids = [entries[w] for w in words]
    blocks = [
        np.array(key, "<i8")[order],
        np.array(to, "<i4")[order],
        np.array(skip, "<i4")[order],
        np.array([final[s] for s in queue], "<u1"),
        np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i4"),
        np.array([i for x in ids for i in x], "<i4"),
    ]
    out, table = [], []
    at = len(MAGIC) + 16 * len(blocks)
    for b in blocks:
        raw = b.tobytes() + b"\0" * (-b.nbytes % 8)
        table.append(struct.pack("<qq", at, len(b)))
        out.append(raw)
        at += len(raw)
    return b"".join([MAGIC, *table, *out])


class Lexicon:
    """The automaton, read from a buffer that may be a memory map."""

    def __init__(self, buffer) -> None:
        if bytes(buffer[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a lexicon file")
        kinds = ("<i8", "<i4", "<i4", "<u1", "<i4", "<i4")
        places = struct.unpack_from(f"<{2 * len(kinds)}q", buffer, len(MAGIC))
        self.key, self.to, self.skip, self.final, self.start, self.ids = (np.frombuffer(buffer, kind, n, at) for kind, at, n in zip(kinds, places[::2], places[1::2], strict=True))

    @classmethod
    def mapped(cls, image: bytes) -> Lexicon:
        """Write the image to a nameless local file and map that."""
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rank of each word, or -1: all words walk the automaton together, a byte a step."""
        rank = np.full(len(start), -1, np.int64)
        if not len(self.key):
            return rank
        live, state, total = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        step = 0
        while len(live):
            ended = start[live] + step >= end[live]
            own = live[ended]
            good = self.final[state[ended]] > 0
            rank[own[good]] = total[ended][good]
            live, state, total = live[~ended], state[~ended], total[~ended]
            if not len(live):
                break
            key = state << 8 | data[start[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = self.key[at] == key
            live, at = live[known], at[known]
            state, total = self.to[at].astype(np.int64), total[known] + self.skip[at]
            step += 1
        return rank


# ---------------------------------------------------------------- encoding


class Remembered:
    """Ids of pre-tokens already met by this worker, by hash; forgets everything when full."""

    def __init__(self, resolve: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        self.resolve = resolve
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat: list[np.ndarray] = []
        self.joined = np.zeros(0, np.int32)
        self.used = 0

    def encode(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that tile ``data``, flat, and their number for each."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))
        unique, first, inverse = np.unique(span_hash(data, start, end, lower=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.key) + len(new) > REMEMBER and len(self.key):
                self.clear()
                return self.encode(data, start)
            ids, count = self.resolve(data, start[first[new]], end[first[new]])
            begin = self.used + np.cumsum(count) - count
            self.joined = np.concatenate((self.joined, ids.astype(np.int32)))
            self.used += len(ids)
            self.key = np.insert(self.key, at[new], unique[new])
            self.start = np.insert(self.start, at[new], begin)
            self.count = np.insert(self.count, at[new], count)
            at = np.searchsorted(self.key, unique)
        count = self.count[at].astype(np.int64)[inverse]
        begin = self.start[at][inverse]
        edge = np.cumsum(count) - count
        where = np.arange(int(count.sum())) + np.repeat(begin - edge, count)
        return self.joined[where], count


class Encoder:
    """Exact ids of whole documents."""

    def __init__(self, vocabulary: Vocabulary, image: bytes | None = None, resolve=None) -> None:
        self.vocabulary = vocabulary
        self.lexicon = Lexicon.mapped(image) if image else None
        self.remembered = Remembered(resolve or self._resolve)
        found = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in found)) if found else None

    def _resolve(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.lexicon.find(data, start, end) if self.lexicon else np.full(len(start), -1)
        new = np.flatnonzero(rank < 0)
        ids, count = merge(self.vocabulary, data, start[new], end[new])
        if len(new) == len(start):
            return ids, count
        hit = np.flatnonzero(rank >= 0)
        begin = self.lexicon.start[rank[hit]].astype(np.int64)
        number = self.lexicon.start[rank[hit] + 1] - begin
        total = np.zeros(len(start), np.int64)
        total[new], total[hit] = count, number
        edge = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.int64)
        out[_spread(edge[new], count)] = ids
        out[_spread(edge[hit], number)] = self.lexicon.ids[_spread(begin, number)]
        return out, total

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents, flat, and their offsets per document (n + 1)."""
        cuts = [(m.start(), m.end(), self.vocabulary.special[m[0].decode()]) for m in self.special.finditer(data.tobytes())] if self.special else []
        if not cuts:
            begin, per = split(data, offsets)
            ids, count = self.remembered.encode(data, begin)
            return ids, np.concatenate(([0], np.cumsum(count)))[per]
        edge = set(offsets.tolist())
        bounds = sorted(edge | {x for a, b, _ in cuts for x in (a, b)})
        # a string that spans the border of two documents is no special token
        cuts = [c for c in cuts if not any(c[0] < e < c[1] for e in edge)]
        token = {a: i for a, _, i in cuts}
        bounds = np.array(sorted(edge | {x for a, b, _ in cuts for x in (a, b)}), np.int64)
        begin, per = split(data, bounds)
        ids, count = self.remembered.encode(data, begin)
        total = np.concatenate(([0], np.cumsum(count)))[per]
        out, sizes = [], []
        for k, a in enumerate(bounds[:-1].tolist()):
            out.append(np.array([token[a]], ids.dtype) if a in token else ids[total[k] : total[k + 1]])
            sizes.append(len(out[-1]))
        place = np.concatenate(([0], np.cumsum(sizes)))
        return np.concatenate(out) if out else ids, place[np.searchsorted(bounds, offsets)]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of some ranges."""
    edge = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - edge, count)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids in UTF-8, special tokens included; broken sequences become U+FFFD."""
    ids = ids.astype(np.int64)
    start = v.token_start[ids]
    raw = v.token_bytes[_spread(start, v.token_start[ids + 1] - start)].tobytes()
    return raw.decode("utf-8", "replace").encode("utf-8")


# ---------------------------------------------------------------- Spark


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS, column: str = "text") -> DataFrame:
    """The most frequent pre-tokens of all documents: word (binary), n; at most ``n`` of them.

    The numbers of words by frequency give the least frequency that still fits; words of
    lower or equal frequency to the first that doesn't fit stay out together, so no sort
    brings candidates of all partitions to one task.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch, "text"):
                start, _ = split(data, offsets)
                if not len(start):
                    continue
                end = np.append(start[1:], len(data))
                _, first, number = np.unique(span_hash(data, start, end, lower=False), return_index=True, return_counts=True)
                a, b = start[first], end[first]
                fit = b - a <= LONG  # a longer word is never looked up
                a, b, number = a[fit], b[fit], number[fit]
                place = np.concatenate(([0], np.cumsum(b - a))).astype(np.int32)
                flat = data[_spread(a, b - a)]
                word = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(place), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([word, pa.array(number, pa.int64())], ["word", "n"])

    text = docs.select(text_of(docs, column).alias("text"))
    counted = text.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    left, least = n, 0
    # a row for each frequency that occurs, at most the square root of twice the corpus's words
    for row in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        left -= row["words"]
        if left < 0:
            least = row["n"]
            break
    return counted.where(F.col("n") > least)


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, n: int = LEXICON_WORDS, column: str = "text") -> bytes:
    """The image of the automaton over the corpus's frequent words: bounded by ``n``."""
    found = frequent_words(docs, n, column).select("word").toArrow().column("word").combine_chunks()
    words = [bytes(w) for w in found.to_pylist()]
    if not words:
        return compile_lexicon({})
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    ids, count = merge(vocabulary, data, end - np.array([len(w) for w in words]), end)
    edge = np.concatenate(([0], np.cumsum(count)))
    return compile_lexicon({w: ids[edge[k] : edge[k + 1]].tolist() for k, w in enumerate(words)})


ENCODED = "n_tokens long, ids binary, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", column: str = "text", digests: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns ``key`` with n_tokens, ids (little-endian unsigned 32-bit) and decoded; with
    ``digests``, the SHA-256 of ids and of the decoded UTF-8 instead of both.
    """
    spark = docs.sparkSession
    vocabulary = load_vocabulary(tokenizer)
    shared = spark.sparkContext.broadcast((vocabulary, build_lexicon(docs, vocabulary, lexicon_words, column)))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {DIGESTS if digests else ENCODED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, image = shared.value
        encoder = encoder_of(vocabulary, image)
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                ids, edge = encoder(data, offsets)
                rows = [ids[edge[k] : edge[k + 1]] for k in range(j - i)]
                raw = [r.astype("<u4").tobytes() for r in rows]
                text = [decode(vocabulary, r) for r in rows]
                if digests:
                    last = [pa.array([hashlib.sha256(x).hexdigest() for x in some]) for some in (raw, text)]
                else:
                    last = [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8") for x in text], pa.string())]
                names = [key, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(edge), pa.int64()), *last], names)

    return docs.select(docs[key], text_of(docs, column).alias("text")).mapInArrow(run, schema)


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary, image: bytes) -> Encoder:
    """One encoder for a worker process, kept between its tasks."""
    name = hashlib.sha1(image).hexdigest() + str(len(vocabulary.token_bytes))
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary, image)
    return _encoders[name]
