"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: a segment holds, for about half a megabyte of text, its terms in
ascending order and for each term its postings, the ascending word positions at which it
stands. Segments are written once to the shared folder. A phrase starts from the postings
of its rarest term in the segment, shifted by the term's place in the phrase, and these are
intersected with the shifted postings of its other terms, rarest first.

The test phrases are written to the shared folder too, in blocks of ``BLOCK`` at most, by the
value of one term each: the longest word, which is seldom a frequent one. A segment meets
only the phrases of a block whose term it holds. A task holds one block at a time unless all
of them are small, so its memory depends on neither the benchmark nor the number of blocks.

Cases: null text has no words; an item without words or without an id is left out; rows
that repeat an item id are one item with the windows of all of them; documents without
words have no hits; rows that share an id, or have none, are judged each by its own text;
other columns do not matter; an empty benchmark matches nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small_side
from ..session import materialise, work_dir
from .shared import filesystem, path_of, ship, text_marks, text_of
from .textvec import give_back, pieces, span_hash, words

WINDOW = 13
#: Phrases in a block: 10 MB at 13 terms.
BLOCK = 100_000
#: Phrases that a worker keeps between batches, if a benchmark has no more than that.
HELD = 200_000

SEGMENT = "keys array<long>, t1 array<long>, t2 array<long>, edges binary, terms binary, lists binary, positions binary"


@dataclass
class Segment:
    """Postings of some documents."""

    keys: pa.Array
    t1: pa.Array  # hashes of the texts
    t2: pa.Array
    edges: np.ndarray  # word offsets of the documents (n + 1)
    terms: np.ndarray  # ascending
    lists: np.ndarray  # offsets of postings (terms + 1)
    positions: np.ndarray  # ascending within a term

    def __post_init__(self) -> None:
        term = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.lists))
        self.posting = term << 32 | self.positions  # ascending

    def lookup(self, term: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        if not len(self.terms):
            return np.full(term.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, at, -1)

    def phrases(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first position) of every occurrence, within a document, of phrases (n, length) of terms."""
        length = phrase.shape[1]
        number = self.lookup(phrase)
        live = np.flatnonzero((number >= 0).all(1))
        number = number[live]
        if not len(live):
            return live, live
        size = self.lists[number + 1] - self.lists[number]
        order = np.argsort(size, axis=1, kind="stable")
        every = np.arange(len(live))
        rare = order[:, 0]
        count = size[every, rare]
        row = np.repeat(every, count)
        begin = self.lists[number[every, rare]]
        flat = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
        start = self.positions[flat].astype(np.int64) - rare[row]
        doc = np.searchsorted(self.edges, np.maximum(start, 0), side="right") - 1
        fits = (start >= 0) & (start + length <= self.edges[np.minimum(doc + 1, len(self.edges) - 1)])
        row, start = row[fits], start[fits]
        for step in range(1, length):
            j = order[row, step]
            wanted = number[row, j] << 32 | (start + j)
            at = np.minimum(np.searchsorted(self.posting, wanted), len(self.posting) - 1)
            there = self.posting[at] == wanted
            row, start = row[there], start[there]
        return live[row], start

    def near(self, terms: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """The shortest stretches (first, last position) that hold all of some distinct terms in at most ``len(terms) + slop`` words of one document."""
        number = self.lookup(terms)
        if (number < 0).any():
            return []
        lists = [self.positions[self.lists[t] : self.lists[t + 1]].astype(np.int64) for t in number]
        lists.sort(key=len)
        reach = len(terms) + slop
        anchors = lists[0]
        for other in lists[1:]:  # anchors with each other term within reach
            left = np.searchsorted(other, anchors - reach + 1)
            anchors = anchors[(left < len(other)) & (other[np.minimum(left, len(other) - 1)] < anchors + reach)]
        found = set()
        for p in anchors.tolist():
            d = int(np.searchsorted(self.edges, p, side="right")) - 1
            low, high = max(int(self.edges[d]), p - reach + 1), min(int(self.edges[d + 1]), p + reach)
            spots = sorted((int(x), k) for k, own in enumerate(lists) for x in own[np.searchsorted(own, low) : np.searchsorted(own, high)])
            last: dict[int, int] = {}
            for x, k in spots:
                last[k] = x
                if len(last) == len(lists) and (first := min(last.values())) > x - reach and first <= p <= x:
                    found.add((first, x))
        return sorted(s for s in found if not any(t != s and t[0] >= s[0] and t[1] <= s[1] for t in found))


def build_index(docs: DataFrame, key: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """Write the postings of every word of every document; one row for each segment."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                start, end, edge = words(data, offsets)
                term = span_hash(data, start, end)
                order = np.argsort(term, kind="stable")
                term = term[order]
                first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
                raw = [edge.astype("<i8"), term[first].astype("<u8"), np.append(first, len(term)).astype("<i4"), order.astype("<i4")]
                own = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(c).slice(i, j - i)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([r.tobytes()], pa.binary()) for r in raw)], ["keys", "t1", "t2", "edges", "terms", "lists", "positions"])

    text = text_of(docs, column)
    rows = docs.select(docs[key].cast("long").alias("key"), *text_marks(text), text.alias("text"))
    return materialise(rows.mapInArrow(run, SEGMENT), "postings", path)


def segments(batch: pa.RecordBatch) -> list[Segment]:
    kinds = ("<i8", "<u8", "<i4", "<i4")
    return [Segment(*(batch.column(c)[k].values for c in range(3)), *(np.frombuffer(batch.column(c + 3)[k].as_buffer(), kind) for c, kind in enumerate(kinds))) for k in range(batch.num_rows)]


@dataclass
class Block:
    """Phrases in ascending order of their chosen terms."""

    items: np.ndarray
    chosen: np.ndarray
    length: np.ndarray
    terms: np.ndarray  # of all phrases
    start: np.ndarray  # offsets of phrases (n + 1)

    @classmethod
    def read(cls, uri: str) -> Block:
        import pyarrow.ipc as ipc

        system, path = filesystem(uri)
        with system.open_input_file(path) as f:
            t = ipc.open_file(f).read_all().combine_chunks()
        chosen = t["chosen"].to_numpy().view(np.uint64)
        order = np.argsort(chosen, kind="stable")
        raw = t["terms"].chunk(0).take(pa.array(order)) if len(order) else pa.array([], pa.binary())
        start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 8
        terms = np.frombuffer(raw.buffers()[2], "<u8")[start[0] : start[-1]]
        start = start - start[0]
        return cls(np.array(t["item"].to_pylist(), dtype=object)[order], chosen[order], np.diff(start), terms, start)

    def candidates(self, s: Segment) -> np.ndarray:
        """The phrases whose chosen term the segment holds."""
        if not len(self.chosen) or not len(s.terms):
            return np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate(([True], self.chosen[1:] != self.chosen[:-1])))
        size = np.diff(np.append(first, len(self.chosen)))
        there = s.lookup(self.chosen[first]) >= 0
        first, size = first[there], size[there]
        return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)

    def phrases(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By length: numbers of phrases among ``some``, and their terms (n, length)."""
        for length in np.unique(self.length[some]).tolist():
            own = some[self.length[some] == length]
            yield own, self.terms[self.start[own][:, None] + np.arange(length)]


_held: dict[str, Block] = {}


def _read_blocks(blocks: list[tuple[str, int]]) -> Iterator[Block]:
    """The blocks one after another; a worker keeps those of a small benchmark."""
    if sum(n for _, n in blocks) > HELD:
        for uri, _ in blocks:
            yield Block.read(uri)
        return
    for uri in set(_held) - {u for u, _ in blocks}:
        del _held[uri]
    for uri, _ in blocks:
        if uri not in _held:
            _held[uri] = Block.read(uri)
        yield _held[uri]


def _groups(batches: Iterator[pa.RecordBatch], blocks: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Segments that are held together: one where the blocks are held too, else those of a batch, for which they are read."""
    for batch in batches:
        step = batch.num_rows if sum(n for _, n in blocks) > HELD else 1
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
        del batch
        give_back()


def write_phrases(items: DataFrame, size: int | None = WINDOW, key: str = "item_id", column: str = "text") -> list[tuple[str, int]]:
    """Write the distinct phrases of the items in blocks; path and number of phrases of each.

    Phrases are all windows of ``size`` words (an item of fewer words is one), or without
    ``size`` the distinct words of each item.
    """
    spark = items.sparkSession
    ship(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                start, end, edge = words(data, offsets)
                term = span_hash(data, start, end)
                # longer words first; among equals any, but always the same
                rank = np.lexsort((term, start - end))
                place = np.empty(len(term), np.int64)
                place[rank] = np.arange(len(term))
                for d in range(j - i):
                    own, where = term[edge[d] : edge[d + 1]], place[edge[d] : edge[d + 1]]
                    if not len(own):
                        continue
                    if size is None:
                        own, first = np.unique(own, return_index=True)
                        where = where[first]
                    m = min(size, len(own)) if size else len(own)
                    for k in range(0, len(own) - m + 1, 8192):  # a long item goes in parts
                        view = np.lib.stride_tricks.sliding_window_view(own[k : k + 8192 + m - 1], m)
                        best = np.lib.stride_tricks.sliding_window_view(where[k : k + 8192 + m - 1], m).argmin(1)
                        n = len(view)
                        terms = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 8 * m, 8 * m, dtype=np.int32)), pa.py_buffer(view.astype("<u8").tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i + d].as_py()] * n, pa.string()), pa.array(view[np.arange(n), best].view(np.int64)), terms], ["item", "chosen", "terms"])

    path = work_dir(spark, "phrases")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.ipc as ipc

        def put(t: pa.Table) -> pa.RecordBatch:
            uri = f"{path}/{uuid.uuid4().hex}.arrow"
            system, name = filesystem(uri)
            system.create_dir(path_of(name), recursive=True)
            with system.open_output_stream(name) as out, ipc.new_file(out, t.schema) as f:
                f.write_table(t)
            return pa.RecordBatch.from_pydict({"path": [uri], "n": [t.num_rows]})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                if sum(b.num_rows for b in held) + part.num_rows > BLOCK:
                    yield put(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield put(pa.Table.from_batches(held))

    rows = items.select(items[key].cast("string").alias("item"), text_of(items, column).alias("text")).where("item is not null")
    found = materialise(rows.mapInArrow(cut, "item string, chosen long, terms binary").dropDuplicates(["item", "terms"]), "windows")
    parts = found.count() // BLOCK + 1
    # a row for each block
    made = found.repartitionByRange(parts, "chosen").mapInArrow(write, "path string, n long").collect()
    return [(r["path"], r["n"]) for r in made]


def phrase_matches(index: DataFrame, items: DataFrame, size: int = WINDOW, item_key: str = "item_id", column: str = "text") -> DataFrame:
    """One row per document: key, t1 and t2 (hash of its text), n_words, n_hit, items (ids, sorted as text, with a window in it) and spans.

    A window is ``size`` consecutive words of an item; an item of fewer is one window. A
    span (item, first, words) joins windows of an item that overlap or adjoin in the document.
    """
    ship(index.sparkSession)
    blocks = write_phrases(items, size, item_key, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, blocks):
            parts = segments(part)
            cover = [np.zeros(int(s.edges[-1]) + 1, np.int32) for s in parts]
            named: list[dict[str, list[np.ndarray]]] = [{} for _ in parts]
            for block in _read_blocks(blocks):
                for s, covered, found in zip(parts, cover, named, strict=True):
                    for number, phrase in block.phrases(block.candidates(s)):
                        row, start = s.phrases(phrase)
                        if not len(row):
                            continue
                        length = phrase.shape[1]
                        np.add.at(covered, start, 1)
                        np.add.at(covered, start + length, -1)
                        own, which = np.unique(block.items[number[row]].astype(str), return_inverse=True)
                        for k, name in enumerate(own.tolist()):
                            at = start[which == k]
                            found.setdefault(name, []).append(np.stack([at, at + length]))
            for s, covered, found in zip(parts, cover, named, strict=True):
                yield _matches(s, covered, found)

    return index.mapInArrow(run, MATCHES)


MATCHES = "key long, t1 long, t2 long, n_words long, n_hit long, items array<string>, spans array<struct<item:string,first:long,words:long>>"


def _matches(s: Segment, cover: np.ndarray, named: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """A row for each document of a segment, from the windows that start (1) and end (-1) at each word and those of each item."""
    n = len(s.keys)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    spans: list[tuple[int, str, int, int]] = []
    for name, found in named.items():
        a, b = np.concatenate(found, axis=1)
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        doc = np.searchsorted(s.edges, a, side="right") - 1
        fresh = np.concatenate(([True], (a[1:] > b[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(fresh)
        last = b[np.append(first[1:], len(a)) - 1]
        spans += zip(doc[first].tolist(), [name] * len(first), (a[first] - s.edges[doc[first]]).tolist(), (last - a[first]).tolist(), strict=True)
    spans.sort()
    at = np.searchsorted([x[0] for x in spans], np.arange(n + 1)) if spans else np.zeros(n + 1, np.int64)
    ids = [sorted({x[1] for x in spans[at[d] : at[d + 1]]}) if at[d + 1] > at[d] else [] for d in range(n)]
    struct = pa.StructArray.from_arrays([pa.array([x[1] for x in spans], pa.string()), pa.array([x[2] for x in spans], pa.int64()), pa.array([x[3] for x in spans], pa.int64())], ["item", "first", "words"])
    columns = [s.keys, s.t1, s.t2, pa.array(np.diff(s.edges)), pa.array(np.diff(hit[s.edges])), pa.array(ids, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(at, pa.int32()), struct)]
    return pa.RecordBatch.from_arrays(columns, ["key", "t1", "t2", "n_words", "n_hit", "items", "spans"])


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, item_key: str = "item_id", column: str = "text") -> DataFrame:
    """(key, item, first, last): the shortest stretches of a document with all distinct words of an item, at most ``slop`` other words among them."""
    ship(index.sparkSession)
    blocks = write_phrases(items, None, item_key, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, blocks):
            parts, out = segments(part), []
            for block in _read_blocks(blocks):
                for s in parts:
                    for number in block.candidates(s).tolist():
                        for a, b in s.near(block.terms[block.start[number] : block.start[number + 1]], slop):
                            d = int(np.searchsorted(s.edges, a, side="right")) - 1
                            out.append((s.keys[d].as_py(), block.items[number], a - int(s.edges[d]), b - int(s.edges[d])))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*sorted(set(out), key=str), strict=True), kinds, strict=True)], ["key", "item", "first", "last"])

    return index.mapInArrow(run, "key long, item string, first long, last long")


def contaminated(matches: DataFrame) -> DataFrame:
    """Adds the rule: a document is contaminated if at least a twentieth of its words, and one, is hit."""
    return matches.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated documents; a row goes by its id and text together."""
    found = contaminated(phrase_matches(build_index(docs, key, column), items, column="text")).where("contaminated")
    drop = small_side(found.select(F.col("key").alias("_drop_id"), F.col("t1").alias("_drop_t1"), F.col("t2").alias("_drop_t2")).distinct(), "drop")
    t1, t2 = text_marks(text_of(docs, column))
    return docs.join(drop, docs[key].cast("long").eqNullSafe(drop["_drop_id"]) & (t1 == drop["_drop_t1"]) & (t2 == drop["_drop_t2"]), "left_anti")
