"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its word shingles, a shingle's weight being how often it
occurs. Each unit of weight of each shingle is a region into which hashed darts fall at
random ranks (the gaps between them are exponential), each dart at a random coordinate.
A signature keeps the earliest dart of each coordinate. Only darts before a rank that
falls with the document's weight are thrown, so the work is its weight plus about
``K * ln K`` darts, however long it is. Two coordinates agree with the probability of the
weighted Jaccard similarity.

Equal texts (by words) first become one node. Nodes that share a band of the signature are
compared with the bucket's leader: candidates whose signatures are near enough are checked
exactly on their shingles. In buckets that still hold members of several classes every pair
of different classes is compared, chunk against chunk, by the signatures in the first bucket
that the pair shares; the members of the pairs that are near enough meet once more with their
shingles, and all pairs of such a block are checked exactly at once, as a matrix product.
Classes are connected components of texts; no step gathers a bucket, and a block gives a
spanning forest of its links, not its pairs.

Cases: null text counts as empty; documents without words are alone; documents of fewer
words than a shingle have one shingle of all their words; a null id is alone; rows that
share an id are judged each by its own text, so an id can be in several classes, and a class
goes by its least id; of the rows with a class's least id those with the same words as its
first text stay, repeated rows among them; an empty table gives no rows; other columns do
not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.joins import skew_join, small_side
from ..session import Scratch, materialise
from .shared import ship, text_marks, text_of
from .textvec import give_back, mix, pieces, shingles, span_hash, utf8, words

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 5 coordinates: a pair at 0.8 shares none with probability 7e-5.
BANDS, ROWS = 24, 5
K = BANDS * ROWS
#: Candidates whose signatures agree less are taken for less similar than the threshold
#: without an exact check: over four standard deviations at K = 120.
FLOOR = 0.64
#: Members of a bucket in a chunk; chunks are compared two at a time.
CHUNK = 256
#: Shingles up to which a text is checked within a block; pairs with a longer one are checked one by one.
HEAVY = 8192
#: Shingles of a block's matrix at once.
COLUMNS = 4096
#: Nodes whose texts are fetched by broadcasting, at most.
NEEDED = 1 << 18

_LONGS = [T.StructField(c, T.LongType()) for c in ("id", "t1", "t2", "h1", "h2")]
SIGNED = T.StructType([*_LONGS, T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("weight", T.LongType())])


def unit_cells(shingle: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each occurrence of each shingle: equal for the n-th occurrence in any document."""
    if not len(shingle):
        return shingle
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(s + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def dart_signatures(cells: np.ndarray, offsets: np.ndarray, k: int = K) -> np.ndarray:
    """The signature (n, k) of each document's unit cells; rows of empty documents are 0."""
    n = len(offsets) - 1
    weight = np.diff(offsets)
    signature = np.zeros((n, k), np.uint32)
    todo = np.flatnonzero(weight)
    reach = k * (np.log(k) + 3) / np.maximum(weight, 1)
    while len(todo):
        size = weight[todo]
        at = np.repeat(offsets[todo] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell, own = cells[at], np.repeat(np.arange(len(todo)), size)
        rank, limit = np.zeros(len(cell)), reach[todo][own]
        slots, ranks, values, step = [], [], [], 0
        while len(cell):
            throw = mix(cell + np.uint64((step + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
            rank = rank - np.log(((throw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank < limit
            cell, own, rank, limit, throw = cell[live], own[live], rank[live], limit[live], throw[live]
            aim = mix(throw)
            slots.append(own * k + ((aim >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            values.append(aim.astype(np.uint32))
            step += 1
        slot, rank, value = np.concatenate(slots), np.concatenate(ranks), np.concatenate(values)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, slot, rank)
        won = rank == first[slot]
        flat = np.zeros(len(todo) * k, np.uint32)
        flat[slot[won]] = value[won]
        full = np.isfinite(first).reshape(-1, k).all(1)
        signature[todo[full]] = flat.reshape(-1, k)[full]
        todo = todo[~full]
        reach[todo] *= 2
    return signature


def _text_hash(word: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each document's sequence of words."""
    place = np.arange(len(word)) - np.repeat(offsets[:-1], np.diff(offsets))
    value = word * (mix(place.astype(np.uint64) + np.uint64(salt)) | np.uint64(1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.uint64(salt) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _texts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """id, t1 and t2 (hash of the text as it is written) and text."""
    rows = docs.select(docs[key].cast("long").alias("id"), text_of(docs, column).alias("text"))
    return rows.select("id", *text_marks("text"), "text")


def signatures(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """id, t1 and t2 (hash of the text), h1 and h2 (hash of its words; null without words), sig (16 bits a coordinate), bands, weight (number of shingles)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                start, end, edge = words(data, offsets)
                word = span_hash(data, start, end)
                shingle, at = shingles(word, edge, SHINGLE)
                sig = dart_signatures(unit_cells(shingle, at), at)
                empty = np.diff(at) == 0
                band = np.zeros((j - i, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9FB21C651E98DF25) + sig[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                rows = np.where(empty, 0, BANDS)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rows))), pa.int32()), pa.array(band[~empty].ravel()))
                short = sig.astype("<u2").tobytes()
                binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(0, (j - i + 1) * 2 * K, 2 * K, dtype=np.int32)), pa.py_buffer(short)])
                own = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(_text_hash(word, edge, 1), mask=empty), pa.array(_text_hash(word, edge, 2), mask=empty), binary, lists, pa.array(np.diff(at))], SIGNED.names)

    return _texts(docs, key, column).mapInArrow(run, SIGNED)


def _agreement(pairs: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) with sig_a and sig_b whose signatures agree in at least ``floor`` of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(utf8_binary(batch.column(c)), "<u2").reshape(-1, K) for c in (2, 3))
            keep = (a == b).mean(1) >= floor
            yield batch.select([0, 1]).filter(pa.array(keep))
            give_back()

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def utf8_binary(column: pa.Array) -> bytes:
    """The bytes of a binary column without nulls, joined."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[at[0] : at[-1]] if len(column) else b""


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The exact similarity of the texts of each row."""
    sides = []
    for column in (left, right):
        data, offsets = utf8(column)
        start, end, edge = words(data, offsets)
        shingle, at = shingles(span_hash(data, start, end), edge, SHINGLE)
        cell = unit_cells(shingle, at)
        sides.append((cell, np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(at)))
    cell, row = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
    order = np.lexsort((cell, row))
    same = (cell[order][1:] == cell[order][:-1]) & (row[order][1:] == row[order][:-1])
    both = np.bincount(row[order][1:][same], minlength=len(left))
    total = sides[0][2] + sides[1][2] - both
    return np.divide(both, total, out=np.zeros(len(left)), where=total > 0)


def _exact(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                keep = weighted_jaccard(part.column(2), part.column(3)) >= threshold
                if keep.any():
                    yield part.select([0, 1]).filter(pa.array(keep))
            give_back()

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _near(pairs: DataFrame, sigs: DataFrame, floor: float, scratch: Scratch) -> DataFrame:
    """Those of some distinct pairs (a, b) whose signatures agree in at least ``floor`` of the coordinates; a table."""
    near = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    near = near.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return scratch.table(_agreement(near, floor), "near")


def _texts_of(nodes: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(node, text) of some distinct nodes; ``names`` has the id and the hash of the text (t1, t2) of each node."""
    needed = small_side(nodes.join(names, "node"), "needed", NEEDED)
    # rows that repeat an id and its text are one
    return texts.join(needed, ["id", "t1", "t2"]).select("node", "text").dropDuplicates(["node"])


def _verify(near: DataFrame, texts: DataFrame, names: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Those of some distinct pairs (a, b) whose texts are at least ``threshold`` similar; a table."""
    own = scratch.table(_texts_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, names), "texts")
    both = near.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return scratch.table(_exact(both, threshold), "links")


#: A block of a bucket: two of its chunks (the same twice: the pairs within it), each given by three numbers.
BLOCK = ["key", *(f"{end}_{c}" for end in ("low", "high") for c in ("big", "of", "i"))]
#: A member of a block: whether it is in the higher chunk, its node and class.
MEMBER = ", ".join(f"{c} {'int' if c.endswith('_big') else 'long'}" for c in BLOCK) + ", kind int, node long, comp long"


def _blocks(members: DataFrame, sigs: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """Of members (key, band, node, comp): rows (*BLOCK, kind, node, comp, band, sig, weight) that meet each pair of different classes of a bucket in one block.

    A class of more than ``chunk`` members of a bucket has chunks of its own, whose pairs are
    left out; all other members share chunks. Kind is 0 for the members of the lower chunk and
    1 for those of the higher one.
    """
    sizes = scratch.table(members.groupBy("key", "comp").agg(F.count("*").alias("n")), "sizes")
    pooled = sizes.where(F.col("n") <= chunk).groupBy("key").agg(F.ceil(F.sum("n") / chunk).alias("pools"))
    part = lambda big, of, i: F.struct(big.alias("big"), of.alias("of"), i.alias("i"))
    large, zero = F.lit(1), F.lit(0).cast("long")
    many = lambda n: F.explode(F.sequence(zero, n - 1)).alias("i")
    chunks = sizes.where(F.col("n") > chunk).select("key", "comp", many(F.ceil(F.col("n") / chunk))).select("key", part(large, F.col("comp"), F.col("i")).alias("part"))
    chunks = chunks.unionByName(pooled.select("key", many(F.col("pools"))).select("key", part(F.lit(0), zero, F.col("i")).alias("part")))
    blocks = chunks.withColumnRenamed("part", "low").join(chunks.withColumnRenamed("part", "high"), "key")
    same_class = (F.col("low.big") == 1) & (F.col("high.big") == 1) & (F.col("low.of") == F.col("high.of"))
    blocks = blocks.where((F.col("low") <= F.col("high")) & ~same_class)
    sides = blocks.select("key", F.explode(F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))).alias("part"), "low", "high")
    sides = sides.withColumn("kind", (F.col("part") > F.col("low")).cast("int"))
    salt = lambda n: F.pmod(F.xxhash64("node"), n)
    at = skew_join(skew_join(members, sizes, ["key", "comp"]), pooled, ["key"], "left")
    at = at.select("key", "band", "node", "comp", F.when(F.col("n") > chunk, part(large, F.col("comp"), salt(F.ceil(F.col("n") / chunk)))).otherwise(part(F.lit(0), zero, salt(F.col("pools")))).alias("part"))
    flat = [F.col("key"), *(F.col(c.replace("_", ".", 1)).alias(c) for c in BLOCK[1:])]
    return skew_join(at, sides, ["key", "part"]).join(sigs, "node").select(*flat, "kind", "node", "comp", "band", "sig", "weight")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """The rows of one block after another, of batches in the order of blocks, and whether its chunks are the same."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
        if held is None or not held.num_rows:
            continue
        block = [np.asarray(held[c]) for c in BLOCK]
        cut = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in block], axis=0), [True])))
        same = np.all([block[c] == block[c + 3] for c in (1, 2, 3)], axis=0)
        stop = len(cut) - (1 if batch is None else 2)
        held = held.combine_chunks()
        for g in range(stop):
            yield held.slice(cut[g], cut[g + 1] - cut[g]), bool(same[cut[g]])
        held = held.slice(cut[stop])
        give_back()


def _packed(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Tables put together into batches of thousands of rows."""
    held, n = [], 0
    for t in itertools.chain(parts, [None]):
        if t is not None:
            held.append(t)
            n += t.num_rows
        if held and (t is None or n >= 8192):
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0


def _candidates(rows: DataFrame, floor: float) -> DataFrame:
    """Of the rows of ``_blocks``, the members of pairs to check: of different classes, agreeing in ``floor``, and with this as their first common bucket.

    A pair with a text of more than ``HEAVY`` shingles is a row of its own, with the partner in ``other``.
    """

    def pairs(t: pa.Table, same: bool) -> pa.Table | None:
        kind, node, comp, weight = (np.asarray(t[c]) for c in ("kind", "node", "comp", "weight"))
        low, high = np.flatnonzero(kind == 0), np.flatnonzero(kind == (0 if same else 1))
        if not len(low) or not len(high):
            return None
        sig = np.frombuffer(utf8_binary(t["sig"].combine_chunks()), "<u2").reshape(-1, K)
        near = np.stack([(sig[high] == x).mean(1) for x in sig[low]]) >= floor
        near &= comp[low][:, None] != comp[high][None, :]
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        i, j = low[i], high[j]
        common = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(2)
        first = common.argmax(1) == t["band"][0].as_py()
        i, j = i[first], j[first]
        heavy = np.maximum(weight[i], weight[j]) > HEAVY
        light = np.unique(np.concatenate((i[~heavy], j[~heavy])))
        take = np.concatenate((light, i[heavy]))
        if not len(take):
            return None
        other = pa.array(np.concatenate((light, node[j[heavy]])), pa.int64(), mask=np.arange(len(take)) < len(light))
        return t.select([*BLOCK, "kind", "node", "comp"]).take(take).append_column("other", other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pairs(t, same) for t, same in _by_block(batches))
        yield from _packed((t for t in found if t is not None))

    dealt = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    return dealt.select(*BLOCK, "kind", "node", "comp", "band", "sig", "weight").mapInArrow(run, MEMBER + ", other long")


def _cells(texts: DataFrame) -> DataFrame:
    """The unit cells of texts (node, text), ascending, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                start, end, edge = words(data, offsets)
                shingle, at = shingles(span_hash(data, start, end), edge, SHINGLE)
                cell = unit_cells(shingle, at)
                raw = [np.sort(cell[at[d] : at[d + 1]]).tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(raw, pa.binary())], ["node", "cells"])

    return texts.select("node", "text").mapInArrow(run, "node long, cells binary")


def common_cells(cells: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many cells each of some sets (numbers ``low``) shares with each other one of ``high``."""
    every = np.concatenate(cells)
    own = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    _, column, number = np.unique(every, return_inverse=True, return_counts=True)
    # what only one set has adds nothing
    rank = np.cumsum(number > 1) - 1
    shared = number[column] > 1
    own, column = own[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    both = np.zeros((len(low), len(high)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        m = np.zeros((len(cells), COLUMNS), np.float32)
        m[own[a:b], column[a:b] - c] = 1
        both += m[low] @ m[high].T
    return both


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """Of members of blocks with their cells: pairs (a, b) at least ``threshold`` similar that span the classes of each block."""

    def forest(t: pa.Table, same: bool) -> pa.Table | None:
        kind, node, comp = (np.asarray(t[c]) for c in ("kind", "node", "comp"))
        low, high = np.flatnonzero(kind == 0), np.flatnonzero(kind == (0 if same else 1))
        if not len(low) or not len(high):
            return None
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["cells"]]
        both = common_cells(cells, low, high)
        size = np.array([len(c) for c in cells])
        near = both >= threshold * (size[low][:, None] + size[high][None, :] - both) - 1e-3
        near &= comp[low][:, None] != comp[high][None, :]
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        exact = both[i, j].astype(float) / (size[low[i]] + size[high[j]] - both[i, j]) >= threshold
        i, j = low[i[exact]], high[j[exact]]
        top = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        taken = []
        for k, (x, y) in enumerate(zip(comp[i].tolist(), comp[j].tolist(), strict=True)):
            x, y = find(x), find(y)
            if x != y:
                top[x] = y
                taken.append(k)
        return pa.table({"a": node[i[taken]], "b": node[j[taken]]}) if taken else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (forest(t, same) for t, same in _by_block(batches))
        yield from _packed((t for t in found if t is not None))

    dealt = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    return dealt.select(*BLOCK, "kind", "node", "comp", "cells").mapInArrow(run, "a long, b long")


def _classified(docs: DataFrame, key: str, column: str, threshold: float, floor: float, chunk: int) -> DataFrame:
    """One row per document: id, t1, t2, class_id, copy_of, group_size, kept."""
    scratch = Scratch(docs.sparkSession)
    table = materialise(signatures(docs, key, column).withColumn("row", F.monotonically_increasing_id()), "signatures")
    usable = table.where("id is not null and h1 is not null")
    # a text is a node, which goes by the number of one of its rows
    nodes = usable.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(nodes, "nodes")
    reps = usable.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    reps = scratch.table(reps.select("node", "id", "t1", "t2", "sig", "bands", "weight"), "reps")
    sigs, names = reps.select("node", "sig"), reps.select("node", "id", "t1", "t2")
    texts = _texts(docs, key, column)
    banded = reps.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = scratch.table(skew_join(banded, leaders, ["key"]), "buckets")
    pairs = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = _verify(_near(pairs, sigs, floor, scratch), texts, names, threshold, scratch)
    classes = materialise(connected_components(links, src="a", dst="b"), "classes")
    # pairs of different classes
    known = shared.join(classes, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("comp"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    members = scratch.table(skew_join(known, mixed, ["key"]), "open")
    found = scratch.table(_candidates(_blocks(members, reps.select("node", "sig", "weight"), chunk, scratch), floor), "candidates")
    light, single = found.where("other is null").drop("other"), found.where("other is not null")
    fresh = None
    if not light.isEmpty():
        cells = scratch.table(_cells(_texts_of(light.select("node").distinct(), texts, names)), "cells")
        fresh = scratch.table(_links(light.join(cells, "node"), threshold), "links")
    if not single.isEmpty():
        single = scratch.table(single.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "single")
        more = _verify(single, texts, names, threshold, scratch)
        fresh = more if fresh is None else fresh.unionByName(more)
    if fresh is not None and not fresh.isEmpty():
        classes = materialise(connected_components(links.unionByName(fresh), src="a", dst="b"), "classes")
    scratch.drop()
    placed = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = F.min(F.struct("least", "h1", "h2", "node"))
    sizes = placed.groupBy("component").agg(chosen.alias("first"), F.sum("copies").alias("group_size"))
    placed = skew_join(placed, sizes, ["component"])
    placed = placed.select("h1", "h2", F.col("least").alias("copy_of"), F.col("first.least").alias("class_id"), "group_size", (F.col("node") == F.col("first.node")).alias("is_first"))
    out = skew_join(table.select("id", "t1", "t2", "h1", "h2"), placed, ["h1", "h2"], "left")
    # rows without id or words are alone
    alone = F.col("class_id").isNull() | F.col("id").isNull()
    return out.select(
        "id",
        "t1",
        "t2",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (alone | (F.col("is_first") & (F.col("id") == F.col("class_id")))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = THRESHOLD, floor: float = FLOOR, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``key``, class_id (least id of its class), copy_of (least id with the same words), group_size, kept.

    With ``floor`` 0 every pair that shares a band is in one class or checked exactly.
    ``chunk`` bounds what a task holds of a bucket; it does not change the result.
    """
    return _classified(docs, key, column, threshold, floor, chunk).select(F.col("id").alias(key), "class_id", "copy_of", "group_size", "kept")


def deduplicate(docs: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = THRESHOLD, floor: float = FLOOR, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one document of each class.

    A row goes by its id and text together, so rows that share an id do not fall for one another.
    """
    drop = _classified(docs, key, column, threshold, floor, chunk).where(~F.col("kept"))
    drop = small_side(drop.select(F.col("id").alias("_drop_id"), F.col("t1").alias("_drop_t1"), F.col("t2").alias("_drop_t2")).distinct(), "drop")
    t1, t2 = text_marks(text_of(docs, column))
    return docs.join(drop, (docs[key].cast("long") == drop["_drop_id"]) & (t1 == drop["_drop_t1"]) & (t2 == drop["_drop_t2"]), "left_anti")
