"""Document quality by ordinal cumulative-link regression on hashed text.

Grades are ordered; one weight vector over hashed text features is shared by all of them,
and ordered thresholds cut its score: P(grade > g) = sigmoid(w.x - t_g). This gives the
expected grade and the tail probability that selection uses. Features are mean-pooled:
byte trigrams, and what stands at each word (the gap before it, its shape, whether it
repeats the word before). A text's score is a sum over the whole text, so it is computed
without building its vector.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE_ROWS``, chosen by
a hash of id and grade among those that differ; of documents that share an id one is learnt
from, the text that sorts first.

Cases: rows without a grade, or with one that is no number, do not train; with fewer than two grades every document gets
the one grade (or 0) and is kept; a null or empty text has no features and scores by the
thresholds alone; repeated ids are separate rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, text_of
from .textvec import pieces, span_hash, words

#: The bound of the training sample.
SAMPLE_ROWS = 4000
TRIGRAMS, AT_WORDS = 1 << 13, 1 << 12
WIDTH = TRIGRAMS + AT_WORDS


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By family, the hashed feature at each place and its offsets per document (n + 1)."""
    n = len(offsets) - 1
    if len(data) < 3:
        return [(np.zeros(0, np.int64), np.zeros(n + 1, np.int64))] * 2
    code = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
    tri = (code * np.uint32(0x9E3779B1) >> np.uint32(19)).astype(np.int64)
    doc_end = offsets[1:]
    keep = np.ones(len(tri), bool)
    for back in (1, 2):
        cut = doc_end - back
        keep[cut[(cut >= 0) & (cut < len(tri))]] = False
    edge = np.concatenate(([0], np.cumsum(keep)))[np.minimum(offsets, len(tri))]
    start, end, at = words(data, offsets)
    h = span_hash(data, start, end)
    gap_from = np.concatenate(([0], end[:-1])) if len(end) else end
    first = at[:-1][np.diff(at) > 0]
    gap_from[first] = offsets[:-1][np.diff(at) > 0]
    gap = np.zeros(len(start), np.uint64)
    some = gap_from < start
    gap[some] = span_hash(data, gap_from[some], start[some], lower=False)
    repeats = np.zeros(len(start), bool)
    repeats[1:] = h[1:] == h[:-1]
    repeats[first] = False
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    caps = upper[end] - upper[start]
    shape = np.minimum(end - start, 15) + 16 * (caps == end - start) + 32 * (caps == 1)
    spot = AT_WORDS // 4
    kinds = [np.where(repeats, 0, 1), 2 + shape, spot + (gap % np.uint64(3 * spot)).astype(np.int64)]
    words_at = np.stack(kinds, 1).ravel() + TRIGRAMS if len(start) else np.zeros(0, np.int64)
    return [(tri[keep], edge), (words_at, at * 3)]


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, grades - 1): the probability of a grade above each but the last."""
        score = np.zeros(len(offsets) - 1)
        for place, edge in features(data, offsets):
            run = np.concatenate(([0.0], np.cumsum(self.weights[place], dtype=np.float64)))
            score += (run[edge[1:]] - run[edge[:-1]]) / np.maximum(np.diff(edge), 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, steps: int = 150, rate: float = 1.0, decay: float = 1e-5) -> Model:
    """Maximum likelihood by Adam over all rows (feature numbers, values) at once."""
    grades = sorted(set(grade.tolist()))
    level = np.searchsorted(grades, grade)
    k = len(grades)
    if k < 2:
        return Model(grades or [0.0], np.zeros(WIDTH), np.zeros(0))
    place = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    own = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    above = (level[:, None] > np.arange(k - 1)[None, :]).mean(0)
    start = -np.log(above / (1 - above))
    # w, first threshold, logs of the gaps
    p = np.concatenate((np.zeros(WIDTH), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)

    def cuts() -> np.ndarray:
        return np.concatenate(([p[WIDTH]], p[WIDTH] + np.cumsum(np.exp(p[WIDTH + 1 :]))))

    for t in range(1, steps + 1):
        score = np.bincount(own, weights=value * p[place], minlength=len(rows))
        edge = np.concatenate(([-np.inf], cuts(), [np.inf]))
        low, high = (1 / (1 + np.exp(np.clip(score - edge[level + s], -500, 500))) for s in (0, 1))  # P(grade <= ...)
        chance = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        g_score = (d_high - d_low) / chance / len(rows)
        g_cut = np.zeros(k + 1)
        np.add.at(g_cut, level + 1, -d_high / chance / len(rows))
        np.add.at(g_cut, level, d_low / chance / len(rows))
        g_cut = g_cut[1:-1]
        later = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate((np.bincount(place, weights=value * g_score[own], minlength=WIDTH) + decay * p[:WIDTH], [later[0]], later[1:] * np.exp(p[WIDTH + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = np.concatenate((np.full(WIDTH, rate), np.full(k - 1, 0.05)))
        p -= scale * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(grades, p[:WIDTH].astype(np.float32), cuts())


def fit(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", column: str = "text", grade: str = "quality") -> Model:
    """Fit on about ``rows`` rated documents. Their features, not their texts, come to the driver."""
    spark = docs.sparkSession
    ship(spark)
    rated = ratings.select(ratings[key].cast("long").alias("key"), ratings[grade].cast("double").alias("grade")).where("key is not null and grade is not null and not isnan(grade)").distinct()
    share = rows / max(1, rated.count())
    chosen = rated.where(F.pmod(F.xxhash64("key", "grade"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    texts = docs.select(docs[key].cast("long").alias("key"), text_of(docs, column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                family = features(data, offsets)
                out = []
                for d in range(j - i):
                    places, values = [], []
                    for place, edge in family:
                        own = place[edge[d] : edge[d + 1]]
                        unique, number = np.unique(own, return_counts=True)
                        places.append(unique)
                        values.append(number / max(1, len(own)))
                    out.append((np.concatenate(places).astype("<u2").tobytes(), np.concatenate(values).astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["grade", "place", "value"])

    # the chosen ratings are bounded by ``rows``
    found = texts.join(F.broadcast(chosen), "key").groupBy("key", "grade").agg(F.min("text").alias("text")).select("grade", "text").mapInArrow(run, "grade double, place binary, value binary").toArrow()
    sparse = [(np.frombuffer(a, "<u2"), np.frombuffer(b, "<f4")) for a, b in zip(found["place"].to_pylist(), found["value"].to_pylist(), strict=True)]
    return train(sparse, np.array(found["grade"].to_pylist(), float))


def score(docs: DataFrame, model: Model, least: float | None = None, cut: float = 0.5, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: ``key``, expected_grade, tail_probability of at least the grade ``least`` (default: the second), kept."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    above = 0 if least is None else max(0, int(np.searchsorted(model.grades, least)) - 1)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        step = np.diff(model.grades)
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                tails = model.tails(data, offsets)
                expected = model.grades[0] + tails @ step
                tail = tails[:, above] if tails.shape[1] else np.ones(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(expected), pa.array(tail), pa.array(tail >= cut)], [key, "expected_grade", "tail_probability", "kept"])

    return docs.select(docs[key], text_of(docs, column).alias("text")).mapInArrow(run, f"`{key}` {kind}, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model, least: float | None = None, cut: float = 0.5, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes: decided row by row, without a join."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    above = 0 if least is None else max(0, int(np.searchsorted(model.grades, least)) - 1)
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], ["text"])
            for i, j, data, offsets in pieces(named, "text"):
                tails = shared.value.tails(data, offsets)
                keep = tails[:, above] >= cut if tails.shape[1] else np.ones(j - i, bool)
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
