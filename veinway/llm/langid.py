"""Language identification: known words first, then ever shorter character n-grams.

The model has, for each language, the log frequency of words and of character n-grams (by code
points) of lower case words with their borders. A known word scores by its own log frequencies. An unseen
word scores by the mean over those of its n-grams of the longest size of which any is
known. A text's score is the sum over its words.

It is fitted on a bounded sample: about ``ROWS_PER_LANGUAGE`` rows of each language, chosen
by a hash of id and text among the rows with a language (rows that repeat both are one). Words seen once in the sample count as unseen.

Cases: a text that is null or has no letter is ``und`` with score 0; without any training
row all texts are ``und``; ties go to the language that sorts first; repeated ids are
separate rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small_side
from .shared import ship, text_of
from .textvec import _BYTE, _POS, mix, pieces, span_hash, words

#: The bound of the training sample.
ROWS_PER_LANGUAGE = 2000
LONGEST = 5
LEAST_COUNT = 2


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of characters of words with a space on either side, and the word of each."""
    length = end - start + 2
    edge = np.cumsum(length) - length
    total = int(length.sum())
    flat = np.full(total, 32, np.uint8)
    word = np.repeat(np.arange(len(start)), length)
    inner = np.ones(total, bool)
    inner[edge] = inner[edge + length - 1] = False
    flat[inner] = data[np.arange(int((end - start).sum())) + np.repeat(start - (edge - 2 * np.arange(len(start))), end - start)]
    # a character is a first byte of UTF-8 and those that continue it
    first = np.flatnonzero((flat & 0xC0) != 0x80)
    if len(first) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(first) == total:
        char = _BYTE[flat]
    else:
        within = np.arange(total) - np.repeat(first, np.diff(np.append(first, total)))
        char = np.add.reduceat(_BYTE[flat] * _POS[16 + within], first)
        char[flat[first] < 0x80] = _BYTE[flat[first][flat[first] < 0x80]]
    word = word[first]
    m = len(first) - n + 1
    value = np.zeros(m, np.uint64)
    for j in range(n):
        value += char[j : j + m] * _POS[j]
    fits = word[:m] == word[n - 1 :]
    return mix(value[fits] + np.uint64(n)), word[:m][fits]


@dataclass
class Model:
    """Languages, and by kind (0: words, n: n-grams) hashes in order with log frequencies (m, languages)."""

    languages: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def known(self, kind: int, h: np.ndarray) -> np.ndarray:
        keys = self.tables[kind][0]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(words, languages) log frequencies of distinct words."""
        out = np.zeros((len(start), len(self.languages)))
        at = self.known(0, h)
        out[at >= 0] = self.tables[0][1][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            gram, word = grams(data, start[left], end[left], n)
            at = self.known(n, gram)
            hit = at >= 0
            word, value = word[hit], self.tables[n][1][at[hit]]
            if len(word):
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                size = np.diff(np.append(first, len(word)))
                out[left[word[first]]] = np.add.reduceat(value, first, axis=0) / size[:, None]
                left = np.delete(left, word[first])
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each document's language, and its share of the likelihood."""
        n = len(offsets) - 1
        start, end, edge = words(data, offsets)
        total = np.zeros((n, len(self.languages)))
        if len(start):
            unique, first, inverse = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
            scores = self.word_scores(data, start[first], end[first], unique)
            run = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(scores[inverse], axis=0)))
            total = run[edge[1:]] - run[edge[:-1]]
        best = total.argmax(1)
        return best, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def training_sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, key: str = "doc_id", language: str = "lang", column: str = "text") -> DataFrame:
    """text and lang of about ``rows`` rows of each language, the same for the same ids."""
    known = docs.select(docs[key].cast("string").alias("id"), docs[language].cast("string").alias("lang"), text_of(docs, column).alias("text")).where("lang is not null")
    # a row for each language: narrow, and broadcast so that no text is dealt out by language
    sizes = small_side(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    part = F.pmod(F.xxhash64("id", "lang", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = known.join(sizes, "lang").where(part < F.lit(rows) / F.col("n")).select("id", "lang", "text").distinct()
    return chosen.select("lang", F.lower("text").alias("text"))


def fit(sample: DataFrame) -> Model:
    """Count words and n-grams of all sampled rows and take logs; the model is bounded by the sample.

    Of each language of the sample, those of words and n-grams that occur ``LEAST_COUNT`` times come to the driver.
    """
    ship(sample.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                names, code = np.unique(np.array(batch.column(0).slice(i, j - i).to_pylist(), dtype=object).astype(str), return_inverse=True)
                start, end, edge = words(data, offsets)
                if not len(start):
                    continue
                own = np.repeat(code, np.diff(edge))
                h = span_hash(data, start, end)
                for k, name in enumerate(names):
                    mine = own == k
                    if not mine.any():
                        continue
                    unique, first, number = np.unique(h[mine], return_index=True, return_counts=True)
                    a, b = start[mine][first], end[mine][first]
                    for kind in range(LONGEST + 1):
                        if kind:
                            gram, word = grams(data, a, b, kind)
                            value, inverse = np.unique(gram, return_inverse=True)
                            size = np.bincount(inverse, weights=number[word], minlength=len(value)).astype(np.int64)
                        else:
                            value, size = unique, number
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(value)), pa.array(np.full(len(value), kind, np.int32)), pa.array(value.view(np.int64)), pa.array(size.astype(np.int64))], ["lang", "kind", "h", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, kind int, h long, n long")
    # what is seen once in all languages never reaches the driver
    counted = counted.groupBy("kind", "h", "lang").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("kind", "h").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang")).where(F.col("total") >= LEAST_COUNT)
    found = counted.select("kind", "h", F.explode("by_lang").alias("x")).select("x.lang", "kind", "h", "x.n").toArrow()
    lang, kind, h, n = (np.asarray(found[c].combine_chunks()) if c != "lang" else np.array(found[c].to_pylist(), dtype=object) for c in ("lang", "kind", "h", "n"))
    languages = sorted({r["lang"] for r in sample.select("lang").distinct().collect()})
    place = {x: i for i, x in enumerate(languages)}
    code = np.array([place[x] for x in lang], np.int64)
    tables = {}
    for k in range(LONGEST + 1):
        mine = kind == k
        keys, at = np.unique(h[mine].view(np.uint64), return_inverse=True) if mine.any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts = np.zeros((len(keys), len(languages)))
        counts[at, code[mine]] = n[mine]
        tables[k] = keys, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(keys)))).astype(np.float32)
    return Model(languages, tables)


def predict(docs: DataFrame, model: Model, keep: list[Column], column: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score for every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.lower(text_of(docs, column)).alias("text"), F.coalesce(docs[column].cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kept = [f for f in rows.schema.fields if f.name not in ("text", "has_letter")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            letters = np.asarray(batch.column(len(kept) + 1))
            for i, j, data, offsets in pieces(batch, "text"):
                if model.languages:
                    best, score = model.predict(data, offsets)
                else:
                    best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                some = letters[i:j] & bool(model.languages)
                label = names[np.where(some, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(kept))), pa.array(label.tolist(), pa.string()), pa.array(np.where(some, score, 0.0))], [*(f.name for f in kept), "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
