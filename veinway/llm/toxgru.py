"""Toxicity by a bidirectional gated recurrent network with attention pooling, in NumPy.

A word enters as an embedding of the word, the mean embedding of its character n-grams
(both hashed, so any word has one) and the strongest of these by its first coordinate. Windows of ``WINDOW`` words, each overlapping the next,
cover the whole text; the network reads a window in both directions, attention pools its
states, and a document's score is that of its highest window, calibrated to the share of
toxic documents among the labelled ones.

The network is trained by backpropagation through time on a bounded sample: about
``SAMPLE_ROWS`` labelled documents of each class, chosen by a hash of id, none longer than
``SAMPLE_BYTES``. Each step trains on the documents' highest windows; embeddings start with
the log odds of a word or n-gram among toxic documents in one coordinate.

Cases: rows without a label do not train; without both classes in the sample every score is
the share of toxic labels (or 0); null or empty texts and texts without words score by one
empty window; repeated ids are separate rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import grams
from .shared import ship, text_of
from .textvec import pieces, span_hash, utf8, words

#: The bounds of the training sample: rows of each class, and bytes of the stretch that stands for a longer text.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 16
WINDOW, STRIDE = 32, 24
WORDS, GRAMS = 1 << 16, 1 << 18
GRAM_SIZES = (3, 4, 5)
D, H = 6, 8  # embedding width of each input, and state width of each direction
X = 2 * D + 1  # word, mean of n-grams, and the highest first coordinate of an n-gram


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_inputs(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of distinct words: word bucket, n-gram buckets, and the word of each n-gram."""
    found = [grams(data, start, end, n) for n in GRAM_SIZES]
    gram = np.concatenate([(g % np.uint64(GRAMS)).astype(np.int32) for g, _ in found])
    own = np.concatenate([w for _, w in found])
    order = np.argsort(own, kind="stable")
    return (h % np.uint64(WORDS)).astype(np.int32), gram[order], own[order]


def windows(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of every window; a document without words has one empty window."""
    count = np.diff(edge)
    n = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = edge[:-1][doc] + k * STRIDE
    return first, np.minimum(WINDOW, np.maximum(edge[1:][doc] - first, 0)), doc


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0  # calibration of a document's highest logit
    shift: float = 0.0

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.05, (WORDS, D)), "C": r.normal(0, 0.05, (GRAMS, D))}
        for side in "fb":
            p["W" + side] = r.normal(0, 0.4, (X, 3 * H))
            p["U" + side] = r.normal(0, 0.25, (H, 3 * H))
            p["b" + side] = np.zeros(3 * H)
        p |= {"A": r.normal(0, 0.3, (2 * H, H)), "a": np.zeros(H), "v": r.normal(0, 0.3, H), "o": r.normal(0, 0.3, 2 * H), "c": np.zeros(1)}
        return cls({k: x.astype(np.float32) for k, x in p.items()})

    def inputs(self, word: np.ndarray, gram: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(words, X) input vectors of distinct words."""
        out = np.zeros((len(word), X), np.float32)
        out[:, :D] = self.p["E"][word]
        if len(gram):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(np.append(first, len(own)))
            out[own[first], D : 2 * D] = np.add.reduceat(self.p["C"][gram], first, axis=0) / size[:, None]
            out[own[first], 2 * D] = np.maximum.reduceat(self.p["C"][gram, 0], first)
        return out

    def _direction(self, side: str, x: list[np.ndarray], mask: np.ndarray, tape: list | None) -> np.ndarray:
        """States (WINDOW, n, H) of one direction; x: projected inputs of each place."""
        u = self.p["U" + side]
        n = mask.shape[1]
        h, out = np.zeros((n, H), np.float32), np.zeros((WINDOW, n, H), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            a, hu = x[t], h @ u
            zr = sigmoid(a[:, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            hn = hu[:, 2 * H :]
            c = np.tanh(a[:, 2 * H :] + r * hn)
            step = (1 - z) * (c - h) * mask[t][:, None]
            if tape is not None:
                tape.append((t, h, z, r, hn, c))
            h = h + step
            out[t] = h
        return out

    def forward(self, vectors: np.ndarray, place: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; place (WINDOW, n): row of ``vectors`` at each place, mask (WINDOW, n): 0 past the end."""
        states = []
        for side in "fb":
            projected = vectors @ self.p["W" + side] + self.p["b" + side]
            own: list | None = [] if tape is not None else None
            states.append(self._direction(side, [projected[q] for q in place], mask, own))
            if tape is not None:
                tape[side] = own
        s = np.concatenate(states, axis=2)
        e = np.tanh(s @ self.p["A"] + self.p["a"])
        w = np.where(mask > 0, e @ self.p["v"], np.float32(-1e9))
        w = np.exp(w - w.max(0)) * (mask > 0)
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if tape is not None:
            tape |= {"s": s, "e": e, "w": w, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["c"][0]

    def backward(self, vectors: np.ndarray, place: np.ndarray, mask: np.ndarray, tape: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of ``vectors``; d: the loss's by the logits."""
        p, s, e, w = self.p, tape["s"], tape["e"], tape["w"]
        g = {k: np.zeros_like(x) for k, x in p.items() if k not in "EC"}
        g["o"], g["c"] = tape["pooled"].T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * p["o"]
        dw = np.einsum("nh,tnh->tn", dp, s)
        ds = w[:, :, None] * dp
        du = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tn,tnh->h", du, e)
        de = du[:, :, None] * p["v"] * (1 - e * e)
        g["A"], g["a"] = np.einsum("tnh,tnk->hk", s, de), de.sum((0, 1))
        ds = ds + de @ p["A"].T
        dv = np.zeros_like(vectors)
        order = np.argsort(place.ravel(), kind="stable")
        rows = place.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        for k, side in enumerate("fb"):
            u, dh = p["U" + side], np.zeros((len(d), H), np.float32)
            steps = np.zeros((WINDOW, len(d), 3 * H), np.float32)
            for t, h, z, r, hn, c in reversed(tape[side]):
                dh = dh + ds[t, :, k * H : (k + 1) * H]
                live = mask[t][:, None]
                dc = dh * (1 - z) * live * (1 - c * c)
                dz = dh * (h - c) * live * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                da = np.concatenate((dz, dr, dc), 1)
                dhu = np.concatenate((dz, dr, dc * r), 1)
                g["U" + side] += h.T @ dhu
                steps[t] = da
                dh = dh * (1 - (1 - z) * live) + dhu @ u.T
            dx = np.zeros((len(vectors), 3 * H), np.float32)
            dx[rows[first]] = np.add.reduceat(steps.reshape(-1, 3 * H)[order], first, axis=0)
            g["W" + side], g["b" + side] = vectors.T @ dx, dx.sum(0)
            dv += dx @ p["W" + side].T
        return g, dv

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window's logit of each document of a chunk."""
        start, end, edge = words(data, offsets)
        first, length, doc = windows(edge)
        if len(start):
            unique, at, inverse = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
            vectors = self.inputs(*word_inputs(data, start[at], end[at], unique))
        else:
            vectors, inverse = np.zeros((1, X), np.float32), np.zeros(1, np.int64)
        top = np.full(len(offsets) - 1, -np.inf)
        for i in range(0, len(first), 8192):
            place, mask = _places(first[i : i + 8192], length[i : i + 8192], inverse)
            np.maximum.at(top, doc[i : i + 8192], self.forward(vectors, place, mask).astype(float))
        return top

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(data, offsets) + self.shift)


def _places(first: np.ndarray, length: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)[:, None]
    mask = (t < length).astype(np.float32)
    return inverse[np.minimum(first + t, len(inverse) - 1)], mask


def _log_odds(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket from its counts in toxic and other documents."""
    both = t + n
    odds = np.log((t + 0.5) / (t.sum() + 1)) - np.log((n + 0.5) / (n.sum() + 1))
    return odds * np.maximum(both - 2, 0) / (both + 5)  # what few documents show is not trusted


def train(texts: list[str], toxic: np.ndarray, prior: float, steps: int = 240, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on whole documents with 0/1 labels; ``prior`` is the share of toxic documents to calibrate to."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    toxic = toxic.astype(bool)
    if toxic.all() or not toxic.any():
        net.p["o"][:] = 0
        net.shift = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        net.scale = 0.0
        return net
    data, offsets = utf8(pa.array(texts))
    start, end, edge = words(data, offsets)
    if not len(start):
        return train([], toxic[:0], prior)
    unique, at, inverse = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    word, gram, own = word_inputs(data, start[at], end[at], unique)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(edge))
    pair = np.unique(doc_of * len(unique) + inverse)
    d, w = pair // len(unique), pair % len(unique)
    net.p["E"][:, 0] = _log_odds(*(np.bincount(word[w[toxic[d] == bad]], minlength=WORDS) for bad in (True, False)))
    gram_edge = np.searchsorted(own, np.arange(len(unique) + 1))
    seen = np.zeros((2, GRAMS))
    for i in range(0, len(w), 1 << 16):  # the n-grams of all words of all documents, a part at a time
        part, bad = w[i : i + (1 << 16)], toxic[d[i : i + (1 << 16)]]
        for k, some in enumerate((part[~bad], part[bad])):
            size = np.diff(gram_edge)[some]
            flat = np.arange(int(size.sum())) + np.repeat(gram_edge[some] - (np.cumsum(size) - size), size)
            seen[k] += np.bincount(gram[flat], minlength=GRAMS)
    net.p["C"][:, 0] = _log_odds(seen[1], seen[0])
    first, length, doc = windows(edge)
    window_edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    vectors = net.inputs(word, gram, own)
    evidence = np.maximum(np.maximum(vectors[:, 0], vectors[:, 2 * D]), 0)
    run = np.concatenate(([0], np.cumsum(evidence[inverse] ** 2)))
    strength = run[np.minimum(first + length, len(inverse))] - run[np.minimum(first, len(inverse))]
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in net.p.items()}
    step = 0
    each = -(-(len(texts) + int((~toxic).sum())) // batch)  # steps to see every window chosen once
    epochs = max(6, -(-steps // each))
    for epoch in range(epochs):
        if epoch in (epochs // 3, 2 * epochs // 3):
            strength = _all_logits(net, word, gram, own, first, length, inverse)
        best = np.array([window_edge[k] + int(np.argmax(strength[window_edge[k] : window_edge[k + 1]])) for k in range(len(texts))])
        other = np.flatnonzero(~toxic)
        other = window_edge[other] + r.integers(0, np.diff(window_edge)[other])
        chosen = np.concatenate((best, other))
        target = np.concatenate((toxic, np.zeros(len(other), bool)))
        weight = np.concatenate((np.ones(len(best)), np.full(len(other), 0.5)))
        order = r.permutation(len(chosen))
        for i in range(0, len(order), batch):
            b = order[i : i + batch]
            place, mask = _places(first[chosen[b]], length[chosen[b]], inverse)
            some, local = np.unique(place, return_inverse=True)
            span = gram_edge[some + 1] - gram_edge[some]
            flat = np.arange(int(span.sum())) + np.repeat(gram_edge[some] - (np.cumsum(span) - span), span)
            mine = np.repeat(np.arange(len(some)), span)
            vectors, tape = net.inputs(word[some], gram[flat], mine), {}
            logit = net.forward(vectors, local.reshape(place.shape), mask, tape)
            d = ((sigmoid(logit) - target[b]) * weight[b] / len(b)).astype(np.float32)
            g, dv = net.backward(vectors, local.reshape(place.shape), mask, tape, d)
            step += 1
            rows = {"E": (word[some], dv[:, :D]), "C": (gram[flat], dv[mine, D : 2 * D] / np.maximum(span, 1)[mine, None])}
            for k, x in net.p.items():
                if k in rows:
                    at, value = rows[k]
                    order_at = np.argsort(at, kind="stable")
                    at = at[order_at]
                    lead = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    grad = np.add.reduceat(value[order_at], lead, axis=0)
                    x[at[lead]] -= 0.05 * rate * grad / (np.sqrt((grad * grad).mean()) + 1e-6)
                    continue
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] * g[k] - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, doc, _all_logits(net, word, gram, own, first, length, inverse))
    share = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    mean, spread = top.mean(), top.std() + 1e-6
    x = np.stack(((top - mean) / spread, np.ones(len(top))), 1)
    a, b = _logistic(x, toxic.astype(float), share)
    net.scale, net.shift = float(a / spread), float(b - a * mean / spread)
    return net


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    c = np.zeros(x.shape[1])
    for _ in range(50):
        q = sigmoid(x @ c)
        g = x.T @ ((q - y) * share) / len(y) + ridge * c
        h = (x.T * (q * (1 - q) * share)) @ x / len(y) + ridge * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return c


def _all_logits(net: Network, word, gram, own, first, length, inverse) -> np.ndarray:
    vectors = net.inputs(word, gram, own)
    return np.concatenate([net.forward(vectors, *_places(first[i : i + 8192], length[i : i + 8192], inverse)) for i in range(0, len(first), 8192)]).astype(float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, stretch: int = SAMPLE_BYTES, key: str = "doc_id", column: str = "text", label: str = "toxic") -> Network:
    """Train on about ``rows`` labelled documents of each class; ``labels`` must hold only rows that may be learnt from.

    Of a text of more than ``stretch`` characters, so many in a row are learnt from, at a place
    that its key decides; a toxic one is learnt from its most toxic window within them. Of
    rows that repeat an id one is learnt from, the text that sorts first.
    """
    known = labels.select(labels[key].cast("long").alias("key"), labels[label].cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)").distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(rows / max(1, sizes.get(1, 0)))).otherwise(F.lit(rows / max(1, sizes.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("key", F.lit(4)), F.lit(1 << 30)) / F.lit(1 << 30) < share)
    texts = docs.select(docs[key].cast("long").alias("key"), text_of(docs, column).alias("text"))
    # the chosen labels are bounded by twice ``rows``
    found = texts.join(F.broadcast(chosen), "key")
    over = F.char_length("text") - stretch
    found = found.withColumn("text", F.when(over > 0, F.substr("text", F.pmod(F.xxhash64("key", F.lit(5)), over + 1).cast("int") + 1, F.lit(stretch))).otherwise(F.col("text")))
    found = found.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("key", "text", "toxic").toArrow().sort_by([("key", "ascending"), ("text", "ascending"), ("toxic", "ascending")])
    total = sum(sizes.values())
    return train(found["text"].to_pylist(), np.array(found["toxic"].to_pylist(), int), sizes.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, network: Network, keep: list[Column], column: str = "text") -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted for every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(network)
    rows = docs.select(*keep, text_of(docs, column).alias("text"))
    kept = rows.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch, "text"):
                s = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(kept))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*(f.name for f in kept), "score", "predicted"])

    return rows.mapInArrow(run, schema)
