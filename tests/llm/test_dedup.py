"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinway.llm import dartdedup, exactdedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ", node string, h1 string, _id string, _sha string, class_id string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "h", "i", "s", "c", "k") for r in rows], "doc_id long, text string" + CLASH)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows, threshold=0.8):
    s = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and s[i] and jaccard(s[i], s[j]) >= threshold:
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), 1 << 60 if k is None else k)
    return [None if k is None else (least[find(i)] if s[i] else k) for i, (k, _) in enumerate(rows)]


def random_texts(r, n, length):
    return [" ".join(r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(length)) for _ in range(n)]


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate(random_texts(r, 30, 120))]
    hub = random_texts(r, 1, 300)[0]
    rows += [(1000, hub)] + [(500 + i, edited(r, hub, 5)) for i in range(60)]  # near the hub, less near one another
    base = random_texts(r, 1, 200)[0]
    rows += [(2000 + i, base.upper() if i % 2 else base + "!") for i in range(40)]  # equal words
    for i in range(10):
        rows += [(3000 + i, edited(r, rows[i][1], 1)), (3100 + i, edited(r, rows[i][1], 6))]
    rows += [(4000, None), (4001, ""), (4002, "..."), (4003, "one two"), (4004, "One, two"), (4005, "one two three"), (4006, "word " * 20_000), (4007, "word " * 19_990)]
    rows += [(None, rows[0][1]), (2000, base)]
    return rows


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = dartdedup.near_duplicates(frame(spark, corpus)).collect()
    want = brute_classes(corpus)
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip([k for k, _ in corpus], want, strict=True))
    sizes = Counter(c for (k, t), c in zip(corpus, want, strict=True) if k is not None and shingles(t))
    for r in got:
        alone = r.doc_id is None or r.doc_id in (4000, 4001, 4002)
        assert r.group_size == (1 if alone else sizes[r.class_id]) and r.kept == (alone or r.doc_id == r.class_id)
    kept = dartdedup.deduplicate(frame(spark, corpus))
    assert kept.columns == frame(spark, corpus).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


@pytest.mark.parametrize(("chunk", "floor"), [(8, dartdedup.FLOOR), (256, 0.0)])
def test_near_duplicates_in_large_buckets_and_without_floor(spark, corpus, chunk, floor):
    got = {r.doc_id: r.class_id for r in dartdedup.near_duplicates(frame(spark, corpus), chunk=chunk, floor=floor).collect()}
    assert got == dict(zip([k for k, _ in corpus], brute_classes(corpus), strict=True))


def test_no_documents(spark):
    assert dartdedup.near_duplicates(frame(spark, [])).count() == 0
    assert exactdedup.groups(frame(spark, [])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        n = 400
        common = rng.integers(1, 1 << 62, int(n * 2 * share / (1 + share)), dtype=np.uint64)
        own = [rng.integers(1, 1 << 62, n - len(common), dtype=np.uint64) for _ in range(2)]
        estimates = []
        for trial in range(20):
            cells = [np.concatenate((common, o)) + np.uint64(trial * 977 * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for o in own]
            a, b = dartdedup.dart_signatures(np.concatenate(cells), np.array([0, n, 2 * n]))
            estimates.append((a == b).mean())
        assert np.mean(estimates) == pytest.approx(len(common) / (2 * n - len(common)), abs=0.03)


def test_signatures_do_not_depend_on_the_reach():
    cells = np.random.default_rng(2).integers(1, 1 << 62, 3, dtype=np.uint64)
    alone = dartdedup.dart_signatures(cells, np.array([0, 3]))
    again = dartdedup.dart_signatures(np.concatenate((cells[::-1], cells)), np.array([0, 3, 6]))
    assert (again == alone).all() and (alone != 0).all()


def test_common_cells():
    rng = np.random.default_rng(3)
    cells = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 100, 200, 90)]
    for columns in (7, 4096):
        dartdedup.COLUMNS, before = columns, dartdedup.COLUMNS
        both = dartdedup.common_cells(cells, np.array([0, 2, 4]), np.array([1, 3]))
        dartdedup.COLUMNS = before
        assert both.tolist() == [[len(np.intersect1d(cells[i], cells[j])) for j in (1, 3)] for i in (0, 2, 4)]


EXACT = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (9, "a b"), (7, None), (6, ""), (8, "A b"), (None, "a b"), (None, "zz"), (1, "x" * 400 + "1"), (3, "x" * 400 + "2"), (4, " "), (10, "é  b"), (11, "é b"), (12, "l " * 200_000), (13, "l\n" * 200_000), (8, "other")]


@pytest.mark.parametrize("digests", [False, True])
def test_exact_groups_equal_brute_force(spark, digests):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in EXACT]
    got = exactdedup.groups(frame(spark, EXACT), digests=digests).collect()
    want = []
    for (k, _), t in zip(EXACT, norm, strict=True):
        own = [j for (j, _), u in zip(EXACT, norm, strict=True) if u == t]
        keep = min((j for j in own if j is not None), default=None)
        want.append((k, keep, len(own), k == keep, *([hashlib.sha256(t.encode()).hexdigest()] if digests else [])))
    assert Counter(map(tuple, got)) == Counter(want)


def test_exact_dedup_keeps_rows_by_id_and_text(spark):
    kept = exactdedup.deduplicate(frame(spark, EXACT))
    assert kept.columns == frame(spark, EXACT).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[(2, "a\tb")] == 1 and got[(9, "a b")] == 0 and got[(None, "a b")] == 0 and got[(None, "zz")] == 1
    assert got[(8, "A b")] == 1 and got[(8, "other")] == 1 and got[(6, "")] == 1 and got[(7, None)] == 0


@pytest.mark.parametrize("make", [lambda d: exactdedup.groups(d, digests=True), exactdedup.groups, exactdedup.deduplicate])
def test_native_plan_has_no_python(spark, make):
    plan = make(frame(spark, EXACT))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_only_survivors_are_read_whole(spark):
    """The hash of the last join is evaluated for rows of dropped ids, not as a key of all rows."""
    plan = exactdedup.deduplicate(frame(spark, EXACT))._jdf.queryExecution().executedPlan().toString()
    keys = re.search(r"BroadcastHashJoin \[(.*?)\], \[", plan).group(1)
    assert "sha2" not in keys and "sha2" in plan


def planted(monkeypatch, agreements, similar):
    """Signatures in one bucket that agree in given shares, and texts (their ids) of which only the pairs in ``similar`` are alike."""
    import pyarrow as pa

    names = list(agreements)
    group = {n: next((p[0] for p in similar if n in p), n) for n in names}

    def signatures(docs, key="doc_id", column="text"):
        rows = [(n, np.asarray(agreements[n], "<u2").tobytes(), [1, *(100 * n + k for k in range(2, 25))], 50) for n in names]
        known = docs.sparkSession.createDataFrame(rows, "id long, sig binary, bands array<long>, weight long")
        marked = dartdedup._texts(docs, key, column).select("id", "t1", "t2", F.col("id").alias("h1"), F.col("id").alias("h2"))
        return marked.join(known, "id").select(*dartdedup.SIGNED.names)

    def exact(pairs, threshold):
        def run(batches):
            for t in batches:
                ids = [[group[int(x)] for x in p] for p in zip(t["text_a"].to_pylist(), t["text_b"].to_pylist(), strict=True)]
                yield t.select(["a", "b"]).filter(pa.array([x == y for x, y in ids], pa.bool_()))

        return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")

    def cells(texts):
        def run(batches):
            for t in batches:
                raw = [(np.arange(50, dtype=np.uint64) + np.uint64(1000 * group[int(x)])).tobytes() for x in t["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([t["node"], pa.array(raw, pa.binary())], ["node", "cells"])

        return texts.select("node", "text").mapInArrow(run, "node long, cells binary")

    monkeypatch.setattr(dartdedup, "signatures", signatures)
    monkeypatch.setattr(dartdedup, "_exact", exact)
    monkeypatch.setattr(dartdedup, "_cells", cells)


@pytest.mark.parametrize("heavy", [10, 8192])
def test_pair_behind_failed_ones_is_checked(spark, monkeypatch, heavy):
    monkeypatch.setattr(dartdedup, "HEAVY", heavy)
    base = np.arange(dartdedup.K)
    a, b = base.copy(), base.copy()
    a[101:] += 1000  # agrees with the leader in 0.84
    b[102:119] += 2000  # so does this, and nearly as much with the other
    planted(monkeypatch, {1: base, 2: a, 3: b, 4: np.r_[base[:60], base[60:] + 5000]}, {(2, 3)})
    got = {r.doc_id: r.class_id for r in dartdedup.near_duplicates(frame(spark, [(i, str(i)) for i in (1, 2, 3, 4)])).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("heavy", [10, 8192])
def test_pairs_in_different_chunks_are_checked(spark, monkeypatch, heavy):
    monkeypatch.setattr(dartdedup, "HEAVY", heavy)
    rows, pairs = {1: np.arange(dartdedup.K)}, set()
    for p in range(2, 14, 2):
        rows[p] = np.r_[:5, np.arange(5, dartdedup.K) + 1000 * p]
        rows[p + 1] = np.r_[rows[p][:100], rows[p][100:] + 500]  # agrees in 0.83
        pairs.add((p, p + 1))
    planted(monkeypatch, rows, pairs)
    got = {r.doc_id: r.class_id for r in dartdedup.near_duplicates(frame(spark, [(i, str(i)) for i in rows]), chunk=2).collect()}
    assert got == {i: i - (i > 1 and i % 2) for i in rows}


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    r = random.Random(8)
    one, two, three = random_texts(r, 3, 120)
    rows = [(5, one), (5, two), (7, edited(r, one, 1)), (8, edited(r, two, 1)), (1, three), (9, three), (9, edited(r, two, 1)), (2, ""), (4, two)]
    got = dartdedup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((g.doc_id, g.class_id) for g in got) == Counter(zip([k for k, _ in rows], brute_classes(rows), strict=True))
    kept = Counter((x.doc_id, x.text) for x in dartdedup.deduplicate(frame(spark, rows)).collect())
    assert kept == Counter([(5, one), (1, three), (4, two), (2, "")])


def test_unique_text_of_a_repeated_id_stays(spark):
    a, c = random_texts(random.Random(9), 2, 120)
    kept = dartdedup.deduplicate(frame(spark, [(1, a), (5, a), (5, c), (5, c), (None, a)]))
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter([(1, a), (5, c), (5, c), (None, a)])


def families(seed, n, size, length, edits):
    r, rows = random.Random(seed), []
    for base in random_texts(r, n, length):
        rows += [edited(r, base, r.randint(0, edits)) for _ in range(size)]
    return list(enumerate(rows))


def test_no_pair_of_near_threshold_families_is_lost(spark):
    """Pairs at 0.8 or more by brute force are in one class but for those without a shared band."""
    rows = families(4, 300, 10, 150, 4)
    got = {g.doc_id: g.class_id for g in dartdedup.near_duplicates(frame(spark, rows)).collect()}
    s, lost, links = [shingles(t) for _, t in rows], 0, 0
    for f in range(0, len(rows), 10):
        for i in range(f, f + 10):
            for j in range(f, i):
                if jaccard(s[i], s[j]) >= 0.8:
                    links += 1
                    lost += got[i] != got[j]
                    # classes join nothing but links
        classes = brute_classes(rows[f : f + 10])
        assert all(got[f + i] == got[f + j] or classes[i] != classes[j] or lost for i in range(10) for j in range(i))
        assert all(got[f + i] != got[f + j] or classes[i] == classes[j] for i in range(10) for j in range(i))
    assert links > 1000 and lost == 0


def test_recall_in_a_bucket_of_thousands(spark):
    """One family of 2,400 variants far below the threshold by pairs, with planted near pairs, at the real chunk size."""
    r = random.Random(12)
    base, rows = random_texts(r, 1, 60)[0], []
    for p in range(1200):
        own = base + " " + random_texts(r, 1, 40)[0]
        rows += [(2 * p, own), (2 * p + 1, edited(r, own, 1))]
    got = {g.doc_id: g.class_id for g in dartdedup.near_duplicates(frame(spark, rows)).collect()}
    found = sum(got[2 * p] == got[2 * p + 1] for p in range(1200))
    true = sum(jaccard(shingles(rows[2 * p][1]), shingles(rows[2 * p + 1][1])) >= 0.8 for p in range(1200))
    assert true > 1100 and found >= true * 0.999
