"""BPE against the tokenizers library, and token shards."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veinway.llm import bpe, tokenbin, warcz
from veinway.llm.queries import vocabulary_path
from veinway.llm.textvec import pieces

PARTS = ["a", "the", "'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", " ", "é", "ß", "中", "1", "23", "½", "!", "...", "　", "😀", "\x1c", "​", "<|endoftext|>", "aaaa", "ll", "́", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    return [*out, "", "a" * 1000, "ab" * 2000 + "x", "é" * 400, "the of " * 40_000, "<|endoftext|>", "<|endoftext"]


def ids(encoder, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = []
    for i, j, data, offsets in pieces(batch, "text"):
        flat, edge = encoder(data, offsets)
        out += [flat[edge[k] : edge[k + 1]].tolist() for k in range(j - i)]
    return out


@pytest.mark.parametrize("lexicon", [False, True])
def test_ids_equal_the_library(library, texts, lexicon):
    v = bpe.load_vocabulary(vocabulary_path())
    image = None
    if lexicon:
        words = [" the", "the", "...", " of", "\n", "aaaa", "é", " a"]
        image = bpe.compile_lexicon({w.encode(): library.encode(w, add_special_tokens=False).ids for w in words})
    got = ids(bpe.Encoder(v, image), texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for g in got:
        assert bpe.decode(v, np.array(g, np.int64)).decode() == library.decode(g, skip_special_tokens=False)


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    import json

    spec = json.load(open(vocabulary_path()))
    changes = [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True}), ("model", spec["model"] | {"ignore_merges": True}), ("added_tokens", [spec["added_tokens"][0] | {"lstrip": True}])]
    for key, value in changes:
        (tmp_path / "t.json").write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError, match="not supported"):
            bpe.load_vocabulary(str(tmp_path / "t.json"))


def test_texts_longer_than_a_chunk_are_whole(library):
    r = random.Random(3)
    text = "".join(r.choice(["the ", "of\n", "é", "zebra ", "  "]) for _ in range(400_000))
    assert len(text.encode()) > 1 << 20
    assert ids(bpe.Encoder(bpe.load_vocabulary(vocabulary_path())), ["a", text, "b"])[1] == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_like_short_ones():
    v = bpe.load_vocabulary(vocabulary_path())
    r = random.Random(1)
    for n in (1, 2, 7, 90):
        word = "".join(r.choice("abehnrstou") for _ in range(n)).encode()
        data = np.frombuffer(word, np.uint8)
        flat, count = bpe.merge(v, data, np.array([0]), np.array([n]))
        assert flat.tolist() == bpe.merge_long(v, word).tolist() and count.tolist() == [len(flat)]


def test_automaton_is_a_minimal_map():
    words = sorted({"".join(p) for p in __import__("itertools").product("abc", repeat=3)} | {"", "a", "ab", "xyzabc", "qrsabc"})
    entries = {w.encode(): [i, i + 1] for i, w in enumerate(words)}
    lexicon = bpe.Lexicon.mapped(bpe.compile_lexicon(entries))
    probe = [*[w for w in words if w], "abcd", "zz", "xy", "b"]
    data = np.frombuffer("".join(probe).encode(), np.uint8)
    end = np.cumsum([len(w) for w in probe])
    rank = lexicon.find(data, end - np.array([len(w) for w in probe]), end)
    known = [w for w in words if w]
    for w, r in zip(probe, rank.tolist(), strict=True):
        if w in known:
            assert lexicon.ids[lexicon.start[r] : lexicon.start[r + 1]].tolist() == entries[w.encode()]
        else:
            assert r == -1
    assert len(lexicon.final) < len({w[:i] for w in known for i in range(len(w) + 1)})  # fewer states than a trie


ROWS = [(3, "a b"), (None, "x"), (1, None), (2, ""), (2, "the end"), (5, "the of " * 30_000), (9, "<|endoftext|>é")]
SCHEMA = "doc_id long, text string, ids string, n_tokens string, start string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "ids", "clash", "start") for r in rows], SCHEMA)


def test_encode_decode_of_odd_rows(spark, library):
    out = bpe.encode_decode(docs(spark, ROWS), vocabulary_path()).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ROWS)
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out)
    assert got == want and all(r.n_tokens == len(r.ids) // 4 for r in out)
    digest = bpe.encode_decode(docs(spark, ROWS), vocabulary_path(), digests=True).collect()
    assert sorted(r.ids_sha256 for r in digest) == sorted(hashlib.sha256(r.ids).hexdigest() for r in out)
    assert sorted(r.decoded_sha256 for r in digest) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, _, t in want)
    assert bpe.encode_decode(docs(spark, []), vocabulary_path()).count() == 0


def test_frequent_words_count_all_rows(spark):
    rows = [(i, "of the the") for i in range(30)] + [(99, "zebra of")]
    got = {bytes(r.word).decode(): r.n for r in bpe.frequent_words(docs(spark, rows), 3).collect()}
    assert got == {" the": 60, "of": 30}  # two words that occur once do not both fit
    assert bpe.frequent_words(docs(spark, rows), 4).count() == 4 and bpe.frequent_words(docs(spark, []), 4).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 40), 1 << 40, 5000))
    for some in (keys, keys[:1], keys[:0]):
        assert sorted(tokenbin.PerfectHash.build(some).slots(some).tolist()) == list(range(len(some)))


def test_token_shards(spark, library, tmp_path):
    rows = [*ROWS, *[(i, f"text {i}") for i in range(100, 160)]]
    store = tokenbin.write_tokens(docs(spark, rows), vocabulary_path(), end_id=2, path=f"file://{tmp_path}/shards", shards=3)
    want = sorted(((-1 if i is None else i), t or "", library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    got = sorted(tokenbin.read_tokens(spark, store).collect(), key=lambda r: r.start)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [w[2] for w in want]
    assert [r.start for r in got] == np.cumsum([0, *[len(w[2]) for w in want]])[:-1].tolist()
    assert [r.doc_id for r in got] == [None if w[0] == -1 else w[0] for w in want]
    crc = {r.start: r.ids_crc32 for r in tokenbin.read_tokens(spark, store, digests=True).collect()}
    assert all(crc[r.start] == zlib.crc32(r.ids) for r in got)
    assert store.get(120).tolist() == [w[2] for w in want if w[0] == 120][0] and store.get(121_000) is None and store.get(4) is None
    assert store.get(2).tolist() == [2]  # the first of rows that share a key
    empty = tokenbin.write_tokens(docs(spark, []), vocabulary_path())
    assert empty.shards == [] and tokenbin.read_tokens(spark, empty).count() == 0 and empty.get(1) is None


def shard_of(tmp_path, keys):
    writer = tokenbin.Writer(f"file://{tmp_path}/one.vwt", np.dtype("<u2"))
    sizes = np.arange(len(keys)) % 3 + 1
    writer.add(keys, np.ones(len(keys), bool), np.repeat(np.arange(len(keys)) % 60_000, sizes), sizes)
    writer.close()
    return f"{tmp_path}/one.vwt", sizes


@pytest.mark.parametrize("n", [100, 200_000])
def test_lookup_reads_its_own_part_only(tmp_path, n):
    keys = np.arange(n) * 7
    path, sizes = shard_of(tmp_path, keys)
    for k in (0, n // 2, n - 1):
        shard = tokenbin.Shard(path)
        opened = shard.read
        assert shard.get(int(keys[k])).tolist() == [k % 60_000] * int(sizes[k])
        assert opened < 2500 and shard.read - opened <= 64 * (len(shard.sizes)) + 8 + 16 + 6
    shard = tokenbin.Shard(path)
    found = [shard.get(int(k)) for k in range(1, 700, 7)]
    assert found == [None] * 100 and shard.read < 2500 + 100 * (64 * len(shard.sizes) + 24)


def test_results_come_through_the_index(spark, tmp_path):
    store = tokenbin.write_tokens(docs(spark, [(i, f"text number {i}") for i in range(50)]), vocabulary_path(), path=f"file://{tmp_path}/s", shards=1)
    path = store.shards[0]["path"].removeprefix("file://")
    at, _, _ = tokenbin.Shard(path).blocks["slots"]
    raw = bytearray(open(path, "rb").read())
    good = tokenbin.read_tokens(spark, store, digests=True).toPandas().set_index("doc_id")
    raw[at + 8 : at + 16], raw[at + 24 : at + 32] = raw[at + 24 : at + 32], raw[at + 8 : at + 16]  # two slots change their places
    open(path, "wb").write(raw)
    bad = tokenbin.read_tokens(spark, store, digests=True).toPandas().set_index("doc_id")
    assert (good.ids_crc32 != bad.ids_crc32).sum() == 2
    raw[at] ^= 1  # a fingerprint
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="does not hold a key"):
        tokenbin.read_tokens(spark, store).collect()


def test_many_shards_are_found_by_bisection(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "SHARD_BYTES", 100)
    store = tokenbin.write_tokens(docs(spark, [(i, f"text number {i}") for i in range(0, 400, 2)]), vocabulary_path(), path=f"file://{tmp_path}/s")
    assert len(store.shards) > 20
    opened = []
    monkeypatch.setattr(tokenbin.Shard, "__init__", lambda self, uri, f=tokenbin.Shard.__init__: (opened.append(uri), f(self, uri))[1])
    assert store.get(124) is not None and store.get(125) is None and store.get(-1) is None and store.get(999) is None
    assert len(opened) <= 2


PAGES = [(1, "http://a", "same"), (7, "http://b", "same"), (3, None, "same"), (4, "http://c\r\nX: y", None), (8, "http://d", ""), (5, "http://e", "é" * 300_000), (None, "http://f", "same"), (None, "u", "only"), (7, "http://b", "same"), (6, "u", "x\r\n\r\ny"), (0, "", "zero"), (-3, "http://é/%41 %zz\n%0A\u2028", "odd"), (-3, "http://a%20b", "other")]


def test_warc_bundles(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    paths = warcz.write_bundles(pages, path=f"file://{tmp_path}/warc")
    got = warcz.read_bundles(spark, paths, payloads=True).collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in PAGES:
        raw, top = (h or "").encode(), best[h or ""]
        revisit = top >= 0 and i != top
        want.append((str(i), u, "revisit" if revisit else "response", top if revisit else None, warcz.payload_digest(raw), len(raw), None if revisit else raw))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    import zstandard

    total = 0
    for p in paths:
        bundle = warcz.Bundle(p)
        raw = open(p.removeprefix("file://"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain == b"".join(bundle.frame(k) for k in range(len(bundle.packed) - 1))
        total += plain.count(b"WARC/1.1\r\n")
        for known, k, *_ in bundle.index.tolist():
            assert not known or bundle.get(k)["page_id"] == k
        key_of = lambda r: (str(r["page_id"]), str(r["url"]), r["payload_digest"])
        assert sorted(map(key_of, bundle.records())) == sorted(map(key_of, bundle.scan()))
        assert bundle.get(10_000) is None
    assert total == len(PAGES)
    none = warcz.write_bundles(pages.where("page_id = 99"))
    assert none == [] and warcz.read_bundles(spark, none).count() == 0


def test_records_come_through_the_index(tmp_path):
    writer = warcz.Writer(f"file://{tmp_path}/one.warc.zst")
    for k in range(5):
        writer.add(k, warcz.record(k, None, b"x" * (k + 1), None, "2024-01-01T00:00:00Z"))
    writer.index[1], writer.index[3] = (*writer.index[1][:2], *writer.index[3][2:]), (*writer.index[3][:2], *writer.index[1][2:])
    writer.close()
    bundle = warcz.Bundle(f"{tmp_path}/one.warc.zst")
    assert [r["payload_bytes"] for r in bundle.scan()] == [1, 2, 3, 4, 5]
    assert bundle.get(1)["payload_bytes"] == 4
    with pytest.raises(ValueError, match="differ"):
        list(bundle.records())


def test_pages_are_not_dealt_out(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    plan = warcz.with_revisits(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_small_payloads_can_be_left_out_of_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warcz.with_revisits(pages, least_bytes=5).collect()
    assert all(r.refers_to is None for r in rows)
