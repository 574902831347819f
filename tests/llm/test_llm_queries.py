"""The registered queries on whole tables, against DuckDB, the tokenizers library and plain Python."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import values
from test_dedup import brute_classes
from tokenizers import Tokenizer

from veinway.llm import queries

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def little(ids):
    return np.asarray(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and values(ours) == values(theirs)


def test_sql_of_chat_takes_rows_without_a_conversation_apart(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", None), (4, 1, "gpt", "x:y"), (4, None, "assistant", "#<")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    ours = [r.asDict() for r in queries.op9_chat_format(spark, str(tmp_path)).collect()]
    cursor = con.execute(queries.OP9)
    theirs = [dict(zip([d[0] for d in cursor.description], row, strict=True)) for row in cursor.fetchall()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, ours)) == sorted(map(key, theirs)) and len(ours) == 5


def test_token_queries_equal_the_library(spark):
    library = Tokenizer.from_file(queries.vocabulary_path())
    docs = read("documents").sort_values("doc_id")
    ids = [e.ids for e in library.encode_batch([t or "" for t in docs.text], add_special_tokens=False)]
    got = queries.op2_token_shards(spark, SF).toPandas().sort_values("start")
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_tokens.tolist() == [len(i) + 1 for i in ids]
    assert got.start.tolist() == np.cumsum([0, *(len(i) + 1 for i in ids)])[:-1].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(little([*i, 2])) for i in ids]
    got = queries.op10_bpe_round_trip(spark, SF).toPandas().sort_values("doc_id")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert got.n_tokens.tolist() == [len(i) for i in ids] and got.ids_sha256.tolist() == [sha(little(i)) for i in ids]
    assert got.decoded_sha256.tolist() == [sha(library.decode(i, skip_special_tokens=False).encode()) for i in ids]


def test_warc_query_equals_plain_python(spark):
    pages = read("pages")
    top = pages.page_id.groupby(pages.html.fillna("")).max()
    got = queries.op3_warc_bundles(spark, SF).toPandas().set_index("page_id")
    assert sorted(got.index) == sorted(pages.page_id)
    for p in pages.itertuples():
        raw, r = (p.html or "").encode(), got.loc[p.page_id]
        best = int(top[p.html or ""])
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.record_type == ("response" if best == p.page_id else "revisit") and (pd.isna(r.refers_to) if best == p.page_id else r.refers_to == best)


def test_near_query_equals_brute_force(spark):
    docs = read("documents")
    rows = list(zip(docs.doc_id.tolist(), docs.text, strict=True))
    got = {r.doc_id: r.class_id for r in queries.op5_near_dedup(spark, SF).collect()}
    assert got == dict(zip(docs.doc_id.tolist(), brute_classes(rows), strict=True))


@pytest.mark.parametrize(("name", "columns", "mod"), [("op1_quality_classifier", {"expected_grade", "tail_probability"}, None), ("op4_toxicity", {"held_out", "score", "predicted"}, (5, 0)), ("op7_language_id", {"held_out", "lang_pred", "score"}, (4, 2))])
def test_model_queries_have_a_row_for_each_document(spark, name, columns, mod):
    got, docs = queries.queries()[name](spark, SF).toPandas(), read("documents")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and columns <= set(got.columns) and not got[sorted(columns)].isna().any().any()
    if mod:
        assert got.held_out.tolist() == [zlib.crc32(str(k).encode()) % mod[0] == mod[1] for k in got.doc_id]
