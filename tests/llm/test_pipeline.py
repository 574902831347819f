"""The pipeline, stage by stage, against plain Python on a small corpus."""

import re

import numpy as np
import pandas as pd
from conftest import values
from test_dedup import brute_classes
from test_text_models import brute
from tokenizers import Tokenizer

import corpus_pipeline
from veinway.llm import queries
from veinway.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    items = list(zip(bench.item_id, bench.text, strict=True))
    columns, before = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), "test")
        got = after.toPandas()
        if name == "quality":
            known = before[before.doc_id.isin(labels.index)]
            gone = set(known.doc_id) - set(got.doc_id)
            assert not labels.loc[list(gone)].quality.any()  # no good document goes
            assert len(gone) >= 0.8 * (labels.quality == 0).sum()
        elif name == "exact":
            norm = before.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or ""))
            assert set(got.doc_id) == set(before.doc_id.groupby(norm).min())
        elif name == "near":
            rows = list(zip(before.doc_id, before.text, strict=True))
            assert set(got.doc_id) == set(brute_classes(rows))
        elif name == "decontaminate":
            bad = {k for k, t in zip(before.doc_id, before.text, strict=True) if (b := brute(t, items))[1] and 20 * b[1] >= b[0]}
            assert set(got.doc_id) == set(before.doc_id) - bad
        else:
            library = Tokenizer.from_file(queries.vocabulary_path())
            text = before.set_index("doc_id").text
            assert sorted(got.doc_id) == sorted(text.index)
            for r in got.itertuples():
                assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(text[r.doc_id], add_special_tokens=False).ids
            break
        assert after.columns == columns
        assert values(got) == values(before[before.doc_id.isin(got.doc_id)])
        docs, before = after, got


def test_stages_of_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
        if name != "tokens":
            docs = materialise(docs, "empty")
