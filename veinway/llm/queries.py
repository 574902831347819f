"""The queries of this subpackage: thin digests of what its operators return, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chatfmt, dartdedup, decontam, exactdedup, langid, ordinal, tokenbin, toxgru, warcz
from .shared import table

#: Where the vocabulary file of the token queries is looked up.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenbin.write_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)
    return tokenbin.read_tokens(spark, store, digests=True)


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warcz.write_bundles(table(spark, sf_dir, "pages"))
    return warcz.read_bundles(spark, paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    share = F.crc32(F.col("doc_id").cast("string")) % 5
    network = toxgru.fit(docs, labels.where(share != 0))
    return toxgru.score(docs, network, [F.col("doc_id"), F.coalesce(share == 0, F.lit(False)).alias("held_out")])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartdedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(table(spark, sf_dir, "documents"), digests=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    share = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(langid.training_sample(docs.where(share != 2)))
    return langid.predict(docs, model, [F.col("doc_id"), F.coalesce(share == 2, F.lit(False)).alias("held_out")])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.contaminated(decontam.phrase_matches(index, table(spark, sf_dir, "benchmark")))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, "contaminated")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string"))
    out = chatfmt.read_back(chatfmt.format_turns(chatfmt.typed_turns(chatfmt.conversations_as_structs(rows), rename=False)))
    turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6, "op8_decontamination": OP8, "op9_chat_format": OP9}


OP6 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP8 = r"""
WITH w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents),
i AS (
  SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(t)) AS n, array_to_string(t[p : p + least(13, len(t)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(t) - 12, 1) + 1)) AS p FROM i WHERE len(t) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, p, array_to_string(t[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS p FROM w, lens WHERE len(t) >= n)),
m AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.s = win.s),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(w.t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.t) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(t) + length(t) - length(replace(replace(replace(t, '\', ''), '<', ''), '#', '')) AS body,
         length(r) + length(r) - length(replace(replace(replace(replace(replace(r, '\', ''), '<', ''), '#', ''), ':', ''), chr(10), '')) AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, lone
"""
