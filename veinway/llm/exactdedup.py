"""Exact dedup by progressive refinement, with DataFrame operations only.

Texts are first told apart by length and a hash of their beginning. Only groups that still
hold several texts go on: their whole content is read and hashed. Counting is done by
partial aggregation and joins on the group's key, so a group of copies of any size is
never gathered in one task.

Cases: null text counts as empty; empty texts are copies of one another; a null id is a
row like any other, and stays only in a group whose ids are all null; repeated ids are
separate rows (each row with the group's smallest id is kept); other columns are passed
on only by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join, small_side
from ..session import materialise

#: Characters of the text that the first hash covers.
PREFIX = 256
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def _sized(docs: DataFrame, key: str, column: str) -> DataFrame:
    """_id, _norm, and the first two marks of each row: _length and _prefix."""
    rows = docs.select(docs[key].alias("_id"), docs[column].cast("string").alias("_text"))
    return rows.select("_id", normalised(F.col("_text")).alias("_norm")).select(
        "_id", "_norm", F.octet_length("_norm").alias("_length"), F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_prefix")
    )


def _open(marks: DataFrame) -> DataFrame:
    """The (_length, _prefix) of several rows: only these marks are shuffled."""
    return marks.groupBy("_length", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1").select("_length", "_prefix", F.lit(True).alias("_open"))


def _judged(rows: DataFrame) -> DataFrame:
    """Of rows with _id, _sha and _open, adds _keep and _size to those open ones whose _sha several have.

    The others keep their _sha as the key of the join, so they are dealt out evenly and find nothing.
    """
    full = rows.where("_open").groupBy("_sha").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    return skew_join(rows, full, ["_sha"], "left")


def _refined(docs: DataFrame, key: str, column: str) -> DataFrame:
    """One row per document: _id, _length, _prefix, and for rows whose first two marks others have too _sha, _keep and _size.

    Texts are read whole only of ids with such a row.
    """
    marks = materialise(_sized(docs, key, column).drop("_norm"), "marks")
    marked = materialise(skew_join(marks, _open(marks), ["_length", "_prefix"], "left"), "marked")
    ids = small_side(marked.where("_open").select("_id").distinct().withColumnRenamed("_id", "_open_id"), "ids")
    some = docs.select(docs[key].alias("_id"), docs[column].cast("string").alias("_text"))
    some = some.join(ids, some["_id"].eqNullSafe(ids["_open_id"]), "left_semi")
    whole = _sized(some, "_id", "_text").select("_id", "_length", "_prefix", F.sha2("_norm", 256).alias("_sha"), F.lit(True).alias("_open"))
    # an id may have further rows that are told apart already
    whole = skew_join(whole, _open(marks), ["_length", "_prefix"], "left_semi")
    alone = marked.where("_open is null").select("_id", "_length", "_prefix", F.lit(None).cast("string").alias("_sha"))
    return alone.withColumn("_keep", F.col("_id")).withColumn("_size", F.lit(None).cast("long")).unionByName(_judged(whole).drop("_open"))


def groups(docs: DataFrame, key: str = "doc_id", column: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept and, with ``digests``, text_sha256.

    ``digests`` hashes the texts that refinement has already told apart too, in the same pass.
    """
    if digests:
        rows = _sized(docs, key, column)
        hashed = rows.select("_id", "_length", "_prefix", F.sha2("_norm", 256).alias("_sha"))
        joined = skew_join(hashed, _open(rows), ["_length", "_prefix"], "left")
        out = _judged(joined.select("_id", "_sha", "_open"))
    else:
        out = _refined(docs, key, column)
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    columns = [F.col("_id").alias(key), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept")]
    return out.select(*columns, *([F.col("_sha").alias("text_sha256")] if digests else []))


def deduplicate(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the copies.

    A row goes if its id and text together were judged a copy, so rows that share an id do
    not fall for one another; a repeated row whose id is the kept one stays as often as it is
    there. Only texts of ids with a copy are hashed again.
    """
    judged = _refined(docs, key, column).where("_size is not null and not _id <=> _keep")
    drop = small_side(judged.select(F.col("_id").alias("_drop_id"), F.col("_sha").alias("_drop_sha")).distinct(), "drop")
    ours = docs[key].eqNullSafe(drop["_drop_id"])
    # the hash waits for an equal id: written so that it is no key of the join
    text = F.when(ours, F.sha2(normalised(docs[column]), 256))
    return docs.join(drop, ours & (text == drop["_drop_sha"]), "left_anti")
