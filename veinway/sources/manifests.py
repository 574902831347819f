"""Dataset manifests and run catalogs."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "image_id string, split string, sat_image_path string, mask_path string"
RUN_ID = r"^[a-zA-Z0-9_\-]+$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header [D19]."""
    return spark.read.csv(path, header=True, schema=MANIFEST)


def training_pairs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the train split whose image and mask are both among ``files`` (path) [S4]."""
    have = files.select("path").distinct()
    rows = manifest.where("split = 'train'")
    rows = rows.join(have.withColumnRenamed("path", "sat_image_path"), "sat_image_path", "left_semi")
    return rows.join(have.withColumnRenamed("path", "mask_path"), "mask_path", "left_semi").select("image_id", "split", "sat_image_path", "mask_path")


def missing_pairs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Train rows without one of their files [S4]."""
    good = training_pairs(manifest, files).select("image_id", "sat_image_path", "mask_path")
    return manifest.where("split = 'train'").join(good, ["image_id", "sat_image_path", "mask_path"], "left_anti")


def split_train_val(pairs: DataFrame, order: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part (train or val): a seeded permutation of the row numbers puts its first share, at least one row, into val [S5].

    The permutation is of the rows in the given order and is made on the driver from their
    number alone; only the numbers chosen are sent out, as a table.
    """
    from ..operators.ranking import numbered

    spark = pairs.sparkSession
    n = pairs.count()
    chosen = np.random.default_rng(seed).permutation(n)[: max(1, int(n * share))] if n else []
    val = spark.createDataFrame([(int(i),) for i in chosen], "row long").withColumn("part", F.lit("val"))
    return numbered(pairs, order, "row").join(val, "row", "left").withColumn("part", F.coalesce("part", F.lit("train"))).drop("row")


def pair_by_name(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images and masks (path) of the same file name; the rest is dropped [S6, J1]."""
    name = F.element_at(F.split("path", "/"), -1)
    return images.select(name.alias("name"), F.col("path").alias("image_path")).join(masks.select(name.alias("name"), F.col("path").alias("mask_path")), "name")


def dataset_summary(pairs: DataFrame) -> DataFrame:
    """Pairs by part [A34]."""
    return pairs.groupBy("part").agg(F.count("*").alias("pairs"))


def training_plan(pairs: DataFrame, batch: int) -> DataFrame:
    """Steps an epoch by part [A35]."""
    return pairs.groupBy("part").agg(F.ceil(F.count("*") / F.lit(batch)).alias("steps"))


VALUE = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())])
SUMMARY = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("projectId", "projectName", "location", "analysisDate", "status", "resolution", "fileSize", "fileName")],
    T.StructField("archived", T.BooleanType()),
    T.StructField("networkSummary", T.StructType([T.StructField(c, VALUE) for c in ("totalRoadLength", "roadSegments")])),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries by glob, each one JSON file; corrupt ones are skipped [S10]."""
    raw = spark.read.schema(SUMMARY).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern).withColumn("_path", F.input_file_name())
    return raw.where("_corrupt_record is null").drop("_corrupt_record")


def run_catalog(runs: DataFrame, include_archived: bool = False) -> DataFrame:
    """Catalog entries with defaults for missing fields, archived ones only if asked for, newest first, then by id [S10, O1]."""
    folder = F.element_at(F.split("_path", "/"), -2) if "_path" in runs.columns else F.lit("")
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d))
    summary = lambda a, b: F.col(f"networkSummary.{a}.{b}")
    out = runs.select(F.coalesce("projectId", folder).alias("id"), text("projectName", "Recent Run").alias("name"), text("location", "Unknown Location").alias("location"), text("analysisDate").alias("date"), F.coalesce(summary("roadSegments", "value"), F.lit(0.0)).cast("long").alias("segments"),
        F.concat(F.coalesce(summary("totalRoadLength", "value"), F.lit(0.0)).cast("string"), F.lit(" "), F.coalesce(summary("totalRoadLength", "unit"), F.lit("km"))).alias("length"), text("status", "complete").alias("status"), F.coalesce("archived", F.lit(False)).alias("archived"), text("resolution").alias("resolution"), text("fileSize").alias("fileSize"), text("fileName").alias("fileName"))
    return (out if include_archived else out.where(~F.col("archived"))).orderBy(F.desc("date"), "id")


def lookup(catalog: DataFrame, run_id: str) -> DataFrame:
    """The entry of an id; ids that could be paths are refused [S11]."""
    if not re.match(RUN_ID, run_id):
        raise ValueError(f"not a run id: {run_id}")
    return catalog.where(F.col("id") == run_id)


def without_run(catalog: DataFrame, run_id: str) -> DataFrame:
    """The catalog after a run's deletion; KeyError if it isn't there [K10]."""
    if lookup(catalog, run_id).isEmpty():
        raise KeyError(run_id)
    return catalog.where(F.col("id") != run_id)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there, else the last [S14]."""
    for path in paths[:-1]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return path
    return paths[-1]
