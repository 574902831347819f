"""What the operators of this subpackage share: shipping code, shared files, column helpers."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship  # noqa: F401

def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; works for any store that Arrow opens."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def path_of(path: str) -> str:
    """The folder of a path in a file system."""
    return path.rsplit("/", 1)[0]


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def text_marks(text: str | Column) -> list[Column]:
    """t1 and t2: 128 bits of hash that tell texts of rows with the same id apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for small follow-up work: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
