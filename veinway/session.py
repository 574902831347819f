"""Session defaults, and where a job may write what all executors must see."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veinway")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only.

    On a cluster a machine's own folder would not be seen by the others, so an unset folder fails there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if context.applicationId not in _own_root:
            _own_root[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veinway-")
            atexit.register(shutil.rmtree, _own_root[context.applicationId][7:], ignore_errors=True)
        root = _own_root[context.applicationId]
    return root.rstrip("/")


_work: list[str] = []


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    path = f"{shared_root(spark)}/veinway/{what}-{uuid.uuid4().hex}"
    _work.append(path)
    return path


def tidy(spark: SparkSession) -> None:
    """Delete all tables and files that jobs of this application have left in the shared folder.

    For the end of a job: what is read later must have been written elsewhere by then.
    """
    while _work:
        discard(spark, _work.pop())


def materialise(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which cuts its lineage.

    The files outlive any executor, so work after this point never goes back before it.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one job, in a folder of their own that goes once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.made = spark, work_dir(spark, "scratch"), 0

    def table(self, df: DataFrame, what: str) -> DataFrame:
        self.made += 1
        return materialise(df, what, f"{self.root}/{self.made:03d}-{what}")

    def drop(self) -> None:
        discard(self.spark, self.root)


_shipped: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Bytes of an Arrow batch sent to a Python worker at once, where the session has Spark's default.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound their batches.

    Batches of long texts are copied on both sides, so a sixteenth of Spark's default size
    keeps a worker's memory small; a size that was set for the session is left alone.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="veinway-code-"), f"veinway_{context.applicationId}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("veinway", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
