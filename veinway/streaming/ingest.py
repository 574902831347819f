"""Incremental ingestion: an extension, the batch operators over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

MASK = "scene_id string, y int, x int, at timestamp"


def mask_stream(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """Mask pixels from Parquet files (scene_id, y, x, at) as they arrive, some files a batch."""
    return spark.readStream.schema(MASK).option("maxFilesPerTrigger", files).parquet(folder)


def road_pixels_by_window(pixels: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Set pixels by scene and arrival window; pixels later than ``late`` are left out, so state stays bounded.

    Pixels are told apart within the watermark, so repeated files don't count twice.
    """
    once = pixels.withWatermark("at", late).dropDuplicatesWithinWatermark(["scene_id", "y", "x"])
    return once.groupBy("scene_id", F.window("at", window)).agg(F.count("*").alias("road_pixels"))


def apply_each_batch(stream: DataFrame, operator, path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch and append its rows, tagged by batch.

    A batch that is run again overwrites its own folder, so rows are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressFile(StreamingQueryListener):
    """Writes a line to a file of the driver's for each micro-batch that ends [K11]."""

    def __init__(self, path: str) -> None:
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows\n")

    def onQueryTerminated(self, event) -> None:
        pass


def progress(query: StreamingQuery) -> str:
    """The last progress as text, or that there is none yet [S12]."""
    last = query.lastProgress
    return f"batch {last['batchId']}: {last['numInputRows']} rows" if last else "Initializing..."
