"""Row numbers over one order of all rows, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with its place, from 0, in a total order.

    Rows are dealt out by ranges of the order and sorted within them; a row's number is its place
    there and the number of rows in the ranges before, of which there is one sum for each.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = materialise(dealt.select("*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
