"""Joins that stay splittable when a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Rows of ids or small records that are broadcast at most: some tens of megabytes.
BROADCAST_ROWS = 1 << 20


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``on`` whose sides are always dealt out anew.

    A side that was just aggregated by the key keeps that dealing, and adaptive execution
    then cannot split a partition that a hot key has swollen. A hash of the keys as a further
    key makes the planner exchange both sides for the join alone, which it can split.
    """
    mark = F.xxhash64(*on)
    return left.withColumn("_spread", mark).join(right.withColumn("_spread", mark), [*on, "_spread"], how).drop("_spread")


def small_side(df: DataFrame, what: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a table, marked for broadcasting if it has at most ``most`` rows.

    Only then; a larger side is joined by an exchange. Meant for narrow rows.
    """
    t = materialise(df, what)
    return F.broadcast(t) if t.count() <= most else t
