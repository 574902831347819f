"""Range joins by grid cells, nearest joins by tiles.

A point within r of another lies in its cell of side r or one of the eight around it, so a
range join becomes an equi-join on cells: one side is put into nine cells, and no pair
farther apart than the nine cells is ever made. Keys: the scene and the cell. A search for
the nearest makes no pairs; ``nearest`` has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialise
from . import nearest
from .joins import skew_join
from .nearest import cell, finite


def _around(df: DataFrame, y: str, x: str, size: float) -> DataFrame:
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return df.select("*", F.explode(shifts).alias("_s")).withColumn("_cy", cell(F.col(y), size) + F.col("_s.dy")).withColumn("_cx", cell(F.col(x), size) + F.col("_s.dx")).drop("_s")


def range_join(left: DataFrame, right: DataFrame, radius: float, scene: str = "scene_id", least: float | None = None) -> DataFrame:
    """Pairs of rows (columns y, x on the left and ry, rx on the right) of a scene at most ``radius`` apart; adds ``gap`` [J5, J6]."""
    a = _around(left, "y", "x", radius)
    b = right.withColumn("_cy", cell(F.col("ry"), radius)).withColumn("_cx", cell(F.col("rx"), radius))
    gap = F.hypot((F.col("ry") - F.col("y")).cast("double"), (F.col("rx") - F.col("x")).cast("double"))
    out = a.join(b, [scene, "_cy", "_cx"]).drop("_cy", "_cx").withColumn("gap", gap).where(F.col("gap") <= radius)
    return out if least is None else out.where(F.col("gap") >= least)


#: Ids of a place that stand in one row; a place with more has several.
PACK = 256


def pairs_within(points: DataFrame, radius: float, least: float | None = None, digits: int | None = None, scene: str = "scene_id") -> DataFrame:
    """Pairs of different points (id, y, x) of a scene at most ``radius`` apart, each once: scene, a < b, ``gap`` [J5].

    Points at one place have the same neighbours, so places are compared, not points, and a pair of
    places becomes the pairs of their points only at the end; so ``digits`` of ``gap``, if given, are
    rounded once for a pair of places. Of a cell's neighbours half are met.
    """
    place = [scene, "y", "x"]
    many = points.groupBy(*place).agg(F.ceil(F.count("*") / PACK).alias("_n")).where("_n > 1")
    rows = points.join(many, place, "left").withColumn("_pack", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1).cast("long"))))
    packs = rows.groupBy(*place, "_pack").agg(F.collect_list("id").alias("ids"))
    own = lambda y, x: (cell(F.col(y), radius), cell(F.col(x), radius))
    cy, cx = own("y", "x")
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    a = packs.select("*", F.explode(shifts).alias("_s")).withColumn("_cy", cy + F.col("_s.dy")).withColumn("_cx", cx + F.col("_s.dx"))
    a = a.withColumn("_home", (F.col("_s.dy") == 0) & (F.col("_s.dx") == 0)).drop("_s")
    ry, rx = own("ry", "rx")
    b = packs.select(scene, F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("_pack").alias("_rpack"), F.col("ids").alias("rids")).withColumn("_cy", ry).withColumn("_cx", rx)
    at, to = F.struct("y", "x", "_pack"), F.struct("ry", "rx", "_rpack")
    dy, dx = ((F.col(f"r{c}") - F.col(c)).cast("double") for c in "yx")
    gap = F.hypot(dy, dx)
    near = a.join(b, [scene, "_cy", "_cx"]).where(~F.col("_home") | (at <= to)).where(dy * dy + dx * dx <= radius * radius * (1 + 1e-9)).withColumn("gap", gap).where(F.col("gap") <= radius)
    near = (near if least is None else near.where(F.col("gap") >= least)).withColumn("_same", F.col("_home") & (at == to))
    near = near if digits is None else near.withColumn("gap", F.round("gap", digits))
    out = near.select(scene, "gap", "_same", "rids", F.explode("ids").alias("p")).select(scene, "gap", "_same", "p", F.explode("rids").alias("q"))
    return out.where((F.col("p") < F.col("q")) | (~F.col("_same") & (F.col("p") > F.col("q")))).select(scene, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "gap")


def _back(rows: DataFrame, found: DataFrame, scene: str) -> DataFrame:
    """Rows with what was found for their places.

    The planner knows rows by their files only, and would broadcast millions of them through the
    driver where these are small; so the join is by an exchange, which splits a crowded place.
    """
    return skew_join(rows.withColumn("y", F.col("y").cast("double")).withColumn("x", F.col("x").cast("double")), found.hint("merge"), [scene, "y", "x"])


def _places(rows: DataFrame, scene: str) -> DataFrame:
    """Each place of some rows once, as copies of a point have the same neighbour."""
    return finite(rows, ["y", "x"]).select(scene, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).distinct()


def nearest_within(left: DataFrame, right: DataFrame, radius: float, key: list[str], tie: str, scene: str = "scene_id") -> DataFrame:
    """For each key of the left the nearest row of the right within ``radius``: least ``tie`` among equals; adds ``gap`` [J4, O5]."""
    value = [c for c in right.columns if c not in (scene, tie)]
    order = [tie, *value]
    # of the rows at one place only the first can win
    first = finite(right, ["ry", "rx"]).groupBy(scene, F.col("ry").cast("double").alias("ay"), F.col("rx").cast("double").alias("ax")).agg(F.min(F.struct(*order)).alias("r"))
    others = materialise(first.select(scene, "ax", "ay", F.col("ax").alias("bx"), F.col("ay").alias("by"), "r.*"), "places")
    places = materialise(_places(left, scene), "points")
    found = nearest.search(places, others, radius, nearest.extent(places, others, scene)[1], scene, order)
    best = _back(left.select(scene, *key, "y", "x"), found, scene).groupBy(scene, *key).agg(F.min(F.struct("gap", *[f"_to_{c}" for c in order])).alias("b"))
    return best.select(scene, *key, *[F.col(f"b._to_{c}").alias(c) for c in order], F.col("b.gap").alias("gap"))


def point_network_distance(points: DataFrame, segments: DataFrame, key: list[str], reach: float | None = None, scene: str = "scene_id") -> DataFrame:
    """For each point (key, y, x) its least distance to the segments (ax, ay, bx, by) of its scene [G11, J9].

    With ``reach`` only points that have a segment within it (at least 1) have a row. Without it the
    search starts with a reach of about the segments' spacing and goes on with one four times as
    large for the places that found nothing within it, until all have; points of scenes without
    segments have no row. Points and segments with a coordinate that is missing or infinite are left out.
    """
    scratch = Scratch(points.sparkSession) if reach is None else None
    table = scratch.table if scratch else materialise
    segments = table(finite(segments, nearest.ENDS).select(scene, *[F.col(c).cast("double").alias(c) for c in nearest.ENDS]).distinct(), "segments")
    left = _places(points, scene)
    left = table(left.join(segments.select(scene).distinct(), scene, "left_semi") if scratch else left, "points")
    size, tile = nearest.extent(left, segments, scene)
    if scratch:
        n, length = segments.agg(F.count("*"), F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()
        found, now = None, max(size / max(n, 1) ** 0.5, length or 0.0, size * 1e-6, 1e-9)
        while n and not left.isEmpty():
            hit = materialise(nearest.search(left, segments, now, tile, scene), "distances")
            found = hit if found is None else found.unionByName(hit)
            left = scratch.table(left.join(hit.select(scene, "y", "x").hint("merge"), [scene, "y", "x"], "left_anti"), "points")
            now *= 4
        scratch.drop()
        if found is None:
            return points.select(scene, *key, F.lit(0.0).alias("distance")).limit(0)
    else:
        found = nearest.search(left, segments, max(reach, 1.0), tile, scene)
    return _back(points.select(scene, *key, "y", "x"), found, scene).groupBy(scene, *key).agg(F.min("gap").alias("distance"))
