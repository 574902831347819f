"""Confidence dimensions, flags, issue lists and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as s
from ..functions.geometry import METRES_PER_PIXEL
from .ranking import numbered


def mask_coverage(segments: DataFrame, mask: DataFrame) -> DataFrame:
    """Share of each segment's points on the mask, 0 without points [A1]."""
    pts = segments.select("scene_id", "segment_id", F.explode_outer("path").alias("p"))
    hit = pts.select("scene_id", "segment_id", F.col("p.y").alias("y"), F.col("p.x").alias("x")).join(mask.select("scene_id", "y", "x").distinct().withColumn("hit", F.lit(1)), ["scene_id", "y", "x"], "left")
    return hit.groupBy("scene_id", "segment_id").agg(F.coalesce(F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count("y")), F.lit(0.0)).alias("mask_coverage"))


def color_contrast(points: DataFrame) -> DataFrame:
    """Rows (scene_id, segment_id, r, g, b) of the pixels under each segment [A2]."""
    return points.groupBy("scene_id", "segment_id").agg(s.contrast(F.col("r"), F.col("g"), F.col("b")).alias("color_contrast"))


def colors_under(segments: DataFrame, rgb: DataFrame, stride: int = 1) -> DataFrame:
    """Rows (scene_id, segment_id, r, g, b) of every ``stride``-th point of each path that lies in the image (scene_id, y, x, r, g, b)."""
    pts = segments.select("scene_id", "segment_id", F.posexplode("path").alias("i", "p")).where(F.col("i") % stride == 0)
    pts = pts.select("scene_id", "segment_id", F.col("p.y").cast("int").alias("y"), F.col("p.x").cast("int").alias("x"))
    return pts.join(rgb.select("scene_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "r", "g", "b"), ["scene_id", "y", "x"]).drop("y", "x")


def mean_color(segments: DataFrame, rgb: DataFrame, stride: int = 3) -> DataFrame:
    """Mean color of every third point of each path, 0 without any in the image [G6]."""
    mean = colors_under(segments, rgb, stride).groupBy("scene_id", "segment_id").agg(*[F.avg(c).alias(c) for c in ("r", "g", "b")])
    return segments.select("scene_id", "segment_id").join(mean, ["scene_id", "segment_id"], "left").fillna(0.0, ["r", "g", "b"])


def connectivity(segments: DataFrame, nodes: DataFrame, degree: DataFrame, disconnected: DataFrame, snap: float = 0.0) -> DataFrame:
    """Half for each end that is a node of degree at least 2; 0 for disconnected segments [A4].

    Ends must be the node's pixel, or lie within ``snap`` of one.
    """
    tips = segments.select("scene_id", "segment_id", F.posexplode(F.array(F.get("path", F.lit(0)), F.element_at("path", -1))).alias("k", "p")).select("scene_id", "segment_id", "k", F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    good = nodes.join(degree.where("degree >= 2"), ["scene_id", "node"]).select("scene_id", F.col("y").alias("ry"), F.col("x").alias("rx")).distinct()
    if snap > 0:
        from .spatial import range_join

        met = range_join(tips, good, snap).select("scene_id", "segment_id", "k").distinct()
    else:
        met = tips.join(good.withColumnsRenamed({"ry": "y", "rx": "x"}), ["scene_id", "y", "x"], "left_semi").select("scene_id", "segment_id", "k")
    n = met.groupBy("scene_id", "segment_id").agg(F.count("*").alias("n"))
    out = segments.select("scene_id", "segment_id").join(n, ["scene_id", "segment_id"], "left").join(disconnected.select("scene_id", "segment_id").distinct().withColumn("off", F.lit(True)), ["scene_id", "segment_id"], "left")
    return out.select("scene_id", "segment_id", F.when(F.col("off"), 0.0).otherwise(F.coalesce("n", F.lit(0)) / 2.0).alias("connectivity"))


def overall(rows: DataFrame) -> DataFrame:
    """Adds overall and notes to rows with the five dimensions [A6]."""
    notes = F.array(F.when(F.col("mask_coverage") < 0.5, "low mask coverage"), F.when(F.col("connectivity") == 0, "isolated segment"), F.when(F.col("length_score") < 0.4, "very short fragment"))
    return rows.withColumn("overall", s.composite(s.DIMENSION_WEIGHTS)).withColumn("notes", F.filter(notes, lambda n: n.isNotNull()))


def network_score(scores: DataFrame) -> DataFrame:
    """Mean score with the numbers of high (at least .7) and low (below .4) segments [A7]."""
    return scores.agg(F.coalesce(F.avg("overall"), F.lit(0.0)).alias("network_score"), F.count(F.when(F.col("overall") >= 0.7, 1)).alias("high"), F.count(F.when(F.col("overall") < 0.4, 1)).alias("low"))


def flags(scores: DataFrame, disconnected: DataFrame, rejected: DataFrame, component_sizes: DataFrame, near_misses: int = 5) -> DataFrame:
    """(severity, kind, segment_id, detail) of known anomalies [A8, O4].

    ``scores`` has curvature; ``rejected`` has seg_a, seg_b, score; ``component_sizes`` component, count.
    """
    none = F.lit(None).cast("long")

    def rows(df: DataFrame, severity: str, kind: str, segment, detail) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), segment.cast("long").alias("segment_id"), F.round(detail.cast("double"), 4).alias("detail"))

    sid = F.col("segment_id")
    best = rejected.where("score >= 0.45").orderBy(F.desc("score"), "seg_a", "seg_b").limit(near_misses)
    parts = [
        rows(scores.where("overall < 0.3"), "warning", "LOW_CONFIDENCE_SEGMENT", sid, F.col("overall")),
        rows(scores.where("mask_coverage < 0.5"), "info", "LOW_MASK_COVERAGE", sid, F.col("mask_coverage")),
        rows(disconnected, "warning", "DISCONNECTED_SEGMENT", sid, F.lit(0.0)),
        rows(best, "info", "NEAR_MISS_CONNECTION", none, F.col("score")),
        rows(component_sizes.where("count < 3"), "info", "ISOLATED_COMPONENT", none, F.col("count")),
        rows(scores.where("curvature > 0.4"), "info", "HIGH_CURVATURE", sid, F.col("curvature")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issues(flag_rows: DataFrame, scores: DataFrame, places: DataFrame) -> DataFrame:
    """Numbered issues with reference, percent coordinates, confidence and review level [A31, J3].

    ``places``: segment_id with y, x, height, width. Flags without a place are at 0. Only
    warnings and errors are for review.
    """
    flag_rows = numbered(flag_rows, ["kind", "segment_id", "detail"], "_n")
    rows = flag_rows.join(scores.select("segment_id", "overall"), "segment_id", "left").join(places, "segment_id", "left")
    confidence = F.when(F.col("overall").isNotNull(), F.round(F.col("overall") * 100)).otherwise(90.0)
    pct = lambda v, n: F.coalesce(F.round(F.try_divide(F.col(v) * 100.0, F.col(n)), 2), F.lit(0.0))
    level = F.when(confidence < 40, "low").when(confidence < 70, "mid").otherwise("high")
    return rows.select((F.col("_n") + 1).alias("number"), "severity", "kind", "segment_id", F.coalesce(F.concat(F.lit("SEGMENT #"), F.col("segment_id").cast("string")), F.lit("")).alias("reference"),
        pct("x", "width").alias("x_pct"), pct("y", "height").alias("y_pct"), confidence.alias("confidence"), level.alias("level"), F.col("severity").isin("warning", "error").alias("for_review"))


def run_summary(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per run: kilometres, mean segment length, connectivity, confidence bands, health [A9].

    ``runs``: run_id, length_px, segments, disconnected, network_score; ``scores``: run_id, overall.
    Bands are whole percents, the low one what is left.
    """
    band = scores.groupBy("run_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("overall") >= 0.7, 1)).alias("hi"), F.count(F.when((F.col("overall") >= 0.4) & (F.col("overall") < 0.7), 1)).alias("mi"))
    j = runs.join(band, "run_id", "left")
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    hi, mi = (F.round(F.coalesce(c, F.lit(0)) * 100.0 / n).cast("int") for c in ("hi", "mi"))
    metres = F.col("length_px") * METRES_PER_PIXEL
    conn = F.when(F.col("segments") > 0, F.round(100 * (1 - F.try_divide(F.col("disconnected") * 1.0, F.col("segments"))), 1)).otherwise(100.0)
    return j.select("run_id", F.round(metres / 1000, 1).alias("length_km"), F.when(F.col("segments") > 0, F.round(F.try_divide(metres, F.col("segments")), 1)).otherwise(0.0).alias("avg_segment_m"), conn.alias("connectivity"),
        F.round(F.col("network_score") * 100, 1).alias("confidence"), hi.alias("high_pct"), mi.alias("mid_pct"), F.greatest(F.lit(0), 100 - hi - mi).alias("low_pct"),
        F.when(conn >= 90, "optimal").otherwise("warning").alias("connectivity_status"), F.when(F.col("network_score") >= 0.8, "optimal").otherwise("warning").alias("quality_status"))


def length_band(length: str = "length_px") -> Column:
    """Colour band of a segment by length [A30]."""
    return F.when(F.col(length) > 40, "long").when(F.col(length) > 15, "medium").otherwise("short")
