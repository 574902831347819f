"""Topology relations: candidate links between road ends, their evidence, intersections and diagnostics.

Segments: (scene_id, segment_id, path array<struct<y,x>>, length_px, direction_deg, curvature,
width_px). Edges: (scene_id, src, dst, segment_id, length_px, edge_kind, ...).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import signals as s
from ..session import materialise
from .joins import small_side
from .spatial import range_join

#: Gate of an accepted link [T4].
GATE = {"score": 0.74, "mask_evidence": 0.70, "approach_align": 0.72, "centerline_continuity": 0.62, "endpoint_distance": 0.85, "direction_compat": 0.80, "width_consistency": 0.80}
GEOMETRIC = ["endpoint_distance", "direction_compat", "approach_align", "centerline_continuity", "width_consistency"]


def ends(segments: DataFrame) -> DataFrame:
    """Both ends of each segment: at_end, y, x, tail and the segment's attributes [G19]."""
    rows = segments.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("at_end"))
    tip = F.when(F.col("at_end"), F.element_at("path", -1)).otherwise(F.get("path", F.lit(0)))
    return rows.select("scene_id", "segment_id", "at_end", tip["y"].alias("y"), tip["x"].alias("x"), g.tail_vector(F.col("path"), F.col("at_end")).alias("tail"), "direction_deg", "width_px")


def candidate_links(end_rows: DataFrame, most: float = 18.0, least: float = 1.5) -> DataFrame:
    """Pairs of ends of different segments between ``least`` and ``most`` pixels apart, each pair once [J5]."""
    right = end_rows.select("scene_id", F.col("segment_id").alias("seg_b"), F.col("at_end").alias("end_b"), F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("tail").alias("tail_b"), F.col("direction_deg").alias("direction_b"), F.col("width_px").alias("width_b"))
    pairs = range_join(end_rows, right, most, least=least)
    return pairs.where("segment_id < seg_b")


def mask_support(pairs: DataFrame, mask: DataFrame, scenes: DataFrame, key: list[str], samples: int = 20) -> DataFrame:
    """Share of the probe from (y, x) to (ry, rx) that lies on the mask; points outside the scene don't count [T2d]."""
    t = F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i")
    rows = pairs.select("scene_id", *key, "y", "x", "ry", "rx", t)
    at = lambda a, b: F.bround(F.col(a) + F.col("i") / samples * (F.col(b) - F.col(a))).cast("int")
    rows = rows.select("scene_id", *key, at("y", "ry").alias("y"), at("x", "rx").alias("x")).join(scenes, "scene_id").where("y >= 0 and x >= 0 and y < height and x < width")
    hit = rows.join(mask.select("scene_id", "y", "x").distinct().withColumn("hit", F.lit(1)), ["scene_id", "y", "x"], "left")
    return hit.groupBy("scene_id", *key).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("mask_evidence"))


def score_links(pairs: DataFrame, support: DataFrame, key: list[str], most: float = 18.0) -> DataFrame:
    """The seven signals, the composite score, the gate and its reasons [T2, T3, T4]."""
    dy, dx = F.col("ry") - F.col("y"), F.col("rx") - F.col("x")
    rows = pairs.join(support, ["scene_id", *key], "left").withColumn("mask_evidence", F.coalesce("mask_evidence", F.lit(0.0)))
    rows = rows.withColumns({
        "endpoint_distance": s.endpoint_distance(F.col("gap"), most),
        "direction_compat": s.direction_compat(g.undirected_angle(F.col("direction_deg"), F.col("direction_b"))),
        "approach_align": s.approach_align(F.col("tail"), F.col("tail_b"), dy, dx),
        "width_consistency": s.width_consistency(F.col("width_px"), F.col("width_b")),
        "centerline_continuity": s.centerline_continuity(F.col("tail"), F.col("tail_b"), dy, dx),
        "gap_penalty": s.gap_penalty(F.col("gap"), most),
    })
    rows = rows.withColumn("score", s.composite(s.SIGNAL_WEIGHTS))
    return gate(rows)


def gate(rows: DataFrame) -> DataFrame:
    """Adds evidence_count, accepted and reasons to rows of signals and a score [T4]."""
    strong = {n: F.col(n) >= GATE[n] for n in [*GEOMETRIC, "mask_evidence"]}
    geometric = sum((strong[n].cast("int") for n in GEOMETRIC), F.lit(0))
    count = geometric + strong["mask_evidence"].cast("int")
    accepted = (F.col("score") >= GATE["score"]) & strong["mask_evidence"] & (geometric >= 4) & strong["approach_align"] & strong["centerline_continuity"]
    why = F.array(
        F.when(~strong["mask_evidence"], "mask support below its floor"),
        F.when(geometric < 4, F.concat(F.lit("strong geometric signals: "), geometric.cast("string"), F.lit("/5"))),
        F.when(~strong["approach_align"], "approach angle below its floor"),
        F.when(~strong["centerline_continuity"], "continuity below its floor"),
        F.when(F.col("score") < GATE["score"], "score below its floor"),
    )
    reasons = F.when(accepted, F.array(F.concat(F.lit("accepted with strong signals: "), count.cast("string")))).otherwise(F.filter(why, lambda r: r.isNotNull()))
    return rows.withColumn("evidence_count", count).withColumn("accepted", accepted).withColumn("reasons", reasons)


def incident(edges: DataFrame) -> DataFrame:
    """(scene_id, node, segment_id) of geometry edges at their ends."""
    own = edges.where("edge_kind in ('geometry_segment', 'skeleton') and segment_id >= 0")
    return own.select("scene_id", F.explode(F.array("src", "dst")).alias("node"), "segment_id")


def intersections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Junction nodes with at least three geometry edges: degree, kind (T, X, complex) and their segments [T7]."""
    at = incident(edges).join(nodes.where("kind = 'junction'").select("scene_id", "node", "y", "x"), ["scene_id", "node"])
    out = at.groupBy("scene_id", "node", "y", "x").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list("segment_id")).alias("segment_ids")).where("degree >= 3")
    return out.withColumn("kind", F.when(F.col("degree") == 3, "T").when(F.col("degree") == 4, "X").otherwise("complex"))


#: Segments at a node that all meet each other; at a node with more, only those in bins of directions near each other do.
CROWD = 256


def continuity_links(edges: DataFrame, directions: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """Pairs of segments that meet at a node and point the same way: (node, segment_a, segment_b, angle_diff) [T8, J8].

    At a node with many segments only those in bins of directions that can be within ``tolerance``
    are compared, so that almost all of the pairs made are links.
    """
    key = ["scene_id", "node"]
    d = F.col("direction_deg").cast("double")
    own = directions.where(F.abs(d) < float("inf")).select("scene_id", "segment_id", d.alias("dir"))
    at = edges.where("edge_kind in ('geometry_segment', 'skeleton') and segment_id >= 0").join(own, ["scene_id", "segment_id"])
    at = materialise(at.select("scene_id", F.explode(F.array("src", "dst")).alias("node"), "segment_id", "dir"), "incident")
    hot = small_side(at.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*key, F.lit(True).alias("hot")), "hot")
    # bins a bit wider than a sixth of the tolerance, so what is within it is at most six bins away
    bins, reach = math.floor(180 / (max(tolerance, 1.0) / 6 * (1 + 1e-6))), 6
    if 2 * reach >= bins:
        bins, reach = 1, 0
    own_bin = F.least(F.floor(F.pmod("dir", F.lit(180.0)) * (bins / 180)), F.lit(bins - 1)).cast("int")
    at = at.join(hot, key, "left").withColumn("_bin", F.when(F.col("hot"), own_bin).otherwise(-1))
    steps = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(reach))).otherwise(F.array(F.lit(0)))
    a = at.select(*key, "_bin", F.explode(steps).alias("_step"), F.col("segment_id").alias("p"), F.col("dir").alias("da"))
    a = a.withColumn("_bin", F.when(F.col("_bin") >= 0, F.pmod(F.col("_bin") + F.col("_step"), F.lit(bins))).otherwise(F.col("_bin")))
    b = at.select(*key, "_bin", F.col("segment_id").alias("q"), F.col("dir").alias("db"))
    # two bins meet from one side, a bin with itself from both
    pairs = a.join(b, [*key, "_bin"]).where("p < q or (_step > 0 and p > q)").withColumn("angle_diff", g.undirected_angle(F.col("da"), F.col("db")))
    return pairs.where(F.col("angle_diff") <= tolerance).select(*key, F.least("p", "q").alias("segment_a"), F.greatest("p", "q").alias("segment_b"), "angle_diff")


def disconnected_segments(edges: DataFrame, components: DataFrame, suspicious: DataFrame | None = None) -> DataFrame:
    """Segments whose component has no other edge, and those already suspicious [T9, O8]."""
    own = edges.join(components.select(F.col("node").alias("src"), "component"), "src")
    alone = own.groupBy("component").agg(F.count("*").alias("n"), F.min("segment_id").alias("segment_id")).where("n = 1 and segment_id >= 0").select("segment_id")
    return alone if suspicious is None else alone.unionByName(suspicious.select("segment_id")).distinct()


def diagnostics(nodes: DataFrame, edges: DataFrame, components: DataFrame, rejected: DataFrame | None = None, short: float = 12.0, floor: float = 0.74) -> DataFrame:
    """One row of connectivity counts [T11, A33]."""
    from .graphs import degrees

    d = degrees(edges, nodes).agg(F.count("*").alias("total_nodes"), F.count(F.when(F.col("degree") == 1, 1)).alias("endpoints"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated_nodes"))
    bridge = F.col("edge_kind") == "geometry_bridge"
    e = edges.agg(F.count("*").alias("total_edges"), F.count(F.when(F.col("length_px") < short, 1)).alias("very_short_edge_count"), F.count(F.when(bridge, 1)).alias("bridge_edges"), F.count(F.when(bridge & (F.coalesce("connection_score", F.lit(0.0)) < floor + 0.08), 1)).alias("weak_bridges"))
    with_edge = edges.select(F.col("src").alias("node")).join(components, "node").select("component").distinct()
    c = components.select("component").distinct()
    comps = c.agg(F.count("*").alias("connected_components")).crossJoin(c.join(with_edge, "component", "left_anti").agg(F.count("*").alias("edgeless_components")))
    r = rejected.agg(F.count("*").alias("rejected_connection_count")) if rejected is not None else nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("rejected_connection_count"))
    return d.crossJoin(e).crossJoin(comps).crossJoin(r).withColumn("suspicious_connection_count", F.col("weak_bridges") + F.col("rejected_connection_count"))


def attach_paths(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Edges with pixels (x, y): the segment's path, or for bridges a straight line between their ends [K3, J2].

    ``edges`` has src_y, src_x, dst_y, dst_x.
    """
    paths = segments.select("scene_id", "segment_id", "path")
    own = F.transform("path", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    end = lambda n: F.struct(F.col(f"{n}_y").alias("y"), F.col(f"{n}_x").alias("x"))
    out = edges.join(paths, ["scene_id", "segment_id"], "left")
    return out.withColumn("pixels", F.coalesce(own, g.interpolate_line(end("src"), end("dst")))).withColumn("length", F.bround("length_px").cast("long")).drop("path")
