"""The whole way from masks to scored networks, as one lazy plan of relations per stage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as s
from ..operators import graphs, kernels, scoring, topology
from ..operators.components import connected_components
from ..session import materialise


@dataclass
class Network:
    """Relations of analysed scenes; every one has scene_id."""

    segments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame
    components: DataFrame
    intersections: DataFrame
    disconnected: DataFrame
    confidence: DataFrame
    summary: DataFrame

    @cached_property
    def continuity(self) -> DataFrame:
        """Made when asked for, as it writes tables of its own."""
        return topology.continuity_links(self.edges, self.segments)


def name(scene: str, node: str) -> Column:
    """A node's name across scenes."""
    return F.concat_ws("/", F.col(scene), F.col(node).cast("string"))


def analyse(mask: DataFrame, scenes: DataFrame, settings: kernels.Settings = kernels.Settings(), gap: float = 18.0, rgb: DataFrame | None = None) -> Network:
    """Geometry, topology with evidence-scored bridges, and confidence of every scene [3.1, T12].

    ``rgb`` (scene_id, y, x, r, g, b) gives segments their mean color and contrast; without an
    image both are 0.

    Geometry runs in one kernel a scene; from then on all is joins and aggregates over all
    scenes at once. A scene without segments has no rows but in the summary.
    """
    net = materialise(kernels.extract_network(mask, scenes, settings), "network")
    nodes = net.where("part = 'node'").select("scene_id", F.col("id").alias("number"), name("scene_id", "id").alias("node"), "y", "x", "kind")
    own = net.where("part = 'edge'")
    segments = own.select("scene_id", F.col("id").cast("int").alias("segment_id"), F.col("pixels").alias("path"), "length_px", "direction_deg", "curvature", "width_px")
    edges = own.select("scene_id", name("scene_id", "src").alias("src"), name("scene_id", "dst").alias("dst"), F.col("id").cast("int").alias("segment_id"), "length_px", F.lit(0.0).alias("gap_px"), F.lit(1.0).alias("connection_score"), F.lit("geometry_segment").alias("edge_kind"))
    # bridges between dead ends
    degree = graphs.degrees(edges)
    tips = topology.ends(segments).join(edges.select("scene_id", "segment_id", "src", "dst"), ["scene_id", "segment_id"])
    tips = tips.withColumn("node", F.when(F.col("at_end"), F.col("dst")).otherwise(F.col("src"))).join(degree.where("degree = 1").select("node"), "node", "left_semi")
    pairs = topology.candidate_links(tips.drop("node", "src", "dst"), gap)
    key = ["segment_id", "at_end", "seg_b", "end_b"]
    scored = topology.score_links(pairs, topology.mask_support(pairs, mask, scenes, key), key, gap)
    at = tips.select("scene_id", "segment_id", "at_end", "node")
    scored = scored.join(at.withColumnRenamed("node", "a"), ["scene_id", "segment_id", "at_end"]).join(at.select("scene_id", F.col("segment_id").alias("seg_b"), F.col("at_end").alias("end_b"), F.col("node").alias("b")), ["scene_id", "seg_b", "end_b"])
    scored = materialise(scored.where("a <> b").select("scene_id", F.col("segment_id").alias("seg_a"), "seg_b", "a", "b", "gap", "score", "accepted", "evidence_count", "reasons"), "links")
    chosen = graphs.greedy_match(scored.where("accepted").select("a", "b", "score"), edges)
    won = chosen.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.lit(True).alias("won"))
    scored = scored.join(won, (F.least("a", "b") == F.col("wa")) & (F.greatest("a", "b") == F.col("wb")), "left")
    bridges = scored.where("won").groupBy("scene_id", "wa", "wb").agg(F.max("score").alias("score"), F.min("gap").alias("gap"))
    bridges = bridges.select("scene_id", F.col("wa").alias("src"), F.col("wb").alias("dst"), F.lit(-1).alias("segment_id"), F.col("gap").alias("length_px"), F.col("gap").alias("gap_px"), F.col("score").alias("connection_score"), F.lit("geometry_bridge").alias("edge_kind"))
    edges = materialise(edges.unionByName(bridges), "edges")
    nodes, edges = graphs.cleanup(nodes, edges)
    nodes = materialise(nodes, "nodes")
    components = connected_components(edges, nodes).join(nodes.select("node", "scene_id"), "node")
    off = _alone(edges, components)
    degree = graphs.degrees(edges).join(nodes.select("node", "scene_id"), "node")
    coverage = scoring.mask_coverage(segments, mask)
    tied = scoring.connectivity(segments, nodes, degree, off, snap=8.0)
    base = segments.join(coverage, ["scene_id", "segment_id"]).join(tied, ["scene_id", "segment_id"])
    if rgb is None:
        base = base.withColumn("color_contrast", F.lit(0.0))
    else:
        contrast = scoring.color_contrast(scoring.colors_under(segments, rgb))
        base = base.join(contrast, ["scene_id", "segment_id"], "left").fillna(0.0, ["color_contrast"])
        segments = segments.join(scoring.mean_color(segments, rgb), ["scene_id", "segment_id"])
    confidence = scoring.overall(base.withColumn("straightness", s.straightness(F.col("curvature"))).withColumn("length_score", s.length_score(F.col("length_px")))).drop("path")
    crossings = topology.intersections(nodes, edges)
    n = lambda df, what: df.groupBy("scene_id").agg(F.count("*").alias(what))
    summary = scenes.select("scene_id").join(segments.groupBy("scene_id").agg(F.count("*").alias("segments"), F.round(F.sum("length_px"), 3).alias("length_px")), "scene_id", "left")
    summary = summary.join(n(nodes, "nodes"), "scene_id", "left").join(n(edges, "edges"), "scene_id", "left").join(n(crossings, "intersections"), "scene_id", "left").join(n(off, "disconnected"), "scene_id", "left")
    summary = summary.join(components.groupBy("scene_id").agg(F.countDistinct("component").alias("components")), "scene_id", "left").join(n(edges.where("edge_kind = 'geometry_bridge'"), "bridges"), "scene_id", "left")
    summary = summary.join(confidence.groupBy("scene_id").agg(F.round(F.avg("overall"), 6).alias("network_score")), "scene_id", "left").fillna(0)
    return Network(segments, nodes, edges, scored.where("won is null").drop("wa", "wb", "won"), components, crossings, off, confidence, summary)


def _alone(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scene_id, segment_id) of segments that are their component's only edge [T9]."""
    own = edges.join(components.select(F.col("node").alias("src"), "component"), "src")
    n = own.groupBy("component").agg(F.count("*").alias("n"), F.min("scene_id").alias("scene_id"), F.min("segment_id").alias("segment_id"))
    return n.where("n = 1 and segment_id >= 0").select("scene_id", "segment_id")


def load_or_compute(spark, path: str, compute) -> DataFrame:
    """A saved relation if it is there and whole, else what ``compute`` gives, saved [S15]."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report_tables(network: Network, classified: DataFrame) -> dict[str, DataFrame]:
    """The tables of a printed report: network measures, classes and tiers [K7]."""
    from ..operators import analytics

    return {"network": network.summary, "classes": analytics.class_distribution(classified), "tiers": analytics.tier_distribution(classified)}
