"""Further queries: scalar functions, sinks, scores and the whole scene plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import analytics, graphs, inference, raster, routing, scoring, topology
from ..sources import images, manifests, vectors
from . import bindings as b
from . import scene
from .queries import CLASS_CTE, _classified, _segments_graph, query, rounded, with_


def _pairs(spark, sf) -> DataFrame:
    """Point and segment coordinates from parts."""
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    return b.table(spark, sf, "part").select(k.alias("id"), d(k % 17).alias("px"), d(k % 13).alias("py"), d(k % 11).alias("ax"), d(k % 7).alias("ay"), d(k % 11 + k % 5).alias("bx"), d(k % 7 + k % 3).alias("by"))


PAIRS = "pr AS (SELECT p_partkey AS id, (p_partkey % 17)::DOUBLE AS px, (p_partkey % 13)::DOUBLE AS py, (p_partkey % 11)::DOUBLE AS ax, (p_partkey % 7)::DOUBLE AS ay, (p_partkey % 11 + p_partkey % 5)::DOUBLE AS qx, (p_partkey % 7 + p_partkey % 3)::DOUBLE AS qy FROM part)"


@query(with_(PAIRS) + "SELECT id, CASE WHEN sqrt(ax * ax + ay * ay) * sqrt(qx * qx + qy * qy) <= 1e-9 THEN 180.0 ELSE round(degrees(acos(greatest(-1, least(1, (ay * qy + ax * qx) / (sqrt(ax * ax + ay * ay) * sqrt(qx * qx + qy * qy)))))), 4) END AS angle FROM pr")
def g7_angle_between(spark, sf):
    return rounded(_pairs(spark, sf).select("id", g.angle_between(*(F.col(c) for c in ("ay", "ax", "by", "bx"))).alias("angle")))


@query(with_(PAIRS) + "SELECT id, least(abs(ax * 17 - qx * 29) % 180, 180 - abs(ax * 17 - qx * 29) % 180) AS difference FROM pr")
def g8_undirected_angle(spark, sf):
    return _pairs(spark, sf).select("id", g.undirected_angle(F.col("ax") * 17, F.col("bx") * 29).alias("difference"))


@query(with_(PAIRS, "tv AS (SELECT *, CASE WHEN qx = ax AND qy = ay THEN 0 ELSE least(1, greatest(0, ((px - ax) * (qx - ax) + (py - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) END AS t FROM pr)") + "SELECT id, round(ax + t * (qx - ax), 4) AS x, round(ay + t * (qy - ay), 4) AS y, round(sqrt((px - ax - t * (qx - ax)) ** 2 + (py - ay - t * (qy - ay)) ** 2), 4) AS distance FROM tv")
def g10_foot_on_segment(spark, sf):
    f = g.foot_on_segment(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    return rounded(_pairs(spark, sf).select("id", f.alias("f")).select("id", "f.x", "f.y", "f.distance"))


@query(with_(b.SQL_PATH, "e AS (SELECT path_id, arg_min(x, i) AS x0, arg_min(y, i) AS y0, arg_max(x, i) AS x1, arg_max(y, i) AS y1 FROM v GROUP BY path_id)") + "SELECT path_id, sqrt((x1 - 100) ** 2 + (y1 - 100) ** 2) < sqrt((x0 - 100) ** 2 + (y0 - 100) ** 2) AS turned FROM e")
def g13_oriented_paths(spark, sf):
    p = b.paths(spark, sf)
    turned = g.orient(F.col("path"), F.lit(100.0), F.lit(100.0))
    return p.select("path_id", ((F.get(turned, F.lit(0))["x"] == F.element_at("path", -1)["x"]) & (F.get(turned, F.lit(0))["y"] == F.element_at("path", -1)["y"])).alias("turned"))


@query(with_(PAIRS) + "SELECT id, 0.5 * px + 100 AS wx, -0.5 * py + 50 AS wy, round(px * 100 / 17, 2) AS x_pct FROM pr")
def g15_affine_and_percent(spark, sf):
    t = F.array(*[F.lit(v) for v in (0.5, 0.0, 100.0, 0.0, -0.5, 50.0)])
    p = _pairs(spark, sf)
    return p.select("id", g.affine(F.col("px"), F.col("py"), t).alias("w"), g.percent_position(F.col("px"), F.lit(17)).alias("x_pct")).select("id", F.col("w.x").alias("wx"), F.col("w.y").alias("wy"), "x_pct")


@query(with_(b.SQL_PATH, "e AS (SELECT path_id, arg_min(x, i) AS x0, arg_min(y, i) AS y0, arg_max(x, i) AS x1, arg_max(y, i) AS y1 FROM v GROUP BY path_id)") + "SELECT path_id, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM e")
def g19_segment_ends(spark, sf):
    p = b.paths(spark, sf).select("path_id", g.segment_ends(F.col("path")).alias("e"))
    at = lambda i, c: F.get("e", F.lit(i))[c]
    return p.select("path_id", F.round(at(0, "x"), 6).alias("x0"), at(0, "y").alias("y0"), F.round(at(1, "x"), 6).alias("x1"), at(1, "y").alias("y1"))


@query("WITH px AS (SELECT l_orderkey % 500 AS y, l_partkey % 500 AS x, (l_quantity * 5)::INT AS r, (l_discount * 2000)::INT AS gr, (l_tax * 2500)::INT AS bl FROM lineitem), h AS (SELECT *, greatest(r, gr, bl) AS hi, least(r, gr, bl) AS lo FROM px) SELECT count(*) AS pixels, count(*) FILTER (WHERE CASE WHEN hi = 0 THEN 0 ELSE round(255.0 * (hi - lo) / hi) END < 65 AND hi > 80) AS bright FROM h")
def f3_bright_surfaces(spark, sf):
    li = b.table(spark, sf, "lineitem")
    px = li.select(F.lit("s0").alias("scene_id"), (F.col("l_orderkey") % 500).alias("y"), (F.col("l_partkey") % 500).alias("x"), F.round(F.col("l_quantity") * 5).cast("int").alias("r"), F.round(F.col("l_discount") * 2000).cast("int").alias("g"), F.round(F.col("l_tax") * 2500).cast("int").alias("b"))
    h = images.hsv(px)
    return h.agg(F.count("*").alias("pixels")).crossJoin(raster.bright_road_pixels(h).agg(F.count("*").alias("bright")))


@query(with_(b.SQL_PX) + "SELECT y // 4 AS segment_id, round(avg((weak.y IS NOT NULL)::INT), 6) AS mask_coverage FROM px LEFT JOIN weak USING (y, x) GROUP BY 1")
def a1_mask_coverage(spark, sf):
    px = b.probabilities(spark, sf)
    seg = px.groupBy("scene_id", F.floor(F.col("y") / 4).cast("int").alias("segment_id")).agg(F.collect_list(F.struct("y", "x")).alias("path"))
    return rounded(scoring.mask_coverage(seg, b.mask(spark, sf)).drop("scene_id"), 6)


@query("SELECT l_suppkey AS segment_id, round(least(stddev_pop(0.299 * l_quantity * 5 + 0.587 * l_discount * 2000 + 0.114 * l_tax * 2500) / 128, 1), 6) AS color_contrast FROM lineitem GROUP BY 1")
def a2_color_contrast(spark, sf):
    px = b.table(spark, sf, "lineitem").select(F.lit("s0").alias("scene_id"), F.col("l_suppkey").alias("segment_id"), (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2000).alias("g"), (F.col("l_tax") * 2500).alias("b"))
    return rounded(scoring.color_contrast(px).drop("scene_id"), 6)


@query(with_(b.SQL_GRAPH, "ge AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS segment_id FROM ed)", "dg AS (SELECT node, degree FROM deg)") + "SELECT segment_id, CASE WHEN segment_id % 9 = 0 THEN 0.0 ELSE ((a.degree >= 2)::INT + (c.degree >= 2)::INT) / 2.0::DOUBLE END AS connectivity FROM ge JOIN dg a ON a.node = src JOIN dg c ON c.node = dst")
def a4_connectivity(spark, sf):
    e = _segments_graph(spark, sf)
    n = graphs.nodes_of(e).select(F.lit("s0").alias("scene_id"), "node", (100 * F.ascii("node")).alias("y"), F.substring("node", 2, 20).cast("int").alias("x"))
    at = lambda c: F.struct((100 * F.ascii(c)).alias("y"), F.substring(c, 2, 20).cast("int").alias("x"))
    seg = e.select("scene_id", F.col("segment_id").cast("long").alias("segment_id"), F.array(at("src"), at("dst")).alias("path"))
    d = graphs.degrees(e).withColumn("scene_id", F.lit("s0"))
    return scoring.connectivity(seg, n, d, seg.where("segment_id % 9 = 0")).drop("scene_id")


@query("SELECT p_partkey AS id, CASE WHEN (p_partkey % 10) / 10.0 < 0.34 THEN 'noise' WHEN p_size < 14 AND p_partkey % 180 < 80 THEN 'invalid' ELSE 'valid' END AS kind, CASE WHEN p_size > 40 THEN 'long' WHEN p_size > 15 THEN 'medium' ELSE 'short' END AS band FROM part")
def a25_spur_taxonomy(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select(k.alias("id"), analytics.spur_kind(F.col("p_size"), k % 10 / 10.0, k % 180).alias("kind"), scoring.length_band("p_size").alias("band"))


@query(with_(b.SQL_PX) + "SELECT round((2 * sum(t * p) + 1) / (sum(t + p) + 1), 6) AS soft_dice, round((sum(t * p) + 1) / (sum(t + p) - sum(t * p) + 1), 6) AS soft_iou, round(avg(-(t * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - t) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6) AS bce FROM (SELECT abs(p) AS p, (p * (1 + label / 10) >= 0.16)::INT::DOUBLE AS t FROM px)")
def a29_soft_metrics(spark, sf):
    px = b.probabilities(spark, sf).withColumn("p", F.abs("p"))
    return rounded(inference.soft_metrics(px, b.truth(spark, sf)).drop("scene_id"), 6)


@query("WITH f AS (SELECT o_orderkey AS k, o_orderkey % 10 AS n, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'valid' END AS split FROM orders) SELECT split AS part, count(*) AS pairs, ceil(count(*) / 8.0)::BIGINT AS steps FROM f GROUP BY 1")
def a34_dataset_summary(spark, sf):
    p = b.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("valid").alias("part"))
    return manifests.dataset_summary(p).join(manifests.training_plan(p, 8), "part")


@query("SELECT c_custkey AS id, 's' || c_custkey || '.png' AS name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def s6_pairs_by_name(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("n"))
    side = lambda folder, k: c.where(F.col("id") % k == 0).select(F.concat(F.lit(folder), F.col("n")).alias("path"))
    out = manifests.pair_by_name(side("images/", 2), side("masks/", 3))
    return out.select(F.regexp_extract("name", r"\d+", 0).cast("long").alias("id"), "name")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey % 4 <> 3 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def s4_training_pairs(spark, sf):
    c = b.table(spark, sf, "customer")
    text = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    m = c.select(text("").alias("image_id"), F.when(F.col("c_nationkey") % 4 != 3, "train").otherwise("valid").alias("split"), text("s").alias("sat_image_path"), text("m").alias("mask_path"))
    files = c.where("c_custkey % 5 <> 0").select(text("s").alias("path")).unionByName(c.where("c_custkey % 7 <> 0").select(text("m").alias("path")))
    return manifests.training_pairs(m, files).select(F.col("image_id").cast("long").alias("id"))


@query(with_(b.SQL_PATH) + "SELECT path_id, count(*) - 1 AS steps, round(sum(px), 3) AS sx, round(sum(y) - arg_min(y, i), 3) AS sy FROM st GROUP BY path_id")
def s8_path_segments(spark, sf):
    s = vectors.path_segments(b.paths(spark, sf), ["path_id"])
    return s.groupBy("path_id").agg(F.count("*").alias("steps"), F.round(F.sum("ax"), 3).alias("sx"), F.round(F.sum("by"), 3).alias("sy"))


@query(with_(b.SQL_PATH, "n AS (SELECT count(*) AS c FROM v)") + "SELECT 'LineString' AS type, count(DISTINCT path_id) AS features, (SELECT c FROM n) AS points FROM v UNION ALL SELECT 'Point', (SELECT c FROM n), (SELECT c FROM n)")
def k1_geojson(spark, sf):
    p = b.paths(spark, sf)
    nodes = b.vertices(spark, sf).select("scene_id", F.col("eid").alias("node"), "x", "y", F.lit("endpoint").alias("kind"))
    edges = p.select("scene_id", F.lit(0).alias("src"), F.lit(1).alias("dst"), g.path_length(F.col("path")).alias("length_px"), F.col("path").alias("pixels"))
    f = vectors.geojson_features(nodes, edges).select(F.from_json("feature", "geometry struct<type:string,coordinates:string>").alias("f"))
    n = F.when(F.col("f.geometry.type") == "Point", 1).otherwise(F.size(F.from_json("f.geometry.coordinates", "array<array<double>>")))
    return f.groupBy(F.col("f.geometry.type").alias("type")).agg(F.count("*").alias("features"), F.sum(n).alias("points"))


@query("SELECT p_partkey AS id, greatest(abs(p_partkey % 13 + 1 - p_partkey % 11), abs(p_partkey % 7 - p_size), 1) + 1 AS points FROM part")
def k3_interpolated_bridges(spark, sf):
    k = F.col("p_partkey")
    pt = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return b.table(spark, sf, "part").select(k.alias("id"), F.size(g.interpolate_line(pt(k % 11, F.col("p_size")), pt(k % 13 + 1, k % 7))).cast("long").alias("points"))


@query()
def t12_scene_network(spark, sf):
    """The whole plan over four bands of the raster as scenes."""
    px = b.probabilities(spark, sf)
    name = F.concat(F.lit("band"), (F.col("label") % 4).cast("string"))
    rows = px.where(F.col("p") >= b.STRONG).select(name.alias("scene_id"), "y", "x")
    sc = px.groupBy(name.alias("scene_id")).agg((F.max("y") + 1).alias("height"), F.lit(b.WIDTH).alias("width"))
    wide = raster.dilate(rows, g.ellipse(2), sc)
    c = F.round(F.abs("p") * 255)
    rgb = px.select(name.alias("scene_id"), "y", "x", c.alias("r"), (255 - c).alias("g"), (c / 2).alias("b"))
    return rounded(scene.analyse(wide, sc, rgb=rgb).summary)


@query()
def a27_occlusions(spark, sf):
    sc = b.scenes(spark, sf)
    return inference.occluded_pixels(inference.occlusions(sc, b.mask(spark, sf, b.STRONG)), sc).select("y", "x")


@query(with_(b.SQL_PX) + "SELECT y, x, round(least(greatest(round(abs(p) * 255), 0), 255) / 255.0::DOUBLE, 4) AS p FROM px")
def f19_model_inference(spark, sf):
    """A stand-in model (the mean of the channels) over tiles and views."""
    px = b.probabilities(spark, sf)
    c = F.least(F.greatest(F.round(F.abs("p") * 255), F.lit(0)), F.lit(255)).cast("int")
    rgb = px.select("scene_id", "y", "x", c.alias("r"), c.alias("g"), c.alias("b"))
    return rounded(inference.predict_tiles(rgb, b.scenes(spark, sf), lambda images: images.mean(3), 32, 16).select("y", "x", "p"))


@query()
def r2_snap_and_split(spark, sf):
    from .queries import _lattice

    n, e = _lattice(spark)
    q = b.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.lit("s0").alias("scene_id"), (F.col("r_regionkey") * 37 + 19).cast("double").alias("sx"), F.lit(2.0).alias("sy"), F.lit(263.0).alias("ex"), F.lit(278.0).alias("ey"))
    none = spark.createDataFrame([], "scene_id string, ax double, ay double, bx double, by double")
    return rounded(routing.routes(q, n, e, none, routing.Options(snap=30.0, routes=2)).select("query_id", "route_id", "length_m", "score", "error"))


@query("WITH RECURSIVE " + CLASS_CTE + " SELECT rank, name, count(path_id) AS count, round(count(path_id) * 100.0 / (SELECT count(*) FROM clf), 1) AS percentage FROM (VALUES (0, 'Primary Arterial'), (1, 'Secondary Collector'), (2, 'Local Road'), (3, 'Minor / Unpaved')) t(rank, name) LEFT JOIN clf ON road_class = name GROUP BY rank, name"
    " UNION ALL SELECT rank, name, count(path_id), round(count(path_id) * 100.0 / (SELECT count(*) FROM clf), 1) FROM (VALUES (0, 'High Quality'), (1, 'Moderate'), (2, 'Requires Review')) t(rank, name) LEFT JOIN clf ON quality_tier = name GROUP BY rank, name")
def k7_report_tables(spark, sf):
    return analytics.class_distribution(_classified(spark, sf)).select("rank", F.col("road_class").alias("name"), "count", "percentage").unionByName(analytics.tier_distribution(_classified(spark, sf)).select("rank", F.col("quality_tier").alias("name"), "count", "percentage"))


@query()
def t5_bridges(spark, sf):
    """Accepted links after matching."""
    rows = topology.score_links(b.links(spark, sf).drop("mask_evidence"), b.links(spark, sf).select("scene_id", "link_id", "mask_evidence"), ["link_id"])
    c = rows.where("accepted").select((F.col("link_id") % 60).alias("a"), (F.col("link_id") % 47 + 60).alias("b"), F.round("score", 9).alias("score"))
    return graphs.greedy_match(c)
