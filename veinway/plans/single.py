"""One query for each scalar, join, order or source that no other query shows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import signals as s
from ..operators import analytics, graphs, kernels, raster, routing, scoring, spatial, topology
from ..operators.components import connected_components
from ..operators.ranking import numbered
from ..session import work_dir
from ..sources import manifests, vectors
from . import bindings as b
from . import scene
from .more import PAIRS, _pairs
from .queries import CLASS_CTE, GEO_EDGES, LENGTHS, SCORES, _classified, _scored, _segments_graph, query, rounded, with_

# ---------------------------------------------------------------- link signals


def _signal(name: str, column: str) -> None:
    def f(spark, sf):
        return rounded(_scored(spark, sf).select("link_id", column), 6)

    f.__name__ = name
    query(with_(b.SQL_LINKS) + f"SELECT link_id, round({column}, 6) AS {column} FROM sg")(f)


for _name, _column in (("t2a", "endpoint_distance"), ("t2b", "direction_compat"), ("t2c", "approach_align"), ("t2e", "width_consistency"), ("t2f", "centerline_continuity"), ("t2g", "gap_penalty")):
    _signal(f"{_name}_{_column}", _column)


@query(with_(b.SQL_PX, "pr AS (SELECT p_partkey AS k, p_partkey % height AS y, p_partkey % 61 AS x, p_partkey % height + p_size % 9 - 4 AS ry, p_partkey % 61 + p_partkey % 13 - 6 AS rx FROM part, sc)", "sm AS (SELECT k, round_even(y + i / 20.0::DOUBLE * (ry - y), 0)::INT AS y, round_even(x + i / 20.0::DOUBLE * (rx - x), 0)::INT AS x FROM pr, range(21) t(i))")
    + "SELECT k AS link_id, round(avg((weak.y IS NOT NULL)::INT), 6) AS mask_evidence FROM sm CROSS JOIN sc LEFT JOIN weak ON weak.y = sm.y AND weak.x = sm.x WHERE sm.y BETWEEN 0 AND height - 1 AND sm.x BETWEEN 0 AND width - 1 GROUP BY k")
def t2d_mask_evidence(spark, sf):
    k, sc = F.col("p_partkey"), b.scenes(spark, sf)
    p = b.table(spark, sf, "part").crossJoin(F.broadcast(sc)).select("scene_id", k.alias("link_id"), (k % F.col("height")).cast("int").alias("y"), (k % 61).cast("int").alias("x"), (k % F.col("height") + F.col("p_size") % 9 - 4).cast("int").alias("ry"), (k % 61 + k % 13 - 6).cast("int").alias("rx"))
    return rounded(topology.mask_support(p, b.mask(spark, sf), sc, ["link_id"]).drop("scene_id"), 6)


# ---------------------------------------------------------------- confidence and quality


@query(SCORES + "SELECT segment_id, round(straightness, 6) AS straightness FROM so")
def a3_straightness(spark, sf):
    return rounded(b.scores(spark, sf).select("segment_id", s.straightness(F.col("curvature")).alias("straightness")), 6)


@query(SCORES + "SELECT segment_id, round(length_score, 6) AS length_score FROM so")
def a5_length_score(spark, sf):
    return rounded(b.scores(spark, sf).select("segment_id", s.length_score(F.col("length_px")).alias("length_score")), 6)


@query("WITH RECURSIVE " + CLASS_CTE + " SELECT path_id, quality_score, quality_tier FROM clf")
def a11_quality(spark, sf):
    return _classified(spark, sf).select("path_id", "quality_score", "quality_tier")


@query("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'long' WHEN p_size > 15 THEN 'medium' ELSE 'short' END AS band FROM part")
def a30_length_band(spark, sf):
    return b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scoring.length_band("p_size").alias("band"))


@query("SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'valid' END AS part, ceil(count(*) / 16.0)::BIGINT AS steps FROM orders GROUP BY 1")
def a35_training_plan(spark, sf):
    return manifests.training_plan(b.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("valid").alias("part")), 16)


ROUTE_ROWS = "SELECT CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE p_partkey::VARCHAR END AS id, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice END AS length_pixels, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_size::DOUBLE END AS length_meters, CASE WHEN p_partkey % 3 = 0 THEN 'Unmapped Route Segment' ELSE p_brand END AS status, '[[' || p_size || ',1],[2,3]]' AS coordinates FROM part WHERE p_partkey % 2 = 0"


@query(ROUTE_ROWS)
def a36_route_rows(spark, sf):
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    some = lambda n, value: F.when(k % n != 0, value)
    props = F.create_map(F.lit("id"), some(4, text("p_partkey")), F.lit("length_pixels"), some(5, text("p_retailprice")), F.lit("length_meters"), some(7, text("p_size")), F.lit("status"), some(3, F.col("p_brand")))
    return analytics.route_rows(b.table(spark, sf, "part").select(F.when(k % 2 == 0, "LineString").otherwise("Point").alias("geometry_type"), F.concat(F.lit("[["), text("p_size"), F.lit(",1],[2,3]]")).alias("coordinates"), props.alias("properties")))


@query()
def a20_excess_endpoints(spark, sf):
    return analytics.excess_endpoints(b.mask(spark, sf, b.STRONG), b.truth(spark, sf), b.scenes(spark, sf))


@query()
def a24_stage_table(spark, sf):
    sc = b.scenes(spark, sf)
    raw = b.mask(spark, sf, b.STRONG)
    wide = raster.dilate(raw, g.ellipse(2), sc)
    net = scene.analyse(wide, sc)
    return rounded(analytics.stage_table(raw, wide, kernels.skeletons(wide, sc), net.nodes, net.edges, net.components, net.intersections, sc))


@query(with_(b.SQL_PX, b.SQL_PATH, LENGTHS, "dg AS (SELECT m.y, m.x, count(n.y) AS degree FROM weak m CROSS JOIN (VALUES (-1), (0), (1)) p(dy) CROSS JOIN (VALUES (-1), (0), (1)) q(dx) LEFT JOIN weak n ON n.y = m.y + dy AND n.x = m.x + dx AND (dy <> 0 OR dx <> 0) GROUP BY m.y, m.x)")
    + "SELECT 's0' AS scene_id, (SELECT count(*) FROM weak) AS mask_pixels, (SELECT count(*) FROM strong) AS skeleton_pixels, (SELECT count(*) FROM ln2) AS segments, round((SELECT sum(length) FROM ln2), 2) AS total_length_px, round((SELECT avg(points) FROM ln2), 4) AS mean_width_px, round((SELECT avg(straight) FROM ln2), 4) AS mean_curvature, (SELECT count(*) FROM dg WHERE degree >= 3) AS junctions, (SELECT count(*) FROM dg WHERE degree = 1) AS endpoints")
def a32_geometry_row(spark, sf):
    p = F.col("path")
    seg = b.paths(spark, sf).select("scene_id", g.path_length(p).alias("length_px"), F.size("path").cast("double").alias("width_px"), g.straight_distance(p).alias("curvature"))
    out = analytics.geometry_row(seg, raster.classify_pixels(b.mask(spark, sf)), b.mask(spark, sf), b.mask(spark, sf, b.STRONG))
    return out.withColumn("total_length_px", F.round("total_length_px", 2)).withColumn("mean_width_px", F.round("mean_width_px", 4)).withColumn("mean_curvature", F.round("mean_curvature", 4))


BLOCKS = "pp AS (SELECT y // 4 AS segment_id, row_number() OVER (PARTITION BY y // 4 ORDER BY y, x) - 1 AS i, abs(p) * 255 AS r FROM px)"


@query(with_(b.SQL_PX, BLOCKS) + "SELECT segment_id, round(avg(r), 6) AS r, round(avg(255 - r), 6) AS g, round(avg(r / 2), 6) AS b FROM pp WHERE i % 3 = 0 GROUP BY segment_id")
def g6_mean_color(spark, sf):
    px = b.probabilities(spark, sf)
    seg = px.groupBy("scene_id", F.floor(F.col("y") / 4).cast("int").alias("segment_id")).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("path"))
    c = F.abs("p") * 255
    return rounded(scoring.mean_color(seg, px.select("scene_id", "y", "x", c.alias("r"), (255 - c).alias("g"), (c / 2).alias("b"))).drop("scene_id"), 6)


# ---------------------------------------------------------------- geometry


@query(with_(b.SQL_PATH, "n AS (SELECT path_id, max(i) AS m FROM v GROUP BY path_id)", "tp AS (SELECT path_id, t.y - u.y AS dy, t.x - u.x AS dx FROM n JOIN v t USING (path_id) JOIN v u USING (path_id) WHERE t.i = m AND u.i = m - least(8, m))")
    + "SELECT path_id, round(CASE WHEN sqrt(dy * dy + dx * dx) < 1e-6 THEN 0.0 ELSE dy / sqrt(dy * dy + dx * dx) END, 6) + 0.0 AS y, round(CASE WHEN sqrt(dy * dy + dx * dx) < 1e-6 THEN 1.0 ELSE dx / sqrt(dy * dy + dx * dx) END, 6) + 0.0 AS x FROM tp")
def g9_tail_vector(spark, sf):
    t = b.paths(spark, sf).select("path_id", g.tail_vector(F.col("path"), F.lit(True)).alias("t"))
    return t.select("path_id", (F.round("t.y", 6) + 0.0).alias("y"), (F.round("t.x", 6) + 0.0).alias("x"))


@query("SELECT p_partkey AS id, round(p_size * 100.0::DOUBLE / 51, 2) AS x_pct FROM part")
def g16_percent_position(spark, sf):
    return b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), g.percent_position(F.col("p_size"), F.lit(51)).alias("x_pct"))


@query(with_(b.SQL_PATH, LENGTHS) + "SELECT path_id, round(CASE WHEN straight > 0 THEN length / straight ELSE 1 END, 4) AS sinuosity FROM ln2")
def g17_sinuosity(spark, sf):
    return rounded(b.paths(spark, sf).select("path_id", g.sinuosity(g.path_length(F.col("path")), g.straight_distance(F.col("path"))).alias("sinuosity")))


@query(with_(PAIRS) + "SELECT id, round(sqrt((ax - qx) ** 2 + (ay - qy) ** 2), 6) AS distance FROM pr")
def g20_point_distance(spark, sf):
    return rounded(_pairs(spark, sf).select("id", g.distance(*(F.col(c) for c in ("ay", "ax", "by", "bx"))).alias("distance")), 6)


# ---------------------------------------------------------------- joins


@query("SELECT 't' || s_suppkey || '.png' AS name FROM supplier JOIN part ON p_partkey = s_suppkey")
def j1_images_and_masks(spark, sf):
    path = lambda folder, c: F.concat(F.lit(folder), F.lit("/t"), F.col(c).cast("string"), F.lit(".png")).alias("path")
    return manifests.pair_by_name(b.table(spark, sf, "supplier").select(path("a", "s_suppkey")), b.table(spark, sf, "part").select(path("b", "p_partkey"))).select("name")


@query("SELECT p_partkey AS segment_id, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE greatest(abs(p_partkey % 9 - p_partkey % 5), abs(p_partkey % 4 - p_size), 1) + 1 END AS points FROM part")
def j2_edges_and_segments(spark, sf):
    k, i = F.col("p_partkey"), lambda c: c.cast("int")
    p = b.table(spark, sf, "part")
    e = p.select(F.lit("s0").alias("scene_id"), k.alias("segment_id"), F.lit(1.0).alias("length_px"), i(F.col("p_size")).alias("src_y"), i(k % 5).alias("src_x"), i(k % 4).alias("dst_y"), i(k % 9).alias("dst_x"))
    seg = p.where("p_partkey % 2 = 0").select(F.lit("s0").alias("scene_id"), k.alias("segment_id"), F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x")), F.struct(F.lit(5).alias("y"), F.lit(5).alias("x"))).alias("path"))
    return topology.attach_paths(e, seg).select("segment_id", F.size("pixels").cast("long").alias("points"))


@query("WITH e AS (SELECT c_custkey AS id, c_acctbal / 10 AS y, (c_custkey * 7 % 1000)::DOUBLE AS x FROM customer) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) AS gap FROM e a JOIN e b ON a.id < b.id AND abs(a.x - b.x) <= 7 AND abs(a.y - b.y) <= 7 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 7")
def j6_small_gaps(spark, sf):
    e = b.table(spark, sf, "customer").select(F.lit("s0").alias("scene_id"), F.col("c_custkey").alias("a"), (F.col("c_acctbal") / 10).alias("y"), (F.col("c_custkey") * 7 % 1000).cast("double").alias("x"))
    return rounded(spatial.range_join(e, e.select("scene_id", F.col("a").alias("b"), F.col("y").alias("ry"), F.col("x").alias("rx")), 7.0).where("a < b").select("a", "b", "gap"))


@query(with_(b.SQL_GRAPH, GEO_EDGES, "i AS (SELECT src AS node, segment_id FROM ge UNION ALL SELECT dst, segment_id FROM ge)") + "SELECT node, count(*) * (count(*) - 1) // 2 AS pairs FROM i GROUP BY node HAVING count(*) > 1")
def j8_incident_pairs(spark, sf):
    e = _segments_graph(spark, sf)
    return topology.continuity_links(e, e.withColumn("direction_deg", F.lit(0.0))).groupBy("node").agg(F.count("*").alias("pairs"))


@query(with_(b.SQL_PATH, b.SQL_REF, "t AS (SELECT v.path_id, v.i, v.x, v.y, ax, ay, qx, qy, CASE WHEN (qx - ax) ** 2 + (qy - ay) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, ((v.x - ax) * (qx - ax) + (v.y - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) END AS t FROM v JOIN rf ON abs(v.y - ay) <= 12)")
    + "SELECT path_id, i AS pos, round(min(sqrt((x - ax - t * (qx - ax)) ** 2 + (y - ay - t * (qy - ay)) ** 2)), 4) AS distance FROM t GROUP BY path_id, i HAVING min(sqrt((x - ax - t * (qx - ax)) ** 2 + (y - ay - t * (qy - ay)) ** 2)) <= 5")
def j9_points_on_the_network(spark, sf):
    v = b.paths(spark, sf).select("scene_id", "path_id", F.posexplode("path").alias("pos", "p")).select("scene_id", "path_id", F.col("pos").cast("long").alias("pos"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return rounded(spatial.point_network_distance(v, b.reference(spark, sf), ["path_id", "pos"], reach=5.0).where("distance <= 5").drop("scene_id"))


@query(with_(b.SQL_PX) + "SELECT 'both' AS kind, count(*) AS pixels FROM (SELECT * FROM strong INTERSECT SELECT * FROM gt) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM strong EXCEPT SELECT * FROM gt) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM gt EXCEPT SELECT * FROM strong)")
def j11_epochs(spark, sf):
    a, c = b.mask(spark, sf, b.STRONG), b.truth(spark, sf)
    n = lambda kind, df: df.agg(F.count("*").alias("pixels")).select(F.lit(kind).alias("kind"), "pixels")
    return n("both", raster.algebra(a, c, "and")).unionByName(n("first", raster.algebra(a, c, "not"))).unionByName(n("second", raster.algebra(c, a, "not")))


@query(with_(b.SQL_PX, b.sql_labels("weak", "lp"), b.sql_labels("gt", "lt")) + "SELECT lt.label AS truth, lp.label AS pred, count(*) AS pixels FROM lt JOIN lp USING (y, x) GROUP BY 1, 2")
def j12_component_overlaps(spark, sf):
    lab = lambda m, name: raster.label(m).select(*raster.PX, (F.col("label_y") * b.WIDTH + F.col("label_x")).alias(name))
    return lab(b.truth(spark, sf), "truth").join(lab(b.mask(spark, sf), "pred"), raster.PX).groupBy("truth", "pred").agg(F.count("*").alias("pixels"))


@query(with_(b.SQL_PX, b.sql_labels("weak", "lab")) + "SELECT label FROM lab GROUP BY label HAVING label IN (SELECT label FROM lab JOIN strong USING (y, x))")
def j13_strong_components(spark, sf):
    weak = raster.label(b.mask(spark, sf))
    strong = raster.threshold(b.probabilities(spark, sf), b.STRONG)
    return weak.join(strong.select(*raster.PX), raster.PX, "left_semi").select((F.col("label_y") * b.WIDTH + F.col("label_x")).alias("label")).distinct()


# ---------------------------------------------------------------- graphs


@query(with_(b.SQL_GRAPH, "n AS (SELECT count(*) AS n FROM nd)", "m AS (SELECT count(*) AS m FROM ed)") + "SELECT round(2.0 * m / (n * (n - 1)), 4) AS density, round(least(m / (3.0 * (n - 2)), 1.0) * 100, 1) AS gamma_percent FROM n, m")
def n2_density_and_gamma(spark, sf):
    e = b.graph(spark, sf)
    return graphs.intelligence(graphs.nodes_of(e), e).select("density", "gamma_percent")


@query("SELECT 0 AS nodes, 0 AS edges, 0.0::DOUBLE AS avg_degree, 0 AS max_degree, 0.0::DOUBLE AS density, 0 AS components, 0 AS dead_ends, 0 AS junctions, 0.0::DOUBLE AS gamma_percent")
def n5_empty_graph(spark, sf):
    e = spark.createDataFrame([], "src string, dst string")
    return graphs.intelligence(graphs.nodes_of(e), e)


# ---------------------------------------------------------------- order and limits


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place, o_orderkey AS id FROM orders")
def o1_runs_by_date(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    return numbered(o.withColumn("before", -F.col("day")), ["before", "id"], "place").select("place", "id")


@query(with_(b.SQL_GRAPH, b.SQL_COMP) + "SELECT row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS place, component, count(*) AS size FROM comp GROUP BY component")
def o2_components_by_size(spark, sf):
    c = graphs.component_table(connected_components(b.graph(spark, sf)))
    return c.select(F.col("id").cast("long").alias("place"), "component", F.col("count").alias("size"))


@query(with_(b.SQL_LINKS) + "SELECT k.link_id, round(k.score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, gap, link_id) AS n FROM sx) k WHERE n <= 12")
def o3_best_candidates(spark, sf):
    """The feature is the cut: the twelve best links, the shorter gap first among equals."""
    return rounded(_scored(spark, sf).orderBy(F.desc(F.round("score", 9)), "gap", "link_id").limit(12).select("link_id", "score"), 6)


@query("WITH e AS (SELECT c_custkey AS id, c_acctbal / 10 AS y, (c_custkey * 7 % 1000)::DOUBLE AS x FROM customer), s AS (SELECT s_suppkey AS node, s_acctbal / 10 AS ry, (s_suppkey * 11 % 1000)::DOUBLE AS rx FROM supplier), p AS (SELECT id, node, sqrt((x - rx) ** 2 + (y - ry) ** 2) AS gap FROM e JOIN s ON abs(x - rx) <= 90 AND abs(y - ry) <= 90) SELECT id, arg_min(node, (gap, node)) AS node FROM p WHERE gap <= 90 GROUP BY id")
def o5_nearest(spark, sf):
    e = b.table(spark, sf, "customer").select(F.lit("s0").alias("scene_id"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("y"), (F.col("c_custkey") * 7 % 1000).cast("double").alias("x"))
    r = b.table(spark, sf, "supplier").select(F.lit("s0").alias("scene_id"), F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 10).alias("ry"), (F.col("s_suppkey") * 11 % 1000).cast("double").alias("rx"))
    return spatial.nearest_within(e, r, 90.0, ["id"], "node").select("id", "node")


@query(with_(b.SQL_PX) + "SELECT 't' || lpad((y // 8)::VARCHAR, 9, '0') AS scene_id, count(*) AS road_pixels FROM strong GROUP BY 1 HAVING count(*) > 0.04 * 8 * 64 ORDER BY 1 LIMIT 10")
def o6_rich_samples(spark, sf):
    """The feature is the cut: the first ten tiles that show enough road."""
    name = F.concat(F.lit("t"), F.lpad(F.floor(F.col("y") / 8).cast("string"), 9, "0"))
    m = b.mask(spark, sf, b.STRONG).select(name.alias("scene_id"), (F.col("y") % 8).alias("y"), "x")
    sc = b.probabilities(spark, sf).select(name.alias("scene_id")).distinct().select("scene_id", F.lit(8).alias("height"), F.lit(b.WIDTH).alias("width"))
    return analytics.rich_samples(m, sc, 10)


def _sets(op: str, name: str, keyword: str) -> None:
    def f(spark, sf):
        return raster.algebra(b.mask(spark, sf), b.truth(spark, sf), op).select("y", "x")

    f.__name__ = name
    query(with_(b.SQL_PX) + f"SELECT y, x FROM weak {keyword} SELECT y, x FROM gt")(f)


_sets("or", "o7_mask_union", "UNION")
_sets("and", "o9_mask_intersection", "INTERSECT")
_sets("not", "o9_mask_difference", "EXCEPT")


@query(with_(b.SQL_PX) + "SELECT 'added' AS kind, y, x FROM (SELECT y, x FROM gt EXCEPT SELECT y, x FROM strong) UNION ALL SELECT 'removed', y, x FROM (SELECT y, x FROM strong EXCEPT SELECT y, x FROM gt)")
def o10_mask_difference_by_side(spark, sf):
    a, c = b.mask(spark, sf, b.STRONG), b.truth(spark, sf)
    side = lambda kind, df: df.select(F.lit(kind).alias("kind"), "y", "x")
    return side("added", raster.algebra(c, a, "not")).unionByName(side("removed", raster.algebra(a, c, "not")))


@query(with_(b.SQL_GRAPH, GEO_EDGES) + "SELECT segment_id FROM ge WHERE src LIKE 'a%' UNION SELECT segment_id FROM ge WHERE src LIKE 'c%'")
def o8_id_union(spark, sf):
    e = _segments_graph(spark, sf)
    out = topology.disconnected_segments(e, connected_components(e), e.where("src like 'c%'"))
    return out.select(F.col("segment_id").cast("long").alias("segment_id"))


# ---------------------------------------------------------------- sources and sinks


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'val' AS part, greatest(1, floor(n * 0.2))::BIGINT AS pairs FROM n UNION ALL SELECT 'train', n - greatest(1, floor(n * 0.2))::BIGINT FROM n")
def s5_train_val_split(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return manifests.dataset_summary(manifests.split_train_val(o, ["id"]))


def _catalog(spark, sf) -> DataFrame:
    o, text = b.table(spark, sf, "orders"), lambda c: F.col(c).cast("string")
    return o.select(F.concat(F.lit("run-"), text("o_orderkey")).alias("id"), text("o_orderstatus").alias("status"))


@query("SELECT 'run-' || o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def s11_run_lookup(spark, sf):
    last = b.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return manifests.lookup(_catalog(spark, sf), f"run-{last}")


@query("SELECT 'run-' || o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders)")
def k10_run_deletion(spark, sf):
    last = b.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return manifests.without_run(_catalog(spark, sf), f"run-{last}")


def _files(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A graph for each nation: customers, and each one's link to the next by key."""
    c = b.table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scene_id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 100).alias("x"))
    nodes = c.select("scene_id", F.col("k").cast("string").alias("node"), "x", "y", F.when(F.col("k") % 3 == 0, "endpoint").otherwise("junction").alias("kind"))
    point = lambda: F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edges = c.where("k > 1").select("scene_id", F.col("k").cast("string").alias("src"), (F.col("k") - 1).cast("string").alias("dst"), (F.col("k") % 37).cast("double").alias("length_px"), F.col("k").cast("int").alias("segment_id"), F.lit("geometry_segment").alias("edge_kind"), F.array(point(), point()).alias("pixels"))
    return nodes, edges


@query("SELECT 'n' || c_nationkey AS scene_id, count(*) AS nodes, count(*) FILTER (WHERE c_custkey > 1) AS edges FROM customer GROUP BY 1")
def k2_graphml(spark, sf):
    nodes, edges = _files(spark, sf)
    made = vectors.graphml(nodes, edges)
    times = lambda tag: (F.size(F.split("graphml", f"<{tag} ")) - 1).cast("long")
    return made.select("scene_id", times("node").alias("nodes"), times("edge").alias("edges"))


@query("SELECT least(c_custkey::VARCHAR, (c_custkey - 1)::VARCHAR) AS src, greatest(c_custkey::VARCHAR, (c_custkey - 1)::VARCHAR) AS dst, (c_custkey % 37)::DOUBLE AS length_px, c_custkey::INT AS segment_id, 2 AS points FROM customer WHERE c_custkey > 1")
def s7_read_graphml(spark, sf):
    """Written by the sink, then read."""
    nodes, edges = _files(spark, sf)
    path = work_dir(spark, "graphml")
    vectors.write_texts(vectors.graphml(nodes, edges), "graphml", path)
    return vectors.read_graphml(spark, f"{path}/*/*.txt")[1].select("src", "dst", "length_px", "segment_id", F.size("pixels").cast("long").alias("points"))


# ---------------------------------------------------------------- routes


@query(with_(b.SQL_PATH, LENGTHS) + "SELECT path_id, greatest(0, CASE WHEN m > 0 THEN (length - m) / m ELSE 0 END) > 0.5 AS long_way, round(length * 0.15, 4) AS length_m FROM ln2, (SELECT min(length) FILTER (WHERE length > 0) AS m FROM ln2)")
def r6_excess_over_the_least(spark, sf):
    p = b.paths(spark, sf).select("path_id", g.path_length(F.col("path")).alias("length"))
    least = p.where("length > 0").agg(F.min("length").alias("m"))
    j = p.crossJoin(F.broadcast(least))
    return rounded(j.select("path_id", (F.greatest(F.lit(0.0), (F.col("length") - F.col("m")) / F.col("m")) > 0.5).alias("long_way"), (F.col("length") * routing.METRES_PER_PIXEL).alias("length_m")))
