"""Queries by operator over the driver's tables, each beside its SQL twin.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` to SQL for DuckDB where
SQL can say the same. Floats are rounded at the output, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import analytics, graphs, kernels, raster, routing, scoring, spatial, topology
from ..operators.components import connected_components
from ..operators.ranking import numbered
from ..sources import vectors
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


OFFS = "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx in g.NEIGHBOURS) + ") o(dy, dx)"


def values(pairs: list[tuple[int, int]], name: str) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx in pairs) + f") {name}(dy, dx)"


def sql_dilate(source: str, kernel: list[tuple[int, int]]) -> str:
    return f"(SELECT DISTINCT {source}.y + dy AS y, {source}.x + dx AS x FROM {source}, {values(kernel, 'kd')}, sc WHERE {source}.y + dy BETWEEN 0 AND height - 1 AND {source}.x + dx BETWEEN 0 AND width - 1)"


# ---------------------------------------------------------------- raster


@query(with_(b.SQL_PX) + "SELECT y, x FROM strong")
def f1_threshold(spark, sf):
    return raster.threshold(b.probabilities(spark, sf), b.STRONG).select("y", "x")


@query(with_(b.SQL_PX, b.sql_labels("weak", "lab")) + "SELECT l.y, l.x FROM lab l WHERE l.label IN (SELECT label FROM lab JOIN strong USING (y, x))")
def f2_hysteresis(spark, sf):
    return raster.hysteresis(b.probabilities(spark, sf), b.STRONG, 0.5).select("y", "x")


@query(with_(b.SQL_PX, b.sql_labels("weak", "lab")) + "SELECT y, x FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 8)")
def f4_drop_small_components(spark, sf):
    return raster.drop_small(b.mask(spark, sf), 8).select("y", "x")


def sql_shifted(source: str, kernel: list[tuple[int, int]], key: str = "") -> str:
    """Pixels all of whose kernel is in ``source`` or outside the scene; ``key``: a further column that a pixel must share."""
    k, on = (f"{key}, ", f" AND s.{key} = c.{key}") if key else ("", "")
    cells = f"(SELECT DISTINCT {k}y - dy AS y, x - dx AS x FROM {source}, {values(kernel, 'ko')})"
    return (f"(SELECT {'c.' + key + ', ' if key else ''}c.y, c.x FROM {cells} c CROSS JOIN {values(kernel, 'ke')} CROSS JOIN sc LEFT JOIN {source} s ON s.y = c.y + ke.dy AND s.x = c.x + ke.dx{on} WHERE c.y BETWEEN 0 AND height - 1 AND c.x BETWEEN 0 AND width - 1"
        f" GROUP BY ALL HAVING count(s.y) = count(*) FILTER (c.y + ke.dy BETWEEN 0 AND height - 1 AND c.x + ke.dx BETWEEN 0 AND width - 1))").replace("GROUP BY ALL", f"GROUP BY {'c.' + key + ', ' if key else ''}c.y, c.x")


def sql_close(source: str, out: str, kernel: list[tuple[int, int]]) -> list[str]:
    """CTEs of a dilation and an erosion by the kernel turned about."""
    return [f"{out}_d AS " + sql_dilate(source, kernel), f"{out} AS " + sql_shifted(f"{out}_d", [(-dy, -dx) for dy, dx in kernel])]


NEAR_ME = values([(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], "o")


def sql_specks(source: str, out: str) -> list[str]:
    """CTEs of the pixels in components of fewer than 4: those are what their pixels reach in three steps."""
    return [f"{out}_n AS (SELECT a.y * 64 + a.x AS s, c.y * 64 + c.x AS d FROM (SELECT y, x, dy, dx FROM {source}, " + NEAR_ME + f") a JOIN {source} c ON c.y = a.y + a.dy AND c.x = a.x + a.dx)", f"{out}_f AS (SELECT s FROM {out}_n GROUP BY s HAVING count(*) < 4)", f"{out}_1 AS (SELECT s, d FROM {out}_n JOIN {out}_f USING (s))",
        f"{out}_2 AS (SELECT DISTINCT a.s, n.d FROM {out}_1 a JOIN {out}_n n ON n.s = a.d)", f"{out}_3 AS (SELECT DISTINCT a.s, n.d FROM {out}_2 a JOIN {out}_n n ON n.s = a.d)", f"{out} AS (SELECT (s // 64)::INT AS y, (s % 64)::INT AS x FROM {out}_3 GROUP BY s HAVING count(*) < 4)"]


@query(with_(b.SQL_PX, "cm AS (SELECT y, x FROM px WHERE p < 0)", *sql_specks("cm", "few")) + "SELECT y, x FROM px WHERE p >= 0 UNION SELECT y, x FROM few")
def f5_fill_small_holes(spark, sf):
    return raster.fill_holes(b.mask(spark, sf, 0.0), b.scenes(spark, sf), 4).select("y", "x")


@query(with_(b.SQL_PX) + "SELECT y, x FROM " + sql_dilate("strong", g.ellipse(2)))
def f6_dilate(spark, sf):
    return raster.dilate(b.mask(spark, sf, b.STRONG), g.ellipse(2), b.scenes(spark, sf)).select("y", "x")


@query(with_(b.SQL_PX, "lo AS (SELECT y, x FROM px WHERE p >= -0.1)", "n AS (SELECT lo.y + dy AS y, lo.x + dx AS x, count(*) AS c FROM lo, " + values(g.cross(), "k") + " GROUP BY ALL)") + "SELECT n.y, n.x FROM n, sc WHERE n.y BETWEEN 0 AND height - 1 AND n.x BETWEEN 0 AND width - 1 AND c = 1 + (n.y > 0)::INT + (n.x > 0)::INT + (n.y < height - 1)::INT + (n.x < width - 1)::INT")
def f6_erode(spark, sf):
    return raster.erode(b.mask(spark, sf, -0.1), g.cross(), b.scenes(spark, sf)).select("y", "x")


@query(with_(b.SQL_PX, "d AS " + sql_dilate("weak", g.cross()), "n AS (SELECT d.y + dy AS y, d.x + dx AS x, count(*) AS c FROM d, " + values(g.cross(), "k") + " GROUP BY ALL)") + "SELECT n.y, n.x FROM n, sc WHERE n.y BETWEEN 0 AND height - 1 AND n.x BETWEEN 0 AND width - 1 AND c = 1 + (n.y > 0)::INT + (n.x > 0)::INT + (n.y < height - 1)::INT + (n.x < width - 1)::INT")
def f6_close(spark, sf):
    return raster.close(b.mask(spark, sf), g.cross(), b.scenes(spark, sf)).select("y", "x")


BRIDGES = {"c1": g.rectangle(1, 5), "c2": g.rectangle(5, 1), "c3": g.diagonal(5), "c4": g.diagonal(5, falling=False)}


@query(with_(b.SQL_PX, *sql_specks("weak", "speck"), "big AS (SELECT y, x FROM weak EXCEPT SELECT y, x FROM speck)", "out0 AS (SELECT y, x FROM px EXCEPT SELECT y, x FROM big)", *sql_specks("out0", "hole"), "full0 AS (SELECT y, x FROM big UNION ALL SELECT y, x FROM hole)", *sql_close("full0", "c0", g.ellipse(1)), *(p for name, kernel in BRIDGES.items() for p in sql_close("c0", name, kernel))) + " UNION ".join(f"SELECT y, x FROM c{i}" for i in range(5)))
def f7_repair(spark, sf):
    return raster.repair(b.mask(spark, sf), b.scenes(spark, sf), least=4, radius=1, bridge=5).select("y", "x")


@query(with_(b.SQL_PX, b.sql_labels("weak", "lab"), "stt AS (SELECT label, count(*) AS area, greatest(max(y) - min(y), max(x) - min(x)) + 1 AS major, least(max(y) - min(y), max(x) - min(x)) + 1 AS minor FROM lab GROUP BY label)",
    "sml AS (SELECT * FROM stt WHERE area < 20 AND major >= 4 AND major / minor::DOUBLE >= 2)", "rch AS (SELECT DISTINCT lab.label, lab.y + dy AS y, lab.x + dx AS x FROM lab JOIN sml USING (label), " + values(g.ellipse(4), "kc") + ")",
    "kp AS (SELECT label FROM stt WHERE area >= 20 UNION SELECT label FROM sml WHERE area <= floor(major * 1.5) UNION SELECT rch.label FROM rch JOIN lab ON lab.y = rch.y AND lab.x = rch.x AND lab.label <> rch.label)",
    "own AS (SELECT lab.label, lab.y, lab.x FROM lab JOIN kp USING (label))", "od AS (SELECT DISTINCT label, own.y + dy AS y, own.x + dx AS x FROM own, " + values(g.ellipse(1), "kd") + ", sc WHERE own.y + dy BETWEEN 0 AND height - 1 AND own.x + dx BETWEEN 0 AND width - 1)",
    "oe AS " + sql_shifted("od", g.ellipse(1), "label")) + "SELECT DISTINCT y, x FROM oe")
def f8_clean(spark, sf):
    return raster.clean(b.mask(spark, sf), b.scenes(spark, sf), least=20, radius=1, span=4, aspect=2.0).select("y", "x")


@query(with_(b.SQL_PX) + "SELECT 'and' AS op, count(*) AS pixels FROM (SELECT * FROM weak INTERSECT SELECT * FROM gt) UNION ALL SELECT 'not', count(*) FROM (SELECT * FROM weak EXCEPT SELECT * FROM gt) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM weak UNION SELECT * FROM gt) UNION ALL SELECT 'xor', count(*) FROM ((SELECT * FROM weak EXCEPT SELECT * FROM gt) UNION ALL (SELECT * FROM gt EXCEPT SELECT * FROM weak))")
def f9_mask_algebra(spark, sf):
    a, t = b.mask(spark, sf), b.truth(spark, sf)
    parts = [raster.algebra(a, t, op).agg(F.count("*").alias("pixels")).select(F.lit(op).alias("op"), "pixels") for op in ("and", "not", "or", "xor")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(with_(b.SQL_PX) + "SELECT count(*) AS pixels, sum(y * 64 + x)::BIGINT AS checksum FROM " + sql_dilate("strong", g.ellipse(10)))
def f10_buffer(spark, sf):
    out = raster.dilate(b.mask(spark, sf, b.STRONG), g.ellipse(10), b.scenes(spark, sf))
    return out.agg(F.count("*").alias("pixels"), F.sum((F.col("y") * 64 + F.col("x")).cast("long")).alias("checksum"))


DEGREE = "dg AS (SELECT m.y, m.x, count(n.y) AS degree FROM weak m CROSS JOIN " + OFFS + " LEFT JOIN weak n ON n.y = m.y + o.dy AND n.x = m.x + o.dx GROUP BY m.y, m.x)"


@query(with_(b.SQL_PX, DEGREE) + "SELECT y, x, degree FROM dg")
def f11_neighbour_degree(spark, sf):
    return raster.degree(b.mask(spark, sf)).select("y", "x", F.col("degree").cast("long").alias("degree"))


@query(with_(b.SQL_PX, DEGREE) + "SELECT coalesce(CASE WHEN degree >= 3 THEN 'junction' WHEN degree = 1 THEN 'endpoint' END, 'none') AS kind, count(*) AS pixels FROM dg GROUP BY 1")
def f12_classify_pixels(spark, sf):
    return raster.classify_pixels(b.mask(spark, sf)).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("pixels"))


@query(with_(b.SQL_PX) + "SELECT 's0' AS scene_id, (SELECT count(*) FROM weak) AS road_pixels, height::BIGINT * width AS pixels, round((SELECT count(*) FROM weak) / (height::DOUBLE * width), 6) AS road_share FROM sc")
def f13_mask_stats(spark, sf):
    return rounded(raster.mask_stats(b.mask(spark, sf), b.scenes(spark, sf)), 6)


@query(with_(b.SQL_PX) + "SELECT y // 2 AS y, x // 2 AS x, round(avg(p), 6) AS p FROM px GROUP BY 1, 2")
def f14_shrink(spark, sf):
    return rounded(raster.shrink(b.probabilities(spark, sf), 2).select("y", "x", "p"), 6)


@query(with_(b.SQL_PX, "h AS (SELECT DISTINCT unnest(list_concat(range(0, greatest(height - 16, 0) + 1, 8), [greatest(height - 16, 0)]))::INT AS ty FROM sc)", "w AS (SELECT DISTINCT unnest(list_concat(range(0, greatest(width - 16, 0) + 1, 8), [greatest(width - 16, 0)]))::INT AS tx FROM sc)") + "SELECT ty, tx FROM h, w")
def f15_tiles(spark, sf):
    return raster.tiles(b.scenes(spark, sf), 16, 8).select("ty", "tx")


@query(with_(b.SQL_PX, "h AS (SELECT DISTINCT unnest(list_concat(range(0, greatest(height - 16, 0) + 1, 8), [greatest(height - 16, 0)]))::INT AS ty FROM sc)", "w AS (SELECT DISTINCT unnest(list_concat(range(0, greatest(width - 16, 0) + 1, 8), [greatest(width - 16, 0)]))::INT AS tx FROM sc)",
    "t AS (SELECT px.y, px.x, px.p * (1 + (ty % 3) / 10.0::DOUBLE) AS p, greatest((0.5 - 0.5 * cos(2 * pi() * (px.y - ty) / 15)) * (0.5 - 0.5 * cos(2 * pi() * (px.x - tx) / 15)), 1e-4) AS w FROM h, w, px WHERE px.y BETWEEN ty AND ty + 15 AND px.x BETWEEN tx AND tx + 15)") + "SELECT y, x, round(sum(p * w) / greatest(sum(w), 1e-6), 6) AS p FROM t GROUP BY y, x")
def f16_blend_tiles(spark, sf):
    t = F.broadcast(raster.tiles(b.scenes(spark, sf), 16, 8))
    px = b.probabilities(spark, sf)
    # a pixel meets its tiles by the blocks of eight rows and columns that they cover
    parts = t.select("scene_id", "ty", "tx", F.explode(F.sequence(F.col("ty"), F.col("ty") + 15)).alias("y"))
    tiles = px.join(parts, ["scene_id", "y"]).where("x between tx and tx + 15")
    tiles = tiles.select("scene_id", "ty", "tx", (F.col("y") - F.col("ty")).alias("i"), (F.col("x") - F.col("tx")).alias("j"), (F.col("p") * (1 + (F.col("ty") % 3) / 10.0)).alias("p"))
    return rounded(raster.blend_tiles(tiles, 16).select("y", "x", "p"), 6)


@query(with_(b.SQL_PX) + "SELECT y, x, round((p + p + p + 2 * p) / 4, 6) AS p FROM px")
def f17_average_views(spark, sf):
    px, sc = b.probabilities(spark, sf).select("scene_id", "y", "x", "p"), b.scenes(spark, sf)
    j = px.join(sc, "scene_id")
    view = lambda n, y, x, p=F.col("p"): j.select("scene_id", F.lit(n).alias("view"), y.alias("y"), x.alias("x"), p.alias("p"))
    y, x, h, w = (F.col(c) for c in ("y", "x", "height", "width"))
    views = view("identity", y, x).unionByName(view("hflip", y, w - 1 - x)).unionByName(view("vflip", h - 1 - y, x)).unionByName(view("rot90", w - 1 - x, y, F.col("p") * 2))
    return rounded(raster.average_views(views, sc).select("y", "x", "p"), 6)


@query(with_(b.SQL_PX) + "SELECT y, x, round(0.25 * (p / 2) + 0.75 * p, 6) AS p FROM px")
def f18_blend_scales(spark, sf):
    px = b.probabilities(spark, sf)
    return rounded(raster.blend_scales(px, px.withColumn("p", F.col("p") / 2)).select("y", "x", "p"), 6)


@query()
def f20_skeletonize(spark, sf):
    return kernels.skeletons(raster.close(b.mask(spark, sf), g.ellipse(1), b.scenes(spark, sf)), b.scenes(spark, sf)).select("y", "x")


@query(with_(b.SQL_PX, b.sql_labels("weak", "lab")) + "SELECT label // 64 AS label_y, label % 64 AS label_x, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM lab GROUP BY label")
def i1_pixel_components(spark, sf):
    return raster.component_stats(b.mask(spark, sf)).drop("scene_id")


@query(with_(b.SQL_PX) + "SELECT a.y, a.x, round(coalesce(min(sqrt((o.dy * o.dy + o.dx * o.dx)::DOUBLE)) FILTER (WHERE c.y IS NOT NULL), 3), 6) AS distance FROM (SELECT y, x FROM px WHERE p >= 0) a CROSS JOIN " + values([(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 9], "o") + " LEFT JOIN (SELECT y, x FROM px WHERE p < 0) c ON c.y = a.y + o.dy AND c.x = a.x + o.dx GROUP BY a.y, a.x")
def p17_distance_transform(spark, sf):
    return rounded(raster.distance_to_background(b.mask(spark, sf, 0.0), b.scenes(spark, sf), 3).select("y", "x", "distance"), 6)


@query()
def p16_extract_segments(spark, sf):
    wide = raster.dilate(b.mask(spark, sf, b.STRONG), g.ellipse(2), b.scenes(spark, sf))
    out = kernels.extract_segments(wide, b.scenes(spark, sf))
    return rounded(out.select("segment_id", F.size("path").alias("points"), "length_px", "direction_deg", "curvature", "width_px"))


@query()
def t1_geometry_graph(spark, sf):
    wide = raster.dilate(b.mask(spark, sf, b.STRONG), g.ellipse(2), b.scenes(spark, sf))
    return rounded(kernels.extract_network(wide, b.scenes(spark, sf)).drop("pixels"))


# ---------------------------------------------------------------- metrics and change

CONFUSION = "cf AS (SELECT (SELECT count(*) FROM (SELECT * FROM strong INTERSECT SELECT * FROM gt))::DOUBLE AS tp, (SELECT count(*) FROM (SELECT * FROM strong EXCEPT SELECT * FROM gt))::DOUBLE AS fp, (SELECT count(*) FROM (SELECT * FROM gt EXCEPT SELECT * FROM strong))::DOUBLE AS fn, (SELECT count(*) FROM px)::DOUBLE AS n)"


@query(with_(b.SQL_PX, CONFUSION) + "SELECT 's0' AS scene_id, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + 1e-6) / (tp + fp + 1e-6), 6) AS precision, round((tp + 1e-6) / (tp + fn + 1e-6), 6) AS recall, round((n - fp - fn) / n, 6) AS accuracy FROM cf")
def a18_pixel_metrics(spark, sf):
    return rounded(analytics.pixel_metrics(analytics.confusion(b.mask(spark, sf, b.STRONG), b.truth(spark, sf), b.scenes(spark, sf))), 6)


@query(with_(b.SQL_PX, b.sql_labels("weak", "lp"), b.sql_labels("gt", "lt"), "kp AS (SELECT label, count(*) AS a FROM lp GROUP BY label HAVING count(*) >= 8)", "kt AS (SELECT label, count(*) AS a FROM lt GROUP BY label HAVING count(*) >= 8)",
    "br AS (SELECT count(*) AS broken FROM (SELECT lt.label FROM lt JOIN lp USING (y, x) WHERE lt.label IN (SELECT label FROM kt) AND lp.label IN (SELECT label FROM kp) GROUP BY lt.label HAVING count(DISTINCT lp.label) >= 2))",
    "ag AS (SELECT (SELECT count(*) FROM kt) AS nt, (SELECT count(*) FROM kp) AS np, (SELECT broken FROM br) AS broken, coalesce((SELECT max(a) / sum(a)::DOUBLE FROM kt), 0) AS lt, coalesce((SELECT max(a) / sum(a)::DOUBLE FROM kp), 0) AS lp)") +
    "SELECT 's0' AS scene_id, nt AS gt_components, np AS pred_components, round(np / greatest(nt, 1)::DOUBLE, 6) AS fragmentation_ratio, broken AS broken_segments, round(CASE WHEN nt > 0 THEN broken * 100.0::DOUBLE / nt ELSE 0 END, 6) AS broken_pct, round(lt, 6) AS lcc_ratio_gt, round(lp, 6) AS lcc_ratio_pred, round(CASE WHEN lt > 0 THEN lp / lt ELSE 0 END, 6) AS lcc_preservation FROM ag")
def a19_fragmentation(spark, sf):
    return rounded(analytics.fragmentation(b.mask(spark, sf), b.truth(spark, sf), b.scenes(spark, sf)), 6)


@query(with_(b.SQL_PX, "sz AS (SELECT * FROM strong INTERSECT SELECT * FROM zn)", "gz AS (SELECT * FROM gt INTERSECT SELECT * FROM zn)", "cz AS (SELECT (SELECT count(*) FROM (SELECT * FROM sz INTERSECT SELECT * FROM gz))::DOUBLE AS tp, (SELECT count(*) FROM (SELECT * FROM sz EXCEPT SELECT * FROM gz))::DOUBLE AS fp, (SELECT count(*) FROM (SELECT * FROM gz EXCEPT SELECT * FROM sz))::DOUBLE AS fn)") +
    "SELECT 's0' AS scene_id, round((tp + 1e-6) / (tp + fn + 1e-6), 6) AS gap_recall, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS gap_iou, round((tp + 1e-6) / (tp + fp + 1e-6), 6) AS gap_precision FROM cz")
def a21_gap_metrics(spark, sf):
    return rounded(analytics.gap_metrics(b.mask(spark, sf, b.STRONG), b.truth(spark, sf), b.scenes(spark, sf), b.zone(spark, sf)), 6)


@query(with_(b.SQL_PX, "r AS (SELECT y, avg((p >= 0.16)::INT) AS share, avg(p) AS mean_p, max(CASE WHEN label IN (0, 1) THEN p END) AS gap FROM px GROUP BY y)") + "SELECT count(*) AS num_samples, round(avg(share), 6) AS share, round(stddev_pop(share), 6) AS share_std, round(avg(mean_p), 6) AS mean_p, round(stddev_pop(mean_p), 6) AS mean_p_std, round(coalesce(avg(gap), 0), 6) AS gap FROM r")
def a22_dataset_means(spark, sf):
    px = b.probabilities(spark, sf)
    rows = px.groupBy("y").agg(F.avg((F.col("p") >= b.STRONG).cast("int")).alias("share"), F.avg("p").alias("mean_p"), F.max(F.when(F.col("label").isin(0, 1), F.col("p"))).alias("gap"))
    return rounded(analytics.dataset_means(rows, ["share", "mean_p"], {"gap": "gap"}), 6)


@query(with_(b.SQL_PX, "ba AS " + sql_dilate("strong", g.ellipse(1)), "bb AS " + sql_dilate("gt", g.ellipse(1))) + "SELECT 'added' AS change, count(*) AS pixels, coalesce(sum(y * 64 + x), 0)::BIGINT AS checksum FROM (SELECT * FROM gt EXCEPT SELECT * FROM ba) UNION ALL SELECT 'removed', count(*), coalesce(sum(y * 64 + x), 0)::BIGINT FROM (SELECT * FROM strong EXCEPT SELECT * FROM bb) UNION ALL SELECT 'unchanged', count(*), coalesce(sum(y * 64 + x), 0)::BIGINT FROM (SELECT * FROM gt INTERSECT SELECT * FROM ba)")
def a14_change_detection(spark, sf):
    out = analytics.changes(b.mask(spark, sf, b.STRONG), b.truth(spark, sf), b.scenes(spark, sf), 1)
    names = spark.createDataFrame([("added",), ("removed",), ("unchanged",)], "change string")
    n = out.groupBy("change").agg(F.count("*").alias("n"), F.sum((F.col("y") * 64 + F.col("x")).cast("long")).alias("s"))
    return names.join(n, "change", "left").select("change", F.coalesce("n", F.lit(0)).alias("pixels"), F.coalesce("s", F.lit(0)).alias("checksum"))


# ---------------------------------------------------------------- graph


@query(with_(b.SQL_GRAPH, b.SQL_COMP) + "SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, round((SELECT avg(degree) FROM deg), 2) AS avg_degree, (SELECT max(degree) FROM deg) AS max_degree, (SELECT count(*) FROM deg WHERE degree = 1) AS dead_ends, (SELECT count(*) FROM deg WHERE degree >= 3) AS junctions, (SELECT count(DISTINCT component) FROM comp) AS components, round(2.0 * (SELECT count(*) FROM ed) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1)), 4) AS density, round(least((SELECT count(*) FROM ed) / (3.0 * ((SELECT count(*) FROM nd) - 2)), 1.0) * 100, 1) AS gamma_percent")
def n1_network_intelligence(spark, sf):
    e = b.graph(spark, sf)
    return graphs.intelligence(graphs.nodes_of(e), e)


@query(with_(b.SQL_GRAPH) + "SELECT label, (SELECT count(*) FROM deg WHERE least(degree, 4) = k) AS count, round((SELECT count(*) FROM deg WHERE least(degree, 4) = k) * 100.0 / (SELECT count(*) FROM deg), 1) AS percentage FROM (VALUES (1, 'Dead End (Degree 1)'), (2, 'Continuation (Degree 2)'), (3, 'T-Junction (Degree 3)'), (4, 'Complex Intersection (Degree 4+)')) t(k, label)")
def n1_degree_distribution(spark, sf):
    return graphs.degree_distribution(graphs.degrees(b.graph(spark, sf)))


@query(with_(b.SQL_GRAPH, b.SQL_COMP) + "SELECT row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS id, component, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM nd), 1) AS percentage FROM comp GROUP BY component")
def n3_component_table(spark, sf):
    return graphs.component_table(connected_components(b.graph(spark, sf))).withColumn("id", F.col("id").cast("long"))


@query(with_(b.SQL_GRAPH, b.SQL_COMP, "rk AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS g FROM comp GROUP BY component)") + "SELECT comp.node, degree, g AS \"group\" FROM comp JOIN deg USING (node) JOIN rk USING (component)")
def n4_node_link(spark, sf):
    e = b.graph(spark, sf)
    return graphs.node_link(graphs.nodes_of(e), e)[0].withColumn("group", F.col("group").cast("long"))


@query("WITH n AS (SELECT c_custkey AS node, c_nationkey AS x, c_acctbal AS y FROM customer) SELECT node, round(40 + (x - (SELECT min(x) FROM n)) / (SELECT (max(x) - min(x))::DOUBLE FROM n) * 520, 4) AS vx, round(360 - (y - (SELECT min(y) FROM n)) / (SELECT max(y) - min(y) FROM n) * 320, 4) AS vy FROM n")
def n6_viewport(spark, sf):
    n = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("x"), F.col("c_acctbal").alias("y"))
    return rounded(graphs.viewport(n).select("node", "vx", "vy"))


@query(with_(b.SQL_GRAPH) + "SELECT node, CASE WHEN node LIKE 'p%' THEN CASE WHEN degree < 3 THEN 'passthrough' ELSE 'junction' END ELSE 'endpoint' END AS kind FROM deg")
def t6_graph_cleanup(spark, sf):
    e = b.graph(spark, sf)
    lone = spark.createDataFrame([("x-none",)], "node string")
    nodes = graphs.nodes_of(e).unionByName(lone).withColumn("kind", F.when(F.col("node").startswith("p"), "junction").otherwise("endpoint"))
    return graphs.cleanup(nodes, e)[0]


GEO_EDGES = "ge AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS segment_id FROM ed)"


def _segments_graph(spark, sf) -> DataFrame:
    e = numbered(b.graph(spark, sf), ["src", "dst"], "segment_id").withColumn("segment_id", F.col("segment_id") + 1)
    return e.withColumn("scene_id", F.lit("s0")).withColumn("edge_kind", F.lit("geometry_segment"))


@query(with_(b.SQL_GRAPH, GEO_EDGES) + "SELECT node, degree, CASE degree WHEN 3 THEN 'T' WHEN 4 THEN 'X' ELSE 'complex' END AS kind, ids AS segment_ids FROM deg JOIN (SELECT dst AS node, string_agg(segment_id::VARCHAR, ',' ORDER BY segment_id) AS ids FROM ge GROUP BY dst) USING (node) WHERE node LIKE 'p%' AND degree >= 3")
def t7_intersections(spark, sf):
    e = _segments_graph(spark, sf)
    nodes = graphs.nodes_of(e).where("node like 'p%'").select(F.lit("s0").alias("scene_id"), "node", F.lit("junction").alias("kind"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    return topology.intersections(nodes, e).select("node", "degree", "kind", F.array_join(F.col("segment_ids").cast("array<string>"), ",").alias("segment_ids"))


@query(with_(b.SQL_GRAPH, GEO_EDGES, "i AS (SELECT src AS node, segment_id FROM ge UNION ALL SELECT dst, segment_id FROM ge)", "d AS (SELECT node, segment_id, (segment_id * 37 % 180)::DOUBLE AS dir FROM i)") + "SELECT a.node, a.segment_id AS segment_a, b.segment_id AS segment_b, least(abs(a.dir - b.dir), 180 - abs(a.dir - b.dir)) AS angle_diff FROM d a JOIN d b ON a.node = b.node AND a.segment_id < b.segment_id WHERE least(abs(a.dir - b.dir), 180 - abs(a.dir - b.dir)) <= 30")
def t8_continuity_links(spark, sf):
    e = _segments_graph(spark, sf)
    return topology.continuity_links(e, e.withColumn("direction_deg", (F.col("segment_id") * 37 % 180).cast("double"))).drop("scene_id")


@query(with_(b.SQL_GRAPH, b.SQL_COMP, GEO_EDGES) + "SELECT min(segment_id) AS segment_id FROM ge JOIN comp ON comp.node = ge.src GROUP BY component HAVING count(*) = 1 UNION SELECT segment_id FROM ge WHERE src LIKE 'c%'")
def t9_disconnected_segments(spark, sf):
    e = _segments_graph(spark, sf)
    out = topology.disconnected_segments(e, connected_components(e), e.where("src like 'c%'"))
    return out.select(F.col("segment_id").cast("long").alias("segment_id"))


@query(with_(b.SQL_GRAPH, b.SQL_COMP) + "SELECT node, component FROM comp")
def t10_graph_components(spark, sf):
    return connected_components(b.graph(spark, sf))


@query(with_(b.SQL_GRAPH, b.SQL_COMP, GEO_EDGES) + "SELECT (SELECT count(*) FROM nd) AS total_nodes, (SELECT count(*) FROM deg WHERE degree = 1) AS endpoints, 0 AS isolated_nodes, (SELECT count(*) FROM ed) AS total_edges, (SELECT count(*) FROM ge WHERE segment_id % 40 < 12) AS very_short_edge_count, 0 AS bridge_edges, 0 AS weak_bridges, (SELECT count(DISTINCT component) FROM comp) AS connected_components, 0 AS edgeless_components, 0 AS rejected_connection_count, 0 AS suspicious_connection_count")
def t11_connectivity_diagnostics(spark, sf):
    e = _segments_graph(spark, sf).withColumn("length_px", F.col("segment_id") % 40).withColumn("connection_score", F.lit(1.0))
    return topology.diagnostics(graphs.nodes_of(e), e, connected_components(e))


@query(with_(b.SQL_GRAPH) + "SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, 0 AS loops, 0 AS dangling_ends")
def t14_graph_validation(spark, sf):
    e = b.graph(spark, sf)
    return graphs.validate(graphs.nodes_of(e), e)


@query(with_(b.SQL_GRAPH, "hops(n, d) USING KEY (n) AS (SELECT (SELECT min(src) FROM ed WHERE src LIKE 'o%'), 0 UNION (SELECT arcs.b, min(hops.d) + 1 FROM hops JOIN arcs ON arcs.a = hops.n LEFT JOIN recurring.hops AS r ON r.n = arcs.b WHERE r.n IS NULL GROUP BY arcs.b))") + "SELECT n AS node, d::DOUBLE AS distance FROM hops")
def r5_shortest_distances(spark, sf):
    e = b.graph(spark, sf)
    return graphs.hop_distances(e, e.where("src like 'o%'").agg(F.min("src")).first()[0])


@query()
def t5_greedy_matching(spark, sf):
    e = b.graph(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.abs(F.xxhash64("src", "dst")) % 1000 / 1000).alias("score"))
    return graphs.greedy_match(e)


# ---------------------------------------------------------------- bridges


@query(with_(b.SQL_LINKS) + "SELECT link_id, round(endpoint_distance, 6) AS endpoint_distance, round(direction_compat, 6) AS direction_compat, round(approach_align, 6) AS approach_align, round(width_consistency, 6) AS width_consistency, round(centerline_continuity, 6) AS centerline_continuity, round(gap_penalty, 6) AS gap_penalty FROM sg")
def t2_bridge_signals(spark, sf):
    return rounded(_scored(spark, sf).select("link_id", *topology.GEOMETRIC, "gap_penalty"), 6)


def _scored(spark, sf) -> DataFrame:
    rows = b.links(spark, sf)
    support = rows.select("scene_id", "link_id", "mask_evidence")
    return topology.score_links(rows.drop("mask_evidence"), support, ["link_id"])


@query(with_(b.SQL_LINKS) + "SELECT link_id, round(score, 6) AS score FROM sx")
def t3_composite_score(spark, sf):
    return rounded(_scored(spark, sf).select("link_id", "score"), 6)


@query(with_(b.SQL_LINKS) + "SELECT link_id, geo + (mask_evidence >= 0.7)::INT AS evidence_count, score >= 0.74 AND mask_evidence >= 0.7 AND geo >= 4 AND approach_align >= 0.72 AND centerline_continuity >= 0.62 AS accepted FROM sh")
def t4_evidence_gate(spark, sf):
    return _scored(spark, sf).select("link_id", "evidence_count", "accepted")


@query("WITH e AS (SELECT c_custkey AS id, c_acctbal / 10 AS y, (c_custkey * 7 % 1000)::DOUBLE AS x FROM customer) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS gap FROM e a JOIN e b ON a.id < b.id AND abs(a.x - b.x) <= 18 AND abs(a.y - b.y) <= 18 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN 1.5 AND 18")
def j5_endpoint_pairs(spark, sf):
    e = b.table(spark, sf, "customer").select(F.lit("s0").alias("scene_id"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("y"), (F.col("c_custkey") * 7 % 1000).cast("double").alias("x"))
    return spatial.pairs_within(e, 18.0, least=1.5, digits=4).select("a", "b", "gap")


@query("WITH e AS (SELECT c_custkey AS id, c_acctbal / 10 AS y, (c_custkey * 7 % 1000)::DOUBLE AS x FROM customer), s AS (SELECT s_suppkey AS node, s_acctbal / 10 AS ry, (s_suppkey * 11 % 1000)::DOUBLE AS rx FROM supplier), p AS (SELECT id, node, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS gap FROM e JOIN s ON abs(x - rx) <= 40 AND abs(y - ry) <= 40) SELECT id, arg_min(node, (gap, node)) AS node, round(min(gap), 4) AS gap FROM p WHERE gap <= 40 GROUP BY id")
def j4_nearest_node(spark, sf):
    e = b.table(spark, sf, "customer").select(F.lit("s0").alias("scene_id"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("y"), (F.col("c_custkey") * 7 % 1000).cast("double").alias("x"))
    s = b.table(spark, sf, "supplier").select(F.lit("s0").alias("scene_id"), F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 10).alias("ry"), (F.col("s_suppkey") * 11 % 1000).cast("double").alias("rx"))
    return rounded(spatial.nearest_within(e, s, 40.0, ["id"], "node").select("id", "node", "gap"))


# ---------------------------------------------------------------- paths

LENGTHS = "ln2 AS (SELECT path_id, count(*) AS points, coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) AS length, sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2) AS straight FROM st GROUP BY path_id)"


@query(with_(b.SQL_PATH, LENGTHS) + "SELECT path_id, points, round(length, 4) AS length, round(straight, 4) AS straight, round(CASE WHEN straight > 0 THEN length / straight ELSE 1 END, 4) AS sinuosity FROM ln2")
def g1_path_length(spark, sf):
    p = b.paths(spark, sf).select("path_id", F.size("path").cast("long").alias("points"), g.path_length(F.col("path")).alias("length"), g.straight_distance(F.col("path")).alias("straight"))
    return rounded(p.withColumn("sinuosity", g.sinuosity(F.col("length"), F.col("straight"))))


@query(with_(b.SQL_PATH) + "SELECT path_id, round(CASE WHEN a < 0 THEN a + 180 ELSE a END, 4) AS direction_deg FROM (SELECT path_id, degrees(atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) / 2 AS a FROM v GROUP BY path_id HAVING count(*) >= 3)")
def g2_dominant_direction(spark, sf):
    return rounded(b.paths(spark, sf).where(F.size("path") >= 3).select("path_id", g.dominant_direction(F.col("path")).alias("direction_deg")))


@query(with_(b.SQL_PATH, "tn AS (SELECT path_id, abs(atan2(ny - y, nx - x) - atan2(y - py, x - px)) AS d FROM st WHERE px IS NOT NULL AND nx IS NOT NULL)") + "SELECT path_id, round(avg(least(d, 2 * pi() - d)), 6) AS curvature FROM tn GROUP BY path_id")
def g3_mean_curvature(spark, sf):
    return rounded(b.paths(spark, sf).where(F.size("path") >= 3).select("path_id", g.mean_curvature(F.col("path")).alias("curvature")), 6)


@query(with_(b.SQL_PATH) + "SELECT path_id, min(y) AS y0, round(min(x), 6) AS x0, max(y) AS y1, round(max(x), 6) AS x1 FROM v GROUP BY path_id")
def g5_bounding_box(spark, sf):
    p = b.paths(spark, sf).select("path_id", g.bounding_box(F.col("path")).alias("b"))
    return p.select("path_id", "b.y0", F.round("b.x0", 6).alias("x0"), "b.y1", F.round("b.x1", 6).alias("x1"))


REF = b.SQL_REF
NEAR = "tt AS (SELECT v.path_id, v.i, v.x, v.y, ax, ay, qx, qy, CASE WHEN (qx - ax) ** 2 + (qy - ay) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, ((v.x - ax) * (qx - ax) + (v.y - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) END AS t FROM v, rf), nr AS (SELECT path_id, i, min(sqrt((x - (ax + t * (qx - ax))) ** 2 + (y - (ay + t * (qy - ay))) ** 2)) AS distance FROM tt GROUP BY path_id, i)"


@query(with_(b.SQL_PATH, REF, NEAR) + "SELECT path_id, i AS pos, round(distance, 4) AS distance FROM nr")
def g11_network_distance(spark, sf):
    pts = b.paths(spark, sf).select("scene_id", "path_id", F.posexplode("path").alias("pos", "p")).select("scene_id", "path_id", F.col("pos").cast("long").alias("pos"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return rounded(spatial.point_network_distance(pts, b.reference(spark, sf), ["path_id", "pos"]).drop("scene_id"))


@query(with_(b.SQL_PATH, REF, NEAR) + "SELECT path_id, round(avg((distance <= 15)::INT), 6) AS overlap_ratio FROM nr GROUP BY path_id")
def r3_edge_overlap(spark, sf):
    e = b.paths(spark, sf).withColumnRenamed("path", "pixels")
    return rounded(routing.edge_overlap(e, b.reference(spark, sf), ["path_id"], 15.0).drop("scene_id"), 6)


@query(with_(b.SQL_PATH, REF, NEAR, LENGTHS, "ov AS (SELECT path_id, avg((distance <= 15)::INT) AS r FROM nr GROUP BY path_id)") + "SELECT path_id, round(CASE WHEN r > 0.1 THEN 1e9 ELSE length * (1 + r * 9) END, 4) AS closed, round(length * (1 + r * 9), 4) AS open FROM ov JOIN ln2 USING (path_id)")
def r4_edge_weight(spark, sf):
    p = b.paths(spark, sf)
    o = routing.edge_overlap(p.withColumnRenamed("path", "pixels"), b.reference(spark, sf), ["path_id"], 15.0)
    # whole paths are not broadcast
    j = p.join(o.hint("merge"), ["scene_id", "path_id"]).withColumn("length", g.path_length(F.col("path")))
    return rounded(j.select("path_id", routing.edge_weight(F.col("length"), F.col("overlap_ratio"), allow_existing=False).alias("closed"), routing.edge_weight(F.col("length"), F.col("overlap_ratio")).alias("open")))


@query(with_(b.SQL_PATH, REF, "v2 AS (SELECT path_id, i, (x + px) / 2 AS x, (y + py) / 2 AS y, sqrt((x - px) ** 2 + (y - py) ** 2) AS len FROM st WHERE px IS NOT NULL)",
    "t2 AS (SELECT v2.*, ax, ay, qx, qy, CASE WHEN (qx - ax) ** 2 + (qy - ay) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, ((v2.x - ax) * (qx - ax) + (v2.y - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) END AS t FROM v2, rf)",
    "n2 AS (SELECT path_id, i, any_value(len) AS len, min(sqrt((x - (ax + t * (qx - ax))) ** 2 + (y - (ay + t * (qy - ay))) ** 2)) AS d FROM t2 GROUP BY path_id, i)") + "SELECT path_id, round(coalesce(sum(len) FILTER (WHERE d <= 10), 0) / sum(len), 6) AS overlap FROM n2 GROUP BY path_id")
def g14_path_overlap(spark, sf):
    steps = vectors.path_segments(b.paths(spark, sf), ["scene_id", "path_id"])
    return rounded(routing.path_overlap(steps.drop("step"), b.reference(spark, sf), ["path_id"], 10.0).drop("scene_id"), 6)


@query(with_(b.SQL_PATH, "pt AS (SELECT path_id, i, px + (x - px) * k / n AS x, py + (y - py) * k / n AS y FROM (SELECT *, floor(sqrt((x - px) ** 2 + (y - py) ** 2) / 2)::INT AS n FROM st WHERE px IS NOT NULL) s, LATERAL (SELECT unnest(range(1, n + 1)) AS k) r WHERE n > 0 UNION ALL SELECT path_id, -1, x, y FROM v WHERE i = 0)") + "SELECT path_id, count(*) AS points, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy FROM pt GROUP BY path_id")
def g12_interpolate_literal(spark, sf):
    pts = analytics.resample(b.paths(spark, sf), ["path_id"], 2.0, literal=True)
    return pts.groupBy("path_id").agg(F.count("*").alias("points"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


@query(with_(b.SQL_PATH, LENGTHS, "am AS (SELECT length, straight, path_id, (path_id % 16 + 1)::DOUBLE AS w FROM ln2)", "wd AS (SELECT v.path_id, avg(1 + (v.y % 14)) AS mw, stddev_pop(1 + (v.y % 14)) AS sw FROM v GROUP BY v.path_id)",
    "cl AS (SELECT path_id, length, mw, sw, round(CASE WHEN straight > 0 THEN length / straight ELSE 1 END - 1, 3) AS curv, sw / mw AS rough FROM ln2 JOIN wd USING (path_id))",
    "kk AS (SELECT *, CASE WHEN mw >= 12 AND curv < 0.15 THEN 'Primary Arterial' WHEN mw >= 8 THEN 'Secondary Collector' WHEN mw >= 5 THEN 'Local Road' ELSE 'Minor / Unpaved' END AS k, least(greatest(90 - least(30, 5 * sw) - least(25, 50 * curv) - CASE WHEN length < 40 THEN 20 ELSE 0 END, 10), 100) AS q FROM cl)") +
    "SELECT path_id, CASE WHEN rough > 0.45 AND k IN ('Secondary Collector', 'Local Road') THEN 'Minor / Unpaved' ELSE k END AS road_class, round(mw, 2) AS mean_width, round(sw, 2) AS width_variation, curv AS curvature, round(rough, 2) AS roughness, round(q, 1) AS quality_score, CASE WHEN q >= 70 THEN 'High Quality' WHEN q >= 40 THEN 'Moderate' ELSE 'Requires Review' END AS quality_tier, round(length, 1) AS length_pixels, round(length * 0.15, 1) AS length_meters FROM kk")
def a10_classification(spark, sf):
    return _classified(spark, sf)


def _classified(spark, sf) -> DataFrame:
    widths = b.vertices(spark, sf).select("path_id", (1 + F.col("y") % 14).alias("width"))
    return analytics.classify(b.paths(spark, sf), widths, "path_id")


CLASSIFIED = ORACLES["a10_classification"].replace("WITH RECURSIVE ", "", 1)
_head, _body = CLASSIFIED.rsplit(") SELECT path_id, CASE", 1)
CLASS_CTE = _head + "), clf AS (SELECT path_id, CASE" + _body + ")"


@query("WITH RECURSIVE " + CLASS_CTE + " SELECT road_class, count(path_id) AS count, coalesce(round(sum(length_pixels) * 0.15 / 1000, 2), 0) AS length_km, round(count(path_id) * 100.0 / (SELECT count(*) FROM clf), 1) AS percentage FROM (VALUES ('Primary Arterial'), ('Secondary Collector'), ('Local Road'), ('Minor / Unpaved')) t(road_class) LEFT JOIN clf USING (road_class) GROUP BY road_class")
def a12_class_distribution(spark, sf):
    return analytics.class_distribution(_classified(spark, sf)).drop("rank")


@query("WITH RECURSIVE " + CLASS_CTE + " SELECT quality_tier, count(path_id) AS count, round(count(path_id) * 100.0 / (SELECT count(*) FROM clf), 1) AS percentage FROM (VALUES ('High Quality'), ('Moderate'), ('Requires Review')) t(quality_tier) LEFT JOIN clf USING (quality_tier) GROUP BY quality_tier")
def a12_tier_distribution(spark, sf):
    return analytics.tier_distribution(_classified(spark, sf)).drop("rank")


@query("WITH RECURSIVE " + CLASS_CTE + " SELECT path_id, road_class, quality_tier FROM clf WHERE road_class IN ('Local Road', 'Secondary Collector') AND quality_tier IN ('Moderate', 'Requires Review')")
def a13_visible_roads(spark, sf):
    return analytics.visible(_classified(spark, sf), ["Local Road", "Secondary Collector"], ["Moderate", "Requires Review"]).select("path_id", "road_class", "quality_tier")


UNMAPPED = with_(b.SQL_PATH, REF, NEAR, "fr AS (SELECT v.path_id, v.i, v.x, v.y, coalesce(distance, 1e9) > 15 AS far FROM v LEFT JOIN nr USING (path_id, i))", "rn AS (SELECT *, sum((NOT far)::INT) OVER (PARTITION BY path_id ORDER BY i) AS run FROM fr)", "sp AS (SELECT path_id, run, i, sqrt((x - lag(x) OVER q) ** 2 + (y - lag(y) OVER q) ** 2) AS step FROM rn WHERE far WINDOW q AS (PARTITION BY path_id, run ORDER BY i))",
    "um AS (SELECT path_id, run, count(*) AS points, coalesce(sum(step), 0) AS length, min(i) AS first_pos, max(i) AS last_pos FROM sp GROUP BY path_id, run HAVING count(*) >= 2 AND coalesce(sum(step), 0) >= 30)")


def _unmapped(spark, sf) -> DataFrame:
    pts = b.paths(spark, sf).select("scene_id", "path_id", F.posexplode("path").alias("pos", "p")).select("scene_id", "path_id", F.col("pos").cast("long").alias("pos"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    near = spatial.point_network_distance(pts, b.reference(spark, sf), ["path_id", "pos"], reach=15.0)
    return analytics.unmapped_runs(pts, near, ["path_id"])


@query(UNMAPPED + "SELECT path_id, run::BIGINT AS run, points, round(length, 4) AS length, first_pos, last_pos FROM um")
def a16_unmapped_runs(spark, sf):
    return rounded(_unmapped(spark, sf).drop("scene_id"))


@query(UNMAPPED + "SELECT count(*) AS routes, coalesce(round(sum(length) * 0.15 / 1000, 2), 0) AS length_km FROM um")
def a17_unmapped_summary(spark, sf):
    return analytics.unmapped_summary(_unmapped(spark, sf))


RESAMPLED = ["ds AS (SELECT path_id, i, x, y, px, py, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS d, nx IS NULL AS last FROM st)", "cu AS (SELECT *, sum(d) OVER (PARTITION BY path_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM ds)",
    "mk AS (SELECT *, unnest(list_concat(CASE WHEN d > 0 THEN list_transform(range(floor((e - d) / 2)::BIGINT + 1, floor(e / 2)::BIGINT + 1), lambda k: k * 2.0::DOUBLE) ELSE [] END, CASE WHEN i = 0 OR (last AND d > 0 AND floor(e / 2) * 2 < e) THEN [e] ELSE [] END)) AS m FROM cu)",
    "sm AS (SELECT path_id, m, CASE WHEN d > 0 THEN px + (x - px) * (m - (e - d)) / d ELSE x END AS x, CASE WHEN d > 0 THEN py + (y - py) * (m - (e - d)) / d ELSE y END AS y FROM mk)", "pt AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY m) - 1 AS i, x, y FROM sm)",
    "tt AS (SELECT pt.path_id, pt.i, pt.x, pt.y, ax, ay, qx, qy, CASE WHEN (qx - ax) ** 2 + (qy - ay) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, ((pt.x - ax) * (qx - ax) + (pt.y - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) END AS t FROM pt JOIN rf ON pt.x BETWEEN ax - 16 AND qx + 16 WHERE pt.y BETWEEN least(ay, qy) - 16 AND greatest(ay, qy) + 16)",
    "nr AS (SELECT path_id, i, min(sqrt((x - (ax + t * (qx - ax))) ** 2 + (y - (ay + t * (qy - ay))) ** 2)) AS distance FROM tt GROUP BY path_id, i)", "fr AS (SELECT pt.path_id, pt.i, pt.x, pt.y, coalesce(distance, 1e9) > 15 AS far FROM pt LEFT JOIN nr USING (path_id, i))"]
DISCOVERED = with_(b.SQL_PATH, REF, *RESAMPLED) + UNMAPPED[UNMAPPED.index(", rn AS ("):]


@query(DISCOVERED + "SELECT path_id, run::BIGINT AS run, points, round(length, 4) AS length, first_pos, last_pos FROM um")
def a16_discovery(spark, sf):
    return rounded(analytics.unmapped(b.paths(spark, sf), b.reference(spark, sf), ["path_id"]).drop("scene_id"))


@query(with_(b.SQL_PATH, "ky AS (SELECT printf('%.2f', px) || ',' || printf('%.2f', py) AS s, printf('%.2f', x) || ',' || printf('%.2f', y) AS d FROM st WHERE px IS NOT NULL)") + "SELECT count(*) AS edges FROM (SELECT DISTINCT least(s, d), greatest(s, d) FROM ky)")
def s9_graph_of_paths(spark, sf):
    return vectors.graph_of_paths(b.paths(spark, sf), ["path_id"])[1].agg(F.count("*").alias("edges"))


@query(with_(b.SQL_PATH, "pr AS (SELECT path_id, i, x, y, coalesce(nx - x, x - px) AS dx, coalesce(ny - y, y - py) AS dy  FROM st)") + "SELECT path_id, i AS pos, round(CASE WHEN dx = 0 AND dy = 0 THEN 1.0 ELSE -dy / sqrt(dx * dx + dy * dy) END, 4) AS nx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE dx / sqrt(dx * dx + dy * dy) END, 4) AS ny FROM pr")
def g18_vertex_normals(spark, sf):
    v = b.vertices(spark, sf)
    w = Window.partitionBy("path_id").orderBy("at", "eid")
    dx, dy = (F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w)) for c in ("x", "y"))
    v = v.select("path_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), dx.alias("dx"), dy.alias("dy")).withColumn("s", F.hypot("dx", "dy"))
    return rounded(v.select("path_id", "pos", F.when(F.col("s") == 0, 1.0).otherwise(F.try_divide(-F.col("dy"), F.col("s"))).alias("nx"), F.when(F.col("s") == 0, 0.0).otherwise(F.try_divide(F.col("dx"), F.col("s"))).alias("ny")))


# the paths run along x, so the probes run along y
@query(with_(b.SQL_PX, "wd AS " + sql_dilate("strong", g.ellipse(2)), "pb AS (SELECT k AS segment_id, j AS pos, 3 * j AS x, side, i * 0.5::DOUBLE AS d, trunc(3 * k + side * i * 0.5::DOUBLE)::INT AS y FROM range(40) a(k), range(20) c(j), (VALUES (1), (-1)) s(side), range(101) p(i))",
    "fs AS (SELECT segment_id, pos, side, min(d) FILTER (WHERE wd.y IS NULL) AS d FROM pb LEFT JOIN wd USING (y, x) GROUP BY 1, 2, 3)") + "SELECT segment_id, pos, sum(coalesce(d, 50.5)) AS width FROM fs GROUP BY 1, 2")
def g18_road_width(spark, sf):
    m = raster.dilate(b.mask(spark, sf, b.STRONG), g.ellipse(2), b.scenes(spark, sf))
    rows = spark.createDataFrame([("s0", k, [(3 * k, x) for x in range(0, 60, 3)]) for k in range(40)], "scene_id string, segment_id int, path array<struct<y:int,x:int>>")
    return analytics.width_probes(rows, m, b.scenes(spark, sf)).drop("scene_id")


# ---------------------------------------------------------------- confidence and runs

SCORES = with_(b.SQL_SCORES)


@query(SCORES + "SELECT segment_id, round(straightness, 6) AS straightness, round(length_score, 6) AS length_score, round(overall, 6) AS overall, concat_ws(',', CASE WHEN mask_coverage < 0.5 THEN 'low mask coverage' END, CASE WHEN connectivity = 0 THEN 'isolated segment' END, CASE WHEN length_score < 0.4 THEN 'very short fragment' END) AS notes FROM so")
def a6_confidence(spark, sf):
    return rounded(b.scores(spark, sf).select("segment_id", "straightness", "length_score", "overall", F.array_join("notes", ",").alias("notes")), 6)


@query(SCORES + "SELECT round(avg(overall), 6) AS network_score, count(*) FILTER (WHERE overall >= 0.7) AS high, count(*) FILTER (WHERE overall < 0.4) AS low FROM so")
def a7_network_score(spark, sf):
    return rounded(scoring.network_score(b.scores(spark, sf)), 6)


FLAGS = with_(b.SQL_SCORES, b.SQL_LINKS, b.SQL_GRAPH, b.SQL_COMP) + """, nm AS (SELECT score FROM sh WHERE NOT (score >= 0.74 AND mask_evidence >= 0.7 AND geo >= 4 AND approach_align >= 0.72 AND centerline_continuity >= 0.62) AND score >= 0.45 ORDER BY score DESC, link_id LIMIT 5),
fl AS (SELECT 'warning' AS severity, 'LOW_CONFIDENCE_SEGMENT' AS kind, segment_id, round(overall, 4) AS detail FROM so WHERE overall < 0.3
UNION ALL SELECT 'info', 'LOW_MASK_COVERAGE', segment_id, round(mask_coverage, 4) FROM so WHERE mask_coverage < 0.5
UNION ALL SELECT 'warning', 'DISCONNECTED_SEGMENT', segment_id, 0.0 FROM so WHERE connectivity = 0
UNION ALL SELECT 'info', 'NEAR_MISS_CONNECTION', NULL, round(score, 4) FROM nm
UNION ALL SELECT 'info', 'ISOLATED_COMPONENT', NULL, count(*)::DOUBLE FROM comp GROUP BY component HAVING count(*) < 3
UNION ALL SELECT 'info', 'HIGH_CURVATURE', segment_id, round(curvature, 4) FROM so WHERE curvature > 0.4)"""


def _flags(spark, sf) -> DataFrame:
    s = b.scores(spark, sf)
    rejected = _scored(spark, sf).where(~F.col("accepted")).select(F.col("link_id").alias("seg_a"), F.col("link_id").alias("seg_b"), "score")
    sizes = connected_components(b.graph(spark, sf)).groupBy("component").agg(F.count("*").alias("count"))
    return scoring.flags(s, s.where("connectivity = 0").select("segment_id"), rejected, sizes)


@query(FLAGS.replace(" , nm", ", nm") + " SELECT severity, kind, count(*) AS flags, count(segment_id) AS segments, round(sum(detail), 2) AS detail FROM fl GROUP BY 1, 2")
def a8_flags(spark, sf):
    return _flags(spark, sf).groupBy("severity", "kind").agg(F.count("*").alias("flags"), F.count("segment_id").alias("segments"), F.round(F.sum("detail"), 2).alias("detail"))


@query(FLAGS.replace(" , nm", ", nm") + " SELECT kind, severity IN ('warning', 'error') AS for_review, CASE WHEN c < 40 THEN 'low' WHEN c < 70 THEN 'mid' ELSE 'high' END AS level, count(*) AS issues FROM (SELECT fl.*, coalesce(round(overall * 100), 90.0) AS c FROM fl LEFT JOIN so USING (segment_id)) GROUP BY 1, 2, 3")
def a31_issue_levels(spark, sf):
    s = b.scores(spark, sf)
    places = s.select("segment_id", (F.col("segment_id") % 50).alias("y"), (F.col("segment_id") % 70).alias("x"), F.lit(50).alias("height"), F.lit(70).alias("width"))
    return scoring.issues(_flags(spark, sf), s, places).groupBy("kind", "for_review", "level").agg(F.count("*").alias("issues"))


RUNS = "ru AS (SELECT o_orderkey AS run_id, o_totalprice * 1.0001237::DOUBLE AS length_px, o_orderkey % 30 AS segments, o_orderkey % 4 AS disconnected, (o_orderkey % 100) / 100.0::DOUBLE AS network_score FROM orders)"


def _runs(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(k.alias("run_id"), (F.col("o_totalprice") * 1.0001237).alias("length_px"), (k % 30).alias("segments"), (k % 4).alias("disconnected"), ((k % 100) / 100.0).alias("network_score"))


@query(with_(b.SQL_SCORES, RUNS, "bd AS (SELECT segment_id % 15000 + 1 AS run_id, count(*) AS n, count(*) FILTER (WHERE overall >= 0.7) AS hi, count(*) FILTER (WHERE overall >= 0.4 AND overall < 0.7) AS mi FROM so GROUP BY 1)",
    "jj AS (SELECT ru.*, round(coalesce(hi, 0) * 100.0 / greatest(coalesce(n, 0), 1))::INT AS h, round(coalesce(mi, 0) * 100.0 / greatest(coalesce(n, 0), 1))::INT AS m, CASE WHEN segments > 0 THEN round(100 * (1 - disconnected / segments::DOUBLE), 1) ELSE 100.0 END AS c FROM ru LEFT JOIN bd USING (run_id))") +
    "SELECT run_id, round(length_px * 0.15 / 1000, 1) AS length_km, CASE WHEN segments > 0 THEN round(length_px * 0.15 / segments, 1) ELSE 0.0 END AS avg_segment_m, c AS connectivity, round(network_score * 100, 1) AS confidence, h AS high_pct, m AS mid_pct, greatest(0, 100 - h - m) AS low_pct, CASE WHEN c >= 90 THEN 'optimal' ELSE 'warning' END AS connectivity_status, CASE WHEN network_score >= 0.8 THEN 'optimal' ELSE 'warning' END AS quality_status FROM jj")
def a9_run_summary(spark, sf):
    s = b.scores(spark, sf).select((F.col("segment_id") % 15000 + 1).alias("run_id"), "overall")
    return scoring.run_summary(_runs(spark, sf), s)


@query("SELECT o_orderkey AS id, c_name AS name, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus = 'F' AS archived FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'")
def s10_run_catalog(spark, sf):
    o, c = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).where("o_orderstatus <> 'F'")
    return j.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderstatus") == "F").alias("archived")).orderBy(F.desc("date"), "id")


@query("WITH a AS (SELECT c_custkey AS k, sum(o_totalprice) AS length, count(*) AS components FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT c_custkey AS k, sum(o_totalprice) AS length, count(*) AS components FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT k, round(b.length - a.length, 2) AS delta_length, round((b.components - a.components)::DOUBLE, 2) AS delta_components, 0.0 AS delta_connectivity FROM a JOIN b USING (k)")
def a15_epoch_deltas(spark, sf):
    o = b.table(spark, sf, "orders")
    side = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("length"), F.count("*").alias("components"), F.lit("97.5%").alias("connectivity"))
    return analytics.epoch_deltas(side(0), side(1), ["k"], ["length", "components", "connectivity"])


HALVES = ", ".join(f"count(*) FILTER (WHERE e = {e}) AS n{e}, sum(p) FILTER (WHERE e = {e}) AS t{e}, count(DISTINCT CASE WHEN e = {e} THEN q END) AS d{e}" for e in (0, 1))
COMPARED = " UNION ALL ".join(f"SELECT k, '{m}' AS metric, {x} AS before, {y} AS after FROM w" for m, x, y in [("edges", "n0::DOUBLE", "n1::DOUBLE"), ("endpoints", "d0::DOUBLE", "d1::DOUBLE"), ("total_centerline_length", "round(t0, 2)", "round(t1, 2)"),
    *((m, "0.0::DOUBLE", "0.0::DOUBLE") for m in ("road_pixels", "skeleton_pixels", "connected_components", "junctions_intersections", "suspicious_disconnected_segments"))])


@query(f"WITH w AS (SELECT k, {HALVES} FROM (SELECT o_custkey AS k, o_orderkey % 2 AS e, o_totalprice AS p, o_orderpriority AS q FROM orders) GROUP BY k HAVING n0 > 0 AND n1 > 0) SELECT k, metric, before, after, round(after - before, 2) AS delta FROM ({COMPARED})")
def a23_compare_metrics(spark, sf):
    o = b.table(spark, sf, "orders")
    side = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("topology_edges"), F.sum("o_totalprice").alias("total_length_pixels"), F.countDistinct("o_orderpriority").alias("endpoints"))
    return analytics.compare_metrics(side(0), side(1), ["k"])


@query("SELECT l_orderkey % 1000 AS k, round(sum(l_tax), 4) AS old, round(sum(l_discount), 4) AS new, CASE WHEN sum(l_tax) = 0 THEN NULL ELSE round((sum(l_discount) - sum(l_tax)) * 100.0 / sum(l_tax), 2) + 0.0 END AS delta_pct FROM lineitem GROUP BY 1")
def k9_percent_deltas(spark, sf):
    s = b.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("k")).agg(F.sum("l_tax").alias("old"), F.sum("l_discount").alias("new"))
    return s.select("k", F.round("old", 4).alias("old"), F.round("new", 4).alias("new"), analytics.percent_delta(F.col("old"), F.col("new")).alias("delta_pct"))


@query("WITH r AS (SELECT o_custkey AS q, o_orderkey AS id, o_totalprice AS len FROM orders), m AS (SELECT *, min(len) OVER w AS lo, max(len) OVER w AS hi, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY q)) SELECT q, id, CASE WHEN n <= 1 OR hi = lo THEN 'Medium' WHEN len <= lo + (hi - lo) / 3.0 THEN 'Short' WHEN len <= lo + 2 * (hi - lo) / 3.0 THEN 'Medium' ELSE 'Long' END AS bucket FROM m")
def r12_length_buckets(spark, sf):
    r = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("len"))
    return r.select("q", "id", analytics.length_bucket(F.col("len"), Window.partitionBy("q")).alias("bucket"))


ROUTES = "rt AS (SELECT l_suppkey AS r, l_quantity AS len, l_discount AS ov, CASE WHEN l_linenumber = 1 THEN 'geometry_bridge' ELSE '' END AS kind, l_returnflag = 'R' AS doubt, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 10 END AS conf FROM lineitem), tt2 AS (SELECT r, sum(len) AS px, sum(len * ov) AS over, sum(CASE WHEN kind = 'geometry_bridge' THEN len ELSE 0 END) AS bridge, sum(CASE WHEN doubt THEN len ELSE 0 END) AS dl, coalesce(sum(len * conf) / sum(CASE WHEN conf IS NOT NULL THEN len END), 0.8) AS confidence FROM rt GROUP BY r)"


def _route_totals(spark, sf) -> DataFrame:
    li = b.table(spark, sf, "lineitem")
    conf = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 10)
    e = li.select(F.col("l_suppkey").alias("r"), F.col("l_quantity").alias("length_px"), F.col("l_discount").alias("overlap_ratio"), F.when(F.col("l_linenumber") == 1, "geometry_bridge").otherwise("").alias("edge_kind"), (F.col("l_returnflag") == "R").alias("doubtful"), conf.alias("confidence"), conf.alias("straightness"))
    return routing.route_totals(e, ["r"])


@query(with_(ROUTES) + "SELECT r, round(px * 0.15, 5) AS length_m, round(over * 0.15, 5) AS overlap_m, round(greatest(0, (px - over) * 0.15), 5) AS novel_m, round(over / px * 100, 5) AS overlap_pct, round(1 - bridge / px, 5) AS connection, round(dl / px, 5) AS doubtful, round(confidence, 5) AS confidence, round(confidence, 5) AS smoothness FROM tt2")
def r8_route_totals(spark, sf):
    return rounded(_route_totals(spark, sf).withColumn("smoothness", F.col("confidence")), 5)


@query(with_(ROUTES) + "SELECT r, round(least(greatest(0.25 * (1 - bridge / px) + 0.25 * confidence + 0.25 * (r % 10) / 10.0 + 0.15 * confidence - 0.15 * least(1, (r % 7) / 5.0) - 0.15 * (over / px) - 0.10 * (dl / px), 0), 1), 3) AS score FROM tt2")
def r10_route_scores(spark, sf):
    t = _route_totals(spark, sf)
    return t.select("r", routing.route_score(F.col("connection"), F.col("confidence"), (F.col("r") % 10) / 10.0, F.col("confidence"), (F.col("r") % 7) / 5.0, F.col("overlap_pct") / 100, F.col("doubtful")).alias("score"))


def _lattice(spark) -> tuple[DataFrame, DataFrame]:
    """A street grid of 8 by 8 corners, 40 pixels apart."""
    n = spark.range(64).select(F.lit("s0").alias("scene_id"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("node"), (F.col("id") % 8 * 40).cast("double").alias("x"), (F.floor(F.col("id") / 8) * 40).cast("double").alias("y"))
    a = n.select("scene_id", F.col("node").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    c = n.select("scene_id", F.col("node").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = a.join(c, "scene_id").where("(bx = ax + 40 and by = ay) or (by = ay + 40 and bx = ax)")
    px = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    return n, e.select("scene_id", "src", "dst", F.lit(40.0).alias("length_px"), F.lit(None).cast("int").alias("segment_id"), F.lit("geometry_segment").alias("edge_kind"), px.alias("pixels"))


@query()
def r10_point_to_point(spark, sf):
    n, e = _lattice(spark)
    q = b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lit("s0").alias("scene_id"), (F.col("n_nationkey") * 11 % 280).cast("double").alias("sx"), F.lit(3.0).alias("sy"), (280 - F.col("n_nationkey") * 7 % 200).cast("double").alias("ex"), F.lit(277.0).alias("ey"))
    ref = spark.createDataFrame([("s0", 0.0, 0.0, 280.0, 0.0)], "scene_id string, ax double, ay double, bx double, by double")
    return rounded(routing.routes(q, n, e, ref).select("query_id", "route_id", "length_m", "novel_m", "overlap_pct", "score", F.size("coordinates").alias("points"), "message", "error"))
