"""Relations derived from the driver's tables, so that every operator runs on real rows.

The tables hold no images or roads: these bindings are synthetic, carry no physical meaning,
and exist so that operators and their SQL twins see the same input. Each has its twin in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
STRONG, WEAK = 0.16, 0.08


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability raster: a vector is a row of pixels; label is its band."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.lit("s0").alias("scene_id"), F.col("vec_id").cast("int").alias("y"), "label", F.posexplode("embedding").alias("x", "p"))
    return rows.select("scene_id", "y", "x", F.col("p").cast("double").alias("p"), "label")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.agg((F.max("vec_id") + 1).cast("int").alias("height")).select(F.lit("s0").alias("scene_id"), "height", F.lit(WIDTH).alias("width"))


def mask(spark: SparkSession, sf_dir: str, t: float = WEAK) -> DataFrame:
    return probabilities(spark, sf_dir).where(F.col("p") >= t).select("scene_id", "y", "x")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).where(F.col("p") * (1 + F.col("label") / 10) >= STRONG).select("scene_id", "y", "x")


def zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).where("label in (0, 1)").select("scene_id", "y", "x")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as vertices (scene_id, path_id, at, eid, x, y): x hours since 2024, y the value."""
    e = table(spark, sf_dir, "events")
    hours = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / F.lit(3.6e9)
    return e.select(F.lit("s0").alias("scene_id"), F.col("user_id").alias("path_id"), F.col("ts").alias("at"), F.col("event_id").alias("eid"), hours.alias("x"), F.col("value").alias("y"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, path_id, path): a path is one object, so its vertices meet in one row."""
    v = vertices(spark, sf_dir).groupBy("scene_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("at", "eid", "x", "y"))).alias("v"))
    return v.select("scene_id", "path_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the reference network: a short step of one of five long roads for each part."""
    k, d = F.col("p_partkey"), lambda c: c.cast("double")
    ax, ay = k * 37 % 7200 / F.lit(10.0), d(k % 5 * 100)
    return table(spark, sf_dir, "part").select(F.lit("s0").alias("scene_id"), ax.alias("ax"), ay.alias("ay"), (ax + F.col("p_size") % 9 + 1).alias("bx"), (ay + k % 7 - 3).alias("by"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges from whole tables: orders to their parts, customers to their nations, suppliers to an account each.

    So there is one large component, a star for each nation and many components of one edge.
    """
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    li, c, sup = (table(spark, sf_dir, t) for t in ("lineitem", "customer", "supplier"))
    parts = li.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).distinct()
    return parts.unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))).unionByName(sup.select(name("a", "s_suppkey").alias("src"), name("s", "s_suppkey").alias("dst")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate links between two ends, from parts: everything the signals need but the mask."""
    k = F.col("p_partkey")
    unit = lambda n: F.struct(F.sin(k % n * 1.0).alias("y"), F.cos(k % n * 1.0).alias("x"))
    rows = table(spark, sf_dir, "part").select(k.alias("link_id"), F.lit("s0").alias("scene_id"), (k % 40).cast("double").alias("direction_deg"), (k % 23).cast("double").alias("direction_b"),
        (F.col("p_size") % 7 + 3).cast("double").alias("width_px"), (F.col("p_size") % 5 + 3).cast("double").alias("width_b"), (k % 7).cast("int").alias("y"), (k % 11).cast("int").alias("x"), (k % 7 + k % 5 - 2).cast("int").alias("ry"), (k % 11 + k % 13 + 1).cast("int").alias("rx"), unit(3).alias("tail"), unit(4).alias("_t"), ((k % 21) / 20.0).alias("mask_evidence"))
    rows = rows.withColumn("tail_b", F.struct((-F.col("_t.y")).alias("y"), (-F.col("_t.x")).alias("x"))).drop("_t")
    return rows.withColumn("gap", F.hypot((F.col("ry") - F.col("y")).cast("double"), (F.col("rx") - F.col("x")).cast("double")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence dimensions of segments, one for each order, from its lines; grouped by (order) only.

    Discounts are added up in the order of the rows, file after file by path, as a mean of 0.05 is low or not by its last bit.
    """
    li = table(spark, sf_dir, "lineitem")
    # without an authority the metadata have file:/x where inputFiles has file:///x
    files = sorted(re.sub("^([^:/]+:)///", r"\1/", f) for f in li.inputFiles())
    li = li.withColumn("_path", F.xxhash64("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    if len(files) > 1:
        rank = spark.createDataFrame(list(enumerate(files)), "_file long, _name string").select("_file", F.xxhash64("_name").alias("_path"))
        li = li.join(F.broadcast(rank), "_path", "left")
    else:
        li = li.withColumn("_file", F.lit(0).cast("long"))
    li = li.withColumn("_at", F.struct(F.col("_file").alias("file"), F.col("_row").alias("row"), "l_discount"))
    in_order = F.transform(F.array_sort(F.collect_list(F.when(F.col("l_discount").isNotNull(), F.col("_at")))), lambda r: r["l_discount"])
    mean = F.try_divide(F.reduce(in_order, F.lit(0.0), lambda a, v: a + v), F.size(in_order))
    g = li.groupBy(F.col("l_orderkey").alias("segment_id")).agg(mean.alias("d"), F.max("l_tax").alias("t"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    from ..functions import signals as s

    g = g.select("segment_id", (F.col("d") * 10).alias("mask_coverage"), F.least(F.col("t") * 5, F.lit(1.0)).alias("color_contrast"), (F.col("t") * 6).alias("curvature"), (F.least(F.col("n"), F.lit(2)) / 2.0).alias("connectivity"), (F.col("q") / 5).alias("length_px"))
    g = g.withColumn("straightness", s.straightness(F.col("curvature"))).withColumn("length_score", s.length_score(F.col("length_px")))
    from ..operators.scoring import overall

    return overall(g.withColumn("connectivity", F.when(F.col("segment_id") % 5 == 0, 0.0).otherwise(F.col("connectivity"))))


# ---------------------------------------------------------------- SQL twins

SQL_PX = f"px AS (SELECT 's0' AS scene_id, CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS p, label FROM embeddings, range(1, {WIDTH + 1}) t(i)), sc AS (SELECT CAST(max(vec_id) + 1 AS INTEGER) AS height, {WIDTH} AS width FROM embeddings), weak AS (SELECT y, x FROM px WHERE p >= {WEAK}), strong AS (SELECT y, x FROM px WHERE p >= {STRONG}), gt AS (SELECT y, x FROM px WHERE p * (1 + label / 10) >= {STRONG}), zn AS (SELECT y, x FROM px WHERE label IN (0, 1))"
SQL_PATH = "v AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, value AS y FROM events), st AS (SELECT path_id, i, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY path_id ORDER BY i))"
SQL_REF = "rf AS (SELECT ax, ay, ax + p_size % 9 + 1 AS qx, ay + k % 7 - 3 AS qy FROM (SELECT p_partkey AS k, p_size, (p_partkey * 37 % 7200) / 10.0::DOUBLE AS ax, (p_partkey % 5 * 100)::DOUBLE AS ay FROM part))"
SQL_GRAPH = (
    "ed AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'a' || s_suppkey, 's' || s_suppkey FROM supplier), "
    "arcs AS (SELECT src AS a, dst AS b FROM ed UNION ALL SELECT dst, src FROM ed), nd AS (SELECT DISTINCT a AS node FROM arcs), deg AS (SELECT a AS node, count(*) AS degree FROM arcs GROUP BY a)"
)
#: Least labels go from node to node until none gets less.
SQL_COMP = "comp(node, component) USING KEY (node) AS (SELECT node, node FROM nd UNION (SELECT arcs.b, min(comp.component) FROM comp JOIN arcs ON arcs.a = comp.node JOIN recurring.comp AS r ON r.node = arcs.b WHERE comp.component < r.component GROUP BY arcs.b))"
SQL_LINKS = "ln AS (SELECT p_partkey AS k, (p_partkey % 40)::DOUBLE AS da, (p_partkey % 23)::DOUBLE AS db, (p_size % 7 + 3)::DOUBLE AS wa, (p_size % 5 + 3)::DOUBLE AS wb, p_partkey % 7 + p_partkey % 5 - 2 - p_partkey % 7 AS dy, p_partkey % 13 + 1 AS dx, sin((p_partkey % 3)::DOUBLE) AS va, cos((p_partkey % 3)::DOUBLE) AS ua, -sin((p_partkey % 4)::DOUBLE) AS vb, -cos((p_partkey % 4)::DOUBLE) AS ub, (p_partkey % 21) / 20.0::DOUBLE AS mask_evidence FROM part), lg AS (SELECT *, sqrt((dy * dy + dx * dx)::DOUBLE) AS gap FROM ln), lc AS (SELECT *, (va * dy + ua * dx) / gap AS ca, -(vb * dy + ub * dx) / gap AS cb, least(abs(da - db), 180 - abs(da - db)) AS diff, greatest(wa, wb) / least(wa, wb) AS ratio FROM lg), sg AS (SELECT k AS link_id, gap, mask_evidence, CASE WHEN gap <= 0 THEN 1.0 WHEN gap >= 18 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * gap / 18)) END AS endpoint_distance, CASE WHEN diff <= 35 THEN 1 - 0.5 * diff / 35 WHEN diff <= 70 THEN 0.5 * (1 - (diff - 35) / 35) ELSE 0.0 END AS direction_compat, least((greatest(ca, 0) + greatest(cb, 0)) / 2, 1) AS approach_align, CASE WHEN ratio >= 3 THEN 0.0 ELSE 1 - (ratio - 1) / 2 END AS width_consistency, greatest(0, 1 - (degrees(acos(greatest(-1, least(1, ca)))) + degrees(acos(greatest(-1, least(1, cb))))) / 2 / 60) AS centerline_continuity, greatest(0, 1 - gap / 18) AS gap_penalty FROM lc), sx AS (SELECT *, least(greatest(0.20 * endpoint_distance + 0.20 * direction_compat + 0.15 * approach_align + 0.20 * mask_evidence + 0.10 * width_consistency + 0.10 * centerline_continuity + 0.05 * gap_penalty, 0), 1) AS score FROM sg), sh AS (SELECT *, (endpoint_distance >= 0.85)::INT + (direction_compat >= 0.80)::INT + (approach_align >= 0.72)::INT + (centerline_continuity >= 0.62)::INT + (width_consistency >= 0.80)::INT AS geo FROM sx)"
SQL_SCORES = "sa AS (SELECT l_orderkey AS segment_id, avg(l_discount) * 10 AS mask_coverage, least(max(l_tax) * 5, 1) AS color_contrast, max(l_tax) * 6 AS curvature, CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE least(count(*), 2) / 2.0 END AS connectivity, sum(l_quantity) / 5 AS length_px FROM lineitem GROUP BY l_orderkey), sb AS (SELECT *, 1 - least(curvature / 0.5, 1) AS straightness, CASE WHEN length_px <= 0 THEN 0 ELSE 1 / (1 + exp(-2 * (length_px / 10 - 1))) END AS length_score FROM sa), so AS (SELECT *, least(greatest(0.30 * mask_coverage + 0.20 * color_contrast + 0.15 * straightness + 0.25 * connectivity + 0.10 * length_score, 0), 1) AS overall FROM sb)"


def sql_labels(source: str, out: str) -> str:
    """CTEs that label the 8-connected components of a pixel set by their first pixel.

    Least labels go between runs of pixels of a row that touch, until none gets less.
    """
    return (
        f"{out}_a AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM {source}), "
        f"{out}_u AS (SELECT y, min(x) AS x0, max(x) AS x1, min(y * {WIDTH} + x) AS id FROM {out}_a GROUP BY y, g), "
        f"{out}_h AS (SELECT u.id AS a, v.id AS b FROM {out}_u u JOIN {out}_u v ON v.y = u.y + 1 AND v.x0 <= u.x1 + 1 AND u.x0 <= v.x1 + 1), "
        f"{out}_n AS (SELECT a, b FROM {out}_h UNION ALL SELECT b, a FROM {out}_h), "
        f"{out}_r(id, label) USING KEY (id) AS (SELECT id, id FROM {out}_u UNION (SELECT n.b, min(c.label) FROM {out}_r c JOIN {out}_n n ON n.a = c.id JOIN recurring.{out}_r AS r ON r.id = n.b WHERE c.label < r.label GROUP BY n.b)), "
        f"{out} AS (SELECT a.y, a.x, r.label FROM {out}_a a JOIN {out}_u u ON u.y = a.y AND a.x BETWEEN u.x0 AND u.x1 JOIN {out}_r r ON r.id = u.id)"
    )
