"""Vector formats: GraphML and GeoJSON in, GraphML, GeoJSON and JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, node, x, y, kind) and undirected edges (path, src, dst, length_px, pixels, ...) of GraphML files [S7].

    Each file has its own keys and graph. Missing coordinates are 0, a missing kind is junction; the length is length_pixels, else
    length, else 0; of parallel edges the last by document order stays.
    """
    keys = spark.read.format("xml").option("rowTag", "key").load(path)
    names = keys.select(F.input_file_name().alias("path"), F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"), F.col("_for").alias("of")).distinct() if "_attr.name" in keys.columns else spark.createDataFrame([], "path string, key string, name string, of string")

    def values(tag: str, ids: list[str]) -> DataFrame:
        schema = ", ".join(f"`_{i}` string" for i in ids) + ", data array<struct<_key:string,_VALUE:string>>"
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("order", F.monotonically_increasing_id()).withColumn("path", F.input_file_name())
        long = rows.select("path", "order", *[F.col(f"_{i}").alias(i) for i in ids], F.explode_outer("data").alias("d")).select("path", "order", *ids, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        named = long.join(names.where(F.col("of") == tag), ["path", "key"], "left")
        return named.groupBy("path", "order", *ids).agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))).alias("data"))

    n = values("node", ["id"])
    number = lambda c: F.coalesce(F.col("data")[c].try_cast("double"), F.lit(0.0))
    nodes = n.select("path", F.col("id").alias("node"), number("x").alias("x"), number("y").alias("y"), F.coalesce(F.col("data")["kind"], F.lit("junction")).alias("kind"))
    e = values("edge", ["source", "target"])
    d = F.col("data")
    length = F.coalesce(d["length_pixels"].try_cast("double"), d["length"].try_cast("double"), F.lit(0.0))
    edges = e.select("path", F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "order", length.alias("length_px"), d["segment_id"].try_cast("double").cast("int").alias("segment_id"), d["edge_kind"].alias("edge_kind"), F.from_json(d["pixels"], "array<array<double>>").alias("px"))
    last = Window.partitionBy("path", "src", "dst").orderBy(F.desc("order"))
    edges = edges.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "order")
    return nodes, edges.withColumn("pixels", F.transform("px", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))).drop("px")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features (feature_id, geometry_type, coordinates as JSON text, properties) of GeoJSON files."""
    files = spark.read.schema(FEATURES).option("multiLine", True).json(path).withColumn("_path", F.input_file_name())
    return files.select("_path", F.posexplode("features").alias("feature_id", "f")).select("_path", "feature_id", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def paths_of(features: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, part, path of x and y) of LineString and MultiLineString features with at least two points; the rest is ignored [S8, D16]."""
    key = key or ["feature_id"]
    one = F.when(F.col("geometry_type") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).when(F.col("geometry_type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    rows = features.select(*key, F.posexplode(one).alias("part", "c")).where(F.size("c") >= 2)
    return rows.select(*key, "part", F.transform("c", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("path"))


def path_segments(paths: DataFrame, key: list[str]) -> DataFrame:
    """The steps (ax, ay, bx, by) of paths."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
    rows = paths.where(F.size("path") >= 2).select(*key, F.posexplode(steps).alias("step", "s"))
    return rows.select(*key, "step", *[F.col(f"s.{p}.{c}").cast("double").alias(p_c) for p, c, p_c in (("a", "x", "ax"), ("a", "y", "ay"), ("b", "x", "bx"), ("b", "y", "by"))])


def place_key(x: Column, y: Column) -> Column:
    return F.concat_ws(",", F.format_string("%.2f", x.cast("double")), F.format_string("%.2f", y.cast("double")))


def graph_of_paths(paths: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of consecutive points; points equal to two decimals are one node [S9]."""
    s = path_segments(paths, key).withColumn("src", place_key(F.col("ax"), F.col("ay"))).withColumn("dst", place_key(F.col("bx"), F.col("by")))
    ends = s.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("dst").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("n")).select("n.*")
    nodes = ends.groupBy("node").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return nodes, s.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def geojson_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, feature) JSON texts: a Point for each node, a LineString for each edge with pixels; any kind but endpoint is written junction [K1]."""
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates")).alias("geometry"),
        F.struct(F.col("node").alias("id"), F.when(F.col("kind") == "endpoint", "endpoint").otherwise("junction").alias("kind")).alias("properties"))
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("pixels", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))).alias("coordinates")).alias("geometry"),
        F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.bround("length_px").cast("long").alias("length_pixels"), F.lit("road_segment").alias("kind")).alias("properties"))
    return nodes.select("scene_id", F.to_json(point).alias("feature")).unionByName(edges.select("scene_id", F.to_json(line).alias("feature")))


def feature_collections(features: DataFrame) -> DataFrame:
    """(scene_id, geojson): one document a scene [K1]."""
    body = F.array_join(F.sort_array(F.collect_list("feature")), ",")
    return features.groupBy("scene_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, graphml): one document a scene [K2]."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), esc(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</data>"))
    n = nodes.select("scene_id", F.lit(0).alias("o"), F.concat(F.lit('<node id="'), esc(F.col("node").cast("string")), F.lit('">'), data("x", F.col("x")), data("y", F.col("y")), data("kind", F.col("kind")), F.lit("</node>")).alias("t"))
    px = F.to_json(F.transform("pixels", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    e = edges.select("scene_id", F.lit(1).alias("o"), F.concat(F.lit('<edge source="'), esc(F.col("src").cast("string")), F.lit('" target="'), esc(F.col("dst").cast("string")), F.lit('">'), data("length_pixels", F.col("length_px")), data("segment_id", F.col("segment_id")), data("edge_kind", F.col("edge_kind")), data("pixels", px), F.lit("</edge>")).alias("t"))
    head = '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{t}"/>' for k, of, t in (("x", "node", "double"), ("y", "node", "double"), ("kind", "node", "string"), ("length_pixels", "edge", "double"), ("segment_id", "edge", "long"), ("edge_kind", "edge", "string"), ("pixels", "edge", "string"))) + '<graph edgedefault="undirected">'
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda s: s["t"]), "")
    return n.unionByName(e).groupBy("scene_id").agg(F.concat(F.lit(head), body, F.lit("</graph></graphml>")).alias("graphml"))


def write_texts(documents: DataFrame, column: str, path: str) -> None:
    """One text file a scene under ``path``/scene_id=... [K1, K2, K4, K8]."""
    documents.select("scene_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("scene_id").text(path)
