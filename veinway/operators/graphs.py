"""Graph relations: nodes (node) and undirected edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, work_dir
from .components import connected_components
from .ranking import numbered

# Labels of the degree classes.
DEGREE_LABELS = ["Dead End (Degree 1)", "Continuation (Degree 2)", "T-Junction (Degree 3)", "Complex Intersection (Degree 4+)"]


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with src < dst; loops go."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree); nodes without edges have 0."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return n if nodes is None else nodes.select("node").join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_distribution(degree: DataFrame) -> DataFrame:
    """The four degree classes with count and share of all nodes; every class has a row, degree 0 is in none [N1]."""
    n = F.count("*")
    counted = degree.agg(n.alias("n"), *[F.sum(F.when((F.least("degree", F.lit(4)) == k), 1).otherwise(0)).alias(f"c{k}") for k in (1, 2, 3, 4)])
    labels = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("count")) for k, label in enumerate(DEGREE_LABELS, 1)])
    return counted.select("n", F.explode(labels).alias("d")).select("d.label", "d.count", F.coalesce(F.round(F.try_divide(F.col("d.count") * 100.0, F.col("n")), 1), F.lit(0.0)).alias("percentage"))


def component_table(components: DataFrame) -> DataFrame:
    """Components by size: rank from 0, least node, count and share of nodes [N3, T10, O2]."""
    sizes = components.groupBy("component").agg(F.count("*").alias("count"))
    total = components.agg(F.count("*").alias("total"))
    ranked = numbered(sizes, [F.desc("count"), F.col("component")], "id")
    return ranked.crossJoin(F.broadcast(total)).select("id", "component", "count", F.round(F.col("count") * 100.0 / F.col("total"), 1).alias("percentage"))


def intelligence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of network measures: sizes, degrees, density, gamma index, components [N1, N2, N5].

    Zeros for an empty graph; the gamma index is 100 up to two nodes.
    """
    d = degrees(edges, nodes)
    by_node = d.agg(F.count("*").alias("nodes"), F.coalesce(F.round(F.avg("degree"), 2), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.count(F.when(F.col("degree") == 1, 1)).alias("dead_ends"), F.count(F.when(F.col("degree") >= 3, 1)).alias("junctions"))
    by_edge = edges.agg(F.count("*").alias("edges"))
    comps = connected_components(edges, nodes).agg(F.countDistinct("component").alias("components"))
    n, m = F.col("nodes"), F.col("edges")
    gamma = F.when(n == 0, 0.0).when(n <= 2, 100.0).otherwise(F.round(F.least(F.try_divide(m * 1.0, 3.0 * (n - 2)), F.lit(1.0)) * 100, 1))
    return by_node.crossJoin(by_edge).crossJoin(comps).select("nodes", "edges", "avg_degree", "max_degree", F.round(F.coalesce(F.when(n > 1, F.try_divide(2.0 * m, n * (n - 1))), F.lit(0.0)), 4).alias("density"),
        "components", "dead_ends", "junctions", gamma.alias("gamma_percent"))


def node_link(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with degree and the rank of their component, and edges [N4]."""
    comps = connected_components(edges, nodes)
    table = component_table(comps).select("component", F.col("id").alias("group"))
    out = comps.join(table, "component").join(degrees(edges, nodes), "node").select("node", "degree", "group")
    return out, canonical_edges(edges).select(F.col("src").alias("source"), F.col("dst").alias("target"))


def viewport(nodes: DataFrame, width: float = 600, height: float = 400, pad: float = 40) -> DataFrame:
    """Coordinates scaled into a viewport, y upwards; a range of 0 counts as 1 [N6]."""
    box = nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise((F.col(f"hi_{c}") - F.col(f"lo_{c}")).cast("double"))
    joined = nodes.crossJoin(F.broadcast(box))
    vx = pad + (F.col("x") - F.col("lo_x")) / span("x") * (width - 2 * pad)
    vy = height - pad - (F.col("y") - F.col("lo_y")) / span("y") * (height - 2 * pad)
    return joined.select(*nodes.columns, vx.alias("vx"), vy.alias("vy"))


def cleanup(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without loops and isolated nodes; junctions of degree below 3 become passthrough [T6]."""
    e = edges.where("src <> dst")
    d = degrees(e.select("src", "dst").distinct())
    out = nodes.join(d, "node").withColumn("kind", F.when((F.col("kind") == "junction") & (F.col("degree") < 3), "passthrough").otherwise(F.col("kind")))
    return out.drop("degree"), e


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, edges whose ends are no nodes, loops [T14]."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    lost = ends.join(nodes, "node", "left_anti").agg(F.count("*").alias("dangling_ends"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))).crossJoin(lost)


def greedy_match(candidates: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, score) chosen greedily by score, each node once; ties by a, then b [T5].

    In each round every pair that is the best of both its nodes is taken and their other pairs
    go; under a strict total order this gives what going through the sorted list gives.
    """
    spark = candidates.sparkSession
    c = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a <> b")
    c = c.groupBy("a", "b").agg(F.max("score").alias("score"))
    if taken is not None:
        c = c.join(taken.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["a", "b"], "left_anti")
    path = work_dir(spark, "match")
    c, chosen, k = materialise(c, "match", f"{path}/left-0"), None, 0
    while not c.isEmpty():
        ends = c.select(F.explode(F.array("a", "b")).alias("node"), F.struct((-F.col("score")).alias("s"), "a", "b").alias("p"))
        best = ends.groupBy("node").agg(F.min("p").alias("p"))
        both = best.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.a", "p.b", (-F.col("p.s")).alias("score"))
        k += 1
        picked = materialise(both, "match", f"{path}/picked-{k}")
        used = picked.select(F.explode(F.array("a", "b")).alias("node"))
        rest = c.join(used.withColumnRenamed("node", "a"), "a", "left_anti").join(used.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b", "score")
        c = materialise(rest, "match", f"{path}/left-{k}")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen if chosen is not None else c


def hop_distances(edges: DataFrame, source, weight: str | None = None, most: int | None = None) -> DataFrame:
    """(node, distance) of all nodes reachable from ``source``: rounds of relaxation until nothing improves [R5, SQL form].

    Fails after ``most`` rounds that improve something; by default the number of nodes, which
    only a negative cycle exceeds.
    """
    spark = edges.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    both = materialise(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "arcs")
    kind = edges.schema["src"].dataType.simpleString()
    known = materialise(spark.createDataFrame([(source, 0.0)], f"node {kind}, distance double"), "distances")
    front, path = known, None
    most = both.select("src").distinct().count() if most is None else most
    rounds = 0
    while True:
        reach = front.join(both, front["node"] == both["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("distance"))
        better = reach.join(known.select("node", F.col("distance").alias("old")), "node", "left").where("old is null or distance < old").select("node", "distance")
        better = materialise(better, "front")
        if better.isEmpty():
            break
        rounds += 1
        if rounds > most:
            raise ValueError(f"distances still improve after {most} rounds")
        old, path = path, work_dir(spark, "distances")
        known = materialise(known.unionByName(better).groupBy("node").agg(F.min("distance").alias("distance")), "distances", path)
        front = better
        if old:
            discard(spark, old)
    return known
