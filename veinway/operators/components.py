"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship
from .joins import skew_join

#: So few edges are joined up in one task: a bound of some tens of megabytes there.
FEW = 200_000
#: Nodes a task holds while it contracts its edges; then it writes what it has and starts afresh.
HELD = 500_000


def _join_up(edges: DataFrame) -> DataFrame:
    """Edges (u, v) contracted in each partition: every node of it with the least node it reaches there."""
    import pyarrow as pa

    kind = edges.schema["u"].dataType
    names = kind.fieldNames() if isinstance(kind, T.StructType) else None

    def run(batches):
        top: dict = {}

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        def stars(arrow):
            pairs = [p for x in top if (p := (x, find(x)))[0] != p[1]]
            for i in range(0, len(pairs), 50_000):
                sides = [[p[k] for p in pairs[i : i + 50_000]] for k in (0, 1)]
                if names:
                    sides = [[dict(zip(names, x, strict=True)) for x in s] for s in sides]
                yield pa.RecordBatch.from_arrays([pa.array(s, arrow) for s in sides], ["u", "v"])

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            if len(top) > HELD:
                yield from stars(arrow)
                top.clear()
            u, v = (c.to_pylist() for c in batch.columns)
            if names:
                u, v = ([tuple(d.values()) for d in c] for c in (u, v))
            for a, b in zip(u, v, strict=True):
                a, b = find(top.setdefault(a, a)), find(top.setdefault(b, b))
                if a != b:
                    top[max(a, b)] = min(a, b)
        yield from stars(arrow)

    return edges.select("u", "v").mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the component is the least node of it.

    Edges are first contracted within each partition. Once at most ``FEW`` are left, which is
    counted, one task joins them up; until then it alternates
    the large-star and small-star steps (Kiveris et al., 2014) until the edges
    form stars. Each step takes a minimum by partial aggregation and joins it back, so a node
    with very many neighbours is never gathered; each round is written to the shared folder,
    which cuts the lineage. ``nodes`` (column node) adds nodes without edges. Loops and null
    ends are left out; repeated edges do not matter.
    """
    ship(edges.sparkSession)
    e = materialise(_join_up(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v")), "components")
    state = _state(e)
    while state[0] > FEW:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        if state[0]:
            e = materialise(_join_up(e.coalesce(1)), "components")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = stars.unionByName(roots.join(stars.select("node"), "node", "left_anti"))
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
