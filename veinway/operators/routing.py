"""Point-to-point routes with diverse alternatives.

Edge weights, overlaps and scores are relations; the search itself is sequential (each
alternative raises the weights the next one sees), so a query's graph is solved in one
grouped kernel. Graphs: nodes (scene_id, node, x, y), edges (scene_id, src, dst, pixels
array<struct<x,y>>, length_px, segment_id, edge_kind).
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import METRES_PER_PIXEL
from ..session import ship

BLOCKED = 1e9
SAME = "Start and destination must be different."
FAR_START = "No usable road network found near the selected start point."
FAR_END = "No usable road network found near the selected destination point."
NO_ROUTE = "No connected route was found between the selected points."
NOT_NEW = "No sufficiently new route alternatives were found."
FEWER = "Fewer route alternatives were available."


@dataclass(frozen=True)
class Options:
    tolerance: float = 15.0
    avoidance: float = 10.0
    routes: int = 4
    allow_existing: bool = True
    snap: float = 150.0
    separation: float = 10.0
    diversity: float = 0.3


def edge_weight(length: Column, overlap: Column, avoidance: float = 10.0, allow_existing: bool = True) -> Column:
    """Length, raised with the overlap; edges on the reference are all but closed where they may not be used [R4]."""
    weight = length * (1 + overlap * (avoidance - 1))
    return weight if allow_existing else F.when(overlap > 0.1, F.lit(BLOCKED)).otherwise(weight)


def edge_overlap(edges: DataFrame, reference: DataFrame, key: list[str], tolerance: float = 15.0) -> DataFrame:
    """Share of each edge's vertices within ``tolerance`` of the reference segments [R3]."""
    from .spatial import point_network_distance

    pts = edges.select("scene_id", *key, F.posexplode("pixels").alias("pos", "p")).select("scene_id", *key, "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    near = point_network_distance(pts, reference, [*key, "pos"], reach=tolerance).where(F.col("distance") <= tolerance)
    j = pts.join(near, ["scene_id", *key, "pos"], "left")
    return j.groupBy("scene_id", *key).agg((F.count("distance") / F.count("*")).alias("overlap_ratio"))


def path_overlap(a: DataFrame, b: DataFrame, key: list[str], reach: float = 10.0) -> DataFrame:
    """Length share of a's steps (ax, ay, bx, by) whose middle lies within ``reach`` of b's steps [G14]."""
    from .spatial import point_network_distance

    steps = a.withColumn("step", F.monotonically_increasing_id()).withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    mid = steps.select("scene_id", *key, "step", "len", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    near = point_network_distance(mid, b, [*key, "step", "len"], reach=reach).where(F.col("distance") <= reach)
    total = mid.groupBy("scene_id", *key).agg(F.sum("len").alias("total"))
    hit = near.groupBy("scene_id", *key).agg(F.sum("len").alias("hit"))
    return total.join(hit, ["scene_id", *key], "left").select("scene_id", *key, F.coalesce(F.try_divide(F.coalesce("hit", F.lit(0.0)), "total"), F.lit(0.0)).alias("overlap"))


def route_score(connection: Column, confidence: Column, diversity: Column, smoothness: Column, excess: Column, overlap: Column, doubtful: Column) -> Column:
    """Composite score of a route in [0, 1], three decimals [R10]."""
    raw = 0.25 * connection + 0.25 * confidence + 0.25 * diversity + 0.15 * smoothness - 0.15 * F.least(F.lit(1.0), excess) - 0.15 * overlap - 0.10 * doubtful
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3)


def route_totals(route_edges: DataFrame, key: list[str]) -> DataFrame:
    """Per route: metres, overlap, novel length, share on bridges and on doubtful segments, weighted confidence and straightness [R8].

    Rows: key, length_px, overlap_ratio, edge_kind, doubtful, confidence and straightness (null: not known).
    """
    length = F.col("length_px")
    weighted = lambda c, d: F.coalesce(F.try_divide(F.sum(F.when(F.col(c).isNotNull(), length * F.col(c))), F.sum(F.when(F.col(c).isNotNull(), length))), F.lit(d))
    t = route_edges.groupBy(*key).agg(F.sum(length).alias("px"), F.sum(length * F.col("overlap_ratio")).alias("over"), F.sum(F.when(F.col("edge_kind") == "geometry_bridge", length).otherwise(0.0)).alias("bridge"),
        F.sum(F.when(F.col("doubtful"), length).otherwise(0.0)).alias("doubt"), weighted("confidence", 0.8).alias("confidence"), weighted("straightness", 0.9).alias("smoothness"))
    m = METRES_PER_PIXEL
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("px")), F.lit(0.0))
    return t.select(*key, (F.col("px") * m).alias("length_m"), (F.col("over") * m).alias("overlap_m"), F.greatest(F.lit(0.0), (F.col("px") - F.col("over")) * m).alias("novel_m"), (share("over") * 100).alias("overlap_pct"), (1 - share("bridge")).alias("connection"), share("doubt").alias("doubtful"), "confidence", "smoothness")


# ---------------------------------------------------------------- grouped kernel


def _distances(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Least distance of each point (n, 2) to segments (m, 4), infinite without any."""
    out = np.full(len(points), np.inf)
    if not len(segments):
        return out
    a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    size = (d * d).sum(1)
    for i in range(0, len(points), 512):
        p = points[i : i + 512, None, :] - a
        t = np.clip(np.divide((p * d).sum(2), size, out=np.zeros(p.shape[:2]), where=size > 0), 0, 1)
        out[i : i + 512] = np.sqrt(((p - t[..., None] * d) ** 2).sum(2)).min(1)
    return out


def _steps(path: np.ndarray) -> np.ndarray:
    return np.hstack((path[:-1], path[1:])) if len(path) > 1 else np.zeros((0, 4))


def _length(path: np.ndarray) -> float:
    return float(np.hypot(*(path[1:] - path[:-1]).T).sum()) if len(path) > 1 else 0.0


@dataclass
class Edge:
    u: str
    v: str
    pixels: np.ndarray
    length: float
    kind: str
    segment: int | None
    weight: float = 0.0
    overlap: float = 0.0


@dataclass
class Graph:
    places: dict[str, tuple[float, float]] = field(default_factory=dict)
    edges: dict[frozenset, Edge] = field(default_factory=dict)
    around: dict[str, dict[str, Edge]] = field(default_factory=dict)

    def add(self, e: Edge) -> None:
        self.edges[frozenset((e.u, e.v))] = e
        self.around.setdefault(e.u, {})[e.v] = e
        self.around.setdefault(e.v, {})[e.u] = e

    def drop(self, e: Edge) -> None:
        del self.edges[frozenset((e.u, e.v))], self.around[e.u][e.v], self.around[e.v][e.u]

    def shortest(self, a: str, b: str, weight) -> list[str] | None:
        """Dijkstra; equal distances go to the node reached first."""
        best, came, heap, order = {a: 0.0}, {}, [(0.0, 0, a)], 0
        done = set()
        while heap:
            d, _, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            if n == b:
                path = [b]
                while path[-1] != a:
                    path.append(came[path[-1]])
                return path[::-1]
            for m, e in self.around.get(n, {}).items():
                if (x := d + weight(e)) < best.get(m, math.inf):
                    best[m], came[m], order = x, n, order + 1
                    heapq.heappush(heap, (x, order, m))
        return None

    def oriented(self, u: str, v: str) -> np.ndarray:
        """The edge's pixels from u to v: turned where the far end is nearer to u."""
        e = self.around[u][v]
        at = np.array(self.places[u])
        p = e.pixels if len(e.pixels) else np.array([self.places[u], self.places[v]], float)
        return p[::-1] if np.hypot(*(p[-1] - at)) < np.hypot(*(p[0] - at)) else p


def snap(graph: Graph, point: tuple[float, float], name: str, limit: float) -> tuple[str, tuple[float, float]]:
    """Join a point to the graph: to the nearest node, or to a new node on the nearest edge [R2, J10]."""
    p = np.array(point, float)
    nodes = list(graph.places)
    far = np.hypot(*(np.array([graph.places[n] for n in nodes]) - p).T) if nodes else np.array([np.inf])
    k = int(far.argmin())
    edge, foot, at, edge_far = None, None, 0, math.inf
    for e in graph.edges.values():
        s = _steps(e.pixels)
        if not len(s):
            continue
        d = s[:, 2:] - s[:, :2]
        size = (d * d).sum(1)
        t = np.clip(np.divide(((p - s[:, :2]) * d).sum(1), size, out=np.zeros(len(s)), where=size > 0), 0, 1)
        feet = s[:, :2] + t[:, None] * d
        gap = np.hypot(*(feet - p).T)
        if gap.min() < edge_far:
            at = int(gap.argmin())
            edge, foot, edge_far = e, feet[at], float(gap[at])
    if far[k] > limit and edge_far > limit:
        raise ValueError(FAR_START if name == "start" else FAR_END)
    click = f"{name}_click"
    if far[k] <= 15 or (far[k] <= edge_far and far[k] <= limit):
        to, spot, gap = nodes[k], graph.places[nodes[k]], float(far[k])
    else:
        to, spot, gap = f"{name}_node", tuple(foot.tolist()), edge_far
        graph.places[to] = spot
        graph.drop(edge)
        for u, v, px in ((edge.u, to, np.vstack((edge.pixels[: at + 1], foot))), (to, edge.v, np.vstack((foot, edge.pixels[at + 1 :])))):
            graph.add(Edge(u, v, px, _length(px), "split_segment", edge.segment))
    graph.places[click] = point
    graph.add(Edge(click, to, np.array([point, spot], float), gap, "connector_segment", None))
    return click, spot


def overlap_share(a: np.ndarray, b: np.ndarray, reach: float) -> float:
    s = _steps(a)
    size = np.hypot(*(s[:, 2:] - s[:, :2]).T) if len(s) else np.zeros(0)
    if size.sum() <= 0 or len(b) < 2:
        return 0.0
    near = _distances((s[:, :2] + s[:, 2:]) / 2, _steps(b)) <= reach
    return float(size[near].sum() / size.sum())


def find_routes(nodes: list[tuple], edges: list[dict], start: tuple, end: tuple, reference: np.ndarray, o: Options = Options(), confidence: dict[int, tuple[float, float]] | None = None, doubtful: set[int] | None = None) -> tuple[list[dict], tuple, tuple, str | None]:
    """Alternatives from start to end with their totals and scores, or a ValueError that says why not [R1-R10]."""
    if math.hypot(start[0] - end[0], start[1] - end[1]) < 2:
        raise ValueError(SAME)
    g = Graph({n: (float(x), float(y)) for n, x, y in nodes})
    for e in edges:
        px = np.array([(p["x"], p["y"]) for p in (e["pixels"] if e["pixels"] is not None else [])], float).reshape(-1, 2)
        segment = None if e["segment_id"] is None or pd.isna(e["segment_id"]) else int(e["segment_id"])
        g.add(Edge(e["src"], e["dst"], px, float(e["length_px"] or 0) or _length(px), e["edge_kind"] or "", segment))
    a, from_ = snap(g, start, "start", o.snap)
    b, to = snap(g, end, "end", o.snap)
    for e in g.edges.values():
        px = e.pixels if len(e.pixels) else np.array([g.places[e.u], g.places[e.v]], float)
        e.length = e.length or _length(px)
        e.overlap = float((_distances(px, reference) <= o.tolerance).mean())
        e.weight = BLOCKED if not o.allow_existing and e.overlap > 0.1 else e.length * (1 + e.overlap * (o.avoidance - 1))
    weight = {k: e.weight for k, e in g.edges.items()}
    middles = {k: g.oriented(e.u, e.v) for k, e in g.edges.items()}
    middle = np.array([m[len(m) // 2] for m in middles.values()], float)
    pool = []
    for _ in range(max(15, 3 * o.routes)):
        path = g.shortest(a, b, lambda e: weight[frozenset((e.u, e.v))])
        if path is None:
            break
        pool.append(path)
        for u, v in zip(path, path[1:], strict=False):
            weight[frozenset((u, v))] *= 5
        line = np.vstack([g.oriented(u, v) for u, v in zip(path, path[1:], strict=False)])
        for k, d in zip(middles, _distances(middle, _steps(line)), strict=True):
            if weight[k] < 1e8 and d <= o.separation:
                weight[k] *= 3
    if not pool:
        raise ValueError(NO_ROUTE)
    direct = g.shortest(a, b, lambda e: e.length)
    least = sum(g.around[u][v].length for u, v in zip(direct, direct[1:], strict=False)) if direct else 0.0
    found = []
    for path in pool:
        line: list[list[float]] = []
        own = [g.around[u][v] for u, v in zip(path, path[1:], strict=False)]
        for u, v in zip(path, path[1:], strict=False):
            px = g.oriented(u, v).tolist()
            line += px[1:] if line and line[-1] == px[0] else px
        length = sum(e.length for e in own)
        over = sum(e.length * e.overlap for e in own)
        known = [(e.length, *((confidence or {}).get(e.segment) or ())) for e in own if e.segment is not None and e.segment in (confidence or {})]
        known += [(e.length, 1.0, 1.0) if e.kind == "connector_segment" else (e.length, 0.4, 0.8) for e in own if e.segment is None and e.kind in ("connector_segment", "geometry_bridge")]
        total = sum(k[0] for k in known)
        share = lambda x: x / length if length > 0 else 0.0  # noqa: B023, E731
        found.append({"line": np.array(line), "length": length, "over": over, "overlap_pct": share(over) * 100, "connection": 1 - share(sum(e.length for e in own if e.kind == "geometry_bridge")), "doubt": share(sum(e.length for e in own if e.segment in (doubtful or set()))),
            "confidence": sum(k[0] * k[1] for k in known) / total if total > 0 else 0.8, "smooth": sum(k[0] * k[2] for k in known) / total if total > 0 else 0.9})
    mutual = lambda p, q: max(overlap_share(p["line"], q["line"], o.separation), overlap_share(q["line"], p["line"], o.separation))
    chosen: list[dict] = []
    for c in found:
        if len(chosen) >= o.routes:
            break
        if all(mutual(c, k) <= 1 - o.diversity for k in chosen):
            chosen.append(c)
    if not chosen or all(c["overlap_pct"] >= 90 for c in chosen):
        raise ValueError(NOT_NEW)
    out = []
    for i, c in enumerate(chosen):
        others = [mutual(c, k) for k in chosen if k is not c]
        excess = max(0.0, (c["length"] - least) / least) if least > 0 else 0.0
        score = 0.25 * c["connection"] + 0.25 * c["confidence"] + 0.25 * (1 - max(others, default=0.0)) + 0.15 * c["smooth"] - 0.15 * min(1.0, excess) - 0.15 * c["overlap_pct"] / 100 - 0.10 * c["doubt"]
        m = METRES_PER_PIXEL
        out.append({"route_id": i + 1, "coordinates": c["line"].tolist(), "length_m": c["length"] * m, "novel_m": max(0.0, (c["length"] - c["over"]) * m), "overlap_m": c["over"] * m, "overlap_pct": c["overlap_pct"], "score": round(max(0.0, min(1.0, score)), 3)})
    return out, from_, to, FEWER if len(out) < o.routes else None


ROUTE = "query_id long, route_id int, length_m double, novel_m double, overlap_m double, overlap_pct double, score double, coordinates array<struct<x:double,y:double>>, message string, error string"


def routes(queries: DataFrame, nodes: DataFrame, edges: DataFrame, reference: DataFrame, options: Options = Options(), per_graph: int = 64) -> DataFrame:
    """Rows of routes for each query (query_id, scene_id, sx, sy, ex, ey): an error row where there is none.

    The queries of a scene are cut into parts of about ``per_graph``; each part meets the
    scene's nodes, edges and reference in one group, so a graph is dealt out once for a part
    and a group is as large as one scene's graph. Queries of scenes without nodes or edges
    have no rows.
    """
    ship(queries.sparkSession)
    group = ["scene_id", "_part"]
    cut = queries.groupBy("scene_id").agg(F.ceil(F.count("*") / per_graph).cast("int").alias("_parts"))
    asked = queries.join(cut, "scene_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int"))
    asked = asked.select(*group, "query_id", *[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "ex", "ey")])
    parts = asked.select(*group).distinct()
    number = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    kinds = {"kind": "int", "node": "string", "x": "double", "y": "double", "src": "string", "dst": "string", "length_px": "double", "segment_id": "long", "edge_kind": "string", "pixels": "array<struct<x:double,y:double>>", "ax": "double", "ay": "double", "bx": "double", "by": "double"}

    def rows(df: DataFrame, kind: int, *columns: Column) -> DataFrame:
        df = df.select("scene_id", F.lit(kind).alias("kind"), *columns)
        return df.select("scene_id", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    graph = rows(nodes, 0, F.col("node"), *number("x", "y")).unionByName(rows(edges, 1, *[F.col(c) for c in ("src", "dst", "length_px", "segment_id", "edge_kind", "pixels")])).unionByName(rows(reference, 2, *number("ax", "ay", "bx", "by")))
    graph = graph.join(parts.select("scene_id", F.col("_part").alias("_to")), "scene_id")

    def solve(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = {k: known[known.kind == k] for k in (0, 1, 2)}
        if len(some) and len(own[0]) and len(own[1]):
            places = list(own[0].sort_values(["node", "x", "y"])[["node", "x", "y"]].itertuples(index=False, name=None))
            ways = own[1].sort_values(["src", "dst", "length_px", "segment_id"])[["src", "dst", "length_px", "segment_id", "edge_kind", "pixels"]].to_dict("records")
            ref = own[2][["ax", "ay", "bx", "by"]].to_numpy(float).reshape(-1, 4)
            for r in some.sort_values("query_id").to_dict("records"):
                try:
                    found, _, _, message = find_routes(places, ways, (r["sx"], r["sy"]), (r["ex"], r["ey"]), ref, options)
                    out += [{**f, "query_id": r["query_id"], "coordinates": [{"x": x, "y": y} for x, y in f["coordinates"]], "message": message, "error": None} for f in found]
                except ValueError as e:
                    out.append({"query_id": r["query_id"], "error": str(e)})
        made = pd.DataFrame(out, columns=[c.split()[0] for c in ROUTE.split(", ")])
        made["route_id"] = made["route_id"].astype("Int32")
        return made

    return asked.groupBy(*group).cogroup(graph.groupBy("scene_id", "_to")).applyInPandas(solve, ROUTE)
