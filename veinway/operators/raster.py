"""Mask algebra on sparse pixel relations.

A mask is a relation (scene_id, y, x) whose rows are its set pixels; ``scenes`` holds
(scene_id, height, width). Operators are joins and aggregates on pixels keyed by scene, so
they spread over the cluster by pixel; a single very large scene is not gathered anywhere.
Repeated rows of a mask count once where the docstring doesn't say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import NEIGHBOURS, diagonal, ellipse, rectangle
from ..session import materialise
from .components import connected_components

PX = ["scene_id", "y", "x"]

#: Side of the blocks of pixels that are dealt out together.
BLOCK = 64


def offsets(pairs: list[tuple[int, int]]) -> Column:
    """The offsets as a constant array, to be exploded: no join needed."""
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in pairs])


def threshold(prob: DataFrame, t: float) -> DataFrame:
    """Pixels of at least ``t`` [F1]."""
    return prob.where(F.col("p") >= t).select(*PX)


def grid(scenes: DataFrame) -> DataFrame:
    """Every pixel of the scenes."""
    rows = scenes.select("scene_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).where("width > 0")
    return rows.select("scene_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def complement(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """[F9]"""
    # the planner takes exploded rows for as few as what they came from, and would broadcast them
    return grid(scenes).join(mask.hint("merge"), PX, "left_anti")


def runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs: (scene_id, y, x0, x1)."""
    w = Window.partitionBy("scene_id", "y").orderBy("x")
    return mask.select(*PX).distinct().withColumn("g", F.col("x") - F.row_number().over(w)).groupBy("scene_id", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def labelled_runs(mask: DataFrame) -> DataFrame:
    """Runs with the label of their 8-connected component, a struct (scene_id, y, x) of its first pixel.

    Runs, not pixels, are the nodes: far fewer rows go through the iterations.
    """
    r = materialise(runs(mask).select("*", F.struct("scene_id", "y", F.col("x0").alias("x")).alias("node")), "runs")
    up = r.select("scene_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("up"))
    edges = r.join(up, ["scene_id", "y"]).where("u0 <= x1 + 1 and u1 >= x0 - 1").select(F.col("node").alias("src"), F.col("up").alias("dst"))
    labels = connected_components(edges).withColumnRenamed("component", "label")
    return materialise(r.join(labels, "node", "left").select("scene_id", "y", "x0", "x1", F.coalesce("label", "node").alias("label")), "labels")


def label(mask: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Each pixel with the first pixel (label_y, label_x) of its 8-connected component [I1]."""
    r = labelled if labelled is not None else labelled_runs(mask)
    return r.select("scene_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("label.y").alias("label_y"), F.col("label.x").alias("label_x"))


def component_stats(mask: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per component: area and bounding box [D4]. ``labelled``: the mask's runs, if they are known."""
    r = labelled if labelled is not None else labelled_runs(mask)
    out = r.groupBy("scene_id", F.col("label.y").alias("label_y"), F.col("label.x").alias("label_x")).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"), F.max("y").alias("y1"), F.max("x1").alias("x1")
    )
    return out.select("scene_id", "label_y", "label_x", "area", "y0", "x0", (F.col("y1") - F.col("y0") + 1).alias("h"), (F.col("x1") - F.col("x0") + 1).alias("w"))


def drop_small(mask: DataFrame, least: int) -> DataFrame:
    """Components of at least ``least`` pixels [F4]."""
    r = labelled_runs(mask)
    lab = label(mask, r)
    keep = component_stats(mask, r).where(F.col("area") >= least).select("scene_id", "label_y", "label_x")
    return lab.join(keep, ["scene_id", "label_y", "label_x"], "left_semi").select(*PX)


def fill_holes(mask: DataFrame, scenes: DataFrame, least: int) -> DataFrame:
    """The mask with components of its complement below ``least`` pixels filled [F5]."""
    outside = label(complement(mask, scenes))
    small = outside.groupBy("scene_id", "label_y", "label_x").agg(F.count("*").alias("area")).where(F.col("area") < least)
    holes = outside.join(small, ["scene_id", "label_y", "label_x"], "left_semi").select(*PX)
    return mask.select(*PX).distinct().unionByName(holes)


def hysteresis(prob: DataFrame, t: float, ratio: float = 0.5) -> DataFrame:
    """Weak components (p >= ratio * t) that hold a strong pixel (p >= t) [F2, J13]."""
    weak = label(threshold(prob, ratio * t))
    strong = weak.join(threshold(prob, t), PX, "left_semi").select("scene_id", "label_y", "label_x").distinct()
    return weak.join(strong, ["scene_id", "label_y", "label_x"], "left_semi").select(*PX)


def dilate(mask: DataFrame, kernel: list[tuple[int, int]], scenes: DataFrame | None = None, also: list[str] | None = None) -> DataFrame:
    """Pixels that the kernel placed on a set pixel covers, within the scene [F6, F10]. ``also``: further columns of the key."""
    keys = [*(also or []), *PX]
    out = mask.select(*(also or []), "scene_id", "y", "x", F.explode(offsets(kernel)).alias("o"))
    out = out.select(*(also or []), "scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    return _inside(out, scenes).select(*keys) if scenes is not None else out


def _inside(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    return mask.join(scenes, "scene_id").where("y >= 0 and x >= 0 and y < height and x < width").drop("height", "width")


def erode(mask: DataFrame, kernel: list[tuple[int, int]], scenes: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Pixels whose whole kernel is set; what lies outside the scene counts as set [F6]."""
    keys = [*(also or []), *PX]
    hit = mask.select(*keys).distinct().select(*(also or []), "scene_id", "y", "x", F.explode(offsets(kernel)).alias("o"))
    hit = hit.select(*(also or []), "scene_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    seen = hit.groupBy(*keys).agg(F.count("*").alias("n")).join(scenes, "scene_id").where("y >= 0 and x >= 0 and y < height and x < width")
    inside = [(F.col("y") + dy >= 0) & (F.col("x") + dx >= 0) & (F.col("y") + dy < F.col("height")) & (F.col("x") + dx < F.col("width")) for dy, dx in kernel]
    # only pixels within the kernel's reach of the border need the full count
    reach = max(max(abs(dy), abs(dx)) for dy, dx in kernel)
    near = (F.col("y") < reach) | (F.col("x") < reach) | (F.col("y") >= F.col("height") - reach) | (F.col("x") >= F.col("width") - reach)
    count = F.aggregate(F.array(*inside), F.lit(0), lambda a, b: a + b.cast("int"))
    return seen.where(F.col("n") == F.when(near, count).otherwise(len(kernel))).select(*keys)


def close(mask: DataFrame, kernel: list[tuple[int, int]], scenes: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Dilation, then erosion by the reflected kernel's anchor [F6]."""
    back = [(-dy, -dx) for dy, dx in kernel]
    return erode(dilate(mask, kernel, scenes, also), back, scenes, also)


def open_(mask: DataFrame, kernel: list[tuple[int, int]], scenes: DataFrame) -> DataFrame:
    back = [(-dy, -dx) for dy, dx in kernel]
    return dilate(erode(mask, kernel, scenes), back, scenes)


def repair(mask: DataFrame, scenes: DataFrame, least: int = 64, radius: int = 3, bridge: int = 9) -> DataFrame:
    """Drop specks, fill holes, close, and bridge along four directions [F7, O7]."""
    closed = close(fill_holes(drop_small(mask, least), scenes, least), ellipse(radius), scenes)
    size = max(3, bridge)
    kernels = [rectangle(1, bridge), rectangle(bridge, 1), diagonal(size), diagonal(size, falling=False)]
    out = closed
    for kernel in kernels:
        out = out.unionByName(close(closed, kernel, scenes))
    return out.distinct()


def clean(mask: DataFrame, scenes: DataFrame, least: int = 50, radius: int = 2, span: int = 12, aspect: float = 6.0, context: int = 4) -> DataFrame:
    """Keep large components and small elongated ones, and close each by itself [F8].

    A small component stays if it is elongated and either thin or near another component;
    closing is done per component, so two of them never merge.
    """
    r = labelled_runs(mask)
    lab = label(mask, r)
    key = ["scene_id", "label_y", "label_x"]
    stats = component_stats(mask, r)
    major, minor = F.greatest("w", "h"), F.greatest(F.least("w", "h"), F.lit(1))
    elongated = (major >= span) & (major / minor >= aspect)
    small = stats.where(F.col("area") < least).where(elongated)
    thin = F.col("area") <= F.floor(major * 1.5)
    # components with another component's pixel in reach
    reach = dilate(lab.join(small, key, "left_semi"), ellipse(context), None, ["label_y", "label_x"])
    other = lab.select("scene_id", "y", "x", F.col("label_y").alias("oy"), F.col("label_x").alias("ox"))
    near = reach.join(other, PX).where("oy <> label_y or ox <> label_x").select(*key).distinct()
    kept = stats.where(F.col("area") >= least).select(*key).unionByName(small.where(thin).select(*key)).unionByName(near.join(small, key, "left_semi").select(*key)).distinct()
    own = lab.join(kept, key, "left_semi")
    if radius <= 0:
        return own.select(*PX)
    return close(own, ellipse(radius), scenes, ["label_y", "label_x"]).select(*PX).distinct()


def algebra(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """and, or, not (a without b) or xor of two masks [F9, O7, O9, O10]."""
    a, b = a.select(*PX).distinct(), b.select(*PX).distinct()
    if op == "and":
        return a.join(b, PX, "left_semi")
    if op == "or":
        return a.unionByName(b).distinct()
    if op == "not":
        return a.join(b, PX, "left_anti")
    if op == "xor":
        return a.join(b, PX, "left_anti").unionByName(b.join(a, PX, "left_anti"))
    raise ValueError(op)


def degree(mask: DataFrame) -> DataFrame:
    """Each pixel with the number of its set neighbours among eight [F11]."""
    own = mask.select(*PX).distinct()
    near = own.select("scene_id", "y", "x", F.explode(offsets(NEIGHBOURS)).alias("o"))
    near = near.select("scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    counts = near.groupBy(*PX).agg(F.count("*").alias("n"))
    return own.join(counts, PX, "left").select(*PX, F.coalesce("n", F.lit(0)).cast("int").alias("degree"))


def classify_pixels(skeleton: DataFrame) -> DataFrame:
    """Junctions (degree at least 3), endpoints (1), and the rest without a kind [F12]."""
    return degree(skeleton).withColumn("kind", F.when(F.col("degree") >= 3, "junction").when(F.col("degree") == 1, "endpoint"))


def mask_stats(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per scene: set pixels and their share [F13]."""
    n = mask.select(*PX).distinct().groupBy("scene_id").agg(F.count("*").alias("n"))
    total = F.col("height").cast("long") * F.col("width")
    return scenes.join(n, "scene_id", "left").select("scene_id", F.coalesce("n", F.lit(0)).alias("road_pixels"), total.alias("pixels"), F.coalesce(F.try_divide("n", total), F.lit(0.0)).alias("road_share"))


def shrink(prob: DataFrame, factor: int) -> DataFrame:
    """Block means for an integer factor [F14]."""
    return prob.groupBy("scene_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("p").alias("p"))


def resize_linear(prob: DataFrame, scenes: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear resize with pixel centres aligned: four neighbours of each target pixel are joined [F14]."""
    target = grid(scenes.select("scene_id", F.lit(height).alias("height"), F.lit(width).alias("width"))).join(scenes, "scene_id")
    sy = clampc((F.col("y") + 0.5) * F.col("height") / height - 0.5, F.col("height") - 1)
    sx = clampc((F.col("x") + 0.5) * F.col("width") / width - 0.5, F.col("width") - 1)
    t = target.select("scene_id", "y", "x", "height", "width", sy.alias("sy"), sx.alias("sx"))
    corner = F.explode(offsets([(0, 0), (0, 1), (1, 0), (1, 1)])).alias("o")
    t = t.select("*", corner).select("scene_id", "y", "x", F.least(F.floor("sy") + F.col("o.dy"), F.col("height") - 1).cast("int").alias("qy"), F.least(F.floor("sx") + F.col("o.dx"), F.col("width") - 1).cast("int").alias("qx"),
        (F.when(F.col("o.dy") == 1, F.col("sy") - F.floor("sy")).otherwise(1 - (F.col("sy") - F.floor("sy"))) * F.when(F.col("o.dx") == 1, F.col("sx") - F.floor("sx")).otherwise(1 - (F.col("sx") - F.floor("sx")))).alias("wt"))
    source = prob.select("scene_id", F.col("y").alias("qy"), F.col("x").alias("qx"), "p")
    return t.join(source, ["scene_id", "qy", "qx"], "left").groupBy(*PX).agg(F.sum(F.col("wt") * F.coalesce("p", F.lit(0.0))).alias("p"))


def clampc(value: Column, high: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), high.cast("double"))


def tile_starts(size: Column, tile: int, stride: int) -> Column:
    """Starts of tiles along an axis: by stride, and one flush with the end; one tile if it is smaller [F15]."""
    last = F.greatest(size - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def tiles(scenes: DataFrame, tile: int = 256, stride: int = 128) -> DataFrame:
    """(scene_id, ty, tx) of every tile [F15]."""
    rows = scenes.select("scene_id", "width", F.explode(tile_starts(F.col("height"), tile, stride)).alias("ty"))
    return rows.select("scene_id", "ty", F.explode(tile_starts(F.col("width"), tile, stride)).alias("tx"))


def hann(i: Column, size: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * F.pi() * i / (size - 1))


def blend_tiles(predicted: DataFrame, tile: int = 256) -> DataFrame:
    """Weighted mean of overlapping tiles (scene_id, ty, tx, i, j, p); Hann weights of at least 1e-4 [F16]."""
    weight = F.greatest(hann(F.col("i"), tile) * hann(F.col("j"), tile), F.lit(1e-4))
    rows = predicted.select("scene_id", (F.col("ty") + F.col("i")).alias("y"), (F.col("tx") + F.col("j")).alias("x"), "p", weight.alias("w"))
    return rows.groupBy(*PX).agg(F.sum(F.col("p") * F.col("w")).alias("a"), F.sum("w").alias("b")).select(*PX, (F.col("a") / F.greatest("b", F.lit(1e-6))).alias("p"))


def average_views(views: DataFrame, scenes: DataFrame) -> DataFrame:
    """Mean of predictions on flipped and turned views (scene_id, view, y, x, p), put back in place [F17].

    Views: identity, hflip, vflip, rot90 (a quarter turn to the left).
    """
    v = views.join(scenes, "scene_id")
    y = F.when(F.col("view") == "vflip", F.col("height") - 1 - F.col("y")).when(F.col("view") == "rot90", F.col("x")).otherwise(F.col("y"))
    x = F.when(F.col("view") == "hflip", F.col("width") - 1 - F.col("x")).when(F.col("view") == "rot90", F.col("width") - 1 - F.col("y")).otherwise(F.col("x"))
    return v.select("scene_id", y.alias("y"), x.alias("x"), "p").groupBy(*PX).agg(F.avg("p").alias("p"))


def blend_scales(local: DataFrame, whole: DataFrame, w_local: float = 0.75, w_whole: float = 0.25) -> DataFrame:
    """Weighted mean of a tiled and a whole-scene prediction [F18]."""
    b = whole.select(*PX, F.col("p").alias("q"))
    return local.join(b, PX).select(*PX, ((F.col("q") * w_whole + F.col("p") * w_local) / (w_local + w_whole)).alias("p"))


def bright_road_pixels(hsv: DataFrame) -> DataFrame:
    """Grey bright pixels: saturation below 65, value above 80 [F3]."""
    return hsv.where("s < 65 and v > 80").select(*PX)


def distance_to_background(mask: DataFrame, scenes: DataFrame, reach: int) -> DataFrame:
    """Distance of set pixels to the nearest unset one of the scene, up to ``reach`` [P17, SQL form]."""
    disk = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy * dy + dx * dx <= reach * reach]
    # by blocks, so that what reaches a pixel from around it meets before the exchange
    outside = complement(mask, scenes).repartition("scene_id", F.floor(F.col("y") / BLOCK), F.floor(F.col("x") / BLOCK))
    near = outside.select("scene_id", "y", "x", F.explode(offsets(disk)).alias("o"))
    squares = F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx")
    near = near.select("scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), squares.alias("d"), F.lit(False).alias("own"))
    own = mask.select(*PX, F.lit(reach * reach).alias("d"), F.lit(True).alias("own"))
    best = own.unionByName(near).groupBy(*PX).agg(F.min("d").alias("d"), F.max("own").alias("own")).where("own")
    return best.select(*PX, F.sqrt(F.col("d").cast("double")).alias("distance"))
