"""Model inference and data preparation around it: the model is a callable you bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import raster
from .ranking import numbered

Model = Callable[[np.ndarray], np.ndarray]  # (n, h, w, 3) in 0..1 to (n, h, w)
TURNS = ("identity", "hflip", "vflip", "rot90")


def turned(image: np.ndarray, view: str) -> np.ndarray:
    """A view of (h, w, ...): flipped, or a quarter turn to the left."""
    return {"identity": image, "hflip": image[:, ::-1], "vflip": image[::-1], "rot90": np.rot90(image)}[view]


def turned_back(image: np.ndarray, view: str) -> np.ndarray:
    return np.rot90(image, -1) if view == "rot90" else turned(image, view)


def predict_tiles(pixels: DataFrame, scenes: DataFrame, model: Model, tile: int = 256, stride: int = 128, views: tuple[str, ...] = TURNS) -> DataFrame:
    """Road probability (scene_id, y, x, p) by a model over overlapping tiles [F15-F17, F19].

    A pixel is dealt to the tiles that hold it, each tile is one group, the model sees its
    views, and the tiles are blended. ``pixels``: scene_id, y, x, r, g, b; what a tile lacks is black.
    """
    ship(pixels.sparkSession)
    size = F.least(F.lit(tile), F.greatest("height", "width"))
    t = raster.tiles(scenes, tile, stride).join(scenes, "scene_id").select("scene_id", "ty", "tx", size.alias("size"))
    bands = t.select("scene_id", "ty", "tx", "size", F.explode(F.sequence(F.col("ty"), F.col("ty") + F.col("size") - 1)).alias("y"))
    cells = pixels.join(bands, ["scene_id", "y"]).where("x >= tx and x < tx + size")
    cells = cells.select("scene_id", "ty", "tx", "size", (F.col("y") - F.col("ty")).alias("i"), (F.col("x") - F.col("tx")).alias("j"), "r", "g", "b")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["size"].iloc[0])
        image = np.zeros((n, n, 3))
        image[frame.i, frame.j] = frame[["r", "g", "b"]].to_numpy() / 255
        out = np.mean([turned_back(p, v) for p, v in zip(model(np.stack([turned(image, v) for v in views])), views, strict=True)], axis=0)
        return pd.DataFrame({"scene_id": frame.scene_id.iloc[0], "ty": frame.ty.iloc[0], "tx": frame.tx.iloc[0], "i": frame.i, "j": frame.j, "p": out[frame.i, frame.j].astype(float)})

    predicted = cells.groupBy("scene_id", "ty", "tx").applyInPandas(run, "scene_id string, ty int, tx int, i int, j int, p double")
    return raster.blend_tiles(predicted, tile)


def occlusions(scenes: DataFrame, mask: DataFrame, most: int = 3, seed: int = 0) -> DataFrame:
    """Synthetic obstacles (scene_id, number, kind, y, x, radius): up to ``most`` a scene, three quarters on the road [A27].

    Kinds are tree, building and shadow with shares .45, .35 and .20. All choices are hashes of
    scene and number, so they don't depend on the order of rows.
    """
    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    n = 1 + F.floor(unit("scene_id") * most).cast("int")
    rows = scenes.select("*", F.explode(F.sequence(F.lit(1), n)).alias("number"))
    u = unit("scene_id", "number", F.lit("kind"))
    rows = rows.withColumn("kind", F.when(u < 0.45, "tree").when(u < 0.80, "building").otherwise("shadow")).withColumn("radius", (4 + F.floor(unit("scene_id", "number", F.lit("r")) * 13)).cast("int"))
    free = F.struct(F.floor(unit("scene_id", "number", F.lit("y")) * F.col("height")).cast("int").alias("y"), F.floor(unit("scene_id", "number", F.lit("x")) * F.col("width")).cast("int").alias("x"))
    # the road pixel with the least hash for this obstacle, found by aggregation
    on_road = rows.select("scene_id", "number").join(mask, "scene_id").groupBy("scene_id", "number").agg(F.min(F.struct(F.xxhash64("y", "x", "number", F.lit(seed)).alias("h"), "y", "x")).alias("p"))
    j = rows.join(on_road, ["scene_id", "number"], "left")
    use = (unit("scene_id", "number", F.lit("road")) < 0.75) & F.col("p").isNotNull()
    return j.select("scene_id", "number", "kind", F.when(use, F.col("p.y")).otherwise(free["y"]).alias("y"), F.when(use, F.col("p.x")).otherwise(free["x"]).alias("x"), "radius")


def occluded_pixels(obstacles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pixels within the radius of an obstacle [A27]."""
    d = F.sequence(-F.col("radius"), F.col("radius"))
    rows = obstacles.select("scene_id", "y", "x", "radius", F.explode(d).alias("dy")).select("*", F.explode(d).alias("dx")).where("dy * dy + dx * dx <= radius * radius")
    px = rows.select("scene_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    return px.join(scenes, "scene_id").where("y >= 0 and x >= 0 and y < height and x < width").select("scene_id", "y", "x")


def batches(samples: DataFrame, order: list[str], size: int, seed: int = 0) -> DataFrame:
    """Adds epoch batch numbers: rows shuffled by a seeded hash and cut into batches [A28]."""
    rows = numbered(samples.withColumn("_mix", F.xxhash64(*order, F.lit(seed))), ["_mix", *order], "_n")
    return rows.withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_mix", "_n")


def soft_metrics(prob: DataFrame, truth: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Soft Dice and IoU and mean binary cross entropy of probabilities against a mask, by scene [A29]."""
    t = truth.select("scene_id", "y", "x").distinct().withColumn("t", F.lit(1.0))
    j = prob.join(t, ["scene_id", "y", "x"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    p = F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    both, total = F.sum(F.col("t") * F.col("p")), F.sum(F.col("t") + F.col("p"))
    return j.groupBy("scene_id").agg(((2 * both + smooth) / (total + smooth)).alias("soft_dice"), ((both + smooth) / (total - both + smooth)).alias("soft_iou"), F.avg(-(F.col("t") * F.log(p) + (1 - F.col("t")) * F.log(1 - p))).alias("bce"))


def run_model_on_batches(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """An iterator body for mapInPandas over whole images (scene_id, image as nested lists) [F19]."""
    for frame in frames:
        images = np.stack([np.array(i, float) for i in frame["image"]]) if len(frame) else np.zeros((0, 1, 1, 3))
        yield pd.DataFrame({"scene_id": frame["scene_id"], "p": [p.tolist() for p in model(images)] if len(frame) else []})
