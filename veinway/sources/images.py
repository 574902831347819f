"""Image files as pixel relations: listing, decoding, and writing masks.

PNG (8-bit, not interlaced), binary PPM/PGM and baseline TIFF are decoded here with zlib and
NumPy; other formats need a decoder passed in and are refused by name otherwise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .tiff import decode_tiff

SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
Decoder = Callable[[bytes], np.ndarray]


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of image files in order, by suffix whatever its case [S1]."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    return files.where(F.lower("path").rlike(r"\.(png|jpe?g|tiff?)$")).orderBy("path")


def decode_png(raw: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG that isn't interlaced; palettes become RGB."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, palette, head = 8, [], None, None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNGs without interlacing are read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            left = np.zeros(channels, np.int64)
            for i in range(0, len(line), channels):
                up = above[i : i + channels]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[i - channels : i] if i else np.zeros(channels, np.int64)
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = line[i : i + channels] = (line[i : i + channels] + guess) & 255
        above = line & 255
        out[y] = above
    image = out.reshape(height, width, channels)
    return palette[image[:, :, 0]] if color == 3 else image


def decode_netpbm(raw: bytes) -> np.ndarray:
    """Binary PGM or PPM with 8-bit samples."""
    kind, width, height, most, data = raw.split(None, 4) if raw[:2] in (b"P5", b"P6") else (b"", b"0", b"0", b"0", b"")
    if not kind or int(most) > 255:
        raise ValueError("no 8-bit PGM or PPM")
    c = 3 if kind == b"P6" else 1
    return np.frombuffer(data[: int(width) * int(height) * c], np.uint8).reshape(int(height), int(width), c)


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB PNG [K5]."""
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, c = image.shape
    rows = np.hstack((np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, w * c))).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def overlay(image: np.ndarray, mask: np.ndarray, color: tuple[int, int, int] = (255, 0, 0), share: float = 0.5) -> np.ndarray:
    """An RGB image with a color laid over the set pixels of a mask [K5]."""
    out = to_rgb(image).astype(float)
    out[mask > 0] = (1 - share) * out[mask > 0] + share * np.array(color)
    return np.rint(out).astype(np.uint8)


def to_rgb(image: np.ndarray) -> np.ndarray:
    """Three 8-bit channels: the first three, or the first repeated; other kinds are stretched to 0..255 [S2]."""
    image = image if image.ndim == 3 else image[:, :, None]
    image = image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    if image.dtype != np.uint8:
        low, high = float(image.min()), float(image.max())
        image = ((image - low) / (high - low) * 255).astype(np.uint8) if high > low else image.astype(np.uint8)
    return image


def decode(raw: bytes, path: str = "", extra: Decoder | None = None) -> np.ndarray:
    for reader in (decode_png, decode_netpbm, decode_tiff):
        try:
            return reader(raw)
        except (ValueError, TypeError):
            continue
    if extra:
        return extra(raw)
    raise ValueError(f"{path}: only 8-bit PNG, PGM and PPM and baseline TIFF are read without a decoder of your own")


def read_pixels(spark: SparkSession, paths: str | list[str], mask: bool = False, decoder: Decoder | None = None) -> DataFrame:
    """(scene_id, y, x, r, g, b) of images, or (scene_id, y, x) of mask pixels above 127 [S2, S3].

    Files are read by Spark, so any store will do; the scene is the file's path.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                image = to_rgb(decode(bytes(raw), path, decoder))
                if mask:
                    grey = image[:, :, 0] if (image[:, :, :1] == image).all() else np.rint(image @ [0.299, 0.587, 0.114])
                    ys, xs = np.nonzero(grey > 127)
                    yield pd.DataFrame({"scene_id": path, "y": ys.astype(np.int32), "x": xs.astype(np.int32)})
                else:
                    ys, xs = np.indices(image.shape[:2])
                    yield pd.DataFrame({"scene_id": path, "y": ys.ravel().astype(np.int32), "x": xs.ravel().astype(np.int32)} | {c: image[:, :, k].ravel().astype(np.int32) for k, c in enumerate("rgb")})

    return files.mapInPandas(run, "scene_id string, y int, x int" + ("" if mask else ", r int, g int, b int"))


def hsv(pixels: DataFrame) -> DataFrame:
    """Adds h (0..179), s and v (0..255) to r, g, b."""
    high, low = F.greatest("r", "g", "b").cast("double"), F.least("r", "g", "b").cast("double")
    d = high - low
    sector = F.when(d == 0, 0.0).when(high == F.col("r"), F.try_divide(F.col("g") - F.col("b"), d)).when(high == F.col("g"), 2 + F.try_divide(F.col("b") - F.col("r"), d)).otherwise(4 + F.try_divide(F.col("r") - F.col("g"), d))
    return pixels.withColumn("h", F.round(F.pmod(sector * 60, F.lit(360.0)) / 2).cast("int")).withColumn("s", F.when(high == 0, 0).otherwise(F.round(F.try_divide(255 * d, high))).cast("int")).withColumn("v", high.cast("int"))
