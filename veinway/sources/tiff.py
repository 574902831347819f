"""TIFF files: pixels, and where they lie on the ground.

Baseline files are read: strips or tiles, one or several samples a pixel (together or in
planes), 8 to 64 bits, without compression or by deflate, LZW or PackBits, with or without
differences along rows. Only the first image of a file is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

# Fixed values of the TIFF 6.0 and GeoTIFF 1.1 formats: tags, sizes of field types, keys.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, PALETTE, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 320, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS, GEO_TEXT = 33550, 33922, 34264, 34735, 34737
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
PROJECTED, GEOGRAPHIC, CITATIONS, USER_DEFINED = 3072, 2048, (3073, 2049, 1026), 32767


def read_tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in FIELDS:
            continue
        form = order + (f"{n}s" if kind == 2 else FIELDS[kind] * n)
        size, place = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            place = struct.unpack(order + "I", raw[place : place + 4])[0]
        tags[tag] = struct.unpack(form, raw[place : place + size])
    return order, tags


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    clear, end = 256, 257
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, width, held, bits = list(start), bytearray(), b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == end:
            break
        if code == clear:
            table, last, width = list(start), b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        # one entry early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode_tiff(raw: bytes) -> np.ndarray:
    """(height, width, samples) of the first image, palettes as 8-bit RGB."""
    order, t = read_tags(raw)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, form = one(BITS, 1), one(FORMAT, 1)
    if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or one(COMPRESSION, 1) not in UNPACK:
        raise ValueError("this kind of TIFF is not read")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    tiled, apart = TILES in t, one(PLANAR, 1) == 2
    high, wide = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    inner, planes = (1, samples) if apart else (samples, 1)
    across, down = -(-width // wide), -(-height // high)
    out = np.zeros((down * high, across * wide, samples), kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(t[TILES if tiled else STRIPS], t[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        plane, spot = divmod(k, across * down)
        y, x = spot // across * high, spot % across * wide
        rows = high if tiled else min(high, height - y)
        part = np.frombuffer(UNPACK[one(COMPRESSION, 1)](raw[at : at + n]), kind, rows * wide * inner).reshape(rows, wide, inner)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[y : y + rows, x : x + wide, plane * inner if apart else 0 : (plane + 1) * inner if apart else samples] = part
    image = out[:height, :width]
    if one(PHOTOMETRIC, 1) == 3 and PALETTE in t:
        return (np.array(t[PALETTE]).reshape(3, -1).T >> 8).astype(np.uint8)[image[:, :, 0]]
    return image


def ground(raw: bytes) -> tuple[str | None, list[float] | None]:
    """Coordinate system (EPSG code, else its text) and six affine coefficients, as far as the file has them [S13]."""
    order, t = read_tags(raw)
    transform = None
    if TRANSFORMATION in t:
        m = t[TRANSFORMATION]
        transform = [float(m[i]) for i in (0, 1, 3, 4, 5, 7)]
    elif PIXEL_SCALE in t and TIE_POINT in t:
        sx, sy = t[PIXEL_SCALE][:2]
        i, j, _, x, y, _ = t[TIE_POINT][:6]
        transform = [float(v) for v in (sx, 0, x - i * sx, 0, -sy, y + j * sy)]
    known = t.get(GEO_KEYS, ())
    keys = {known[k]: known[k + 1 : k + 4] for k in range(4, len(known) - 3, 4)}
    for key in (PROJECTED, GEOGRAPHIC):
        if key in keys and keys[key][0] == 0 and keys[key][2] not in (0, USER_DEFINED):
            return f"EPSG:{keys[key][2]}", transform
    text = t.get(GEO_TEXT, (b"",))[0].decode("latin-1")
    for key in CITATIONS:
        if key in keys and keys[key][0] == GEO_TEXT:
            _, n, at = keys[key]
            return text[at : at + n].rstrip("|\0"), transform
    return None, transform


def read_ground(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(scene_id, crs, transform) of image files; null for what a file does not have, or if it is no TIFF [S13]."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    crs, transform = ground(bytes(raw))
                except (ValueError, struct.error):
                    crs = transform = None
                rows.append((path, crs, transform))
            yield pd.DataFrame(rows, columns=["scene_id", "crs", "transform"])

    return files.mapInPandas(run, "scene_id string, crs string, transform array<double>")
