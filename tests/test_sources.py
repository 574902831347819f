import json
import zlib

import numpy as np
import pytest

from veinway.sources import images, manifests, vectors
from veinway.streaming import ingest


def test_png_round_trip_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (7, 9, 3), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(rgb)) == rgb).all()
    (tmp_path / "a.PNG").write_bytes(images.encode_png(rgb))
    (tmp_path / "b.txt").write_text("no image")
    assert [r.path.rsplit("/", 1)[1] for r in images.list_images(spark, str(tmp_path)).collect()] == ["a.PNG"]
    px = {(r.y, r.x): (r.r, r.g, r.b) for r in images.read_pixels(spark, str(tmp_path / "a.PNG")).collect()}
    assert len(px) == 63 and px[3, 4] == tuple(rgb[3, 4].tolist())
    grey = rng.integers(0, 256, (5, 6), dtype=np.uint8)
    (tmp_path / "m.png").write_bytes(images.encode_png(grey))
    got = {(r.y, r.x) for r in images.read_pixels(spark, str(tmp_path / "m.png"), mask=True).collect()}
    assert got == set(zip(*(v.tolist() for v in np.nonzero(grey > 127)), strict=True))


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(4)
    want = rng.integers(0, 256, (5, 12)).astype(int)
    rows, above = [], np.zeros(12, int)
    for kind, line in enumerate(want):
        left, corner = np.concatenate(([0] * 3, line[:-3])), np.concatenate(([0] * 3, above[:-3]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (images.decode_png(raw).reshape(5, 12) == want).all()


def test_unknown_images_are_refused():
    with pytest.raises(ValueError, match="PNG"):
        images.decode(b"\xff\xd8\xff", "x.jpg")


def test_manifest_pairs_and_split(spark, tmp_path):
    rows = ["image_id,split,sat_image_path,mask_path"] + [f"{i},{'train' if i < 10 else 'valid'},s{i}.png,m{i}.png" for i in range(12)]
    (tmp_path / "metadata.csv").write_text("\n".join(rows))
    m = manifests.read_manifest(spark, str(tmp_path / "metadata.csv"))
    files = spark.createDataFrame([(f"{k}{i}.png",) for i in range(12) for k in "sm" if (k, i) != ("m", 3)], "path string")
    pairs = manifests.training_pairs(m, files)
    assert pairs.count() == 9 and [r.image_id for r in manifests.missing_pairs(m, files).collect()] == ["3"]
    parts = {r.image_id: r.part for r in manifests.split_train_val(pairs, ["image_id"]).collect()}
    order = sorted(parts)
    chosen = np.random.default_rng(42).permutation(9)[:1]
    assert [x for x in order if parts[x] == "val"] == [order[i] for i in sorted(chosen)]


def test_run_catalog(spark, tmp_path):
    def run(name, body):
        (tmp_path / name).mkdir()
        (tmp_path / name / "analysis_summary.json").write_text(body)

    run("a", json.dumps({"projectId": "a", "analysisDate": "2024-01-02", "networkSummary": {"roadSegments": {"value": 4}, "totalRoadLength": {"value": 1.5, "unit": "km"}}}))
    run("b", json.dumps({"projectId": "b", "analysisDate": "2024-03-01", "archived": True}))
    run("c", json.dumps({"analysisDate": "2024-02-01"}))
    run("d", "{broken")
    runs = manifests.read_runs(spark, str(tmp_path / "*" / "analysis_summary.json"))
    cat = manifests.run_catalog(runs).collect()
    assert [r.id for r in cat] == ["c", "a"] and cat[1].length == "1.5 km" and cat[1].segments == 4 and cat[0].name == "Recent Run"
    every = manifests.run_catalog(runs, include_archived=True)
    assert [r.id for r in every.collect()] == ["b", "c", "a"]
    assert manifests.lookup(every, "a").count() == 1 and manifests.without_run(every, "a").count() == 2
    with pytest.raises(KeyError):
        manifests.without_run(every, "zz")
    with pytest.raises(ValueError, match="run id"):
        manifests.lookup(every, "../x")


PIXELS = "array<struct<x:double,y:double>>"


def test_graphml_and_geojson_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([("s", 1, 0.0, 0.0, "endpoint"), ("s", 2, 10.0, 0.0, "passthrough")], "scene_id string, node int, x double, y double, kind string")
    edges = spark.createDataFrame([("s", 1, 2, 10.0, 7, "geometry_segment", [(0.0, 0.0), (10.0, 0.0)])], f"scene_id string, src int, dst int, length_px double, segment_id int, edge_kind string, pixels {PIXELS}")
    (tmp_path / "g.graphml").write_text(vectors.graphml(nodes, edges).first().graphml)
    n, e = vectors.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.node, r.x, r.kind) for r in n.collect()} == {("1", 0.0, "endpoint"), ("2", 10.0, "passthrough")}
    (r,) = e.collect()
    assert (r.src, r.dst, r.length_px, r.segment_id, len(r.pixels)) == ("1", "2", 10.0, 7, 2)
    text = vectors.feature_collections(vectors.geojson_features(nodes, edges)).first().geojson
    kinds = sorted(f["properties"].get("kind") for f in json.loads(text)["features"])
    assert kinds == ["endpoint", "junction", "road_segment"]
    multi = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [5, 5]], [[1, 1]]]}, "properties": {}}, *json.loads(text)["features"]]}
    (tmp_path / "g.geojson").write_text(json.dumps(multi))
    paths = vectors.paths_of(vectors.read_geojson(spark, str(tmp_path / "g.geojson")))
    assert paths.count() == 2
    nn, ee = vectors.graph_of_paths(paths, ["feature_id", "part"])
    assert nn.count() == 3 and ee.count() == 2


def test_stream_of_masks(spark, tmp_path):
    rows = [("s", 1, x, "2024-01-01 00:00:00") for x in range(5)] + [("s", 1, 0, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "scene_id string, y int, x int, at string").selectExpr("scene_id", "y", "x", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = ingest.mask_stream(spark, str(tmp_path / "in"))
    q = ingest.apply_each_batch(stream, lambda b: b.groupBy("scene_id").count(), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 6 and "rows" in ingest.progress(q)
    w = ingest.road_pixels_by_window(ingest.mask_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    w.awaitTermination()
    assert spark.table("w").agg({"road_pixels": "max"}).first()[0] == 5


def tiff(image, order="<", compression=1, predictor=1, tile=None, planar=1, extra=()):
    """A TIFF of an array (height, width, samples); ``extra``: (tag, type, values)."""
    import struct

    h, w, c = image.shape
    kind = image.dtype.newbyteorder(order)
    if predictor == 2:
        image = np.concatenate((image[:, :1], image[:, 1:] - image[:, :-1]), axis=1)
    pack = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([0, x]) for x in b)}[compression]
    planes = [image[:, :, k : k + 1] for k in range(c)] if planar == 2 else [image]
    parts = []
    for p in planes:
        if tile:
            full = np.pad(p, ((0, -h % tile), (0, -w % tile), (0, 0)))
            parts += [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            parts += [p[y : y + 3] for y in range(0, h, 3)]
    body = [pack(np.ascontiguousarray(p).astype(kind).tobytes()) for p in parts]
    at = np.cumsum([8, *map(len, body)])
    code = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * image.dtype.itemsize] * c), (259, 3, [compression]), (262, 3, [1]), (277, 3, [c]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [code] * c)]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, at[:-1].tolist()), (325, 4, list(map(len, body)))] if tile else [(273, 4, at[:-1].tolist()), (278, 4, [3]), (279, 4, list(map(len, body)))]
    tags = sorted(tags + list(extra))
    form = {2: "s", 3: "H", 4: "I", 12: "d"}
    values = [v if k == 2 else struct.pack(order + form[k] * len(v), *v) for _, k, v in tags]
    start = int(at[-1])
    rest = start + 2 + 12 * len(tags) + 4
    entries, tail = b"", b""
    for (tag, k, v), raw in zip(tags, values, strict=True):
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", rest + len(tail))
        tail += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, k, len(v)) + where
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + b"".join(body) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + tail


@pytest.mark.parametrize("options", [{}, {"order": ">"}, {"compression": 8, "predictor": 2}, {"compression": 32773}, {"tile": 16}, {"planar": 2}, {"planar": 2, "tile": 16, "compression": 8}])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_tiff_is_read_as_it_was(options, kind):
    from veinway.sources.tiff import decode_tiff

    if options.get("predictor") == 2 and kind == "f4":
        return
    image = np.random.default_rng(1).integers(0, 200, (20, 37, 3)).astype(kind)
    assert (decode_tiff(tiff(image, **options)) == image).all()


def test_lzw_of_the_format_s_own_kind():
    from veinway.sources.tiff import unpack_lzw

    def pack(data):
        out, held, bits, width, table, last = bytearray(), 0, 0, 9, {bytes([i]): i for i in range(256)}, b""
        n = 258

        def put(code):
            nonlocal held, bits
            held, bits = held << width | code, bits + width
            while bits >= 8:
                bits -= 8
                out.append(held >> bits & 255)
                held &= (1 << bits) - 1

        put(256)
        for x in data:
            word = last + bytes([x])
            if word in table:
                last = word
                continue
            put(table[last])
            table[word], n, last = n, n + 1, bytes([x])
            if n == 4094:
                put(256)
                table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
            else:
                width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        put(table[last])
        width = 9 if n + 1 < 512 else 10 if n + 1 < 1024 else 11 if n + 1 < 2048 else 12
        put(257)
        out.append(held << 8 - bits & 255 if bits else 0)
        return bytes(out)

    r = np.random.default_rng(2)
    for data in (b"aaaaaaaaaab", bytes(r.integers(0, 4, 30_000).astype(np.uint8)), bytes(r.integers(0, 256, 9000).astype(np.uint8))):
        assert unpack_lzw(pack(data)) == data


def test_where_an_image_lies(spark, tmp_path):
    from veinway.functions import geometry
    from veinway.sources import tiff as t
    from pyspark.sql import functions as F

    image = np.zeros((4, 5, 3), np.uint8)
    image[1, 2] = (9, 8, 7)
    keys = (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32643])
    (tmp_path / "a.tif").write_bytes(tiff(image, extra=[(33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [1.0, 1.0, 0.0, 500.0, 900.0, 0.0]), keys]))
    named = (34735, 3, [1, 1, 0, 1, 1026, 34737, 7, 2])
    (tmp_path / "b.tif").write_bytes(tiff(image, extra=[(34264, 12, [1.0, 2, 0, 3, 4, 5, 0, 6, 0, 0, 0, 0, 0, 0, 0, 1]), named, (34737, 2, b"x|My grid|\0")]))
    (tmp_path / "c.tif").write_bytes(tiff(image))
    (tmp_path / "d.png").write_bytes(images.encode_png(image))
    got = {r.scene_id.rsplit("/", 1)[1]: r for r in t.read_ground(spark, str(tmp_path)).collect()}
    assert got["a.tif"].crs == "EPSG:32643" and got["a.tif"].transform == [2.0, 0.0, 498.0, 0.0, -3.0, 903.0]
    assert got["b.tif"].crs == "My grid" and got["b.tif"].transform == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert got["c.tif"].crs is None and got["c.tif"].transform is None and got["d.png"].crs is None
    px = images.read_pixels(spark, str(tmp_path / "a.tif")).where("r = 9").join(t.read_ground(spark, str(tmp_path)), "scene_id")
    w = px.select(geometry.affine(F.col("x"), F.col("y"), F.col("transform")).alias("w")).first().w
    assert (w.x, w.y) == (502.0, 900.0)


def test_choice_overlay_and_progress_file(spark, tmp_path):
    import time

    (tmp_path / "b").write_text("x")
    paths = [str(tmp_path / p) for p in ("a", "b", "c")]
    assert manifests.first_existing(spark, paths) == paths[1] and manifests.first_existing(spark, [paths[0], paths[2]]) == paths[2]
    image = np.full((2, 2, 3), 100, np.uint8)
    assert images.overlay(image, np.array([[1, 0], [0, 0]]))[0].tolist() == [[178, 50, 50], [100, 100, 100]]
    listener = ingest.ProgressFile(str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame([("s", 1, 2)], "scene_id string, y int, x int").selectExpr("*", "timestamp'2024-01-01' AS at").write.parquet(str(tmp_path / "in"))
        ingest.apply_each_batch(ingest.mask_stream(spark, str(tmp_path / "in")), lambda d: d, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        for _ in range(50):
            if (tmp_path / "progress").exists():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (tmp_path / "progress").read_text().startswith("batch 0: 1 rows")
