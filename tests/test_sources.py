"""Files written and read again, and reference systems."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import crs
from terralith.functions import geometry as G
from terralith.operators import features, raster, tiles
from terralith.sources import geotiff, readers, writers

SHAPES = ["POINT (1 2)", "LINESTRING (0 0, 1 1.5, 3 0)", "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 1), (2 3))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 5))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 7, 7 7, 5 5)))"]
SHAPES = [G.to_wkt(G.from_wkt(s)) for s in SHAPES]


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(i, s, f"n{i}", None if i == 2 else i * 1.5) for i, s in enumerate(SHAPES)], "id int, geom string, name string, w double")


def same(a: str, b: str) -> bool:
    """Equal but for the direction of rings."""
    g, h = G.from_wkt(a), G.from_wkt(b)
    return sorted(map(tuple, G.coordinates(g))) == sorted(map(tuple, G.coordinates(h))) and abs(G.area(g) - G.area(h)) < 1e-9


@pytest.mark.parametrize("kind", ["csv", "json", "geoparquet", "geojson", "wkt", "wkb"])
def test_features(spark, tmp_path, some, kind):
    path = str(tmp_path / kind)
    writers.write_features(some, path, kind)
    if kind in ("csv", "json"):
        got = (readers.csv if kind == "csv" else readers.json_lines)(spark, path).orderBy("id").collect()
        assert [(r.id, r.geom, r.name, r.w) for r in got] == [(r.id, r.geom, r.name, r.w) for r in some.orderBy("id").collect()]
    elif kind == "geoparquet":
        got = readers.parquet(spark, path).orderBy("id").collect()
        assert [r.geom for r in got] == SHAPES and got[2].w is None
    elif kind == "geojson":
        lines = [r.value for r in spark.read.text(path).collect()]
        rows = [readers.features_of(__import__("json").loads(x))[0] for x in lines]
        assert {(p["name"], G.to_wkt(g)) for _, g, p in rows} == {(f"n{i}", s) for i, s in enumerate(SHAPES)} and any(p["w"] is None for _, _, p in rows)
    elif kind == "wkt":
        assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(SHAPES)
    else:
        assert sorted(G.to_wkt(G.from_wkb(bytes(r.geometry))) for r in spark.read.parquet(path).collect()) == sorted(SHAPES)


@pytest.mark.parametrize("picked", [[0], [1, 4], [2, 5], [3]])
def test_shapefiles(spark, tmp_path, some, picked):
    df = some.where(F.col("id").isin(picked))
    writers.write_features(df.repartition(2), str(tmp_path / "s"), "shp")
    got = {r.props["name"]: r for r in readers.shapefile(spark, str(tmp_path / "s")).collect()}
    assert set(got) == {f"n{i}" for i in picked}
    for i in picked:
        assert same(got[f"n{i}"].geom, SHAPES[i]) and got[f"n{i}"].props["id"] == str(i)
    with pytest.raises(Exception, match="one kind"):
        writers.write_features(some.coalesce(1), str(tmp_path / "mixed"), "shp")
    assert not list((tmp_path / "mixed").glob("*.shp"))
    with pytest.raises(ValueError, match="longer"):
        writers.encode_dbf(["a"], [("x" * 300,)])


def test_one_collection_as_text(spark, some):
    import json

    d = json.loads(writers.geojson_text(some).first().value)
    assert d["type"] == "FeatureCollection" and len(d["features"]) == 6


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
def test_geotiff(dtype):
    image = (np.arange(2 * 30 * 41).reshape(2, 30, 41) % 251).astype(dtype)
    got, info = geotiff.decode(geotiff.encode(image, 5.0, 9.0, 0.5, nodata=7))
    assert (got == image).all() and got.dtype == image.dtype and info["nodata"] == 7 and geotiff.grid_of(info) == ("EPSG:4326", 5.0, 9.0, 0.5)


def handmade(blocks: list[bytes], w: int, h: int, bw: int, bh: int, pack: int, big: bool, predictor: int = 1) -> bytes:
    """A tiled file of bytes, one band, classic or big."""
    word, entry = ("Q", "<HHQQ") if big else ("I", "<HHII")
    kind = 16 if big else 4
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    tags = [(256, w), (257, h), (258, 8), (259, pack), (277, 1), (317, predictor), (322, bw), (323, bh), (324, None), (325, None)]
    directory = struct.calcsize("Q" if big else "H") + len(tags) * struct.calcsize(entry) + struct.calcsize(word)
    lists = len(head) + directory
    size = struct.calcsize(word) * len(blocks)
    first = lists + 2 * size
    offsets = [first + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    out = head + struct.pack("<Q" if big else "<H", len(tags))
    for tag, v in tags:
        out += struct.pack(entry, tag, kind if v is None else 4, len(blocks) if v is None else 1, (lists if tag == 324 else lists + size) if v is None else v)
    return out + struct.pack(f"<{word}", 0) + struct.pack(f"<{len(blocks)}{word}", *offsets) + struct.pack(f"<{len(blocks)}{word}", *map(len, blocks)) + b"".join(blocks)


def lzw(data: bytes) -> bytes:
    bits, n, width, table = 0, 0, 9, {bytes([i]): i for i in range(256)}
    out, now, after = bytearray(), b"", 258

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
            bits &= (1 << n) - 1

    put(256)
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        table[now + bytes([b])] = after
        after += 1
        if after in (512, 1024, 2048):  # one more than the reader, which is a code behind
            width += 1
        if after == 4094:
            put(256)
            width, after, table = 9, 258, {bytes([i]): i for i in range(256)}
        now = bytes([b])
    put(table[now])
    put(257)
    out.append(bits << (8 - n) & 255)
    return bytes(out)


def packed(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("pack,squeeze", [(1, bytes), (8, zlib.compress), (5, lzw), (32773, packed)])
def test_tiled_files(pack, squeeze, big):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 9, (100, 90), np.uint8).repeat(1, 0)
    padded = np.zeros((128, 128), np.uint8)
    padded[:100, :90] = image
    blocks = [squeeze(padded[y : y + 64, x : x + 64].tobytes()) for y in (0, 64) for x in (0, 64)]
    assert (geotiff.decode(handmade(blocks, 90, 100, 64, 64, pack, big))[0][0] == image).all()
    steps = np.diff(padded, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    blocks = [squeeze(np.concatenate([padded[y : y + 64, x : x + 1], steps[y : y + 64, x + 1 : x + 64]], 1).tobytes()) for y in (0, 64) for x in (0, 64)]
    assert (geotiff.decode(handmade(blocks, 90, 100, 64, 64, pack, big, 2))[0][0] == image).all()


def test_rasters_of_files(spark, tmp_path):
    image = np.arange(2 * 37 * 29, dtype=float).reshape(2, 37, 29)
    image[0, 3, 4] = -9.0
    (tmp_path / "r.tif").write_bytes(geotiff.encode(image, nodata=-9.0))
    cells = readers.read_geotiff(spark, str(tmp_path / "r.tif"))
    t = readers.read_tiles(spark, str(tmp_path / "r.tif"), 16)
    got = {(r.cov_id, r.band, r.cx, r.cy): r.v for r in tiles.from_tiles(t).collect()}
    assert got.pop(("r", "B1", 4, 3)) is None and got == {(r.cov_id, r.band, r.cx, r.cy): r.v for r in cells.collect()} and len(got) == 2 * 37 * 29 - 1
    blocks = {(r.bx, r.by): geotiff.decode(r.content)[0] for r in writers.tiff_blocks(t.drop("cov_id"), 20).collect()}
    back = np.block([[blocks[0, 0], blocks[1, 0]], [blocks[0, 1], blocks[1, 1]]])[:, :37, :29]
    image[0, 3, 4] = -9999
    assert (back == image).all()


def test_pictures(spark):
    cells = spark.createDataFrame([(b, x, y, float(40 * x + 3 * y)) for b in "RGB" for x in range(4) for y in range(4) if (x, y) != (2, 1)], "band string, cx int, cy int, v double")
    data = writers.picture_tiles(tiles.to_tiles(cells, 4)).first().content
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack_from(">2I", data, 16) == (4, 4)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack_from(">I", data, at - 4)[0]])
    image = np.frombuffer(raw, np.uint8).reshape(4, 17)[:, 1:].reshape(4, 4, 4)
    assert image[3, 1].tolist() == [49, 49, 49, 255] and image[1, 2, 3] == 0


def test_jdbc_is_refused_without_a_driver(spark):
    with pytest.raises(Exception, match="No suitable driver|ClassNotFound|driver"):
        readers.jdbc(spark, "jdbc:nothing:x", "SELECT 1")


# --- reference systems ---


def test_known_places():
    at = lambda x, y, to: tuple(float(v) for v in crs.transform(x, y, "EPSG:4326", f"EPSG:{to}"))
    assert at(15, 45, 32633) == pytest.approx((500000, 4982950.400), abs=0.001)
    assert at(12, 0, 32633) == pytest.approx((166021.443, 0), abs=0.001)
    assert at(15, -45, 32733) == pytest.approx((500000, 10_000_000 - 4982950.400), abs=0.001)
    assert at(114, 30, 4547) == pytest.approx((500000, 3320113.398), abs=0.01)
    assert at(114, 30, 4526)[0] == pytest.approx(38_500_000)
    assert at(10, 50, 3857) == pytest.approx((1113194.908, 6446275.841), abs=0.001)
    assert at(10, 50, 3395)[1] == pytest.approx(6413524.594, abs=0.01)
    with pytest.raises(ValueError, match="no formulas"):
        crs.transform(0, 0, 4326, 2154)


@pytest.mark.parametrize("epsg,lon", [(3857, 20), (3395, 20), (32633, 16), (32733, 16), (4547, 113), (4526, 113), (4508, 112), (4497, 112), (4490, 5)])
def test_there_and_back(epsg, lon):
    x, y = lon + np.linspace(-1.4, 1.4, 9), np.linspace(-70, 70, 9)
    u, v = crs.transform(*crs.transform(x, y, 4326, epsg), epsg, 4326)
    assert u == pytest.approx(x, abs=1e-9) and v == pytest.approx(y, abs=1e-9)


def test_features_in_another_system(spark, some):
    there = features.reproject(some, "EPSG:4326", "EPSG:32631")
    for r in features.reproject(there, "EPSG:32631", "EPSG:4326").collect():
        assert np.array(G.coordinates(G.from_wkt(r.geom))) == pytest.approx(np.array(G.coordinates(G.from_wkt(SHAPES[r.id]))), abs=1e-9)


@pytest.mark.parametrize("how", ["nearest", "bilinear"])
def test_warped_rasters(spark, how):
    """A slanted plane of longitude and latitude comes back at every cell centre of the other grid."""
    source, target = ("EPSG:4326", 14.0, 46.0, 0.01), ("EPSG:32633", 440000.0, 5090000.0, 900.0)
    n = 90
    cells = [("a", x, y, 2 * (14 + (x + 0.5) * 0.01) + 46 - (y + 0.5) * 0.01) for x in range(n) for y in range(n)]
    t = tiles.to_tiles(spark.createDataFrame(cells, "band string, cx int, cy int, v double"), 32)
    got = {(r.cx, r.cy): r.v for r in tiles.from_tiles(tiles.warped(t, source, target, how, 16)).collect()}
    want = {}
    for i in range(-40, 140):
        for j in range(-40, 140):
            x, y = (float(v) for v in crs.transform(440000 + (i + 0.5) * 900, 5090000 - (j + 0.5) * 900, "EPSG:32633", "EPSG:4326"))
            if 14 <= x < 14.9 and 45.1 < y <= 46:
                want[i, j] = 2 * x + y
    assert set(got) == set(want) and len(want) > 5000
    inner = [k for k in want if how == "nearest" or all((k[0] + a, k[1] + b) in want for a in (-2, 2) for b in (-2, 2))]
    assert max(abs(got[k] - want[k]) for k in inner) < (0.0151 if how == "nearest" else 1e-9)


def test_the_finer_grid_wins(spark):
    fine = tiles.to_tiles(spark.createDataFrame([("a", x, y, 1.0) for x in range(20) for y in range(20)], "band string, cx int, cy int, v double"), 8)
    rough = tiles.to_tiles(spark.createDataFrame([("a", x, y, 10.0 * x + y) for x in range(10) for y in range(10)], "band string, cx int, cy int, v double"), 8)
    a, b, grid = raster.aligned(rough, fine, ("EPSG:4326", 0.0, 0.0, 2.0), ("EPSG:4326", 5.0, -3.0, 0.5))
    assert grid[3] == 0.5
    got = {(r.cx, r.cy): r.v for r in tiles.from_tiles(raster.binary(a, b, "add")).collect()}
    assert got == {(x, y): 1 + 10.0 * int((5 + (x + 0.5) / 2) // 2) + int((3 + (y + 0.5) / 2) // 2) for x in range(20) for y in range(20)}


def test_cell_types(spark):
    rows = [("a", 1.0), ("a", 100.0), ("b", 1.0), ("b", 255.0), ("c", -300.0), ("c", 5.0), ("d", 0.5), ("e", 0.1), ("f", 60000.0), ("f", 2.0), ("g", 1e6), ("g", -5.0)]
    cells = spark.createDataFrame([(b, i, 0, v) for i, (b, v) in enumerate(rows)], "band string, cx int, cy int, v double")
    assert {r.band: r.kind for r in raster.band_types(cells).collect()} == {"a": "int8", "b": "uint8", "c": "int16", "d": "float", "e": "double", "f": "uint16", "g": "int32"}
