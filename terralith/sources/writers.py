"""Sinks of features and rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import geotiff


def geojson_features(df: DataFrame, geom: str = "geom") -> DataFrame:
    """(value): a GeoJSON feature a row, all other columns as its properties."""
    props = [c for c in df.columns if c != geom]
    shape = G.to_geojson_column()(F.col(geom))
    body = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    return df.select(F.concat(F.lit('{"type": "Feature", "geometry": '), F.coalesce(shape, F.lit("null")), F.lit(', "properties": '), body, F.lit("}")).alias("value"))


def geojson_text(df: DataFrame, geom: str = "geom") -> DataFrame:
    """(value): one feature collection; for results that fit in one row."""
    f = geojson_features(df, geom)
    return f.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.sort_array(F.collect_list("value")), ", "), F.lit("]}")).alias("value"))


def write_features(df: DataFrame, path: str, kind: str, geom: str = "geom") -> None:
    """csv and json with WKT, geojson (a feature a line), wkt, wkb, shp (a pair of files a partition), or geoparquet with WKB in ``geometry``."""
    w = lambda d: d.write.mode("overwrite")
    if kind == "csv":
        w(df).option("header", True).csv(path)
    elif kind == "json":
        w(df).json(path)
    elif kind == "geojson":
        w(geojson_features(df, geom)).text(path)
    elif kind == "wkt":
        w(df.select(F.col(geom).alias("value"))).text(path)
    elif kind == "wkb":
        w(df.select(G.to_wkb_column()(geom).alias("geometry"))).parquet(path)
    elif kind == "shp":
        shapefiles(df, path, geom)
    elif kind == "geoparquet":
        w(df.withColumn("geometry", G.to_wkb_column()(geom)).drop(geom)).parquet(path)
    else:
        raise ValueError(f"no such format: {kind}")


def encode_shp(geoms: list) -> tuple[bytes, bytes]:
    """(.shp, .shx) of geometries of one kind: points, lines or polygons, single or multiple."""
    import struct

    kinds = {"Point": 1, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5, "MultiPoint": 8}
    code = {kinds[g[0]] for g in geoms if g is not None}
    if len(code) > 1:
        raise ValueError("a shapefile holds geometries of one kind")
    code = code.pop() if code else 1
    body, index, at = b"", b"", 50
    box = [np.inf, np.inf, -np.inf, -np.inf]
    for i, g in enumerate(geoms, 1):
        if g is None or not G.coordinates(g):
            raw = struct.pack("<i", 0)
        else:
            b = G.bounds(g)
            box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
            if code == 1:
                raw = struct.pack("<idd", 1, *G.coordinates(g)[0])
            elif code == 8:
                p = G.coordinates(g)
                raw = struct.pack(f"<i4di{2 * len(p)}d", 8, *b, len(p), *[v for q in p for v in q])
            else:
                rings = [g[1]] if g[0] == "LineString" else g[1] if g[0] == "MultiLineString" else [_wound(r, k == 0) for poly in G.polygons(g) for k, r in enumerate(poly)]
                starts = np.cumsum([0, *map(len, rings[:-1])]).tolist()
                flat = [v for r in rings for q in r for v in q]
                raw = struct.pack(f"<i4d2i{len(rings)}i{len(flat)}d", code, *b, len(rings), len(flat) // 2, *starts, *flat)
        body += struct.pack(">2i", i, len(raw) // 2) + raw
        index += struct.pack(">2i", at, len(raw) // 2)
        at += 4 + len(raw) // 2
    box = box if np.isfinite(box[0]) else [0.0] * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0)
    return head(50 + len(body) // 2) + body, head(50 + len(index) // 2) + index


def _wound(ring: list, outer: bool) -> list:
    """Outer rings clockwise, holes the other way."""
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring if (turn < 0) == outer else ring[::-1]


def encode_dbf(names: list[str], rows: list[tuple]) -> bytes:
    """Text fields of up to 254 bytes; a longer value is an error, not cut."""
    import struct

    if len({n[:10] for n in names}) < len(names):
        raise ValueError("field names must differ in their first ten characters")
    text = [["" if v is None else str(v) for v in r] for r in rows]
    wide = [min(254, max([1, *(len(r[i].encode()) for r in text)])) for i in range(len(names))]
    if any(len(r[i].encode()) > 254 for r in text for i in range(len(names))):
        raise ValueError("a value is longer than 254 bytes")
    head = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(wide))
    fields = b"".join(n.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in zip(names, wide))
    return head + fields + b"\r" + b"".join(b" " + b"".join(v.encode().ljust(w) for v, w in zip(r, wide)) for r in text) + b"\x1a"


def shapefiles(df: DataFrame, path: str, geom: str = "geom") -> None:
    """part-N.shp, .shx and .dbf for each partition, written by its task to a folder that all executors share.

    Files get their names only when they are whole, so a task that is run again does no harm.
    """
    import os

    names = [c for c in df.columns if c != geom]
    os.makedirs(path, exist_ok=True)

    def run(batches):
        from pyspark import TaskContext

        part, geoms, rows = TaskContext.get(), [], []
        for b in batches:
            geoms += [None if g is None else G.from_wkt(g) for g in b.column(geom).to_pylist()]
            rows += zip(*[b.column(n).to_pylist() for n in names]) if names else [()] * b.num_rows
        if geoms:
            shp, shx = encode_shp(geoms)
            for kind, data in (("shp", shp), ("shx", shx), ("dbf", encode_dbf(names, rows))):
                name = f"{path}/part-{part.partitionId():05d}.{kind}"
                with open(f"{name}.{part.taskAttemptId()}", "wb") as f:
                    f.write(data)
                os.replace(f"{name}.{part.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([len(geoms)])], ["n"])

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def png(rgb: np.ndarray) -> bytes:
    """A PNG of (rows, columns, 3 or 4) bytes."""
    import struct
    import zlib

    h, w, n = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * n)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture_tiles(styled: DataFrame) -> DataFrame:
    """(tx, ty, content): a PNG of each tile of a styled raster: one band in grey, or bands R, G and B; no data is clear."""
    from ..operators import tiles

    t = tiles.tiles_of(styled)

    def run(t: pa.Table) -> pa.Table:
        bands = {b: c.values.to_numpy(zero_copy_only=False) for b, c in zip(t["band"].to_pylist(), t["cells"].combine_chunks())}
        names = [n for n in ("R", "G", "B") if n in bands]
        one = [bands[n] for n in names] if len(names) == 3 else [bands[sorted(bands)[0]]] * 3
        n = int(round(len(one[0]) ** 0.5))
        clear = np.any([np.isnan(v) for v in one], 0)
        image = np.stack([*[np.clip(np.nan_to_num(v), 0, 255) for v in one], np.where(clear, 0, 255)], 1).reshape(n, n, 4)
        return pa.table({"tx": t["tx"].combine_chunks()[:1], "ty": t["ty"].combine_chunks()[:1], "content": pa.array([png(image)], pa.binary())})

    return t.select("band", "tx", "ty", "cells").groupBy("tx", "ty").applyInArrow(run, "tx int, ty int, content binary")


def tiff_blocks(cells: DataFrame, block: int = 1024, size: float = 1.0, x0: float = 0.0, y1: float = 0.0, nodata: float = -9999.0) -> DataFrame:
    """(bx, by, content): a GeoTIFF for each block of cells, made in parallel; no image is on one machine."""
    from ..operators.tiles import cells_of

    t = cells_of(cells).select("band", "cx", "cy", F.col("v").cast("double").alias("v"), F.floor(F.col("cx") / block).cast("int").alias("bx"), F.floor(F.col("cy") / block).cast("int").alias("by"))

    def make(t: pa.Table) -> pa.Table:
        bx, by = t["bx"][0].as_py(), t["by"][0].as_py()
        names = sorted(set(t["band"].to_pylist()))
        image = np.full((len(names), block, block), nodata)
        v = t["v"].to_numpy(zero_copy_only=False).astype(float)
        v = np.where(np.isnan(v), nodata, v)
        image[np.array([names.index(b) for b in t["band"].to_pylist()]), t["cy"].to_numpy() - by * block, t["cx"].to_numpy() - bx * block] = v
        data = geotiff.encode(image, x0 + bx * block * size, y1 - by * block * size, size, nodata=nodata)
        return pa.table({"bx": pa.array([bx], pa.int32()), "by": pa.array([by], pa.int32()), "content": pa.array([data], pa.binary())})

    return t.groupBy("bx", "by").applyInArrow(make, "bx int, by int, content binary")


def ascii_grid(cells: DataFrame, cols: int, rows: int, nodata: float = -9999.0) -> DataFrame:
    """(band, cy, line): rows of an ASCII grid."""
    m = cells.groupBy("band", "cy").agg(F.map_from_entries(F.collect_list(F.struct("cx", "v"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(nodata)).cast("string")), " ")
    return m.where((F.col("cy") >= 0) & (F.col("cy") < rows)).select("band", "cy", line.alias("line"))


def write_pyramid(levels: DataFrame, path: str) -> None:
    """Levels of a pyramid, a folder each."""
    levels.write.mode("overwrite").partitionBy("level").parquet(path)
