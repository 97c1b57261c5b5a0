"""Sources of features and rasters, and the catalog of coverages."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import geotiff


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of files by their ending: csv, json, geojson, parquet or shp."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "shp":
        return shapefile(spark, path[:-3] + "{shp,dbf}")
    return {"csv": csv, "json": json_lines, "geojson": geojson, "parquet": parquet}[end](spark, path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, with WKT in ``geom``; types are inferred without a schema."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; a ``geometry`` column of WKB becomes ``geom`` in WKT."""
    df = spark.read.parquet(path)
    if "geometry" in df.columns and "geom" not in df.columns:
        kind = df.schema["geometry"].dataType.typeName()
        df = df.withColumn("geom", G.from_wkb_column()("geometry") if kind == "binary" else F.col("geometry")).drop("geometry")
    return df


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, geom, props, source_file) of GeoJSON files: a collection, a feature or a geometry."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("source_file"))

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"id": [], "geom": [], "props": [], "source_file": []}
            for text, file in zip(b.column("value").to_pylist(), b.column("source_file").to_pylist()):
                for i, (fid, g, props) in enumerate(features_of(json.loads(text))):
                    out["id"].append(str(i) if fid is None else str(fid))
                    out["geom"].append(G.to_wkt(g) if g else None)
                    out["props"].append([(k, None if v is None else str(v)) for k, v in props.items()])
                    out["source_file"].append(file)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.string()), pa.array(out["geom"], pa.string()), pa.array(out["props"], pa.map_(pa.string(), pa.string())), pa.array(out["source_file"], pa.string())], list(out))

    return raw.mapInArrow(run, "id string, geom string, props map<string,string>, source_file string")


def features_of(d: dict) -> list[tuple]:
    """(id, geometry, properties) of a parsed GeoJSON object."""
    if d["type"] == "FeatureCollection":
        return [f for x in d["features"] for f in features_of(x)]
    if d["type"] == "Feature":
        return [(d.get("id"), G.from_geojson(d["geometry"]) if d.get("geometry") else None, d.get("properties") or {})]
    return [(None, G.from_geojson(d), {})]


def parse_shp(data: bytes) -> list[tuple]:
    """Geometries of a shapefile's main part: points, lines, polygons and multipoints."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        rec = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", rec)[0] % 10
        if kind == 0:
            out.append(("Point", ()))
        elif kind == 1:
            out.append(("Point", struct.unpack_from("<2d", rec, 4)))
        elif kind == 8:
            n = struct.unpack_from("<i", rec, 36)[0]
            out.append(("MultiPoint", [struct.unpack_from("<2d", rec, 40 + 16 * i) for i in range(n)]))
        else:
            parts, n = struct.unpack_from("<2i", rec, 36)
            first = [*struct.unpack_from(f"<{parts}i", rec, 44), n]
            base = 44 + 4 * parts
            ps = [struct.unpack_from("<2d", rec, base + 16 * i) for i in range(n)]
            lines = [ps[a:b] for a, b in zip(first, first[1:])]
            if kind == 3:
                out.append(("LineString", lines[0]) if len(lines) == 1 else ("MultiLineString", lines))
            else:  # shells are clockwise in a shapefile
                shells = [[r] for r in lines if G.ring_area(r) <= 0] or [[lines[0]]]
                for h in (r for r in lines if G.ring_area(r) > 0):
                    owner = next((s for s in shells if G._in_ring(h[0], s[0]) != "e"), shells[0])
                    if h is not owner[0]:
                        owner.append(h)
                out.append(("Polygon", shells[0]) if len(shells) == 1 else ("MultiPolygon", shells))
    return out


def parse_dbf(data: bytes) -> list[dict]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, _, width in fields:
            row[name] = data[at : at + width].decode("utf-8", "replace").strip() or None
            at += width
        rows.append(row)
    return rows


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(id, geom, props, source_file) of .shp files with their .dbf beside them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path).select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.col("path"), "content")

    def run(t: pa.Table) -> pa.Table:
        by = {p[-3:].lower(): c for p, c in zip(t["path"].to_pylist(), t["content"].to_pylist())}
        geoms = parse_shp(by["shp"]) if "shp" in by else []
        props = parse_dbf(by["dbf"]) if "dbf" in by else [{}] * len(geoms)
        n = len(geoms)
        return pa.table({"id": pa.array([str(i) for i in range(n)], pa.string()), "geom": pa.array(map(G.to_wkt, geoms), pa.string()), "props": pa.array([list(p.items()) for p in props[:n]], pa.map_(pa.string(), pa.string())), "source_file": pa.array([t["stem"][0].as_py()] * n, pa.string())})

    return files.groupBy("stem").applyInArrow(run, "id string, geom string, props map<string,string>, source_file string")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows; Spark pushes further filters and columns into it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_tiles(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """(cov_id, band, tx, ty, cells) of GeoTIFF files, a file a task."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[Tt][Ii][Ff]+$", 1).alias("cov_id"), "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("cov_id").to_pylist(), b.column("content").to_pylist()):
                yield from geotiff.tiles(name, *geotiff.decode(data), size)

    return raw.mapInArrow(run, "cov_id string, band string, tx int, ty int, cells array<double>")


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(cov_id, band, cx, cy, v) of GeoTIFF files, a file a task; NoData leaves no row."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[Tt][Ii][Ff]+$", 1).alias("cov_id"), "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("cov_id").to_pylist(), b.column("content").to_pylist()):
                image, info = geotiff.decode(data)
                yield from geotiff.cells(name, image, info)

    return raw.mapInArrow(run, "cov_id string, band string, cx int, cy int, v double")


def catalog_query(catalog: DataFrame, product: str | None = None, sensor: str | None = None, bands: list[str] | None = None, start: str | None = None, end: str | None = None, extent: tuple | None = None, crs: str | None = None, cloud: tuple[float, float] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Catalog rows that meet all conditions given; start and end are independent."""
    for name, v in (("product", product), ("sensor", sensor), ("crs", crs)):
        catalog = catalog.where(F.col(name) == v) if v is not None else catalog
    if bands:
        catalog = catalog.where(F.col("band").isin(bands))
    if ids:
        catalog = catalog.where(F.col("cov_id").isin(ids))
    if start:
        catalog = catalog.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end:
        catalog = catalog.where(F.col("time") <= F.lit(end).cast("timestamp"))
    if cloud:
        catalog = catalog.where(F.col("cloud").between(*cloud))
    if extent:
        x0, y0, x1, y1 = extent
        catalog = catalog.where((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))
    return catalog
