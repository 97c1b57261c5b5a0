"""Every operator that a graph may call, by name and with the arguments that graphs give.

Arguments come as values or as the text that graphs hold ("[a, b]", "true", "1.5"). Coverages
are tile (or cell) tables, features and collections are tables (id, geom, properties), a
geometry is WKT. What lies outside of a graph comes with its context: ``spark``; ``catalog``
and ``imagery`` (images by ``cov_id``); ``products`` (name -> table of features or a path);
``tables``, ``cubes`` (name -> table); ``folder`` for uploads and results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cellmath
from ..functions import geometry as G
from ..operators import collection, cube, features, focal, interpolation, raster, regression, spatial, statistics, terrain, tiles
from ..sources import readers, writers

NAMES: dict[str, Callable] = {}


def op(*names: str):
    def keep(f: Callable) -> Callable:
        for n in names:
            NAMES[n] = f
        return f

    return keep


# --- arguments ---


def listed(x, kind: Callable = str) -> list:
    """A list from a list or from its text: "[a, b]" or "a,b"."""
    if x is None:
        return []
    if isinstance(x, str):
        t = x.strip()
        try:
            got = json.loads(t) if t.startswith("[") else None
        except ValueError:
            got = None
        x = got if isinstance(got, list) else [v.strip().strip("'\"") for v in t.strip("[]").split(",") if v.strip()]
    return [kind(v) for v in (x if isinstance(x, (list, tuple)) else [x])]


def flag(x) -> bool:
    return x if isinstance(x, bool) else str(x).strip().lower() in ("true", "1", "yes")


def optional(x, kind: Callable = float):
    return None if x is None or x == "" else kind(x)


def centres(df: DataFrame, geom: str = "geom") -> DataFrame:
    """A collection with x and y: those it has, or its geometries' centroids."""
    if {"x", "y"} <= set(df.columns):
        return df
    b = spatial.with_bounds(df.withColumn("__c", G.shape("centroid")(geom)), "__c")
    return b.withColumnsRenamed({"xmin": "x", "ymin": "y"}).drop("xmax", "ymax", "__c")


def value_of(df: DataFrame, c) -> DataFrame:
    return df.select("id", c.alias("value"))


def one_geometry(x, geom: str = "geom") -> str:
    """WKT of a geometry, or of a single feature's one row."""
    return x if isinstance(x, str) else x.select(geom).first()[0]


@dataclass
class Images:
    """A selection of the catalog's images; read when an operator needs pixels."""

    catalog: DataFrame
    imagery: DataFrame
    bands: list[str]

    def pixels(self) -> DataFrame:
        got = self.imagery.join(self.catalog.select("cov_id").distinct(), "cov_id", "left_semi")
        return got.where(F.col("band").isin(self.bands)) if self.bands else got


def pixels(x) -> DataFrame:
    return x.pixels() if isinstance(x, Images) else x


# --- services and filters ---


@op("Service.printString", "Service.printNumber", "Service.printList")
def _print(object, name=""):
    return {"name": name, "value": object, "type": type(object).__name__}


@op("Service.getCoverageCollection")
def _images(catalog, imagery, productID=None, datetime=None, bbox=None, cloudCoverMin=None, cloudCoverMax=None, customFiles=None, bands=None, coverageIDList=None):
    if customFiles:
        ids = [str(f).rsplit("/", 1)[-1].rsplit(".", 1)[0] for f in listed(customFiles)]
        return Images(readers.read_tiles(imagery.sparkSession, ",".join(listed(customFiles))).select("cov_id").where(F.col("cov_id").isin(ids)), readers.read_tiles(imagery.sparkSession, listed(customFiles)), listed(bands))
    start, end = (listed(datetime) + [None, None])[:2] if datetime else (None, None)
    low, high = (0.0 if cloudCoverMin is None else float(cloudCoverMin)), (100.0 if cloudCoverMax is None else float(cloudCoverMax))
    got = readers.catalog_query(catalog, productID, start=start, end=end, extent=tuple(listed(bbox, float)) if bbox else None, cloud=(low, high), ids=listed(coverageIDList) or None)
    return Images(got, imagery, listed(bands))


@op("Service.getCoverageByFeature")
def _images_at(catalog, imagery, feature, productID=None):
    return Images(readers.catalog_query(catalog, productID, extent=G.bounds(G.from_wkt(one_geometry(feature)))), imagery, [])


@op("Service.getCoverage")
def _coverage(spark, coverageID, productID=None, imagery=None, folder=""):
    if "/" in coverageID or coverageID.lower().endswith((".tif", ".tiff")):
        path = coverageID if coverageID.startswith(("file:", "/")) or "://" in coverageID else f"{folder}/{coverageID}"
        return readers.read_tiles(spark, path).drop("cov_id")
    got = imagery.where(F.col("cov_id") == coverageID)
    return (got.where(F.col("product") == productID) if productID and "product" in got.columns else got).drop("cov_id", "product")


@op("Service.getCube")
def _cube(cubes, cubeId, products=None, bands=None, time=None, extent=None, tms=None, resolution=None):
    start, end = (listed(time) + [None, None])[:2]
    return cube.load(cubes[cubeId], listed(products) or None, listed(bands) or None, start, end, tuple(listed(extent, int)) if extent else None)


@op("Service.getTable")
def _table(tables, productID):
    return tables[productID]


def _product(spark, products, name: str, folder: str) -> DataFrame:
    got = (products or {}).get(name, name if name.startswith("/") else f"{folder}/{name}")
    return got if isinstance(got, DataFrame) else readers.features(spark, got)


@op("Service.getFeatureCollection", "FeatureCollection.load")
def _features(spark, productId, extent=None, startTime=None, endTime=None, crs=None, products=None, folder=""):
    got = _product(spark, products, productId, folder)
    got = spatial.query(got, extent, "Intersects") if extent else got
    if startTime or endTime:
        got = features.filter_date(got, startTime or "0001-01-01", endTime or "9999-12-31")
    return got


@op("FeatureCollection.loadFeatureCollectionFromUpload")
def _upload(spark, featureId, crs=None, products=None, folder=""):
    return _product(spark, products, featureId, folder)


@op("Service.getFeature", "Feature.load", "Feature.loadFeatureFromUpload", "Feature_deprecated.load")
def _feature(spark, featureId, productId=None, crs=None, products=None, folder="", dataTime=None, dateTime=None, productName=None):
    name = productId or productName
    return _product(spark, products, name, folder).where(F.col("id") == featureId) if name else _product(spark, products, featureId, folder)


@op("FeatureCollection.loadAllTableElements")
def _all_rows(tables, tableName, geometryColumn="geom"):
    return tables[tableName].withColumnRenamed(geometryColumn, "geom")


@op("FeatureCollection.loadWithRestrictions")
def _some_rows(spark, tables, queryInSQL, geometryColumn="geom"):
    for name, t in tables.items():
        t.createOrReplaceTempView(name)
    return spark.sql(queryInSQL).withColumnRenamed(geometryColumn, "geom")


_FIELDS = {"sensorName": "sensor", "measurementName": "band", "productName": "product", "crs": "crs"}
NAMES["Filter.equals"] = lambda leftField, rightValue: collection.equals(_FIELDS.get(leftField, leftField), rightValue)
NAMES["Filter.date"] = lambda startTime, endTime: collection.date(startTime, endTime)
NAMES["Filter.bounds"] = lambda bounds: collection.bounds(*listed(bounds, float))
NAMES["Filter.and"] = lambda filters: collection.all_of(*filters)

# --- coverages ---

_UNARY = {"round": "round", "not": "not", "bitwiseNot": "bitwise_not", **{n: n for n in ("ceil", "floor", "sin", "tan", "tanh", "cos", "sinh", "cosh", "asin", "acos", "atan", "log", "log10", "abs", "signum", "cbrt", "sqrt")}}
for _n, _f in _UNARY.items():
    if _n == "not":
        NAMES["Coverage.not"] = lambda coverage1=None, coverage=None: raster.unary(pixels(coverage1 if coverage is None else coverage), "not")
    else:
        NAMES[f"Coverage.{_n}"] = lambda coverage, f=_f: raster.unary(pixels(coverage), f)
for _n in ("add", "subtract", "multiply", "divide", "mod", "and", "or", "atan2", "eq", "neq", "gt", "gte", "lt", "lte", "pow", "mini", "maxi"):
    NAMES[f"Coverage.{_n}"] = lambda coverage1, coverage2, f=_n: raster.binary(pixels(coverage1), pixels(coverage2), f)
for _n, _f in (("bitwiseAnd", "bitwise_and"), ("bitwiseOr", "bitwise_or"), ("bitwiseXor", "bitwise_xor"), ("rasterUnion", "raster_union")):
    NAMES[f"Coverage.{_n}"] = lambda coverage1, coverage2, f=_f: raster.binary(pixels(coverage1), pixels(coverage2), f)
for _n in ("add", "subtract", "multiply", "divide", "mod", "pow"):
    NAMES[f"Coverage.{_n}Num"] = lambda coverage, i, f=_n: raster.constant(pixels(coverage), f"{f}_num", float(i))
for _n, _f in (("binarization", "binarization"), ("gteByGEE", "gte_value"), ("lteByGEE", "lte_value")):
    NAMES[f"Coverage.{_n}"] = lambda coverage, threshold, f=_f: raster.constant(pixels(coverage), f, float(threshold))
for _n in cellmath.CELL_TYPES:
    NAMES[f"Coverage.to{_n.title()}"] = lambda coverage, n=_n: raster.local(pixels(coverage), lambda v: cellmath.to_type(v, n))
for _n in ("mean", "median", "min", "max", "mode"):
    NAMES[f"Coverage.focal{_n.title()}"] = lambda coverage, kernelType="square", radius=1, n=_n: focal.focal(pixels(coverage), n, int(radius), kernelType)
NAMES["Coverage.entropy"] = lambda coverage, radius=1: focal.focal(pixels(coverage), "entropy", int(radius))
NAMES["Coverage.cat"] = lambda coverage1, coverage2: raster.overlay(pixels(coverage1), pixels(coverage2))
NAMES["Coverage.bandNames"] = lambda coverage: raster.band_names(pixels(coverage))
NAMES["Coverage.bandNum"] = lambda coverage: raster.band_num(pixels(coverage))
NAMES["Coverage.bandTypes"] = lambda coverage: raster.band_types(pixels(coverage))
NAMES["Coverage.selectBands"] = lambda coverage, bands: raster.select_bands(pixels(coverage), listed(bands))
NAMES["Coverage.addBands"] = lambda coverage1, coverage2, names=None: raster.add_bands(pixels(coverage1), pixels(coverage2), listed(names) or None)
NAMES["Coverage.convolve"] = lambda coverage, kernel: focal.convolve(pixels(coverage), kernel)
NAMES["Coverage.gradient"] = lambda coverage: focal.gradient(pixels(coverage))
NAMES["Coverage.polynomial"] = lambda coverage, l: raster.local(pixels(coverage), lambda v: cellmath.polynomial(v, listed(l, float)))  # noqa: E741
NAMES["Coverage.slice"] = lambda coverage, start, end: raster.slice_bands(pixels(coverage), int(start), int(end))
NAMES["Coverage.clip"] = lambda coverage, geom: raster.clip(pixels(coverage), one_geometry(geom))
NAMES["Coverage.clamp"] = lambda coverage, low, high: raster.local(pixels(coverage), lambda v: cellmath.clamp(v, float(low), float(high)))
NAMES["Coverage.metadata"] = lambda coverage: raster.metadata(pixels(coverage))
NAMES["Coverage.mask"] = lambda coverage1, coverage2, readMask, writeMask: raster.mask(pixels(coverage1), pixels(coverage2), float(readMask), float(writeMask))
NAMES["Coverage.updateMask"] = lambda coverage1, coverage2: raster.update_mask(pixels(coverage1), pixels(coverage2))
NAMES["Coverage.unmask"] = lambda coverage1, coverage2: raster.unmask(pixels(coverage1), pixels(coverage2))
NAMES["Coverage.setValueRangeByPercentage"] = lambda coverage, minimum, maximum: raster.percentile_range(pixels(coverage), float(minimum), float(maximum))
NAMES["Coverage.filter"] = lambda coverage, min, max: raster.local(pixels(coverage), lambda v: cellmath.within(v, float(min), float(max)))
NAMES["Coverage.area"] = lambda coverage, valueRange, resolution: raster.area(pixels(coverage), listed(valueRange), float(resolution))
NAMES["Coverage.slope"] = lambda coverage, radius=1, Z_factor=1.0, size=1.0: focal.slope(pixels(coverage), float(size), float(Z_factor))
NAMES["Coverage.aspect"] = lambda coverage, radius=1, size=1.0: focal.aspect(pixels(coverage), float(size))


def _in_order(t: DataFrame) -> list[str]:
    """A raster's band names in alphabetical order."""
    return raster.band_names(t).first()[0].split(",")


@op("Coverage.setValidDataRange")
def _valid(coverage, range):
    low, high = listed(range, float)
    return raster.local(pixels(coverage), lambda v: cellmath.within(v, low, high))


@op("Coverage.reclass")
def _reclass(coverage, rules, NaN_value=None):
    rules = json.loads(rules) if isinstance(rules, str) else rules
    return raster.local(pixels(coverage), lambda v: cellmath.reclass(v, [tuple(map(float, r)) for r in rules], optional(NaN_value)))


@op("Coverage.remap")
def _remap(coverage, **kw):
    old, new = listed(kw["from"], lambda v: int(float(v))), listed(kw["to"], float)
    return raster.local(pixels(coverage), lambda v: cellmath.remap(v, old, new, optional(kw.get("defaultValue"))))


@op("Coverage.rename")
def _rename(coverage, name):
    t = pixels(coverage)
    return raster.rename(t, _in_order(t), listed(name))


@op("Coverage.normalizedDifference")
def _difference(coverage, bandNames):
    return raster.normalized_difference(pixels(coverage), *listed(bandNames)[:2])


@op("Coverage.NDVI")
def _ndvi(NIR, Red):
    """Of two rasters of one band each."""
    return raster.combine(pixels(NIR), pixels(Red), lambda a, b: (a - b) / F.nullif(a + b, F.lit(0.0)), by_position=True).withColumn("band", F.lit("NDVI"))


@op("Coverage.rgbToHsv")
def _hsv(coverage):
    t = pixels(coverage)
    return raster.rgb_to_hsv(t, *_in_order(t)[:3])


@op("Coverage.hsvToRgb")
def _rgb(coverage):
    t = pixels(coverage)
    names = _in_order(t)
    return raster.hsv_to_rgb(t, *(("H", "S", "V") if {"H", "S", "V"} <= set(names) else names[:3]))


@op("Coverage.date")
def _date(coverage):
    """(day): the days of a raster's time stamps."""
    t = pixels(coverage)
    ts = next((c for c in ("ts", "time") if c in t.columns), None)
    if ts is None:
        raise ValueError("the raster has no time stamps")
    return t.select(F.date_format(ts, "yyyy-MM-dd").alias("day")).distinct()


@op("Coverage.geoDetector")
def _detector(depVar_In, facVar_In, facVar_name_In="", norExtent_sta=None, norExtent_end=None, NaN_value=None):
    kept = lambda v: cellmath.within(v, float(norExtent_sta), float(norExtent_end)) if norExtent_sta is not None else v
    clean = lambda v: F.when(v != float(NaN_value), v) if NaN_value is not None else v
    got = raster.factor_detector(raster.local(pixels(depVar_In), lambda v: kept(clean(v))), raster.local(pixels(facVar_In), clean))
    return got.withColumn("factor", F.lit(facVar_name_In))


@op("Coverage.histogram")
def _histogram(coverage, scale=None):
    """Counts of the whole parts, after resampling to blocks of ``scale`` cells."""
    k = int(float(scale)) if scale else 1
    return raster.histogram(raster.resample(pixels(coverage), -k) if k > 1 else pixels(coverage))


@op("Coverage.projection")
def _projection(coverage, grid=("EPSG:4326", 0.0, 0.0, 1.0)):
    """The reference system of the context's grid (crs, left, top, cell size)."""
    return {"name": "crs", "value": grid[0], "type": "str"}


@op("Coverage.reproject")
def _reproject(coverage, crsCode, resolution, grid=("EPSG:4326", 0.0, 0.0, 1.0)):
    from ..functions import crs

    code = f"EPSG:{crs.code(crsCode)}"
    left, top = crs.transform(grid[1], grid[2], grid[0], code)
    return raster.reproject(pixels(coverage), tuple(grid), (code, float(left), float(top), float(resolution)))


@op("Coverage.resample")
def _resample(coverage, level, mode="nearest"):
    """A grid of 2 ** level times the resolution, or coarser where level is negative."""
    k = int(level)
    how = {"bilinear": "bilinear", "cubicconvolution": "cubic", "cubic": "cubic"}.get(str(mode).lower(), "nearest")
    return raster.resample(pixels(coverage), 2**k if k > 0 else -(2**-k) if k < 0 else 1, how)


def _styled(t: DataFrame, bands=None, gain=None, bias=None, min=None, max=None, gamma=None, palette=None) -> DataFrame:
    """One value for all bands, or one a band, of each parameter; a palette is a list of #RRGGBB."""
    names = listed(bands) or _in_order(t)
    per = {k: listed(v, float) for k, v in (("gain", gain), ("bias", bias), ("low", min), ("high", max), ("gamma", gamma)) if v is not None and v != ""}
    colours = [tuple(int(c.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)) for c in listed(palette)] or None
    if all(len(v) == 1 for v in per.values()):
        return raster.add_styles(t, **{k: v[0] for k, v in per.items()}, palette=colours, bands=names)
    out = None
    for i, n in enumerate(names):
        one = raster.add_styles(t, **{k: v[i % len(v)] for k, v in per.items()}, palette=colours, bands=[n])
        out = one if out is None else out.unionByName(one)
    return out


@op("Coverage.addStyles")
def _coverage_styles(coverage, bands=None, gain=None, bias=None, min=None, max=None, gamma=None, opacity=None, palette=None, format=None):
    """(tx, ty, content): pictures of the tiles, with opacity in the alpha channel where one is given."""
    return writers.picture_tiles(_styled(pixels(coverage), bands, gain, bias, min, max, gamma, palette))


@op("CoverageCollection.addStyles")
def _collection_styles(coverageCollection, bands=None, gain=None, bias=None, min=None, max=None, gamma=None, opacity=None, palette=None, format=None):
    return writers.picture_tiles(_styled(collection.reduce(pixels(coverageCollection), "mean"), bands, gain, bias, min, max, gamma, palette))


@op("Cube.addStyles")
def _cube_styles(cube, bands=None, gain=None, bias=None, min=None, max=None, gamma=None, opacity=None, palette=None, format=None):
    """Pictures of each product and time of a cube, side by side in one table."""
    t = tiles.tiles_of(cube)
    moment = [c for c in ("product", "platform", "ts") if c in t.columns]
    label = F.concat_ws("|", *[F.col(c).cast("string") for c in moment], F.col("band"))
    flat = t.withColumn("band", label).select(*tiles.KEY, "cells")
    wide = raster.add_styles(flat, **{k: float(v) for k, v in (("gain", gain), ("bias", bias), ("low", min), ("high", max), ("gamma", gamma)) if v not in (None, "")})
    return wide.groupBy("band").applyInArrow(_pictures, "layer string, tx int, ty int, content binary")


def _pictures(t):
    import numpy as np
    import pyarrow as pa

    out = []
    for c in t["cells"].combine_chunks():
        v = c.values.to_numpy(zero_copy_only=False)
        n = int(round(len(v) ** 0.5))
        grey = np.clip(np.nan_to_num(v), 0, 255)
        out.append(writers.png(np.stack([grey, grey, grey, np.where(np.isnan(v), 0, 255)], 1).reshape(n, n, 4)))
    return pa.table({"layer": t["band"], "tx": t["tx"], "ty": t["ty"], "content": pa.array(out, pa.binary())})


@op("Coverage.export")
def _export(coverage, folder="", block=1024, grid=("EPSG:4326", 0.0, 0.0, 1.0)):
    """(bx, by, content): GeoTIFF files, a block of cells each."""
    return writers.tiff_blocks(pixels(coverage), int(block), float(grid[3]), float(grid[1]), float(grid[2]))


@op("Coverage.sampleRegions")
def _sample(coverage, feature, properties=None, scale=None, projection=None):
    boxes = feature if {"xmin", "xmax"} <= set(feature.columns) else spatial.with_bounds(feature)
    got = raster.sample_regions(pixels(coverage), boxes.select("id", "xmin", "ymin", "xmax", "ymax"))
    names = [n for n in listed(properties) if n in feature.columns]
    return got.join(feature.select("id", *names), "id") if names else got


# --- terrain ---

_TERRAIN = {"terrSlope": terrain.slope, "terrAspect": terrain.aspect, "terrRuggedness": terrain.ruggedness, "terrSlopelength": terrain.slope_length, "terrCurvature": terrain.curvature, "terrHillshade": terrain.hillshade, "terrPitrouter": terrain.pit_routes, "terrPiteliminator": terrain.fill_pits, "terrFlowdirection": terrain.flow_direction, "terrStrahlerOrder": terrain.strahler_order, "terrFlowConnectivity": terrain.flow_connectivity, "terrFlowLength": terrain.flow_length, "terrFlowWidth": terrain.flow_width}


def _scaled(dem, z_Factor) -> DataFrame:
    z = float(z_Factor)
    return pixels(dem) if z == 1 else raster.local(pixels(dem), lambda v: v * z)


for _n, _f in _TERRAIN.items():
    NAMES[f"Coverage.{_n}"] = lambda coverage, radius=1, z_Factor=1.0, f=_f: f(_scaled(coverage, z_Factor))
NAMES["Coverage.terrFlowaccumulation"] = lambda coverage, z_Factor=1.0, method="d8": terrain.flow_accumulation(_scaled(coverage, z_Factor), method=method)
NAMES["Coverage.terrChannelnetwork"] = lambda DEM, threshold, FlowAccumulation=None, FlowDirection=None, z_Factor=1.0: terrain.channel_network(_scaled(DEM, z_Factor), float(threshold), joined=True)
NAMES["Coverage.terrFilter"] = lambda coverage, min, max, z_Factor=1.0: terrain.keep(_scaled(coverage, z_Factor), list(zip(listed(min, float), listed(max, float))))
NAMES["Coverage.terrWatershedBasins"] = lambda coverage, FlowAccumulation=None, z_Factor=1.0, least=1: terrain.watershed_basins(_scaled(coverage, z_Factor), int(least))
NAMES["Coverage.terrFeatureSelect"] = lambda coverage, radius=1, vipValue=0.0, z_Factor=1.0: terrain.feature_points(_scaled(coverage, z_Factor), float(vipValue))
NAMES["Coverage.terrTIN"] = lambda coverage, radius=1, vipValue=0.0, geometryType=0, z_Factor=1.0: terrain.tin(_scaled(coverage, z_Factor), float(vipValue))

# --- collections and cubes ---

for _n in ("mean", "min", "max", "sum", "or", "and", "median", "mode", "cat"):
    NAMES[f"CoverageCollection.{_n}"] = lambda coverageCollection, n=_n: collection.reduce(pixels(coverageCollection), n)
NAMES["CoverageCollection.mosaic"] = lambda coverageCollection, method=None: collection.mosaic(pixels(coverageCollection), method or "mean")
NAMES["CoverageCollection.mergeCoverages"] = lambda coverages, names: collection.merge_coverages([pixels(c) for c in coverages], listed(names))


@op("CoverageCollection.filter")
def _filtered(filter, collection):
    if isinstance(collection, Images):
        return Images(filter(collection.catalog), collection.imagery, collection.bands)
    return filter(collection)


NAMES["Cube.NDVI"] = lambda input, bandName1, platform1, bandName2, platform2: cube.normalized_difference(input, bandName1, platform1, bandName2, platform2)
for _n in ("add", "subtract", "multiply", "divide"):
    NAMES[f"Cube.{_n}"] = lambda cube1, cube2, f=_n: cube.combine(cube1, cube2, f)

# --- kernels ---

for _n in ("chebyshev", "circle", "diamond", "euclidean", "manhattan", "octagon", "plus"):
    NAMES[f"Kernel.{_n}"] = lambda radius, normalize=False, magnitude=1.0, f=getattr(focal, _n): f(int(radius), flag(normalize), float(magnitude))
for _n in ("compass", "roberts", "prewitt", "kirsch"):
    NAMES[f"Kernel.{_n}"] = lambda normalize=False, magnitude=1.0, f=getattr(focal, _n): f(flag(normalize), float(magnitude))
NAMES["Kernel.fixed"] = lambda weights: focal.fixed(weights if isinstance(weights, str) else json.dumps(weights))
NAMES["Kernel.gaussian"] = lambda radius, sigma=1.0, normalize=True, magnitude=1.0: focal.gaussian(int(radius), float(sigma), flag(normalize), float(magnitude))
NAMES["Kernel.inverse"] = lambda kernel: focal.inverse(kernel)
NAMES["Kernel.square"] = lambda radius, normalize=True, value=1.0: focal.square(int(radius), flag(normalize), float(value))
NAMES["Kernel.rectangle"] = lambda xRadius, yRadius, normalize=False, magnitude=1.0: focal.rectangle(int(xRadius), int(yRadius), flag(normalize), float(magnitude))
NAMES["Kernel.rotate"] = lambda kernel, rotations: focal.rotate(kernel, int(rotations))
NAMES["Kernel.sobel"] = lambda axis: focal.sobel(axis)
NAMES["Kernel.laplacian4"], NAMES["Kernel.laplacian8"] = (lambda: focal.laplacian4()), (lambda: focal.laplacian8())
NAMES["Kernel.add"] = lambda kernel1, kernel2: focal.add(kernel1, kernel2)

# --- geometries: WKT ---

for _n in ("Point", "LineString", "LinearRing", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"):
    NAMES[f"Geometry.{_n}"] = lambda coordinates, crs="EPSG:4326", geodesic=None, k=_n: G.to_wkt(G.build(k, coordinates))
    NAMES[f"Geometry.{_n[0].lower()}{_n[1:]}"] = NAMES[f"Geometry.{_n}"]
NAMES["Geometry.reproject"] = lambda geometry, crs, source="EPSG:4326": G.to_wkt(G.reproject(G.from_wkt(geometry), source, crs))


@op("Geometry.addStyles", "Feature.addStyles", "FeatureCollection.addStyles", "Feature_deprecated.addStyles")
def _feature_styles(input, color=None, attribute=None, spark=None):
    """GeoJSON features with a colour: one for all, or one of a list for each value of an attribute in its order."""
    df = spark.createDataFrame([("0", input)], "id string, geom string") if isinstance(input, str) else input
    colours = listed(color) or ["#3388ff"]
    if attribute and attribute in df.columns:
        from pyspark.sql.window import Window

        rank = df.select(attribute).distinct().withColumn("__r", F.row_number().over(Window.orderBy(attribute)) - 1)
        df = df.join(rank, attribute).withColumn("color", F.element_at(F.array(*map(F.lit, colours)), (F.col("__r") % len(colours) + 1).cast("int"))).drop("__r")
    else:
        df = df.withColumn("color", F.lit(colours[0]))
    return writers.geojson_features(df)


# --- features: (id, geom, props), usually of one row ---


def _projected(df: DataFrame, crs=None, own="EPSG:4326") -> DataFrame:
    return df if not crs or crs == own else features.reproject(df, own, crs)


def _shape(name: str, *args) -> Callable:
    return lambda feature, crs=None, *_: _projected(feature, crs).withColumn("geom", G.shape(name, *args)("geom"))


for _n, _f in (("bounds", "envelope"), ("centroid", "centroid"), ("convexHull", "convex_hull"), ("dissolve", "dissolve")):
    NAMES[f"Feature.{_n}"] = lambda feature, crs=None, f=_f: _projected(feature, crs).withColumn("geom", G.shape(f)("geom"))
    NAMES[f"Feature_deprecated.{_n}"] = lambda featureRDD, crs=None, f=_f: _projected(featureRDD, crs).withColumn("geom", G.shape(f)("geom"))
for _n in ("area", "length", "perimeter"):
    NAMES[f"Feature.{_n}"] = lambda feature, crs="EPSG:3857", f=_n: value_of(_projected(feature, crs), G.measure(f)("geom"))
    NAMES[f"Feature_deprecated.{_n}"] = lambda featureRDD, crs="EPSG:3857", f=_n: value_of(_projected(featureRDD, crs), G.measure(f)("geom"))
NAMES["Feature.buffer"] = lambda feature, distance, crs=None: _projected(feature, crs).withColumn("geom", G.shape("buffer", float(distance))("geom"))
NAMES["Feature_deprecated.buffer"] = lambda featureRDD, distance, crs=None: NAMES["Feature.buffer"](featureRDD, distance, crs)


def _beside(a: DataFrame, b: DataFrame, crs=None, target="EPSG:4326") -> DataFrame:
    """The rows of a with the other feature's geometry as ``__g``: the second one is a single feature."""
    a, b = _projected(a, crs), _projected(b, crs)
    return a.withColumn("__g", F.lit(one_geometry(b)))


for _n, _p in (("containedIn", "Within"), ("contains", "Contains"), ("disjoint", "Disjoint"), ("intersects", "Intersects")):
    NAMES[f"Feature.{_n}"] = lambda feature1, feature2, crs=None, p=_p: value_of(_beside(feature1, feature2, crs), G.predicate(p)("geom", "__g"))
    NAMES[f"Feature_deprecated.{_n}"] = lambda featureRDD1, featureRDD2, crs=None, p=_p: value_of(_beside(featureRDD1, featureRDD2, crs), G.predicate(p)("geom", "__g"))
for _n, _p in (("difference", "difference"), ("symmetricDifference", "symmetric_difference"), ("intersection", "intersection"), ("union", "union")):
    NAMES[f"Feature.{_n}"] = lambda feature1, feature2, crs=None, p=_p: _beside(feature1, feature2, crs).withColumn("geom", G.overlaid(p)("geom", "__g")).drop("__g")
    NAMES[f"Feature_deprecated.{_n}"] = lambda featureRDD1, featureRDD2, crs=None, p=_p: NAMES[f"Feature.{p if p != 'symmetric_difference' else 'symmetricDifference'}"](featureRDD1, featureRDD2, crs)
NAMES["Feature.distance"] = lambda feature1, feature2, crs="EPSG:3857": value_of(_beside(feature1, feature2, crs), G.between()("geom", "__g"))
NAMES["Feature.withinDistance"] = lambda feature1, feature2, distance, crs=None: value_of(_beside(feature1, feature2, crs), G.between()("geom", "__g") <= float(distance))
NAMES["Feature_deprecated.distance"] = lambda featureRDD1, featureRDD2, crs="EPSG:3857": NAMES["Feature.distance"](featureRDD1, featureRDD2, crs)
NAMES["Feature_deprecated.withDistance"] = lambda featureRDD1, featureRDD2, distance, crs=None: NAMES["Feature.withinDistance"](featureRDD1, featureRDD2, distance, crs)
NAMES["Feature.closestPoint"] = lambda feature1, feature2, terminateDistance=0.0: _beside(feature1, feature2).withColumn("geom", G.closest(0)("geom", "__g")).drop("__g")
NAMES["Feature.closestPoints"] = lambda feature1, feature2, terminateDistance=0.0: _beside(feature1, feature2).withColumn("geom", G.closest(None)("geom", "__g")).drop("__g")
NAMES["Feature.cutLines"] = lambda feature, distances, crs=None: _projected(feature, crs).withColumn("geom", G.shape("cut_lines", listed(distances, float))("geom"))
NAMES["Feature.simplify"] = lambda feature, distanceTolerance, crs=None, topoPreserved=False: _projected(feature, crs).withColumn("geom", G.shape("simplify", float(distanceTolerance))("geom"))
NAMES["Feature.densify"] = lambda feature, distanceTolerance, crs=None: _projected(feature, crs).withColumn("geom", G.shape("densify", float(distanceTolerance))("geom"))
NAMES["Feature.reproject"] = lambda feature, tarCrsCode, crs="EPSG:4326": features.reproject(feature, crs, tarCrsCode)
NAMES["Feature.id"] = lambda feature: feature.select("id")
NAMES["Feature.geometry"] = lambda feature, geodesics=None: feature.select("id", F.col("geom").alias("value"))
NAMES["Feature.setGeometry"] = lambda feature, geometry: feature.withColumn("geom", F.lit(one_geometry(geometry)))
NAMES["Feature.export"] = lambda feature, fileType="geojson": writers.geojson_features(feature)
for _n, _f in (("get", "get"), ("getNumber", "get_number"), ("getString", "get_string")):
    NAMES[f"Feature.{_n}"] = lambda feature, property, f=getattr(features, _f): f(feature, property)
NAMES["Feature.toArray"] = lambda feature, properties: features.to_array(feature, listed(properties))
NAMES["Feature.toDictionary"] = lambda feature, properties=None: features.to_dictionary(feature, listed(properties) or None)
NAMES["Feature.copyProperties"] = lambda feature1, feature2, properties=None, exclude=None: features.copy_properties(feature1, feature2, listed(properties) or None, listed(exclude) or None)


@op("Feature.set")
def _set(feature, var_args):
    if isinstance(var_args, str):
        try:
            var_args = json.loads(var_args)
        except ValueError:
            var_args = listed(var_args)
    if not isinstance(var_args, dict):
        var_args = dict(zip(var_args[::2], var_args[1::2]))
    return features.set_(feature, var_args)


@op("Feature.select")
def _select(feature, propertySelectors, newProperties=None, retainGeometry=True):
    """Properties whose names match any of the patterns; new names go by the order of plain names."""
    olds, new = listed(propertySelectors), listed(newProperties)
    got = features.select_regex(feature, "|".join(olds))
    if new:
        pairs = F.create_map(*[F.lit(v) for p in zip(olds, new) for v in p])
        got = got.withColumn("props", F.transform_keys("props", lambda k, v: F.coalesce(F.element_at(pairs, k), k)))
    return got if flag(retainGeometry) else got.drop("geom")


def _properties(x) -> dict:
    x = json.loads(x) if isinstance(x, str) and x.strip() else x or {}
    return {k: None if v is None else str(v) for k, v in x.items()}


def _new(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "id string, geom string, props map<string,string>")


NAMES["Feature.loadFromGeometry"] = lambda spark, geometry, metadata=None: _new(spark, [("0", geometry, _properties(metadata))])


@op("Feature.loadFromGeojson", "FeatureCollection.loadFromGeojson")
def _from_geojson(spark, gjson, properties=None, crs="EPSG:4326"):
    rows = readers.features_of(json.loads(gjson) if isinstance(gjson, str) else gjson)
    return _new(spark, [(str(i if f is None else f), G.to_wkt(g) if g else None, _properties(p) | _properties(properties)) for i, (f, g, p) in enumerate(rows)])


_DEPRECATED = {"point": "Point", "lineString": "LineString", "linearRing": "LinearRing", "polygon": "Polygon", "multiPoint": "MultiPoint", "multiLineString": "MultiLineString", "multiPolygon": "MultiPolygon"}
for _n, _k in _DEPRECATED.items():
    NAMES[f"Feature_deprecated.{_n}"] = lambda spark, coors, properties=None, crs="EPSG:4326", k=_k: _new(spark, [("0", G.to_wkt(G.build(k, coors)), _properties(properties))])
NAMES["Feature_deprecated.geometry"] = lambda spark, coors, crs="EPSG:4326": _from_geojson(spark, coors)
NAMES["Feature_deprecated.featureCollection"] = lambda featureList: features.merge_all(featureList)
NAMES["Feature_deprecated.coordinates"] = lambda featureRDD: value_of(featureRDD, G.coordinates_column()("geom"))
NAMES["Feature_deprecated.reproject"] = lambda featureRDD, tarCrsCode: features.reproject(featureRDD, "EPSG:4326", tarCrsCode)
NAMES["Feature_deprecated.isUnbounded"] = lambda featureRDD: value_of(featureRDD, G.unbounded_column()("geom"))
NAMES["Feature_deprecated.getType"] = lambda featureRDD: value_of(featureRDD, G.type_column()("geom"))
NAMES["Feature_deprecated.projection"] = lambda featureRDD, crs="EPSG:4326": value_of(featureRDD, F.lit(crs))
NAMES["Feature_deprecated.toGeoJSONString"] = lambda featureRDD: value_of(featureRDD, G.to_geojson_column()("geom"))
NAMES["Feature_deprecated.geometries"] = lambda featureRDD: featureRDD.select("id", F.posexplode(G.parts_column()("geom")).alias("part", "geom"))
NAMES["Feature_deprecated.copyProperties"] = lambda featureRDD1, featureRDD2, properties=None: features.copy_properties(featureRDD1, featureRDD2, listed(properties) or None)
NAMES["Feature_deprecated.get"] = lambda featureRDD, property: features.get(featureRDD, property)
NAMES["Feature_deprecated.propertyNames"] = lambda featureRDD: features.keys(featureRDD)
NAMES["Feature_deprecated.set"] = lambda featureRDD, property: _set(featureRDD, property)
NAMES["Feature_deprecated.setGeometry"] = lambda featureRDD, geom: featureRDD.withColumn("geom", F.lit(one_geometry(geom)))

# --- feature collections ---


@op("FeatureCollection.loadFromGeometry")
def _from_geometries(spark, geometry, metadata=None, id=None):
    geoms, ids, props = (geometry if isinstance(geometry, list) else [geometry]), listed(id), metadata if isinstance(metadata, list) else [metadata] * (len(geometry) if isinstance(geometry, list) else 1)
    return _new(spark, [(ids[i] if ids else str(i), g, _properties(p)) for i, (g, p) in enumerate(zip(geoms, props))])


NAMES["FeatureCollection.loadFromFeature"] = lambda feature: feature
NAMES["FeatureCollection.loadFromFeatureList"] = lambda features_=None, **kw: features.merge_all(kw.get("features") or features_)
NAMES["FeatureCollection.export"] = lambda featureCollection: writers.geojson_features(featureCollection)
_AGGREGATES = {"Count": "count", "CountDistinct": "count_distinct", "Max": "max", "Min": "min", "Mean": "mean", "Product": "product", "SampleSD": "sample_sd", "SampleVAR": "sample_var", "TotalSD": "total_sd", "TotalVAR": "total_var", "TotalSum": "sum"}
for _n, _f in _AGGREGATES.items():
    NAMES[f"FeatureCollection.aggregate{_n}"] = lambda collection, property, f=_f: features.aggregate(collection, property, f)
NAMES["FeatureCollection.aggregateArray"] = lambda collection, property: features.aggregate_array(collection, property, "id")
NAMES["FeatureCollection.aggregateFirst"] = lambda collection, property: features.aggregate_first(collection, property, "id")
NAMES["FeatureCollection.aggregateStats"] = lambda collection, property: features.stats(collection, property)
NAMES["FeatureCollection.distinct"] = lambda collection, property=None: features.distinct(collection, listed(property) or None, "id" if property and "id" in collection.columns else None)
NAMES["FeatureCollection.describe"] = lambda collection, property: features.describe(collection, listed(property))
NAMES["FeatureCollection.limit"] = lambda collection, maxRows, property=None, ascending=True: features.limit(collection, int(maxRows), property, flag(ascending), "id" if "id" in collection.columns else None)
NAMES["FeatureCollection.assembleNumericArray"] = lambda collection, properties, newPropertyName="array": features.assemble_array(collection, listed(properties), newPropertyName)
NAMES["FeatureCollection.propertyNames"] = lambda collection: features.property_names(collection.sparkSession, collection)
NAMES["FeatureCollection.propertySet"] = lambda collection, columnName, newContent: features.property_set(collection, newContent, columnName)
NAMES["FeatureCollection.randomColumn"] = lambda collection, seed=0, newPropertyName=None, columnName=None, distribution="uniform", rowKeys=None: features.random_column(collection, newPropertyName or columnName or "random", int(seed), distribution, listed(rowKeys) or None)
NAMES["FeatureCollection.map"] = lambda collection, baseAlgorithm, dropNulls=False: features.map_(collection, baseAlgorithm, flag(dropNulls))
NAMES["FeatureCollection.remap"] = lambda collection, lookupIn, lookupOut, property: features.remap(collection, listed(lookupIn), listed(lookupOut), property)
NAMES["FeatureCollection.select"] = lambda collection, propertySelectors, newProperties=None, retainGeometry=True: features.select(collection, listed(propertySelectors), listed(newProperties) or None, "geom" if flag(retainGeometry) else None)
NAMES["FeatureCollection.extractRowsAsList"] = lambda collection, count, offset=0: features.extract_rows(collection, int(count), int(offset))
NAMES["FeatureCollection.size"] = lambda collection: features.size(collection)
NAMES["FeatureCollection.subtract"] = lambda collection, column1, column2, newColumnName: features.subtract(collection, column1, column2, newColumnName)
NAMES["FeatureCollection.combine"] = lambda collection, column1, column2, newColumnName: features.combine(collection, column1, column2, newColumnName)
NAMES["FeatureCollection.constantColumn"] = lambda collection, constantValue, columnName="constant": features.constant_column(collection, constantValue, columnName)
NAMES["FeatureCollection.reproject"] = lambda collection, tarCrsCode, geometryFieldName="geom", crs="EPSG:4326": features.reproject(collection, crs, tarCrsCode, geometryFieldName)
NAMES["FeatureCollection.sample"] = lambda collection, fraction, seed=0, allowDuplicate=False: features.sample(collection, float(fraction), int(seed), flag(allowDuplicate))
NAMES["FeatureCollection.randomSplit"] = lambda collection, weights, seed=0: features.random_split(collection, listed(weights, float), int(seed))
NAMES["FeatureCollection.filterDate"] = lambda collection, start, end, timeFieldName="time": features.filter_date(collection, start, end, timeFieldName)
NAMES["FeatureCollection.filterMetadata"] = lambda collection, name, operator, value: features.filter_metadata(collection, name, operator, value)
NAMES["FeatureCollection.merge"] = lambda collection1, collection2: features.merge(collection1, collection2)
NAMES["FeatureCollection.mergeAll"] = lambda collectionList: features.merge_all(collectionList)


@op("FeatureCollection.sortAndSplit")
def _sorted(collection, property=None, ascending=True, seed=0, geoHashPrecision=None):
    """By a property, or by geohash of the centres where a precision is given."""
    if geoHashPrecision:
        c = centres(collection)
        return c.withColumn("__h", features.geohash(F.col("x"), F.col("y"), int(geoHashPrecision))).orderBy("__h").select(*collection.columns)
    return features.sort(collection, property, flag(ascending))


for _n in ("area", "length", "perimeter"):
    NAMES[f"FeatureCollection.{_n}"] = lambda collection, geometryFieldName="geom", f=_n: collection.withColumn(f, G.measure(f)(geometryFieldName))
NAMES["FeatureCollection.boundary"] = lambda collection, geometryFieldName="geom": collection.withColumn(geometryFieldName, G.shape("boundary")(geometryFieldName))
NAMES["FeatureCollection.buffer"] = lambda collection, distance, geometryFieldName="geom": collection.withColumn(geometryFieldName, G.shape("buffer", float(distance))(geometryFieldName))


@op("FeatureCollection.geoHash")
def _hashes(collection, geometryFieldName="geom", geoHashPrecision=10):
    c = centres(collection, geometryFieldName)
    return c.withColumn("geohash", features.geohash(F.col("x"), F.col("y"), int(geoHashPrecision))).select(*collection.columns, "geohash")


@op("FeatureCollection.delaunay")
def _delaunay(collection, geometryFieldName="geom"):
    return spatial.delaunay_cells(centres(collection, geometryFieldName))


@op("FeatureCollection.voronoi")
def _voronoi(collection, geometryFieldName="geom"):
    c = centres(collection, geometryFieldName)
    b = c.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    mx, my = (b[2] - b[0]) or 1.0, (b[3] - b[1]) or 1.0
    return spatial.voronoi_cells(c, G.to_wkt(G.box(b[0] - mx, b[1] - my, b[2] + mx, b[3] + my)))


def _cell(df: DataFrame) -> float:
    return spatial.cell_size(df)


def _joined(a, b, predicate, geom_a, geom_b):
    a, b = a.withColumnRenamed(geom_a, "geom"), b.withColumnRenamed(geom_b, "geom")
    return spatial.join(a, b, predicate, _cell(spatial.with_bounds(b)))


@op("FeatureCollection.spatialJoinQueryFlat")
def _join_flat(leftSpatialDataFrame, rightCollection, leftGeometryFieldName="geom", rightGeometryFieldName="geom", spatialPredicate="Contains", useRDD=False, useIndex=True, gridType="QUADTREE"):
    return _joined(leftSpatialDataFrame, rightCollection, spatialPredicate, leftGeometryFieldName, rightGeometryFieldName)


@op("FeatureCollection.spatialJoinQuery")
def _join_grouped(leftSpatialDataFrame, rightCollection, leftGeometryFieldName="geom", rightGeometryFieldName="geom", spatialPredicate="Contains", useRDD=False, useIndex=True, gridType="QUADTREE"):
    got = _joined(leftSpatialDataFrame, rightCollection, spatialPredicate, leftGeometryFieldName, rightGeometryFieldName)
    return got.groupBy(F.col("a.id").alias("id")).agg(F.sort_array(F.collect_list("b.id")).alias("matched"))


@op("FeatureCollection.spatialJoinOneToOne")
def _join_reduced(leftCollection, rightCollection, reduceProperties, reduceRules, leftGeometryFieldName="geom", rightGeometryFieldName="geom", useIndex=True, spatialPredicate="Contains"):
    got = _joined(leftCollection, rightCollection, spatialPredicate, leftGeometryFieldName, rightGeometryFieldName)
    return spatial.reduce(got, F.col("a.id"), list(zip(listed(reduceProperties), listed(reduceRules))), F.col("b.id"))


@op("FeatureCollection.distanceJoinQueryFlat")
def _near_flat(spatialDataFrame, queryDataFrame, distance, spatialGeometryFieldName="geom", queryGeometryFieldName="geom", limit="less_than", useRDD=False, useIndex=True, spatialPredicate=None, gridType=None):
    a, b = centres(spatialDataFrame, spatialGeometryFieldName), centres(queryDataFrame, queryGeometryFieldName)
    return spatial.distance_join(a, b, float(distance), limit)


@op("FeatureCollection.distanceJoinQuery")
def _near_grouped(spatialDataFrame, queryDataFrame, distance, spatialGeometryFieldName="geom", queryGeometryFieldName="geom", limit="less_than", useRDD=False, useIndex=True, spatialPredicate=None, gridType=None):
    return spatial.distance_join_grouped(centres(spatialDataFrame, spatialGeometryFieldName), centres(queryDataFrame, queryGeometryFieldName), float(distance), limit)


@op("FeatureCollection.kNNQuery")
def _nearest(spatialDataFrame, queryGeometry, k, geometryFieldName="geom", useRDD=False, useIndex=True, spatialPredicate=None, gridType=None):
    p = G.centroid(G.from_wkt(one_geometry(queryGeometry)))[1]
    return spatial.nearest_to(centres(spatialDataFrame, geometryFieldName), float(p[0]), float(p[1]), int(k))


NAMES["FeatureCollection.spatialPredicateQuery"] = lambda collection, geometry, geometryFieldName="geom", spatialPredicate="Intersects": spatial.query(collection, one_geometry(geometry), spatialPredicate, geometryFieldName)
NAMES["FeatureCollection.filterBounds"] = lambda collection, geometry, geometryFieldName="geom", useRDD=False: spatial.query(collection, one_geometry(geometry), "Intersects", geometryFieldName)
NAMES["FeatureCollection.differenceWithGeometry"] = lambda collection, geometry, geometryFieldName="geom": spatial.difference_with(collection, one_geometry(geometry), geometryFieldName)
for _n in ("intersection", "erase", "difference"):
    NAMES[f"FeatureCollection.{_n}"] = lambda collection1, collection2, geometryFieldName1="geom", geometryFieldName2="geom", f=getattr(spatial, _n): f(collection1.withColumnRenamed(geometryFieldName1, "geom"), collection2.withColumnRenamed(geometryFieldName2, "geom"), _cell(spatial.with_bounds(collection2.withColumnRenamed(geometryFieldName2, "geom"))))
NAMES["FeatureCollection.union"] = lambda collection1, collection2, geometryFieldName="geom": spatial.union(collection1, collection2, geometryFieldName)
NAMES["FeatureCollection.aggregateUnion"] = lambda collection, geometryFieldName="geom": spatial.union_aggregate(collection, geometryFieldName)
NAMES["FeatureCollection.aggregateIntersection"] = lambda collection, geometryFieldName="geom": spatial.intersection_aggregate(collection, geometryFieldName)
NAMES["FeatureCollection.geometryGetAndMerge"] = lambda collection, geometryFieldName="geom": spatial.union_aggregate(collection, geometryFieldName)
NAMES["FeatureCollection.aggregateBounds"] = lambda collection, geometryFieldName="geom": features.aggregate_bounds(spatial.with_bounds(collection, geometryFieldName))
NAMES["FeatureCollection.cultivatedLandSuitability"] = lambda landTable, ecologyTable, urbanTable, slopeTable, tables=None: spatial.land_suitability(*[tables[t] if isinstance(t, str) else t for t in (landTable, ecologyTable, urbanTable, slopeTable)])


@op("FeatureCollection.rasterize")
def _rasterize(collection, geometryFieldName="geom", property=None, cols=256, rows=256):
    c = centres(collection, geometryFieldName)
    b = c.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    value = property or next(n for n, k in c.dtypes if n not in ("id", "x", "y") and k in ("int", "bigint", "double", "float"))
    wide = lambda lo, hi: hi + (hi - lo or 1.0) * 1e-9
    return spatial.rasterize(c, value, int(cols), int(rows), b[0], b[1], wide(b[0], b[2]), wide(b[1], b[3]))


@op("FeatureCollection.idwInterpolation")
def _idw(collection, propertyName, maskGeom=None, cols=20, rows=20, defaultValue=None):
    return interpolation.idw(centres(collection), propertyName, int(cols), int(rows), mask=one_geometry(maskGeom) if maskGeom is not None else None, default=optional(defaultValue))


@op("FeatureCollection.simpleKriging")
def _simple_kriging(collection, propertyName, cols=20, rows=20, defaultValue=None):
    return interpolation.kriging(centres(collection), propertyName, int(cols), int(rows), mean=float(collection.agg(F.avg(propertyName)).first()[0]))


# --- statistics ---

_S = "SpatialStats."
_B, _T, _R, _I, _W = (_S + n for n in ("BasicStatistics.", "STCorrelations.", "SpatialRegression.", "SpatialInterpolation.", "GWModels."))


def numeric(df: DataFrame) -> list[str]:
    return [n for n, k in df.dtypes if k in ("int", "bigint", "double", "float", "smallint") and n not in ("id", "x", "y")]


def _weights(df: DataFrame, weightstyle="W", knn=None) -> DataFrame:
    """Of the k nearest, or of touching polygons; points take their four nearest."""
    if knn is not None and int(knn) > 0:
        return statistics.knn_weights(centres(df), int(knn), weightstyle)
    if "geom" in df.columns and not {"x", "y"} <= set(df.columns):
        return statistics.contiguity_weights(df, _cell(spatial.with_bounds(df)), weightstyle)
    return statistics.knn_weights(centres(df), 4, weightstyle)


NAMES[_B + "AverageNearestNeighbor"] = lambda featureRDD: statistics.average_nearest_neighbor(centres(featureRDD))
NAMES[_B + "DescriptiveStatistics"] = lambda featureRDD: statistics.descriptive(featureRDD, numeric(featureRDD))
NAMES[_B + "PrincipalComponentAnalysis"] = lambda featureRDD, properties, keep=2, split=None, is_scale=True: statistics.pca(featureRDD, listed(properties), int(keep), flag(is_scale))
NAMES[_B + "RipleysK"] = lambda featureRDD: statistics.ripley_k(centres(featureRDD))


@op(_B + "KernelDensityEstimation")
def _density(featureRDD, propertyName=None, rows=10, cols=10, kernel="gaussian", size=5, sigma=1.0, amplitude=1.0, radius=1):
    c = centres(featureRDD)
    b = c.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    k = {"gaussian": lambda: focal.gaussian(int(size) // 2, float(sigma), False, float(amplitude)), "circle": lambda: focal.circle(int(radius)), "square": lambda: focal.square(int(radius), False)}[str(kernel).lower()]()
    return statistics.kernel_density(c, int(cols), int(rows), b[0], b[1], b[2], b[3], k, propertyName or None)


NAMES[_T + "CorrelationAnalysis.corrMat"] = lambda featureRDD, properties, method="pearson": statistics.correlation(featureRDD, listed(properties), method)
_AUTO = _T + "SpatialAutoCorrelation."
NAMES[_AUTO + "globalMoranI"] = lambda featureRDD, property, plot=False, test=False, weightstyle="W": statistics.moran(featureRDD, property, _weights(featureRDD, weightstyle))
NAMES[_AUTO + "localMoranI"] = lambda featureRDD, property, adjust=False: statistics.local_moran(featureRDD, property, _weights(featureRDD))
NAMES[_AUTO + "globalGearyC"] = lambda featureRDD, property, test=False, weightstyle="W", knn=None: statistics.geary(featureRDD, property, _weights(featureRDD, weightstyle, knn))
NAMES[_AUTO + "localGearyC"] = lambda featureRDD, property, adjust=False, weightstyle="W", knn=None, nsim=None: statistics.local_geary(featureRDD, property, _weights(featureRDD, weightstyle, knn))
NAMES[_AUTO + "getisOrdG"] = lambda featureRDD, property, weightstyle="B", knn=None, star=False: statistics.getis_ord(featureRDD, property, _weights(featureRDD, weightstyle, knn), flag(star))
NAMES[_T + "TemporalAutoCorrelation.ACF"] = lambda featureRDD, property, timelag=20: statistics.acf(featureRDD, property, next(c for c in ("time", "ts", "time_point", "id") if c in featureRDD.columns), int(timelag))
for _n, _k in (("SpatialLagModel", "lag"), ("SpatialErrorModel", "error"), ("SpatialDurbinModel", "durbin")):
    NAMES[f"{_R}{_n}.fit"] = lambda featureRDD, propertyY, propertiesX, k=_k: regression.spatial_regression(featureRDD, propertyY, listed(propertiesX), _weights(featureRDD), k)
NAMES[_R + "LinearRegression.feature"] = lambda data, y, x, Intercept=True: regression.ols(data, y, listed(x), flag(Intercept))[0]
NAMES[_R + "LogisticRegression.feature"] = lambda data, y, x, Intercept=True, maxIter=100, epsilon=1e-8: regression.glm(data, y, listed(x), "logistic", flag(Intercept), int(maxIter), float(epsilon))[0]
NAMES[_R + "PoissonRegression.feature"] = lambda data, y, x, Intercept=True, maxIter=100, epsilon=1e-8: regression.glm(data, y, listed(x), "poisson", flag(Intercept), int(maxIter), float(epsilon))[0]
_P = _S + "STSampling."
NAMES[_P + "randomSampling"] = lambda featureRDD, n=10: statistics.random_sampling(featureRDD, int(n))
NAMES[_P + "regularSampling"] = lambda featureRDD, x=10, y=10: statistics.regular_sampling(centres(featureRDD), int(x), int(y))
NAMES[_P + "stratifiedSampling"] = lambda featureRDD, properties, n=10: statistics.stratified_sampling(featureRDD, listed(properties)[0], int(n))
NAMES[_P + "SandwichSampling"] = lambda featureRDD, y_title, knowledge_title, reporting_title, accuracy=0.05: statistics.sandwich(featureRDD, y_title, knowledge_title, reporting_title)
_MODELS = {"sph": "Sph", "spherical": "Sph", "exp": "Exp", "exponential": "Exp", "gau": "Gau", "gaussian": "Gau"}
NAMES[_I + "OrdinaryKriging"] = lambda featureRDD, propertyName, rows=20, cols=20, method="Sph", binMaxCount=20: interpolation.kriging(centres(featureRDD), propertyName, int(cols), int(rows), _MODELS.get(str(method).lower(), "Sph"), int(binMaxCount))
NAMES[_I + "selfDefinedKriging"] = lambda featureRDD, propertyName, range, sill, nugget, rows=20, cols=20, method="Sph": interpolation.kriging(centres(featureRDD), propertyName, int(cols), int(rows), _MODELS.get(str(method).lower(), "Sph"), nugget=float(nugget), sill=float(sill), reach=float(range))
for _n, _f in (("NearestNeighbourInterpolation.fit", interpolation.nearest), ("LinearInterpolation.fit", interpolation.linear), ("SplineInterpolation.thinPlateSpline", interpolation.thin_plate_spline), ("SplineInterpolation.BSpline", interpolation.b_spline)):
    NAMES[_I + _n] = lambda featureRDD, propertyName, rows=20, cols=20, f=_f: f(centres(featureRDD), propertyName, int(cols), int(rows))
NAMES[_I + "IDW.fit"] = lambda featureRDD, propertyName, rows=20, cols=20, radiusX=None, radiusY=None, rotation=None, weightingPower=2.0, smoothingFactor=0.0, equalWeightRadius=0.0: interpolation.idw(centres(featureRDD), propertyName, int(cols), int(rows), float(weightingPower), radius=optional(radiusX))


def _bandwidth(df, y, xs, bandwidth, kernel, adaptive):
    return float(bandwidth) if bandwidth not in (None, "") else regression.gwr_bandwidth(df, y, xs, kernel, adaptive)


def _gwr(featureRDD, propertyY, propertiesX, bandwidth=None, kernel="gaussian", approach="CV", adaptive=False, varSelTh=None, predictRDD=None, select=False):
    df, xs, ad = centres(featureRDD), listed(propertiesX), flag(adaptive)
    b = _bandwidth(df, propertyY, xs, bandwidth, kernel, ad)
    xs = regression.gwr_select(df, propertyY, xs, b, kernel, ad, optional(varSelTh) or 3.0) if select else xs
    return regression.gwr(df, propertyY, xs, b, kernel, ad, places=centres(predictRDD) if predictRDD is not None else None)


NAMES[_W + "GWRbasic.fit"] = lambda featureRDD, propertyY, propertiesX, bandwidth=None, kernel="gaussian", adaptive=False: _gwr(featureRDD, propertyY, propertiesX, bandwidth, kernel, adaptive=adaptive)
NAMES[_W + "GWRbasic.autoFit"] = lambda featureRDD, propertyY, propertiesX, kernel="gaussian", approach="CV", adaptive=False: _gwr(featureRDD, propertyY, propertiesX, None, kernel, approach, adaptive)
NAMES[_W + "GWRbasic.auto"] = lambda featureRDD, propertyY, propertiesX, kernel="gaussian", approach="CV", adaptive=False, varSelTh=3.0: _gwr(featureRDD, propertyY, propertiesX, None, kernel, approach, adaptive, varSelTh, select=True)
NAMES[_W + "GWRbasic.predict"] = lambda featureRDD, predictRDD, propertyY, propertiesX, bandwidth=None, kernel="gaussian", adaptive=False, approach="CV": _gwr(featureRDD, propertyY, propertiesX, bandwidth, kernel, approach, adaptive, None, predictRDD)


@op(_W + "GWRGeneralized.fit")
def _gwglm(featureRDD, propertyY, propertiesX, bandwidth=None, family="poisson", kernel="gaussian", approach="CV", adaptive=False, tolerance=1e-8, maxIter=50):
    df, xs, ad = centres(featureRDD), listed(propertiesX), flag(adaptive)
    return regression.gwr_generalized(df, propertyY, xs, _bandwidth(df, propertyY, xs, bandwidth, kernel, ad), str(family).lower().replace("binomial", "logistic"), kernel, ad, int(maxIter))


def _gtwr(featureRDD, propertyY, propertiesX, propertyT, bandwidth=None, kernel="gaussian", adaptive=False, lam=0.05, places=None):
    df, xs, ad = centres(featureRDD).withColumn("t", F.col(propertyT).cast("double")), listed(propertiesX), flag(adaptive)
    at = centres(places).withColumn("t", F.col(propertyT).cast("double")) if places is not None else None
    return regression.gwr(df, propertyY, xs, _bandwidth(df, propertyY, xs, bandwidth, kernel, ad), kernel, ad, float(lam), at)


# "lambda" can't be a Python name, so these take the rest of their arguments as they come
NAMES[_W + "GTWR.fit"] = lambda featureRDD, propertyY, propertiesX, propertyT, bandwidth=None, kernel="gaussian", adaptive=False, **kw: _gtwr(featureRDD, propertyY, propertiesX, propertyT, bandwidth, kernel, adaptive, kw.get("lambda", 0.05))
NAMES[_W + "GTWR.autoFit"] = lambda featureRDD, propertyY, propertiesX, propertyT, kernel="gaussian", approach="CV", adaptive=False, **kw: _gtwr(featureRDD, propertyY, propertiesX, propertyT, None, kernel, adaptive, kw.get("lambda", 0.05))
NAMES[_W + "GTWR.predict"] = lambda featureRDD, propertyY, propertiesX, propertiesT, predictRDD=None, bandwidth=None, kernel="gaussian", approach="CV", adaptive=False, **kw: _gtwr(featureRDD, propertyY, propertiesX, listed(propertiesT)[0], bandwidth, kernel, adaptive, kw.get("lambda", 0.05), predictRDD if predictRDD is not None else featureRDD)
NAMES[_W + "GWDA.calculate"] = lambda featureRDD, propertyY, propertiesX, bandwidth, kernel="gaussian", adaptive=False, method=None: regression.gw_discriminant(centres(featureRDD), propertyY, listed(propertiesX), float(bandwidth), kernel, flag(adaptive))
NAMES[_W + "GWAverage"] = lambda featureRDD, bandwidth, propertyY=None, propertiesX=None, kernel="gaussian", adaptive=False, quantile=False: regression.gw_average(centres(featureRDD), [*listed(propertyY), *listed(propertiesX)], float(bandwidth), kernel, flag(adaptive))
NAMES[_W + "GWCorrelation"] = lambda featureRDD, propertyY, propertiesX, bandwidth, kernel="gaussian", adaptive=False: regression.gw_correlation(centres(featureRDD), propertyY, listed(propertiesX)[0], float(bandwidth), kernel, flag(adaptive))
NAMES[_W + "GWPCA"] = lambda featureRDD, properties, bandwidth, kernel="gaussian", adaptive=False, k=2, robust=False: regression.gw_pca(centres(featureRDD), listed(properties), float(bandwidth), int(k), kernel, flag(adaptive), flag(robust))


@op(_W + "MGWR")
def _mgwr(featureRDD, propertyY, propertiesX, kernel="bisquare", approach="CV", adaptive=True, iteration=20, epsilon=1e-5):
    df, xs = centres(featureRDD), listed(propertiesX)
    bw = regression.mgwr_bandwidths(df, propertyY, xs, kernel, flag(adaptive))
    return regression.mgwr(df, propertyY, xs, bw, kernel, flag(adaptive), int(iteration), float(epsilon))


_H = _S + "SpatialHeterogeneity."
for _n, _f in (("Factor", statistics.factor_detector), ("Interaction", statistics.interaction_detector), ("Ecological", statistics.ecological_detector)):
    NAMES[f"{_H}Geo{_n}Detector"] = lambda featureRDD, y_title, x_titles, f=_f: f(featureRDD, y_title, listed(x_titles))


@op(_H + "GeoRiskDetector")
def _risk(featureRDD, y_title, x_titles):
    out = None
    for x in listed(x_titles):
        one = statistics.risk_detector(featureRDD, y_title, x).withColumns({"x": F.lit(x), "stratum1": F.col("stratum1").cast("string"), "stratum2": F.col("stratum2").cast("string")})
        out = one if out is None else out.unionByName(one)
    return out


def zoom_of(scale: float) -> int:
    """Zoom level of a scale in metres a cell."""
    return int(math.floor(math.log2(156543.033928 / scale))) + 1 if scale > 0 else -1
