"""Graphs: every name with its arguments, and whole graphs from a file to a file."""

import inspect
import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators import raster, tiles
from terralith.plans import dag, names
from terralith.sources import geotiff, readers

# Arguments of names that are only evaluated later, by whom they are given to.
LATER = {"Filter.equals": ["leftField", "rightValue"], "Filter.date": ["startTime", "endTime"], "Filter.bounds": ["bounds"], "Filter.and": ["filters"], "Service.getCoverageByFeature": ["feature"]}
WANTED = {m[1]: [a for a in m[2].split(",") if a] for m in re.finditer(r"(\S+?)\((\S*?)\)", (Path(__file__).parent / "graph_names.txt").read_text())} | LATER


def call(f, **args):
    return {"functionInvocationValue": {"functionName": f, "arguments": {k.rstrip("_").replace("__", "-"): v if isinstance(v, dict) else {"constantValue": v} for k, v in args.items()}}}


def ref(n):
    return {"valueReference": n}


def test_every_name_takes_its_arguments():
    assert len(WANTED) == 387
    for n, args in WANTED.items():
        ps = inspect.signature(dag.REGISTRY[n]).parameters
        assert any(p.kind is p.VAR_KEYWORD for p in ps.values()) or set(args) <= set(ps), n


@pytest.fixture(scope="module")
def world(spark):
    """Values for arguments by name."""
    rng = np.random.default_rng(1)
    cells = [(b, x, y, float(rng.integers(1, 60))) for b in "abc" for x in range(20) for y in range(20)]
    t = tiles.to_tiles(spark.createDataFrame(cells, "band string, cx int, cy int, v double"), 16).cache()
    one = raster.select_bands(t, ["a"])
    poly = lambda x, y, s=2.0: f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"
    fc = spark.createDataFrame([(str(i), poly(i % 5 * 2.0, i // 5 * 2.0), i + 1.0, float(i % 4), float(i * 7 % 5), "uv"[i % 2], float(i), "2020-01-0%d" % (i % 9 + 1)) for i in range(20)], "id string, geom string, p double, a double, b double, k string, t double, time string").withColumn("time", F.col("time").cast("timestamp")).cache()
    feature = spark.createDataFrame([("0", poly(0, 0), {"name": "n", "size": "4"})], "id string, geom string, props map<string,string>")
    line = spark.createDataFrame([("0", "LINESTRING (0 0, 10 0)", {"name": "l"})], "id string, geom string, props map<string,string>")
    images = t.select(F.explode(F.array(F.lit("i1"), F.lit("i2"))).alias("cov_id"), *tiles.KEY, "cells")
    cube = t.select(F.lit("p").alias("product"), F.lit("q").alias("platform"), F.lit("2020-01-01").cast("timestamp").alias("ts"), *tiles.KEY, "cells")
    catalog = spark.createDataFrame([("i1", "P", "S", "2020-01-01", 5.0, 0.0, 0.0, 20.0, 20.0, "EPSG:4326")], "cov_id string, product string, sensor string, time string, cloud double, xmin double, ymin double, xmax double, ymax double, crs string").withColumn("time", F.col("time").cast("timestamp"))
    context = {"spark": spark, "catalog": catalog, "imagery": images, "products": {"F": fc}, "tables": {"T": fc.withColumn("grade", F.lit("5"))}, "cubes": {"C": cube}}
    by = {"coverage": t, "coverage1": t, "coverage2": t, "NIR": one, "Red": one, "depVar_In": one, "facVar_In": one, "DEM": one, "coverageCollection": images, "collection": fc, "collection1": fc, "collection2": fc, "featureRDD": fc, "feature": feature, "feature1": feature, "feature2": feature, "featureRDD1": feature, "featureRDD2": feature, "cube1": cube, "cube2": cube, "input": feature, "featureCollection": fc, "predictRDD": fc, "data": fc, "leftCollection": fc, "rightCollection": fc, "leftSpatialDataFrame": fc, "spatialDataFrame": fc, "queryDataFrame": fc, "collectionList": [fc, fc], "featureList": [feature, feature], "features": [feature, feature], "coverages": [t, t], "names": "[x, y]"}
    by |= {"geometry": poly(1, 1), "geom": poly(1, 1, 9.0), "queryGeometry": "POINT (1 1)", "maskGeom": poly(0, 0, 9.0), "kernel1": [[1.0]], "kernel2": [[2.0]], "gjson": '{"type": "Point", "coordinates": [1, 2]}', "bands": "[a, b]", "bandNames": "[a, b]", "name": "x,y,z", "rules": "[[0,10,1],[10,70,2]]", "range": "[5, 40]", "from": "[1, 2]", "to": "[3, 4]", "l": "[1, 2]", "valueRange": "[0:10, 20:30]", "kernelType": "square", "palette": "[#000000, #ffffff]", "coverageID": "i1", "productId": "F", "productID": "P", "featureId": "3", "cubeId": "C", "tableName": "T", "queryInSQL": "SELECT * FROM T WHERE p > 3", "geometryColumn": "geom", "crs": "EPSG:4326", "crsCode": "EPSG:3857", "tarCrsCode": "EPSG:3857", "resolution": 1.0, "level": -1, "mode": "nearest", "properties": "[a, b]", "propertiesX": "[a, b]", "propertyY": "p", "propertyName": "p", "property": "p", "propertyT": "t", "propertiesT": "[t]", "y_title": "p", "x_titles": "[k, a]", "knowledge_title": "k", "reporting_title": "a", "y": "p", "x": "[a]", "weights": "[0.5, 0.5]", "rows": 4, "cols": 4, "bandwidth": 12.0, "adaptive": "true", "weightstyle": "W", "start": 0, "end": 2, "filters": [], "coordinates": "[1, 2]", "coors": "[1, 2]", "distances": "[1, 2]", "var_args": '{"u": "v"}', "propertySelectors": "[a]", "newProperties": "[z]", "reduceProperties": "[p, k]", "reduceRules": "[mean, mode]", "spatialPredicate": "Intersects", "lookupIn": "[u, v]", "lookupOut": "[1, 2]", "columnName": "new", "newContent": "z", "rowKeys": "[id]", "column1": "a", "column2": "b", "newColumnName": "c", "distribution": "uniform", "baseAlgorithm": lambda d: d, "operator": "less_than", "value": 9, "leftField": "sensorName", "rightValue": "S", "startTime": "2019-01-01", "endTime": "2021-01-01", "bounds": "0,0,9,9", "constantValue": 3, "filter": lambda d: d, "axis": "x", "bandName1": "a", "bandName2": "b", "platform1": "q", "platform2": "q", "kernel": "gaussian", "limit": "less_than", "distance": 2.5, "k": 2, "object": 5, "opacity": None, "format": "png", "landTable": "T", "ecologyTable": "T", "urbanTable": "T", "slopeTable": "T", "facVar_name_In": "f", "geometryType": 0, "time": None, "extent": None, "products_": None, "datetime": "[2019-01-01, 2021-01-01]", "bbox": "[0, 0, 9, 9]", "method": None, "var": None, "metadata": '{"m": "1"}', "timeFieldName": "time", "scale": 1, "family": "poisson", "propertiesX_": None}
    numbers = dict.fromkeys(["i", "threshold", "radius", "low", "min", "max", "high", "minimum", "maximum", "gain", "bias", "gamma", "readMask", "writeMask", "xRadius", "yRadius", "sigma", "magnitude", "rotations", "maxRows", "count", "offset", "fraction", "seed", "geoHashPrecision", "distanceTolerance", "n", "timelag", "accuracy", "binMaxCount", "sill", "nugget", "vipValue", "size", "amplitude", "keep", "weightingPower"], 1)
    by |= numbers | {"high": 50, "max": 50, "maximum": 0.9, "minimum": 0.1, "fraction": 0.5, "sill": 90, "binMaxCount": 5, "geoHashPrecision": 4, "size": 3, "keep": 2, "bias": None, "gain": None, "accuracy": 0.1, "maxRows": 5, "count": 5, "timelag": 3, "n": 3}
    return by, context, {"line": line, "one": one, "points": fc}


SPECIAL = {
    "Coverage.selectBands": {"bands": "[a]"}, "Coverage.addBands": {"names": "a"}, "Coverage.geoDetector": {"norExtent_sta": 0, "norExtent_end": 99, "NaN_value": -1}, "Coverage.convolve": {"kernel": [[0, 1, 0], [1, 1, 1], [0, 1, 0]]}, "Kernel.inverse": {"kernel": [[2.0]]}, "Kernel.rotate": {"kernel": [[2.0]]}, "Kernel.fixed": {"weights": "[[1, 2], [3, 4]]"},
    "Coverage.terrFilter": {"min": "[0, 5]", "max": "[3, 9]"}, "Coverage.clip": {"geom": "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))"}, "Coverage.sampleRegions": {"properties": "[k]", "scale": None}, "Coverage.addStyles": {"bands": "[a]", "min": 0, "max": 50}, "CoverageCollection.addStyles": {"bands": "[a]", "min": 0, "max": 50, "palette": None}, "Cube.addStyles": {"min": 0, "max": 50}, "Coverage.remap": {"defaultValue": 0}, "Coverage.histogram": {"scale": 2},
    "Service.getCoverage": {"productID": None}, "Service.getTable": {"productID": "T"}, "Service.getFeature": {"productId": "F"}, "Service.getCoverageCollection": {"customFiles": None, "bands": None, "coverageIDList": None}, "Service.getCube": {"products": None, "bands": None}, "Feature.load": {"productId": "F"}, "FeatureCollection.loadFeatureCollectionFromUpload": {"featureId": "F"}, "Feature.loadFeatureFromUpload": {"featureId": "F"}, "Feature_deprecated.load": {"productName": "F"},
    "Feature.get": {"property": "name"}, "Feature.getNumber": {"property": "size"}, "Feature.getString": {"property": "name"}, "Feature.toArray": {"properties": "[name]"}, "Feature.copyProperties": {"properties": "[name]"}, "Feature.select": {"propertySelectors": "[name]", "newProperties": "[other]"}, "Feature_deprecated.set": {"property": '{"u": "v"}'}, "Feature_deprecated.propertyNames": {"featureRDD": "feature"}, "Feature_deprecated.get": {"featureRDD": "feature", "property": "name"}, "Feature.loadFromGeojson": {"properties": '{"q": 1}'},
    "FeatureCollection.remap": {"property": "k"}, "FeatureCollection.filterMetadata": {"name": "p"}, "FeatureCollection.filterDate": {"start": "2020-01-02", "end": "2020-01-05"}, "FeatureCollection.limit": {"property": "p", "ascending": "false"}, "FeatureCollection.sortAndSplit": {"geoHashPrecision": None}, "FeatureCollection.select": {"newProperties": "[z]"}, "FeatureCollection.distinct": {"property": "k"}, "FeatureCollection.load": {"extent": "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))"}, "FeatureCollection.loadFromGeometry": {"id": "g"},
    "Geometry.LineString": {"coordinates": "[[0, 0], [1, 1]]"}, "Geometry.MultiPoint": {"coordinates": "[[0, 0], [1, 1]]"}, "Geometry.MultiLineString": {"coordinates": "[[[0, 0], [1, 1]]]"}, "Geometry.LinearRing": {"coordinates": "[[0, 0], [1, 0], [1, 1], [0, 0]]"}, "Geometry.Polygon": {"coordinates": "[[[0, 0], [1, 0], [1, 1], [0, 0]]]"}, "Geometry.MultiPolygon": {"coordinates": "[[[[0, 0], [1, 0], [1, 1], [0, 0]]]]"}, "Geometry.GeometryCollection": {"coordinates": ["POINT (1 1)", {"type": "Point", "coordinates": [2, 2]}]},
    **{f"Feature_deprecated.{n}": {"coors": SPECIAL_} for n, SPECIAL_ in (("lineString", "[[0, 0], [1, 1]]"), ("multiPoint", "[[0, 0], [1, 1]]"), ("multiLineString", "[[[0, 0], [1, 1]]]"), ("linearRing", "[[0, 0], [1, 0], [1, 1], [0, 0]]"), ("polygon", "[[[0, 0], [1, 0], [1, 1], [0, 0]]]"), ("multiPolygon", "[[[[0, 0], [1, 0], [1, 1], [0, 0]]]]"), ("geometry", '{"type": "Point", "coordinates": [1, 2]}'))},
    "SpatialStats.BasicStatistics.KernelDensityEstimation": {"kernel": "gaussian"}, "SpatialStats.SpatialInterpolation.selfDefinedKriging": {"range": 9, "method": "Sph"}, "SpatialStats.SpatialInterpolation.OrdinaryKriging": {"method": "Sph"}, "SpatialStats.STCorrelations.CorrelationAnalysis.corrMat": {"method": "spearman"}, "SpatialStats.SpatialRegression.LogisticRegression.feature": {"y": "l"}, "SpatialStats.STSampling.regularSampling": {"x": 2, "y": 2}, "SpatialStats.STSampling.stratifiedSampling": {"properties": "[k]"}, "SpatialStats.GWModels.MGWR": {"kernel": "bisquare", "iteration": 2}, "SpatialStats.GWModels.GWDA.calculate": {"propertyY": "k"}, "SpatialStats.GWModels.GWRGeneralized.fit": {"maxIter": 100}, "SpatialStats.BasicStatistics.PrincipalComponentAnalysis": {"properties": "[a, b]"}, "SpatialStats.GWModels.GTWR.autoFit": {"lambda": 0.9}, "SpatialStats.GWModels.GTWR.fit": {"lambda": 0.9}, "SpatialStats.GWModels.GTWR.predict": {"lambda": 0.9},
    "SpatialStats.STCorrelations.SpatialAutoCorrelation.globalGearyC": {"knn": 3}, "SpatialStats.STCorrelations.SpatialAutoCorrelation.localGearyC": {"knn": 3}, "SpatialStats.STCorrelations.SpatialAutoCorrelation.getisOrdG": {"knn": 3, "star": "true"}, "SpatialStats.SpatialInterpolation.IDW.fit": {"radiusX": 9.0, "weightingPower": 2},
}
SEARCHED = ("autoFit", "auto", "MGWR")  # these try many bandwidths, minutes each; their parts have tests of their own


@pytest.mark.parametrize("prefix", sorted({n.split(".")[0] for n in WANTED}))
def test_every_name_runs(spark, world, prefix):
    """Each gives a table that can be planned, or a value; what takes one job or two is counted as well."""
    by, context, _ = world
    bad = []
    for n in sorted(n for n in WANTED if n.split(".")[0] == prefix and not n.endswith(SEARCHED)):
        own = SPECIAL.get(n, {})
        args = {a: own[a] if a in own else by.get(a) for a in WANTED[n] if a in own or by.get(a) is not None}
        args = {k: by["feature"] if isinstance(v, str) and v == "feature" else v for k, v in args.items()}
        if n.endswith("LogisticRegression.feature"):
            args["data"] = args["data"].withColumn("l", (F.col("p") % 3 == 0).cast("double"))
        if n == "Cube.addStyles":
            args["cube"] = by["cube1"]
        if prefix == "Feature_deprecated" and "featureRDD" in args:
            args["featureRDD"] = by["feature"]
        if n == "Cube.NDVI":
            args["input"] = by["cube1"]
        if n == "Coverage.date":
            args["coverage"] = by["cube1"]
        if "coors" in args and "properties" in args:
            args["properties"] = '{"q": 1}'
        try:
            got = dag.call(n, args, context)
            if isinstance(got, names.Images):
                got = got.pixels()
            if isinstance(got, DataFrame):
                assert got.columns
                if prefix in ("Service", "Feature", "Geometry", "CoverageCollection", "Cube"):
                    assert got.count() >= 0
            else:
                assert got is not None
        except Exception as x:
            bad.append((n, type(x).__name__, str(x)[:300]))
    assert not bad, bad


def test_slope_of_a_file_to_a_file(spark, tmp_path):
    """Read a GeoTIFF, take its slope, write a GeoTIFF: as one graph."""
    z = np.add.outer(np.zeros(40), np.arange(50.0))[None]
    (tmp_path / "dem.tif").write_bytes(geotiff.encode(z, 10.0, 60.0, 1.0, nodata=-1.0))
    graph = {"result": "0", "values": {"0": call("Coverage.export", coverage=ref("1")), "1": call("Coverage.slope", coverage=ref("2"), radius=1, Z_factor=1), "2": call("Service.getCoverage", coverageID=str(tmp_path / "dem.tif"), productID="")}}
    got = dag.run(json.dumps(graph), {"spark": spark, "grid": ("EPSG:4326", 10.0, 60.0, 1.0)}).collect()
    image, info = geotiff.decode(got[0].content)
    assert len(got) == 1 and image[0, 5, 5] == pytest.approx(45) and info["origin"][3:5] == (10.0, 60.0)


def test_a_collection_by_filters(spark, world):
    by, context, _ = world
    nodes = {"0": call("CoverageCollection.mean", coverageCollection=ref("1")), "1": call("CoverageCollection.filter", filter=ref("2"), collection=ref("5")), "2": call("Filter.and", filters={"arrayValue": {"values": [ref("3"), ref("4")]}}), "3": call("Filter.equals", leftField="sensorName", rightValue="S"), "4": call("Filter.bounds", bounds="0,0,5,5"), "5": call("Service.getCoverageCollection", productID="P")}
    got = tiles.from_tiles(dag.run({"result": "0", "values": nodes}, context))
    assert got.count() == 1200
    nodes["3"] = call("Filter.equals", leftField="sensorName", rightValue="other")
    assert dag.run({"result": "0", "values": nodes}, context).count() == 0


def test_equal_parts_run_once_and_cycles_are_refused(spark, world):
    by, context, _ = world
    nodes = {"0": call("Coverage.add", coverage1=ref("1"), coverage2=ref("2")), "1": call("Coverage.abs", coverage=ref("3")), "2": call("Coverage.abs", coverage=ref("3")), "3": call("Service.getCoverage", coverageID="i1", productID=None)}
    calls, _ = dag.Graph({"result": "0", "values": nodes}).ordered()
    assert len(calls) == 3
    with pytest.raises(ValueError, match="itself"):
        dag.Graph({"result": "0", "values": {"0": call("Coverage.abs", coverage=ref("0"))}}).ordered()
    with pytest.raises(TypeError, match="no argument"):
        dag.call("Coverage.abs", {"coverage": by["coverage"], "other": 1}, context)


def test_terrain_takes_its_factor(spark, world):
    by, context, more = world
    a = dag.call("Coverage.terrSlope", {"coverage": more["one"], "radius": 1, "z-Factor": 2.0}, context)
    b = dag.call("Coverage.terrSlope", {"coverage": raster.local(more["one"], lambda v: v * 2), "radius": 1, "z-Factor": 1}, context)
    assert {tuple(r) for r in tiles.from_tiles(a).collect()} == {tuple(r) for r in tiles.from_tiles(b).collect()}


def test_constructors():
    f = lambda n, c: names.NAMES[f"Geometry.{n}"](c)
    assert f("Point", "[1, 2.5]") == "POINT (1 2.5)" and f("LineString", [[0, 0], [1, 1]]) == "LINESTRING (0 0, 1 1)"
    assert f("Polygon", "[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]") == "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
    assert f("MultiPolygon", "[[[[0,0],[4,0],[4,4],[0,0]]]]") == "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)))" and f("GeometryCollection", ["POINT (1 1)"]) == "GEOMETRYCOLLECTION (POINT (1 1))"
    for kind, bad in (("Polygon", "[[[0,0],[1,0],[0,0]]]"), ("LinearRing", "[[0,0],[1,0],[1,1],[2,2]]"), ("LineString", "[[0,0]]"), ("Point", "[1]")):
        with pytest.raises((ValueError, IndexError)):
            f(kind, bad)


def test_readers_by_ending(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"q": 3}}]}')
    r = readers.features(spark, str(tmp_path / "a.geojson")).first()
    assert (r.id, r.geom, r.props) == ("7", "POINT (1 2)", {"q": "3"})
