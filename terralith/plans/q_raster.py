"""Queries of the raster, focal, collection and cube operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cellmath
from ..operators import collection, cube, focal, raster
from . import fixtures
from .fixtures import as_cells, rounded, table, tiled


def add(name, f, sql=None, cte=True):
    """Queries run on tiles; what comes out as tiles is compared as cells."""
    fixtures.add(name, lambda s, d: as_cells(f(s, d)), sql, cte)


def r1(s, d):
    return tiled(fixtures.r1(s, d))


def r2(s, d):
    return tiled(fixtures.r2(s, d))


def coll(s, d):
    return tiled(fixtures.coll(s, d))


def dem(s):
    return tiled(fixtures.dem(s))


_KEY = "band, cx, cy"
_UNARY = {**{n: f"{n}(x)" for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "log10", "sqrt", "cbrt", "abs", "ceil", "floor")}, "asin": "asin(x / 100)", "acos": "acos(x / 100)", "log": "ln(x)", "signum": "sign(x)", "round": "floor(x + 0.5)", "not": "(x = 0)::DOUBLE", "remove_zero": "CASE WHEN x <> 0 THEN x END", "bitwise_not": "(~ (v::BIGINT))::DOUBLE"}
for _n, _sql in _UNARY.items():
    def _f(s, d, n=_n):
        scale = 1.0 if n == "bitwise_not" else 1e-5 if n in ("asin", "acos") else 1e-3
        return rounded(raster.unary(raster.local(r1(s, d), lambda v: v * scale if scale != 1.0 else v), n))

    add(f"ras_unary_{_n}", _f, f"SELECT {_KEY}, round({_sql}, 6) AS v FROM (SELECT *, v * 0.001 AS x FROM r)".replace("x / 100", "v * 0.00001"))

_CONST = {"add_num": "v + 3", "subtract_num": "v - 3", "multiply_num": "v * 3", "divide_num": "v / 3", "mod_num": "v % 3", "pow_num": "pow(v, 3)", "binarization": "CASE WHEN v > 3 THEN 255.0 ELSE 0.0 END", "gte_value": "(v >= 3)::DOUBLE", "lte_value": "(v <= 3)::DOUBLE"}
for _n, _sql in _CONST.items():
    add(f"ras_const_{_n}", lambda s, d, n=_n: rounded(raster.constant(r1(s, d), n, 3)), f"SELECT {_KEY}, round({_sql}, 6) AS v FROM r")

_BINARY = {"add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "a / nullif(b, 0)", "mod": "a % nullif(b, 0)", "pow": "pow(a * 0.01, b * 0.01)", "atan2": "atan2(a, b)", "mini": "least(a, b)", "maxi": "greatest(a, b)", "eq": "(a = b)::DOUBLE", "neq": "(a <> b)::DOUBLE", "gt": "(a > b)::DOUBLE", "gte": "(a >= b)::DOUBLE", "lt": "(a < b)::DOUBLE", "lte": "(a <= b)::DOUBLE", "and": "(a <> 0 AND b <> 0)::DOUBLE", "or": "(a <> 0 OR b <> 0)::DOUBLE", "bitwise_and": "(a::BIGINT & b::BIGINT)::DOUBLE", "bitwise_or": "(a::BIGINT | b::BIGINT)::DOUBLE", "bitwise_xor": "xor(a::BIGINT, b::BIGINT)::DOUBLE", "raster_union": "(a + b) - a"}
for _n, _sql in _BINARY.items():
    def _g(s, d, n=_n):
        scale = (lambda v: v * 0.01) if n == "pow" else (lambda v: v)
        return rounded(raster.binary(raster.local(r1(s, d), scale), raster.local(r2(s, d), scale), n))

    add(f"ras_binary_{_n}", _g, f"SELECT {_KEY}, round({_sql}, 6) AS v FROM (SELECT {_KEY}, r.v AS a, r2.v AS b FROM r JOIN r2 USING ({_KEY}))")

for _n, (_lo, _hi, _, _none) in cellmath.CELL_TYPES.items():
    _sql = f"CASE WHEN v BETWEEN {_lo} AND {_hi} AND v <> {_none} THEN v::BIGINT::DOUBLE END" if _lo is not None else "v::FLOAT::DOUBLE" if _n == "float" else "v"
    add(f"ras_cast_{_n}", lambda s, d, n=_n: raster.local(r1(s, d), lambda v: cellmath.to_type(v, n).cast("double")), f"SELECT {_KEY}, {_sql} AS v FROM r")

add("ras_reclass", lambda s, d: raster.local(r1(s, d), lambda v: cellmath.reclass(v, [(0, 30, 1), (20, 90, 2)], -1)), f"SELECT {_KEY}, CASE WHEN v BETWEEN 0 AND 30 THEN 1.0 WHEN v BETWEEN 20 AND 90 THEN 2.0 ELSE -1.0 END AS v FROM r")
add("ras_remap", lambda s, d: raster.local(r1(s, d), lambda v: cellmath.remap(v, [10, 20], [1.5, 2.5])), f"SELECT {_KEY}, CASE v::INT WHEN 10 THEN 1.5 WHEN 20 THEN 2.5 ELSE v END AS v FROM r")
add("ras_remap_default", lambda s, d: raster.local(r1(s, d), lambda v: cellmath.remap(v, [10, 20], [1.5, 2.5], -9)), f"SELECT {_KEY}, CASE v::INT WHEN 10 THEN 1.5 WHEN 20 THEN 2.5 ELSE -9.0 END AS v FROM r")
add("ras_polynomial", lambda s, d: rounded(raster.local(r1(s, d), lambda v: cellmath.polynomial(v, [1, 0.5, 0.25]))), f"SELECT {_KEY}, round(1 + 0.5 * v + 0.25 * v * v, 6) AS v FROM r")
add("ras_clamp", lambda s, d: raster.local(r1(s, d), lambda v: cellmath.clamp(v, 10, 50)), f"SELECT {_KEY}, least(greatest(v, 10.0), 50.0) AS v FROM r")
add("ras_filter", lambda s, d: raster.local(r1(s, d), lambda v: cellmath.within(v, 10, 50)), f"SELECT {_KEY}, CASE WHEN v BETWEEN 10 AND 50 THEN v END AS v FROM r")
add("ras_ndvi", lambda s, d: rounded(raster.normalized_difference(r1(s, d), "A", "N")), "SELECT 'nd' AS band, cx, cy, round((a.v - b.v) / nullif(a.v + b.v, 0), 6) AS v FROM (SELECT * FROM r WHERE band = 'A') a JOIN (SELECT * FROM r WHERE band = 'N') b USING (cx, cy)")
add("ras_cat", lambda s, d: raster.overlay(r1(s, d), r2(s, d)), f"SELECT {_KEY}, coalesce(r.v, r2.v) AS v FROM r FULL JOIN r2 USING ({_KEY})")
add("ras_mask", lambda s, d: raster.mask(r1(s, d), raster.local(raster.select_bands(r2(s, d), ["A"]), lambda v: v % 2), 0, -1), f"SELECT {_KEY}, CASE WHEN m.v % 2 = 0 THEN -1.0 ELSE r.v END AS v FROM r JOIN (SELECT cx, cy, v FROM r2 WHERE band = 'A') m USING (cx, cy)")
add("ras_update_mask", lambda s, d: raster.update_mask(r1(s, d), raster.local(r2(s, d), lambda v: v % 2)), f"SELECT {_KEY}, CASE WHEN r2.v % 2 <> 0 THEN r.v END AS v FROM r JOIN r2 USING ({_KEY})")
add("ras_unmask", lambda s, d: raster.unmask(raster.local(r1(s, d), lambda v: cellmath.within(v, 20, 80)), r2(s, d)), f"SELECT {_KEY}, coalesce(CASE WHEN r.v BETWEEN 20 AND 80 THEN r.v END, r2.v) AS v FROM r LEFT JOIN r2 USING ({_KEY})")
add("ras_select_bands", lambda s, d: raster.select_bands(r1(s, d), ["A", "R"]), f"SELECT {_KEY}, v FROM r WHERE band IN ('A', 'R')")
add("ras_add_bands", lambda s, d: raster.add_bands(r1(s, d), r2(s, d), ["A"], True), f"SELECT {_KEY}, v FROM r WHERE band <> 'A' UNION ALL SELECT {_KEY}, v FROM r2 WHERE band = 'A'")
add("ras_rename", lambda s, d: raster.rename(r1(s, d), ["A", "N", "R"], ["x", "y", "z"]), "SELECT CASE band WHEN 'A' THEN 'x' WHEN 'N' THEN 'y' ELSE 'z' END AS band, cx, cy, v FROM r")
add("ras_band_names", lambda s, d: raster.band_names(r1(s, d)), "SELECT string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM r")
add("ras_band_num", lambda s, d: raster.band_num(r1(s, d)), "SELECT count(DISTINCT band) AS n FROM r")
add("ras_slice", lambda s, d: raster.slice_bands(r1(s, d), 0, 2), f"SELECT {_KEY}, v FROM r WHERE band IN (SELECT DISTINCT band FROM r ORDER BY band LIMIT 2)")
add("ras_into_one", lambda s, d: rounded(raster.into_one(r1(s, d), ["A", "N"])), "SELECT 'A' AS band, cx, cy, round(avg(v), 6) AS v FROM r WHERE band IN ('A', 'N') GROUP BY cx, cy")
add("ras_stack", lambda s, d: raster.stack(raster.select_bands(r1(s, d), ["A"]), 3), "SELECT 'B' || i.range AS band, cx, cy, v FROM r, range(1, 4) i WHERE band = 'A'")
add("ras_percentile_range", lambda s, d: raster.percentile_range(r1(s, d), 0.1, 0.9), f"SELECT {_KEY}, CASE WHEN v BETWEEN lo AND hi THEN v END AS v FROM r, (SELECT l[least(floor(len(l) * 0.1)::INT, len(l) - 1) + 1] AS lo, l[least(floor(len(l) * 0.9)::INT, len(l) - 1) + 1] AS hi FROM (SELECT list_sort(list(DISTINCT v)) AS l FROM r))")
add("ras_histogram", lambda s, d: raster.histogram(r1(s, d)), "SELECT v::INT AS value, count(*) AS n FROM r GROUP BY 1")
add("ras_area", lambda s, d: raster.area(r1(s, d), [":10", "50:60", "70:70"], 30.0), "SELECT count(*) * 900.0 AS area FROM r WHERE band = 'A' AND (v < 10 OR (v > 50 AND v < 60) OR v = 70)")
add("ras_resample_down", lambda s, d: rounded(raster.resample(r1(s, d), -4, "mean")), "SELECT band, (cx // 4)::INT AS cx, (cy // 4)::INT AS cy, round(avg(v), 6) AS v FROM r GROUP BY 1, 2, 3")
add("ras_resample_nearest", lambda s, d: raster.resample(r1(s, d), 2), "SELECT band, (cx * 2 + i.range)::INT AS cx, (cy * 2 + j.range)::INT AS cy, v FROM r, range(2) i, range(2) j")
add("ras_resample_bilinear", lambda s, d: rounded(raster.resample(dem(s), 2, "bilinear")), """SELECT 'B1' AS band, fx::INT AS cx, fy::INT AS cy, round(sum(v * w) / sum(w), 6) AS v FROM (SELECT a.range AS fx, b.range AS fy, v, (1 - abs((a.range + 0.5) / 2 - 0.5 - cx)) * (1 - abs((b.range + 0.5) / 2 - 0.5 - cy)) AS w
    FROM range(128) a, range(128) b, dem WHERE abs((a.range + 0.5) / 2 - 0.5 - cx) < 1 AND abs((b.range + 0.5) / 2 - 0.5 - cy) < 1) GROUP BY 1, 2, 3""")
add("ras_clip_box", lambda s, d: raster.clip_box(r1(s, d), 5, 6, 20, 30), f"SELECT {_KEY}, v FROM r WHERE cx >= 5 AND cx < 20 AND cy >= 6 AND cy < 30")
add("ras_clip_polygon", lambda s, d: raster.clip(r1(s, d), "POLYGON ((0 0, 40 0, 0 40, 0 0))"), f"SELECT {_KEY}, v FROM r WHERE cx + 0.5 + cy + 0.5 < 40")
add("ras_rgb_hsv", lambda s, d: rounded(raster.rgb_to_hsv(raster.local(r1(s, d), lambda v: v % 256), "R", "A", "N")), """, p AS (SELECT cx, cy, max(CASE band WHEN 'R' THEN v % 256 END) / 255 AS r, max(CASE band WHEN 'A' THEN v % 256 END) / 255 AS g, max(CASE band WHEN 'N' THEN v % 256 END) / 255 AS b FROM r GROUP BY 1, 2),
    h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM p WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL),
    t AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN 60 * ((g - b) / d) WHEN hi = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END AS u FROM h)
    SELECT 'H' AS band, cx, cy, round(CASE WHEN u < 0 THEN u + 360 ELSE u END, 6) AS v FROM t UNION ALL SELECT 'S', cx, cy, round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 6) FROM t UNION ALL SELECT 'V', cx, cy, round(hi, 6) FROM t""")
add("ras_gain_bias", lambda s, d: rounded(raster.gain_bias(r1(s, d)), "gain", "bias"), "SELECT band, round(255 / (max(v) - min(v)), 6) AS gain, round(0 - min(v) * 255 / (max(v) - min(v)), 6) AS bias FROM r GROUP BY 1")
add("ras_styles", lambda s, d: raster.add_styles(r1(s, d), low=0, high=100), f"SELECT {_KEY}, floor(1 + 254 * least(greatest(v / 100, 0), 1)) AS v FROM r")
add("ras_geo_detector", lambda s, d: rounded(raster.factor_detector(raster.select_bands(r1(s, d), ["A"]), raster.local(raster.select_bands(r2(s, d), ["A"]), lambda v: v % 5)), "q"), """, j AS (SELECT a.v, b.v % 5 AS k FROM (SELECT * FROM r WHERE band = 'A') a JOIN (SELECT * FROM r2 WHERE band = 'A') b USING (cx, cy)),
    w AS (SELECT k, count(*) AS n, var_pop(v) AS s FROM j GROUP BY k) SELECT round(1 - (SELECT sum(n * s) FROM w) / (count(*) * var_pop(v)), 6) AS q, count(*) AS n, count(DISTINCT k) AS strata FROM j""")
add("ras_metadata", lambda s, d: raster.metadata(r1(s, d), "EPSG:3857", 100.0, 200.0, 10.0), "SELECT 'EPSG:3857' AS crs, 100.0 + min(cx) * 10 AS xmin, 200.0 + min(cy) * 10 AS ymin, 100.0 + (max(cx) + 1) * 10 AS xmax, 200.0 + (max(cy) + 1) * 10 AS ymax, 10.0 AS resolution FROM r")
add("ras_pyramid", lambda s, d: rounded(raster.pyramid(dem(s), 2)), """, one AS (SELECT band, (cx // 2)::INT AS cx, (cy // 2)::INT AS cy, avg(v) AS v FROM dem GROUP BY 1, 2, 3) SELECT 0 AS level, band, cx, cy, v FROM dem UNION ALL SELECT 1, band, cx, cy, round(v, 6) FROM one
    UNION ALL SELECT 2, band, (cx // 2)::INT, (cy // 2)::INT, round(avg(v), 6) FROM one GROUP BY 2, 3, 4""")
add("ras_tiles_round_trip", lambda s, d: raster.from_tiles(raster.to_tiles(fixtures.r1(s, d), 16)), f"SELECT {_KEY}, v FROM r")
add("ras_date", lambda s, d: table(s, d, "events").select("event_id", raster.as_date(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day")), "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events", cte=False)
add("ras_sample_regions", lambda s, d: raster.sample_regions(raster.select_bands(r1(s, d), ["A"]), s.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 3.0, 3.0, 9.0, 6.0)], "id int, xmin double, ymin double, xmax double, ymax double")), """, g(id, xmin, ymin, xmax, ymax) AS (VALUES (1, 0, 0, 5, 5), (2, 3, 3, 9, 6))
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY cy, cx, band))::INT AS sample, band, cx, cy, v FROM r JOIN g ON cx + 0.5 >= xmin AND cx + 0.5 < xmax AND cy + 0.5 >= ymin AND cy + 0.5 < ymax WHERE band = 'A'""")

_OFF = "(SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a, range(3) b)"
_NB = f"SELECT t.band, t.cx, t.cy, o.dx, o.dy, n.v FROM r t CROSS JOIN {_OFF} o LEFT JOIN r n ON n.band = t.band AND n.cx = t.cx + o.dx AND n.cy = t.cy + o.dy"
for _n, _sql in {"mean": "sum(coalesce(v, 0)) / 9", "max": "max(coalesce(v, 0))", "min": "min(coalesce(v, 0))", "median": "median(coalesce(v, 0))", "sum": "sum(coalesce(v, 0))", "sd": "stddev_pop(coalesce(v, 0))"}.items():
    add(f"ras_focal_{_n}", lambda s, d, n=_n: rounded(focal.focal(r1(s, d), n, 1)), f"SELECT {_KEY}, round({_sql}, 6) AS v FROM ({_NB}) GROUP BY 1, 2, 3")
add("ras_focal_mode", lambda s, d: focal.focal(r1(s, d), "mode", 1), f"SELECT {_KEY}, w AS v FROM (SELECT {_KEY}, coalesce(v, 0) AS w, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, coalesce(v, 0)) AS i FROM ({_NB}) GROUP BY 1, 2, 3, 4) WHERE i = 1")
add("ras_focal_entropy", lambda s, d: rounded(focal.focal(r1(s, d), "entropy", 1)), f"SELECT {_KEY}, round(sum(-(n / 9.0) * log2(n / 9.0)), 6) AS v FROM (SELECT {_KEY}, coalesce(v, 0) AS w, count(*) AS n FROM ({_NB}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
add("ras_focal_circle_mean", lambda s, d: rounded(focal.focal(r1(s, d), "mean", 1, "circle")), f"SELECT {_KEY}, round(sum(coalesce(v, 0)) / 5, 6) AS v FROM ({_NB}) WHERE abs(dx) + abs(dy) <= 1 GROUP BY 1, 2, 3")


def _weights(k: list[list[float]]) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b}, {w!r})" for a, b, w in focal.offsets(k)) + ") AS k(dx, dy, w)"


_KERNELS = {"sobel_x": focal.sobel("x"), "sobel_y": focal.sobel("y"), "laplacian4": focal.laplacian4(), "laplacian8": focal.laplacian8(), "prewitt": focal.prewitt(), "kirsch": focal.kirsch(), "compass": focal.compass(), "gaussian": focal.gaussian(1), "circle": focal.circle(1, True), "square": focal.square(1), "manhattan": focal.manhattan(1), "chebyshev": focal.chebyshev(1), "euclidean": focal.euclidean(1), "diamond": focal.diamond(1), "octagon": focal.octagon(1), "plus": focal.plus(1), "plain": focal.plain(), "rectangle": focal.rectangle(1, 1), "roberts": focal.roberts(), "inverse": focal.inverse(focal.euclidean(1)), "rotated": focal.rotate(focal.kirsch(), 1), "summed": focal.add(focal.plus(1), focal.diamond(1)), "fixed": focal.fixed("[[1, 2, 3], [4, 5, 6], [7, 8, 9]]")}
for _n, _k in _KERNELS.items():
    add(f"ras_convolve_{_n}", lambda s, d, k=_k: rounded(focal.convolve(r1(s, d), k)), f"SELECT t.band, t.cx, t.cy, round(sum(coalesce(n.v, 0) * w), 6) AS v FROM r t CROSS JOIN {_weights(_k)} LEFT JOIN r n ON n.band = t.band AND n.cx = t.cx + k.dx AND n.cy = t.cy + k.dy GROUP BY 1, 2, 3")
add("ras_gradient", lambda s, d: rounded(focal.gradient(r1(s, d))), f"SELECT {_KEY}, round(sqrt(pow(sum(coalesce(v, 0) * dx * (2 - abs(dy))), 2) + pow(sum(coalesce(v, 0) * -dy * (2 - abs(dx))), 2)), 6) AS v FROM ({_NB}) GROUP BY 1, 2, 3")
_HORN = f"(SELECT {_KEY}, sum(coalesce(v, 0) * dx * (2 - abs(dy))) / 8 AS gx, sum(coalesce(v, 0) * dy * (2 - abs(dx))) / 8 AS gy FROM ({_NB}) GROUP BY 1, 2, 3)"
add("ras_slope", lambda s, d: rounded(focal.slope(r1(s, d))), f"SELECT {_KEY}, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS v FROM {_HORN}")
add("ras_aspect", lambda s, d: rounded(focal.aspect(r1(s, d))), f"SELECT {_KEY}, round(CASE WHEN gx = 0 AND gy = 0 THEN -1 ELSE (degrees(atan2(-gx, gy)) + 360) % 360 END, 6) AS v FROM {_HORN}")

for _n, _sql in {"mean": "avg(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "median": "median(v)", "or": "bit_or(v::BIGINT)::DOUBLE", "and": "bit_and(v::BIGINT)::DOUBLE", "cat": "arg_min(v, cov_id)", "count": "count(v)::DOUBLE"}.items():
    add(f"ras_collection_{_n}", lambda s, d, n=_n: rounded(collection.reduce(coll(s, d), n)), f"SELECT {_KEY}, round({_sql}, 6) AS v FROM coll GROUP BY 1, 2, 3")
add("ras_collection_mode", lambda s, d: collection.reduce(coll(s, d), "mode"), f"SELECT {_KEY}, v FROM (SELECT {_KEY}, v, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, v) AS i FROM coll GROUP BY 1, 2, 3, 4) WHERE i = 1")
add("ras_collection_merge", lambda s, d: collection.merge_coverages([r1(s, d), r2(s, d)], ["one", "two"]), f"SELECT 'one' AS cov_id, {_KEY}, v FROM r UNION ALL SELECT 'two', {_KEY}, v FROM r2")
add("ras_mosaic_window", lambda s, d: rounded(collection.mosaic(coll(s, d), "mean", (0, 0, 32, 32))), f"SELECT {_KEY}, round(avg(v), 6) AS v FROM coll WHERE cx < 32 AND cy < 32 GROUP BY 1, 2, 3")


def _catalog(s, d):
    t = table(s, d, "orders")
    return t.select(F.col("o_orderkey").cast("string").alias("cov_id"), F.col("o_orderpriority").alias("product"), F.col("o_orderdate").alias("time"), (F.col("o_totalprice") % 100).alias("cloud"), (F.col("o_custkey") % 360 - 180).cast("double").alias("xmin"), (F.col("o_custkey") % 180 - 90).cast("double").alias("ymin")).withColumn("xmax", F.col("xmin") + 1).withColumn("ymax", F.col("ymin") + 1)


add("ras_catalog_filters", lambda s, d: collection.all_of(collection.equals("product", "1-URGENT"), collection.date("1995-01-01", "1996-12-31"), collection.bounds(-90, -45, 0, 45), collection.cloud(0, 50))(_catalog(s, d)).select("cov_id"), """SELECT o_orderkey::VARCHAR AS cov_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= '1995-01-01' AND o_orderdate <= '1996-12-31' AND o_totalprice % 100 <= 50
    AND o_custkey % 360 - 179 >= -90 AND o_custkey % 360 - 180 <= 0 AND o_custkey % 180 - 89 >= -45 AND o_custkey % 180 - 90 <= 45""", cte=False)


def _cube(s, d, shift=0):
    t = table(s, d, "lineitem")
    return tiled(t.groupBy(F.lit("p").alias("product"), F.col("l_linestatus").alias("platform"), F.trunc("l_shipdate", "year").cast("timestamp").alias("ts"), F.col("l_returnflag").alias("band"), ((F.col("l_partkey") + shift) % 16).cast("int").alias("cx"), (F.col("l_orderkey") % 16).cast("int").alias("cy")).agg(F.sum("l_quantity").alias("v")))


def _cube_sql(shift=0):
    return f"(SELECT 'p' AS product, l_linestatus AS platform, date_trunc('year', l_shipdate)::TIMESTAMP AS ts, l_returnflag AS band, ((l_partkey + {shift}) % 16)::INT AS cx, (l_orderkey % 16)::INT AS cy, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


_CK = "product, platform, ts, band, cx, cy"
add("cube_calibrate", lambda s, d: cube.calibrate(_cube(s, d), 2.0, 1.0), f"SELECT {_CK}, v * 2 + 1 AS v FROM {_cube_sql()}", cte=False)
for _n, _sql in {"add": "a.v + b.v", "subtract": "a.v - b.v", "multiply": "a.v * b.v", "divide": "a.v / b.v"}.items():
    add(f"cube_{_n}", lambda s, d, n=_n: rounded(cube.combine(_cube(s, d), _cube(s, d, 1), n)), f"SELECT {_CK}, round({_sql}, 6) AS v FROM {_cube_sql()} a JOIN {_cube_sql(1)} b USING ({_CK})", cte=False)
for _n, _sql in {"add_num": "v + 2", "subtract_num": "v - 2", "multiply_num": "v * 2", "divide_num": "v / 2"}.items():
    add(f"cube_{_n}", lambda s, d, n=_n: cube.constant(_cube(s, d), n, 2.0), f"SELECT {_CK}, {_sql} AS v FROM {_cube_sql()}", cte=False)
add("cube_load", lambda s, d: cube.load(_cube(s, d), bands=["A"], start="1994-01-01", end="1996-01-01", extent=(0, 0, 8, 8)), f"SELECT {_CK}, v FROM {_cube_sql()} WHERE band = 'A' AND ts BETWEEN '1994-01-01' AND '1996-01-01' AND cx < 8 AND cy < 8", cte=False)
add("cube_ndvi", lambda s, d: rounded(cube.normalized_difference(_cube(s, d), "A", "F", "R", "F")), f"SELECT 'NDVI' AS band, cx, cy, round((a - b) / (a + b), 6) AS v FROM (SELECT cx, cy, avg(v) FILTER (band = 'A') AS a, avg(v) FILTER (band = 'R') AS b FROM {_cube_sql()} WHERE platform = 'F' AND band IN ('A', 'R') GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL", cte=False)
