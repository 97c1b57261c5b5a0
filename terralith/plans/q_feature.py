"""Queries of the feature, geometry and spatial join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import features, spatial
from . import dag
from .fixtures import add, boxes, pts, qp, rounded, table

# --- attributes ---

_C = "c_custkey, c_acctbal, c_mktsegment"


def _cust(s, d):
    return table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")


for _n, _op, _sql in (("eq", "equals", "="), ("ne", "not_equals", "<>"), ("lt", "less_than", "<"), ("gt", "greater_than", ">"), ("nlt", "not_less_than", ">="), ("ngt", "not_greater_than", "<=")):
    add(f"fc_filter_metadata_{_n}", lambda s, d, op=_op: features.filter_metadata(_cust(s, d), "c_custkey", op, "75"), f"SELECT {_C} FROM customer WHERE c_custkey {_sql} 75", cte=False)
for _n, _sql in (("starts_with", "p_name LIKE 'p%'"), ("ends_with", "p_name LIKE '%1'"), ("contains", "p_name LIKE '%a%'"), ("not_starts_with", "p_name NOT LIKE 'p%'"), ("not_ends_with", "p_name NOT LIKE '%1'"), ("not_contains", "p_name NOT LIKE '%a%'")):
    _v = _sql.split("'")[1].strip("%")
    add(f"fc_filter_metadata_{_n}", lambda s, d, op=_n, v=_v: features.filter_metadata(table(s, d, "part").select("p_partkey", "p_name"), "p_name", op, v), f"SELECT p_partkey, p_name FROM part WHERE {_sql}", cte=False)
add("fc_filter_date", lambda s, d: features.filter_date(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "1995-01-01", "1995-06-30", "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > '1995-01-01' AND o_orderdate < '1995-06-30'", cte=False)
add("fc_select_rename", lambda s, d: features.select(_cust(s, d), ["c_custkey", "c_acctbal"], ["id", "balance"]), "SELECT c_custkey AS id, c_acctbal AS balance FROM customer", cte=False)
add("fc_constant_column", lambda s, d: features.constant_column(_cust(s, d), 7, "seven"), f"SELECT {_C}, 7 AS seven FROM customer", cte=False)
add("fc_combine", lambda s, d: rounded(features.combine(_cust(s, d), "c_custkey", "c_acctbal", "total"), "total"), f"SELECT {_C}, round(c_custkey + c_acctbal, 6) AS total FROM customer", cte=False)
add("fc_subtract", lambda s, d: rounded(features.subtract(_cust(s, d), "c_custkey", "c_acctbal", "gap"), "gap"), f"SELECT {_C}, round(c_custkey - c_acctbal, 6) AS gap FROM customer", cte=False)
add("fc_assemble_array", lambda s, d: features.assemble_array(_cust(s, d), ["c_custkey", "c_acctbal"]).select("c_custkey", F.size("array").alias("n"), F.round(F.aggregate("array", F.lit(0.0), lambda a, x: a + x), 6).alias("total")), "SELECT c_custkey, 2 AS n, round(c_custkey + c_acctbal, 6) AS total FROM customer", cte=False)
add("fc_random_keyed", lambda s, d: rounded(features.random_column(_cust(s, d), keys=["c_custkey"], seed=5), "random", places=9), f"SELECT {_C}, round(('0x' || substr(md5('5_' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0, 9) AS random FROM customer", cte=False)
_AGG = {"min": "min(c_acctbal)", "max": "max(c_acctbal)", "mean": "avg(c_acctbal)", "sum": "sum(c_acctbal)", "sample_sd": "stddev_samp(c_acctbal)", "sample_var": "var_samp(c_acctbal)", "total_sd": "stddev_pop(c_acctbal)", "total_var": "var_pop(c_acctbal)", "count": "count(c_acctbal)", "count_distinct": "count(DISTINCT c_acctbal)"}
for _n, _sql in _AGG.items():
    add(f"fc_aggregate_{_n}", lambda s, d, n=_n: rounded(features.aggregate(_cust(s, d), "c_acctbal", n), "value", places=4), f"SELECT round({_sql}, 4) AS value FROM customer", cte=False)
add("fc_aggregate_product", lambda s, d: rounded(features.aggregate(table(s, d, "nation").withColumn("f", 1 + F.col("n_nationkey") % 3), "f", "product"), "value"), "SELECT round(product(1 + n_nationkey % 3), 6) AS value FROM nation", cte=False)
add("fc_aggregate_first", lambda s, d: features.aggregate_first(_cust(s, d), "c_mktsegment", "c_custkey"), "SELECT arg_min(c_mktsegment, c_custkey) AS value FROM customer", cte=False)
add("fc_aggregate_array", lambda s, d: features.aggregate_array(table(s, d, "nation"), "n_name", "n_nationkey").select(F.array_join("value", ",").alias("value")), "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS value FROM nation", cte=False)
add("fc_stats", lambda s, d: rounded(features.stats(_cust(s, d), "c_acctbal"), "sum", "min", "max", "mean", "sample_sd", "sample_var", "total_sd", "total_var", places=4), "SELECT round(sum(v), 4) AS sum, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sample_sd, round(var_samp(v), 4) AS sample_var, round(stddev_pop(v), 4) AS total_sd, round(var_pop(v), 4) AS total_var FROM pts")
add("fc_describe", lambda s, d: rounded(features.describe(_cust(s, d), ["c_custkey", "c_acctbal"]), "mean", "stddev", places=4), "SELECT 'c_custkey' AS property, count(*) AS count, round(avg(c_custkey), 4) AS mean, round(stddev_samp(c_custkey), 4) AS stddev, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max FROM customer UNION ALL SELECT 'c_acctbal', count(*), round(avg(c_acctbal), 4), round(stddev_samp(c_acctbal), 4), min(c_acctbal), max(c_acctbal) FROM customer", cte=False)
add("fc_distinct", lambda s, d: features.distinct(table(s, d, "part").select("p_brand", "p_size")), "SELECT DISTINCT p_brand, p_size FROM part", cte=False)
add("fc_drop_duplicates", lambda s, d: features.distinct(table(s, d, "part").select("p_partkey", "p_brand"), ["p_brand"], "p_partkey"), "SELECT min(p_partkey) AS p_partkey, p_brand FROM part GROUP BY p_brand", cte=False)
add("fc_remap", lambda s, d: features.remap(_cust(s, d), ["BUILDING", "MACHINERY"], ["b", "m"], "c_mktsegment"), "SELECT c_custkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' ELSE 'm' END AS c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", cte=False)
add("fc_size", lambda s, d: features.size(_cust(s, d)), "SELECT count(*) AS size FROM customer", cte=False)
add("fc_limit_topk", lambda s, d: features.limit(_cust(s, d), 10, "c_acctbal", False, "c_custkey"), f"SELECT {_C} FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", cte=False)
add("fc_extract_rows", lambda s, d: features.extract_rows(_cust(s, d), 5, 10, "c_custkey"), f"SELECT {_C} FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10", cte=False)
add("fc_sort", lambda s, d: features.sort(_cust(s, d), "c_custkey"), f"SELECT {_C} FROM customer ORDER BY c_custkey", cte=False)
add("fc_merge_all", lambda s, d: features.merge_all([table(s, d, "nation").selectExpr("n_nationkey id", "n_name"), table(s, d, "region").selectExpr("r_regionkey id", "r_name")]), "SELECT '1_' || n_nationkey AS id, n_name, NULL AS r_name FROM nation UNION ALL SELECT '2_' || r_regionkey, NULL, r_name FROM region", cte=False)
add("fc_property_names", lambda s, d: features.property_names(s, table(s, d, "region")), "SELECT unnest(['r_regionkey', 'r_name']) AS name", cte=False)
add("fc_map", lambda s, d: features.map_(_cust(s, d), lambda t: t.withColumn("half", F.col("c_acctbal") / 2), True), f"SELECT {_C}, c_acctbal / 2 AS half FROM customer", cte=False)
add("fc_sample", lambda s, d: features.sample(_cust(s, d), 0.5, 3))
add("fc_random_split", lambda s, d: features.random_split(_cust(s, d), [0.3, 0.7], 3)[0])
add("fc_bounds", lambda s, d: features.aggregate_bounds(boxes(s, d)), "SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM boxes")
add("fc_geohash", lambda s, d: pts(s, d).select("id", features.geohash(F.col("x"), F.col("y"), 6).alias("hash")))
add("fc_reproject", lambda s, d: rounded(pts(s, d).where("abs(y) < 85").select("id", *[c.alias(n) for c, n in zip(features.web_mercator(F.col("x"), F.col("y")), ("mx", "my"))]), "mx", "my", places=3), "SELECT id, round(radians(x) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137, 3) AS my FROM pts WHERE abs(y) < 85")
add("fc_reproject_back", lambda s, d: rounded(pts(s, d).select("id", *[c.alias(n) for c, n in zip(features.from_web_mercator(F.col("x") * 10000, F.col("y") * 10000), ("lon", "lat"))]), "lon", "lat"), "SELECT id, round(degrees(x * 10000 / 6378137), 6) AS lon, round(degrees(2 * atan(exp(y * 10000 / 6378137)) - pi() / 2), 6) AS lat FROM pts")


def _maps(s, d):
    n = table(s, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("props"))


add("feature_get", lambda s, d: features.get(_maps(s, d), "name"), "SELECT n_nationkey AS id, n_name AS value FROM nation", cte=False)
add("feature_get_number", lambda s, d: features.get_number(_maps(s, d), "region"), "SELECT n_nationkey AS id, n_regionkey::DOUBLE AS value FROM nation", cte=False)
add("feature_get_string", lambda s, d: features.get_string(_maps(s, d), "none"), "SELECT n_nationkey AS id, '' AS value FROM nation", cte=False)
add("feature_names", lambda s, d: features.keys(features.set_(_maps(s, d), {"a": "1"})).select("id", F.array_join("names", ",").alias("names")), "SELECT n_nationkey AS id, 'a,name,region' AS names FROM nation", cte=False)
add("feature_set", lambda s, d: features.get(features.set_(_maps(s, d), {"name": "x"}), "name"), "SELECT n_nationkey AS id, 'x' AS value FROM nation", cte=False)
add("feature_select", lambda s, d: features.keys(features.select_regex(_maps(s, d), "na.*")).select("id", F.array_join("names", ",").alias("names")), "SELECT n_nationkey AS id, 'name' AS names FROM nation", cte=False)
add("feature_copy", lambda s, d: features.get(features.copy_properties(features.set_(_maps(s, d), {"name": "old"}), _maps(s, d), ["name"]), "name"), "SELECT n_nationkey AS id, n_name AS value FROM nation", cte=False)
add("feature_to_array", lambda s, d: features.to_array(_maps(s, d), ["name", "none"]).select("id", F.array_join("value", ",", "-").alias("value")), "SELECT n_nationkey AS id, n_name || ',-' AS value FROM nation", cte=False)
add("feature_to_dictionary", lambda s, d: features.to_dictionary(_maps(s, d), ["region"]).select("id", F.element_at("value", "region").alias("value")), "SELECT n_nationkey AS id, n_regionkey::VARCHAR AS value FROM nation", cte=False)

# --- points and boxes ---

_IN = "pts p JOIN boxes b ON p.x >= b.xmin AND p.x < b.xmax AND p.y >= b.ymin AND p.y < b.ymax"


def _pairs(s, d):
    return spatial.points_in_boxes(pts(s, d), boxes(s, d), 36.0)


add("geo_join_flat", lambda s, d: _pairs(s, d).select(F.col("p.id").alias("point"), F.col("b.id").alias("box")), f"SELECT p.id AS point, b.id AS box FROM {_IN}")
add("geo_join_grouped", lambda s, d: _pairs(s, d).groupBy(F.col("b.id").alias("box")).agg(F.array_join(F.sort_array(F.collect_list("p.id")), ",").alias("points")), f"SELECT b.id AS box, string_agg(p.id, ',' ORDER BY p.id) AS points FROM {_IN} GROUP BY 1")
add("geo_join_reduce", lambda s, d: rounded(spatial.reduce(_pairs(s, d), F.col("b.id"), [("v", r) for r in ("first", "last", "sum", "mean", "median", "min", "max", "std", "count")] + [("k", "mode"), ("k", "concat")], F.col("p.id"), "p"), "v_sum", "v_mean", "v_median", "v_std", places=4), f"""SELECT b.id, arg_min(v, p.id) AS v_first, arg_max(v, p.id) AS v_last, round(sum(v), 4) AS v_sum, round(avg(v), 4) AS v_mean, round(median(v), 4) AS v_median, min(v) AS v_min, max(v) AS v_max, round(stddev_samp(v), 4) AS v_std, count(v) AS v_count,
    (SELECT k FROM pts p2 WHERE p2.x >= b.xmin AND p2.x < b.xmax AND p2.y >= b.ymin AND p2.y < b.ymax GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS k_mode, string_agg(k, ',' ORDER BY p.id) AS k_concat FROM {_IN} GROUP BY b.id, b.xmin, b.xmax, b.ymin, b.ymax""")
add("geo_range_query", lambda s, d: spatial.query(pts(s, d).withColumn("geom", G.point_wkt(F.col("x"), F.col("y"))), "POLYGON ((-60 -30, 60 -30, 60 45, -60 45, -60 -30))", "Within").select("id"), "SELECT id FROM pts WHERE x > -60 AND x < 60 AND y > -30 AND y < 45")
add("geo_range_count", lambda s, d: spatial.query(pts(s, d).withColumn("geom", G.point_wkt(F.col("x"), F.col("y"))), "POLYGON ((-60 -30, 60 -30, 60 45, -60 45, -60 -30))", "Intersects", count=True), "SELECT count(*) AS count FROM pts WHERE x >= -60 AND x <= 60 AND y >= -30 AND y <= 45")
add("geo_filter_semi", lambda s, d: pts(s, d).join(_pairs(s, d).where("b.id < 5").select("p.id"), "id", "left_semi").select("id"), f"SELECT p.id FROM {_IN} WHERE b.id < 5")
add("geo_erase_anti", lambda s, d: pts(s, d).join(_pairs(s, d).where("b.id < 5").select("p.id"), "id", "left_anti").select("id"), f"SELECT id FROM pts WHERE id NOT IN (SELECT p.id FROM {_IN} WHERE b.id < 5)")
_D = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
add("geo_distance_join", lambda s, d: spatial.distance_join(pts(s, d).select("id", "x", "y"), qp(s, d), 10.0, places=6).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "dist"), f"SELECT p.id AS a, q.id AS b, round({_D}, 6) AS dist FROM pts p JOIN qp q ON {_D} < 10")
add("geo_distance_join_grouped", lambda s, d: spatial.distance_join_grouped(pts(s, d).select("id", "x", "y"), qp(s, d), 10.0, "less_equal", text=","), f"SELECT p.id, string_agg(q.id, ',' ORDER BY q.id) AS matched FROM pts p JOIN qp q ON {_D} <= 10 GROUP BY 1")
add("geo_knn", lambda s, d: rounded(spatial.knn(qp(s, d), pts(s, d), 3), "dist"), f"SELECT qid, id, round(dist, 6) AS dist, rank FROM (SELECT q.id AS qid, p.id, {_D} AS dist, (row_number() OVER (PARTITION BY q.id ORDER BY {_D}, p.id))::INT AS rank FROM qp q, pts p) WHERE rank <= 3")
add("geo_nearest_to", lambda s, d: rounded(spatial.nearest_to(pts(s, d), 10.0, 20.0, 5).select("id", "dist"), "dist"), "SELECT id, round(sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)), 6) AS dist FROM pts ORDER BY sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)), id LIMIT 5")


def _few(s, d):
    return qp(s, d).withColumn("v", F.col("id"))


_EDGE = "e AS (SELECT p.id AS a, q.id AS b FROM qp p JOIN qp q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 400)"
add("geo_dbscan", lambda s, d: spatial.dbscan(qp(s, d), 20.0, 3), f""", {_EDGE}, c AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 3), ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
    walk AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT id AS a, id AS b FROM c UNION SELECT w.a, ce.b FROM w JOIN ce ON w.b = ce.a) SELECT a AS id, min(b) AS cluster FROM w GROUP BY a)),
    bd AS (SELECT a AS id, arg_min(cluster, b) AS cluster FROM e JOIN walk ON e.b = walk.id GROUP BY a) SELECT qp.id, coalesce(walk.cluster, bd.cluster) AS cluster FROM qp LEFT JOIN walk USING (id) LEFT JOIN bd ON bd.id = qp.id""")
add("geo_rasterize", lambda s, d: spatial.rasterize(pts(s, d), "v", 36, 18, -180, -90, 180, 90), "SELECT 'v' AS band, floor((x + 180) / 10)::INT AS cx, floor((90 - y) / 10)::INT AS cy, arg_max(v, id) AS v FROM pts WHERE floor((90 - y) / 10) BETWEEN 0 AND 17 GROUP BY 2, 3")

# --- polygons: boxes as WKT, and half-boxes moved by a quarter ---


def _poly(s, d, shift=0.0):
    b = boxes(s, d)
    p = lambda x, y: F.concat((F.col(x) + shift).cast("string"), F.lit(" "), (F.col(y) + shift).cast("string"))
    ring = F.concat_ws(", ", p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    return b.select("id", "name", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geom"))


_S = "(SELECT id, xmin + 10 AS xmin, ymin + 10 AS ymin, xmax + 10 AS xmax, ymax + 10 AS ymax FROM boxes)"
_MEET = "a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"
_OVER = "a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"
for _n, _sql in {"Intersects": _MEET, "Overlaps": f"{_OVER}", "Touches": f"{_MEET} AND NOT ({_OVER})", "Disjoint": f"NOT ({_MEET})"}.items():
    add(f"geo_predicate_{_n.lower()}", lambda s, d, n=_n: spatial.join(_poly(s, d), _poly(s, d, 10.0), n, 36.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), f"SELECT a.id AS a, b.id AS b FROM boxes a JOIN {_S} b ON {_sql}")
for _n in ("Contains", "Within", "Covers", "CoveredBy", "Equals", "OrderingEquals"):
    add(f"geo_predicate_{_n.lower()}", lambda s, d, n=_n: spatial.join(_poly(s, d), _poly(s, d), n, 36.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), "SELECT id AS a, id AS b FROM boxes")
add("geo_predicate_crosses", lambda s, d: spatial.join(s.createDataFrame([(1, "LINESTRING (-180 -80, 180 -80)")], "id long, geom string"), _poly(s, d), "Crosses", 36.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), "SELECT 1 AS a, id AS b FROM boxes WHERE ymin = -90")
add("geo_predicate_touching_self", lambda s, d: spatial.join(_poly(s, d), _poly(s, d), "Touches", 36.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), f"SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id <> b.id AND {_MEET}")
_IA = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
add("geo_intersection_area", lambda s, d: rounded(spatial.join(_poly(s, d), _poly(s, d, 10.0), "Overlaps", 36.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), G.measure("area")(G.overlaid("intersection")(F.col("a.geom"), F.col("b.geom"))).alias("v"))), f"SELECT a.id AS a, b.id AS b, round({_IA}, 6) AS v FROM boxes a JOIN {_S} b ON {_OVER}")
for _n, _sql in {"difference": f"2592 - {_IA}", "union": f"5184 - {_IA}", "symmetric_difference": f"5184 - 2 * {_IA}"}.items():
    add(f"geo_{_n}_area", lambda s, d, n=_n: rounded(spatial.join(_poly(s, d), _poly(s, d, 10.0), "Overlaps", 36.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), G.measure("area")(G.overlaid(n)(F.col("a.geom"), F.col("b.geom"))).alias("v"))), f"SELECT a.id AS a, b.id AS b, round({_sql}, 6) AS v FROM boxes a JOIN {_S} b ON {_OVER}")
add("geo_union_aggregate", lambda s, d: rounded(spatial.union_aggregate(_poly(s, d)).select(G.measure("area")("geom").alias("v"))), "SELECT 64800.0 AS v")
add("geo_intersection_aggregate", lambda s, d: rounded(spatial.intersection_aggregate(_poly(s, d).where("id = 6").unionByName(_poly(s, d, 10.0).where("id = 6"))).select(G.measure("area")("geom").alias("v"))), "SELECT 62.0 * 26 AS v")
add("geo_erase", lambda s, d: rounded(spatial.erase(_poly(s, d), _poly(s, d, 10.0).where("id = 6"), 36.0).select("id", G.measure("area")("geom").alias("v"))), f"SELECT a.id, round(2592 - CASE WHEN b.id IS NULL THEN 0 ELSE {_IA} END, 6) AS v FROM boxes a LEFT JOIN (SELECT * FROM {_S} WHERE id = 6) b ON {_OVER}")
add("geo_difference_rows", lambda s, d: rounded(spatial.difference(_poly(s, d), _poly(s, d, 10.0).where("id = 6"), 36.0).select("id", G.measure("area")("geom").alias("v"))), f"SELECT a.id, round(2592 - (CASE WHEN {_OVER} THEN {_IA} ELSE 0 END), 6) AS v FROM boxes a JOIN (SELECT * FROM {_S} WHERE id = 6) b ON {_MEET}")
add("geo_difference_with", lambda s, d: rounded(spatial.difference_with(_poly(s, d), "POLYGON ((-10 -10, 10 -10, 10 10, -10 10, -10 -10))").select("id", G.measure("area")("geom").alias("v"))), "SELECT id, round(2592 - greatest(0, least(xmax, 10) - greatest(xmin, -10)) * greatest(0, least(ymax, 10) - greatest(ymin, -10)), 6) AS v FROM boxes")
add("geo_buffer_overlay", lambda s, d: spatial.buffer_overlay(_poly(s, d), _poly(s, d).select(F.col("id").alias("other"), "geom"), 1.0, 36.0).select("id", G.measure("area")("geom").alias("v")))
add("geo_within_distance", lambda s, d: rounded(spatial.within_distance(_poly(s, d).where("id = 12"), _poly(s, d), 36.0, 36.0), "dist"), "SELECT a.id AS a, b.id AS b, round(sqrt(pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2)), 6) AS dist FROM boxes a JOIN boxes b ON a.id = 12 AND sqrt(pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2)) <= 36")
add("geo_nearest_within", lambda s, d: rounded(spatial.nearest_within(_poly(s, d).where("id < 5"), _poly(s, d).where("id > 9"), 40.0, 36.0), "min_dist"), "SELECT id AS a, 36.0 AS min_dist, 9 + greatest(1, id) AS nearest FROM boxes WHERE id < 5")
add("geo_neighbourhood", lambda s, d: rounded(spatial.neighbourhood(_poly(s, d), 36.0), "area", "length"), "SELECT id, 0.0 AS area, round(72.0 * ((ymin > -90)::INT + (ymax < 90)::INT) + 36.0 * ((xmin > -180)::INT + (xmax < 180)::INT), 6) AS length, (1 + (xmin > -180)::INT + (xmax < 180)::INT) * (1 + (ymin > -90)::INT + (ymax < 90)::INT) - 1 AS node_count FROM boxes")
_SHAPES = {"area": "2592.0", "perimeter": "216.0", "length": "216.0"}
for _n, _sql in _SHAPES.items():
    add(f"geo_measure_{_n}", lambda s, d, n=_n: _poly(s, d).select("id", G.measure(n)("geom").alias("v")), f"SELECT id, {_sql} AS v FROM boxes")
add("geo_measure_geodesic_area", lambda s, d: rounded(_poly(s, d).select("id", (G.measure("geodesic_area")("geom") / 1e6).alias("v")), places=3), "SELECT id, round(6371.0088 * 6371.0088 * radians(72) * abs(sin(radians(ymax)) - sin(radians(ymin))), 3) AS v FROM boxes")
add("geo_measure_geodesic_length", lambda s, d: rounded(_poly(s, d).select("id", (G.measure("geodesic_length")("geom") / 1e3).alias("v")), places=3))
add("geo_centroid", lambda s, d: _poly(s, d).select("id", G.shape("centroid")("geom").alias("geom")), "SELECT id, 'POINT (' || (xmin + 36)::INT || ' ' || (ymin + 18)::INT || ')' AS geom FROM boxes")
_RING = "(xmin)::INT || ' ' || (ymin)::INT || ', ' || (xmax)::INT || ' ' || (ymin)::INT || ', ' || (xmax)::INT || ' ' || (ymax)::INT || ', ' || (xmin)::INT || ' ' || (ymax)::INT || ', ' || (xmin)::INT || ' ' || (ymin)::INT"
for _n in ("envelope", "convex_hull", "dissolve"):
    add(f"geo_{_n}", lambda s, d, n=_n: _poly(s, d).select("id", G.shape(n)("geom").alias("geom")), f"SELECT id, 'POLYGON ((' || {_RING} || '))' AS geom FROM boxes")
add("geo_boundary", lambda s, d: _poly(s, d).select("id", G.shape("boundary")("geom").alias("geom")), f"SELECT id, 'LINESTRING (' || {_RING} || ')' AS geom FROM boxes")
add("geo_simplify", lambda s, d: _poly(s, d).select("id", G.shape("simplify", 0.5)(G.shape("densify", 10.0)("geom")).alias("geom")), f"SELECT id, 'POLYGON ((' || {_RING} || '))' AS geom FROM boxes")
add("geo_buffer_area", lambda s, d: rounded(_poly(s, d).where("id < 3").select("id", G.measure("area")(G.shape("buffer", 1.0, 16)("geom")).alias("v")), places=2), "SELECT id, round(2592 + 216 + 64 * sin(2 * pi() / 64) / 2, 2) AS v FROM boxes WHERE id < 3")
add("geo_type", lambda s, d: _poly(s, d).select("id", G.type_column()("geom").alias("kind")), "SELECT id, 'Polygon' AS kind FROM boxes")
add("geo_wkb_round_trip", lambda s, d: _poly(s, d).select("id", G.from_wkb_column()(G.to_wkb_column()("geom")).alias("geom")), f"SELECT id, 'POLYGON ((' || {_RING} || '))' AS geom FROM boxes")
add("geo_geojson_round_trip", lambda s, d: _poly(s, d).select("id", G.from_geojson_column()(G.to_geojson_column()("geom")).alias("geom")), f"SELECT id, 'POLYGON ((' || {_RING} || '))' AS geom FROM boxes")
add("geo_distance", lambda s, d: _poly(s, d).select("id", G.between()("geom", F.lit("POINT (-200 -100)")).alias("v")).withColumn("v", F.round("v", 6)), "SELECT id, round(sqrt(pow(xmin + 200, 2) + pow(ymin + 100, 2)), 6) AS v FROM boxes")
add("geo_land_suitability", lambda s, d: rounded(spatial.land_suitability(_poly(s, d), _poly(s, d, 10.0).where("id = 6"), _poly(s, d, 10.0).where("id = 12"), _poly(s, d, 10.0).where("id = 18").withColumn("grade", F.lit("5")), cell=36.0, small=0, least=1.0).groupBy("reason").agg(F.sum(G.measure("area")("geom")).alias("v"))), "SELECT unnest(['ecology', 'urban', 'slope']) AS reason, 2592.0 AS v")

# --- graphs ---


def _graph(s, d):
    call = lambda f, **a: {"functionInvocationValue": {"functionName": f, "arguments": a}}
    const, ref = (lambda v: {"constantValue": v}), (lambda v: {"valueReference": v})
    dag.register("Test.customers", lambda spark: _cust(spark, d))
    nodes = {"0": call("FeatureCollection.aggregate_mean", collection=ref("1"), property=const("c_acctbal")), "1": call("FeatureCollection.filterMetadata", collection=ref("2"), name=const("c_mktsegment"), operator=const("equals"), value=const("BUILDING")), "2": call("Test.customers")}
    return rounded(dag.run({"result": "0", "values": nodes}, {"spark": s}), "value", places=4)


add("dag_filter_mean", _graph, "SELECT round(avg(c_acctbal), 4) AS value FROM customer WHERE c_mktsegment = 'BUILDING'", cte=False)


def _raster_graph(s, d):
    from .fixtures import r1, r2

    call = lambda f, **a: {"functionInvocationValue": {"functionName": f, "arguments": a}}
    ref = lambda v: {"valueReference": v}
    dag.register("Test.r1", lambda spark: r1(spark, d))
    dag.register("Test.r2", lambda spark: r2(spark, d))
    nodes = {"0": call("Coverage.add", coverage1=ref("1"), coverage2=ref("2")), "1": call("Coverage.addNum", coverage=ref("3"), i={"constantValue": 1}), "2": call("Coverage.multiply", coverage1=ref("4"), coverage2=ref("5")), "3": call("Test.r1"), "4": call("Test.r2"), "5": call("Test.r1")}
    return dag.run({"result": "0", "values": nodes}, {"spark": s})


add("dag_raster", _raster_graph, "SELECT band, cx, cy, r.v + 1 + r2.v * r.v AS v FROM r JOIN r2 USING (band, cx, cy)")
