"""Queries of the statistics, sampling, interpolation and regression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import focal, interpolation, regression, spatial, statistics
from .fixtures import add, pts, qp, rounded, table

_D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)"
add("sta_ann", lambda s, d: rounded(statistics.average_nearest_neighbor(pts(s, d)).drop("p"), "observed", "expected", "ann", "z"), f"""SELECT round(o, 6) AS observed, round(e, 6) AS expected, round(o / e, 6) AS ann, round((o - e) / se, 6) AS z FROM (SELECT avg(m) AS o FROM (SELECT p.id, min(sqrt({_D2})) AS m FROM pts p JOIN pts q ON p.id <> q.id GROUP BY 1)),
    (SELECT 0.5 / sqrt(count(*) / ((max(x) - min(x)) * (max(y) - min(y)))) AS e, 0.26136 / sqrt(count(*) * count(*) / ((max(x) - min(x)) * (max(y) - min(y)))) AS se FROM pts)""")
add("sta_descriptive", lambda s, d: rounded(statistics.descriptive(pts(s, d), ["x", "v"]), "sum", "stdev", "variance", places=3), "SELECT 'x' AS property, count(x) AS count, round(sum(x), 3) AS sum, round(stddev_pop(x), 3) AS stdev, round(var_pop(x), 3) AS variance, max(x) AS max, min(x) AS min FROM pts UNION ALL SELECT 'v', count(v), round(sum(v), 3), round(stddev_pop(v), 3), round(var_pop(v), 3), max(v), min(v) FROM pts")
add("sta_kernel_density", lambda s, d: rounded(statistics.kernel_density(pts(s, d), 36, 18, -180, -90, 180, 90, focal.square(1, False))), """, c AS (SELECT least(floor((x + 180) / 10), 35) AS cx, least(floor((90 - y) / 10), 17) AS cy FROM pts)
    SELECT (cx + a.range - 1)::INT AS cx, (cy + b.range - 1)::INT AS cy, count(*)::DOUBLE AS v FROM c, range(3) a, range(3) b WHERE cx + a.range - 1 BETWEEN 0 AND 35 AND cy + b.range - 1 BETWEEN 0 AND 17 GROUP BY 1, 2""")
add("sta_pca", lambda s, d: rounded(statistics.pca(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], 2, True).drop("loadings"), "variance", "share", places=4), """, c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT 1 AS component, round(1 + r, 4) AS variance, round((1 + r) / 2, 4) AS share FROM c UNION ALL SELECT 2, round(1 - r, 4), round((1 - r) / 2, 4) FROM c""")
add("sta_pearson", lambda s, d: rounded(statistics.correlation(pts(s, d), ["x", "y", "v"]), "r"), "SELECT a, b, round(r, 6) AS r FROM (SELECT 'x' AS a, 'x' AS b, 1.0 AS r UNION ALL SELECT 'x', 'y', corr(x, y) FROM pts UNION ALL SELECT 'x', 'v', corr(x, v) FROM pts UNION ALL SELECT 'y', 'y', 1.0 UNION ALL SELECT 'y', 'v', corr(y, v) FROM pts UNION ALL SELECT 'v', 'v', 1.0)")
add("sta_spearman", lambda s, d: rounded(statistics.correlation(table(s, d, "part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], "spearman"), "r"), "SELECT a, b, round(r, 6) AS r FROM (SELECT 'p_size' AS a, 'p_size' AS b, 1.0 AS r UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0 UNION ALL SELECT 'p_size', 'p_retailprice', corr(i, j) FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS i, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS j FROM part))", cte=False)
add("sta_ripley", lambda s, d: rounded(statistics.ripley_k(qp(s, d)), "r", "k"), f""", b AS (SELECT count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS h FROM qp), t AS (SELECT floor(sqrt({_D2}) / (greatest(w, h) * 0.25 / 10)) + 1 AS bin FROM qp p JOIN qp q ON p.id <> q.id, b)
    SELECT round(i.range * greatest(w, h) * 0.25 / 10, 6) AS r, round(sqrt(w * h * (SELECT count(*) FROM t WHERE bin <= i.range) / (pi() * n * (n - 1))), 6) AS k FROM range(1, 11) i, b""")


def _grid(s, d):
    t = table(s, d, "lineitem").groupBy((F.col("l_partkey") % 12).cast("int").alias("cx"), (F.col("l_orderkey") % 12).cast("int").alias("cy")).agg(F.sum("l_quantity").alias("v"))
    return t.withColumn("id", F.col("cx") * 12 + F.col("cy"))


_G = "g AS (SELECT (l_partkey % 12)::INT AS cx, (l_orderkey % 12)::INT AS cy, sum(l_quantity) AS v, ((l_partkey % 12) * 12 + l_orderkey % 12)::INT AS id FROM lineitem GROUP BY 1, 2, 4), nb AS (SELECT a.id AS i, b.id AS j, 1.0 / count(*) OVER (PARTITION BY a.id) AS w FROM g a JOIN g b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.id <> b.id), m AS (SELECT avg(v) AS m, var_pop(v) AS s2, count(*) AS n FROM g)"


def _w(s, d):
    return statistics.grid_weights(_grid(s, d))


for _style, _sql in {"W": "w", "B": "1.0", "C": "1.0 * (SELECT count(DISTINCT i) FROM nb) / (SELECT count(*) FROM nb)", "U": "1.0 / (SELECT count(*) FROM nb)"}.items():
    add(f"sta_weights_{_style}", lambda s, d, st=_style: rounded(statistics.grid_weights(_grid(s, d), st), "w", places=9), f", {_G} SELECT i, j, round({_sql}, 9) AS w FROM nb")
add("sta_moran", lambda s, d: rounded(statistics.moran(_grid(s, d), "v", _w(s, d)).select("i", "expectation"), "i", "expectation"), f", {_G} SELECT round((SELECT n FROM m) / (SELECT sum(w) FROM nb) * sum(w * (a.v - m) * (b.v - m)) / (SELECT sum((v - m) * (v - m)) FROM g, m), 6) AS i, round(-1.0 / ((SELECT n FROM m) - 1), 6) AS expectation FROM nb JOIN g a ON a.id = i JOIN g b ON b.id = j, m")
add("sta_local_moran", lambda s, d: rounded(statistics.local_moran(_grid(s, d), "v", _w(s, d)).select("id", "local_i"), "local_i"), f", {_G} SELECT i AS id, round(sum(w * (b.v - m)) * any_value(a.v - m) / any_value(s2), 6) AS local_i FROM nb JOIN g a ON a.id = i JOIN g b ON b.id = j, m GROUP BY 1")
add("sta_geary", lambda s, d: rounded(statistics.geary(_grid(s, d), "v", _w(s, d)), "c"), f", {_G} SELECT round(((SELECT n FROM m) - 1) * sum(w * (a.v - b.v) * (a.v - b.v)) / (2 * sum(w) * (SELECT n * s2 FROM m)), 6) AS c FROM nb JOIN g a ON a.id = i JOIN g b ON b.id = j")
add("sta_local_geary", lambda s, d: rounded(statistics.local_geary(_grid(s, d), "v", _w(s, d)), "local_c"), f", {_G} SELECT i AS id, round(sum(w * (a.v - b.v) * (a.v - b.v)) / any_value(s2), 6) AS local_c FROM nb JOIN g a ON a.id = i JOIN g b ON b.id = j, m GROUP BY 1")
add("sta_getis", lambda s, d: rounded(statistics.getis_ord(_grid(s, d), "v", _w(s, d)), "g"), f", {_G}, o AS (SELECT id, v, (m * n - v) / (n - 1) AS om, ((s2 + m * m) * n - v * v) / (n - 1) AS q, n FROM g, m) SELECT i AS id, round((sum(w * b.v) - any_value(om) * sum(w)) / sqrt((any_value(q) - any_value(om) * any_value(om)) * ((any_value(n) - 1) * sum(w * w) - sum(w) * sum(w)) / (any_value(n) - 2)), 6) AS g FROM nb JOIN o ON o.id = i JOIN g b ON b.id = j GROUP BY 1")
add("sta_getis_star", lambda s, d: rounded(statistics.getis_ord(_grid(s, d), "v", statistics.grid_weights(_grid(s, d), "B"), True), "g"), f", {_G}, ns AS (SELECT i, j, 1.0 AS w FROM nb UNION ALL SELECT id, id, 1.0 FROM g) SELECT i AS id, round((sum(w * b.v) - any_value(m) * sum(w)) / sqrt(any_value(s2) * (any_value(n) * sum(w * w) - sum(w) * sum(w)) / (any_value(n) - 1)), 6) AS g FROM ns JOIN g b ON b.id = j, m GROUP BY 1")


def _hours(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))


add("sta_acf", lambda s, d: rounded(statistics.acf(_hours(s, d), "v", "h", 10), "acf"), """WITH h AS (SELECT row_number() OVER (ORDER BY date_trunc('hour', ts)) AS t, avg(value) AS v FROM events GROUP BY date_trunc('hour', ts)), z AS (SELECT t, v - (SELECT avg(v) FROM h) AS z FROM h)
    SELECT k.range::INT AS lag, round(sum(a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS acf FROM range(11) k, z a JOIN z b ON b.t = a.t - k.range GROUP BY 1""".replace("FROM range(11) k, z a JOIN z b ON b.t = a.t - k.range", "FROM range(11) k JOIN z a ON true JOIN z b ON b.t = a.t - k.range"), cte=False)

# --- sampling ---

_H = "md5('0:' || id)"
add("smp_random", lambda s, d: statistics.random_sampling(pts(s, d), 20).select("id"), f"SELECT id FROM pts ORDER BY {_H}, id LIMIT 20")
add("smp_random_replace", lambda s, d: statistics.random_sampling(pts(s, d), 20, replace=True).select("id"))
add("smp_regular", lambda s, d: statistics.regular_sampling(pts(s, d), 5, 5).select("id"), f", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY least(floor((x - x0) * 5 / (x1 - x0)), 4), least(floor((y - y0) * 5 / (y1 - y0)), 4) ORDER BY {_H}, id) AS i FROM pts, b) WHERE i = 1")
add("smp_stratified", lambda s, d: statistics.stratified_sampling(pts(s, d), "k", 5).select("id", "k"), f"SELECT id, k FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY {_H}, id) AS i FROM pts) WHERE i <= 5")
add("smp_every_gap", lambda s, d: statistics.continuous_sampling(pts(s, d), 7).select("id"), "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS i FROM pts) WHERE (i - 1) % 7 = 0")
_K = "(SELECT *, id % 4 AS u FROM pts)"
add("smp_sandwich", lambda s, d: rounded(statistics.sandwich(pts(s, d).withColumn("u", F.col("id") % 4), "v", "k", "u"), "mean", "variance", places=4), f", z AS (SELECT k, avg(v) AS m, var_samp(v) / count(v) AS s FROM pts GROUP BY k), p AS (SELECT u, k, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY u) AS w FROM {_K} GROUP BY 1, 2) SELECT u, round(sum(w * m), 4) AS mean, round(sum(w * w * s), 4) AS variance FROM p JOIN z USING (k) GROUP BY u")
add("smp_sandwich_size", lambda s, d: statistics.sandwich_size(pts(s, d), "v"), "SELECT ceil(pow(2.5758 * stddev_samp(v) / (avg(v) * 0.05), 2))::BIGINT AS n FROM pts")

# --- detectors ---


def _strata(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))


_O = "WITH o AS (SELECT o_totalprice AS y, o_orderpriority AS a, o_orderstatus AS b FROM orders), t AS (SELECT count(*) * var_pop(y) AS sst FROM o), q AS (SELECT 1 - (SELECT sum(n * s) FROM (SELECT count(*) AS n, var_pop(y) AS s FROM o GROUP BY a)) / sst AS qa, 1 - (SELECT sum(n * s) FROM (SELECT count(*) AS n, var_pop(y) AS s FROM o GROUP BY b)) / sst AS qb, 1 - (SELECT sum(n * s) FROM (SELECT count(*) AS n, var_pop(y) AS s FROM o GROUP BY a, b)) / sst AS q FROM t) "
add("sta_factor_detector", lambda s, d: rounded(statistics.factor_detector(_strata(s, d), "y", ["a", "b"]), "q", places=7), _O + "SELECT 'a' AS x, round(qa, 7) AS q FROM q UNION ALL SELECT 'b', round(qb, 7) FROM q", cte=False)
add("sta_interaction_detector", lambda s, d: rounded(statistics.interaction_detector(_strata(s, d), "y", ["a", "b"]).drop("kind"), "q1", "q2", "q", places=7), _O + "SELECT 'a' AS x1, 'b' AS x2, round(qa, 7) AS q1, round(qb, 7) AS q2, round(q, 7) AS q FROM q", cte=False)
add("sta_ecological_detector", lambda s, d: rounded(statistics.ecological_detector(_strata(s, d), "y", ["a", "b"]), "ratio", places=3), _O + "SELECT 'a' AS x1, 'b' AS x2, round(greatest(qa, qb) / least(qa, qb), 3) AS ratio FROM q", cte=False)
add("sta_risk_detector", lambda s, d: rounded(statistics.risk_detector(_strata(s, d), "y", "b"), "mean1", "mean2", "t", "df", places=4), "WITH s AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 1) SELECT a.s AS stratum1, b.s AS stratum2, round(a.m, 4) AS mean1, round(b.m, 4) AS mean2, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM s a JOIN s b ON a.s < b.s", cte=False)

# --- interpolation of the supplier points' plane ---


def _plane(s, d):
    return qp(s, d).withColumn("v", 2 + 3 * F.col("x") - F.col("y"))


_GRID = "gr AS (SELECT a.range::INT AS cx, b.range::INT AS cy, (SELECT min(x) FROM qp) + (a.range + 0.5) * ((SELECT max(x) - min(x) FROM qp)) / 6 AS x, (SELECT max(y) FROM qp) - (b.range + 0.5) * ((SELECT max(y) - min(y) FROM qp)) / 5 AS y FROM range(6) a, range(5) b)"
_GD = "sqrt((g.x - q.x) * (g.x - q.x) + (g.y - q.y) * (g.y - q.y))"
add("int_nearest", lambda s, d: rounded(interpolation.nearest(_plane(s, d), "v", 6, 5)), f", {_GRID} SELECT cx, cy, round(2 + 3 * px - py, 6) AS v FROM (SELECT cx, cy, q.x AS px, q.y AS py, row_number() OVER (PARTITION BY cx, cy ORDER BY {_GD}, q.id) AS i FROM gr g, qp q) WHERE i = 1")
add("int_idw", lambda s, d: rounded(interpolation.idw(_plane(s, d), "v", 6, 5)), f", {_GRID} SELECT cx, cy, round(sum((2 + 3 * q.x - q.y) / ({_GD} * {_GD})) / sum(1 / ({_GD} * {_GD})), 6) AS v FROM gr g, qp q GROUP BY 1, 2")
add("int_thin_plate", lambda s, d: rounded(interpolation.thin_plate_spline(_plane(s, d), "v", 6, 5), places=4), f", {_GRID} SELECT cx, cy, round(2 + 3 * x - y, 4) AS v FROM gr")
add("int_linear", lambda s, d: rounded(interpolation.linear(_plane(s, d), "v", 6, 5), places=4))
add("int_b_spline", lambda s, d: rounded(interpolation.b_spline(_plane(s, d), "v", 6, 5), places=4))
add("int_kriging", lambda s, d: rounded(interpolation.kriging(_plane(s, d), "v", 6, 5), "v", "variance", places=3))
add("int_simple_kriging", lambda s, d: rounded(interpolation.kriging(_plane(s, d), "v", 6, 5, sill=100.0, reach=90.0, mean=0.0), "v", "variance", places=3))

# --- regression ---


def _lines(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity", "l_discount", "l_extendedprice")


def _ols(s, d):
    _, info = regression.ols(_lines(s, d), "l_extendedprice", ["l_quantity"])
    return s.createDataFrame([(info["coefficients"]["intercept"], info["coefficients"]["l_quantity"], info["r2"])], "intercept double, slope double, r2 double")


add("reg_ols", lambda s, d: rounded(_ols(s, d), "intercept", "slope", "r2", places=4), "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem", cte=False)


def _glm(s, d, family):
    t = table(s, d, "part").select((F.col("p_size") / 50.0).alias("x"), (F.col("p_partkey") % 2 if family == "logistic" else F.col("p_partkey") % 7).cast("double").alias("y"))
    _, info = regression.glm(t, "y", ["x"], family)
    return s.createDataFrame([(info["coefficients"]["intercept"], info["coefficients"]["x"], info["deviance"])], "intercept double, slope double, deviance double")


add("reg_logistic", lambda s, d: rounded(_glm(s, d, "logistic"), "intercept", "slope", "deviance", places=4))
add("reg_poisson", lambda s, d: rounded(_glm(s, d, "poisson"), "intercept", "slope", "deviance", places=4))


def _field(s, d):
    t = _grid(s, d)
    return t.select("id", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), "v", ((F.col("cx") * 5 + F.col("cy") * 3) % 7).cast("double").alias("a"), ((F.col("cx") + F.col("cy") * 2) % 5).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("t"))


for _kind in ("lag", "error", "sac", "durbin"):
    add(f"reg_spatial_{_kind}", lambda s, d, k=_kind: rounded(regression.spatial_regression(_field(s, d), "v", ["a", "b"], _w(s, d), k).drop("beta"), "yhat", "residual", "rho", "lambda", "loglik", places=3))
add("reg_gwr", lambda s, d: rounded(regression.gwr(_field(s, d), "v", ["a"], 4.0, "bisquare").select("id", "yhat"), "yhat", places=4), f""", {_G}, f AS (SELECT id, cx::DOUBLE AS x, cy::DOUBLE AS y, v, ((cx * 5 + cy * 3) % 7)::DOUBLE AS a FROM g),
    k AS (SELECT p.id, p.a AS pa, q.a, q.v, pow(1 - ({_D2}) / 16, 2) AS w FROM f p JOIN f q ON {_D2} < 16), m2 AS (SELECT id, any_value(pa) AS pa, sum(w) AS s, sum(w * a) AS sa, sum(w * v) AS sv, sum(w * a * a) AS saa, sum(w * a * v) AS sav FROM k GROUP BY id)
    SELECT id, round((sv - (s * sav - sa * sv) / (s * saa - sa * sa) * sa) / s + (s * sav - sa * sv) / (s * saa - sa * sa) * pa, 4) AS yhat FROM m2""")
add("reg_gwr_adaptive", lambda s, d: rounded(regression.gwr(_field(s, d), "v", ["a", "b"], 40, "gaussian", True).select("id", "yhat", "residual"), "yhat", "residual", places=3))
add("reg_gwr_predict", lambda s, d: rounded(regression.gwr(_field(s, d), "v", ["a"], 4.0, "gaussian", places=_field(s, d)).select("id", "yhat"), "yhat", places=3))
add("reg_gtwr", lambda s, d: rounded(regression.gwr(_field(s, d), "v", ["a"], 5.0, "gaussian", lam=0.6).select("id", "yhat"), "yhat", places=3))
add("reg_gwr_poisson", lambda s, d: rounded(regression.gwr_generalized(_field(s, d).withColumn("c", F.col("id") % 5), "c", ["a"], 6.0, "poisson").select("id", "yhat"), "yhat", places=3))
add("reg_mgwr", lambda s, d: rounded(regression.mgwr(_field(s, d), "v", ["a"], [60, 40], rounds=5).select("id", "yhat"), "yhat", places=2))
add("reg_gw_average", lambda s, d: rounded(regression.gw_average(_field(s, d), ["v"], 4.0, "bisquare").select("id", "v_mean", "v_sd"), "v_mean", "v_sd", places=4), f", {_G}, k AS (SELECT p.id, q.v, pow(1 - (pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2)) / 16, 2) AS w FROM g p JOIN g q ON pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2) < 16) SELECT id, round(sum(w * v) / sum(w), 4) AS v_mean, round(sqrt(greatest(0, sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2))), 4) AS v_sd FROM k GROUP BY 1")
add("reg_gw_correlation", lambda s, d: rounded(regression.gw_correlation(_field(s, d), "a", "v", 4.0), "cov", "corr", places=4))
add("reg_gw_pca", lambda s, d: rounded(regression.gw_pca(_field(s, d), ["a", "b", "v"], 5.0).select("id", F.element_at("share", 1).alias("share")), "share", places=5))
add("reg_gw_discriminant", lambda s, d: regression.gw_discriminant(_field(s, d).withColumn("c", F.when(F.col("a") + F.col("b") > 5, "high").otherwise("low")), "c", ["a", "b"], 5.0))
add("int_voronoi_area", lambda s, d: rounded(spatial.voronoi_cells(qp(s, d), "POLYGON ((-180 -90, 180 -90, 180 90, -180 90, -180 -90))").agg(F.sum(G.measure("area")("geom")).alias("v"))), "SELECT 64800.0 AS v")
