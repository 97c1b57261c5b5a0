"""Queries of the terrain operators on a 64 by 64 elevation grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terrain
from . import fixtures
from .fixtures import as_cells, rounded, tiled


def add(name, f, sql=None):
    fixtures.add(name, lambda s, d: as_cells(f(s, d)), sql)


def dem(s):
    return tiled(fixtures.dem(s))


def whole(df):
    return as_cells(df).withColumn("v", F.col("v").cast("int"))


_W = """, w AS (SELECT c.cx, c.cy, c.v AS z, n.v AS n, s.v AS s, e.v AS e, w.v AS w, ne.v AS ne, se.v AS se, sw.v AS sw, nw.v AS nw FROM dem c LEFT JOIN dem n ON n.cx = c.cx AND n.cy = c.cy - 1 LEFT JOIN dem s ON s.cx = c.cx AND s.cy = c.cy + 1 LEFT JOIN dem e ON e.cx = c.cx + 1 AND e.cy = c.cy LEFT JOIN dem w ON w.cx = c.cx - 1 AND w.cy = c.cy
    LEFT JOIN dem ne ON ne.cx = c.cx + 1 AND ne.cy = c.cy - 1 LEFT JOIN dem se ON se.cx = c.cx + 1 AND se.cy = c.cy + 1 LEFT JOIN dem sw ON sw.cx = c.cx - 1 AND sw.cy = c.cy + 1 LEFT JOIN dem nw ON nw.cx = c.cx - 1 AND nw.cy = c.cy - 1),
g AS (SELECT *, (coalesce(e, 2 * z - w, z) - coalesce(w, 2 * z - e, z)) / 2 AS g, (coalesce(n, 2 * z - s, z) - coalesce(s, 2 * z - n, z)) / 2 AS h, (coalesce(e, 2 * z - w, z) + coalesce(w, 2 * z - e, z)) / 2 - z AS d, (coalesce(n, 2 * z - s, z) + coalesce(s, 2 * z - n, z)) / 2 - z AS f FROM w),
a AS (SELECT *, atan(sqrt(g * g + h * h)) AS sl, CASE WHEN g <> 0 THEN degrees(pi() + atan2(h, g)) WHEN h > 0 THEN 270 WHEN h < 0 THEN 90 ELSE 0 END AS asp FROM g),
drops AS (SELECT cx, cy, k, (z - t) / (CASE WHEN k % 2 = 1 THEN sqrt(2) ELSE 1 END) AS r FROM (SELECT cx, cy, z, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([n, ne, e, se, s, sw, w, nw]) AS t FROM w) WHERE t < z),
dir AS (SELECT dem.cx, dem.cy, coalesce(b.k, -1)::INT AS v FROM dem LEFT JOIN (SELECT cx, cy, k FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY r DESC, k) AS i FROM drops) WHERE i = 1) b USING (cx, cy)),
edges AS (SELECT cx, cy, cx + [0, 1, 1, 1, 0, -1, -1, -1][v + 1] AS tx, cy + [-1, -1, 0, 1, 1, 1, 0, -1][v + 1] AS ty, CASE WHEN v % 2 = 1 THEN sqrt(2) ELSE 1 END AS step FROM dir WHERE v >= 0) """
_OUT = "SELECT 'B1' AS band, cx, cy, "
add("ter_slope", lambda s, d: rounded(terrain.slope(dem(s))), _W + _OUT + "round(degrees(sl), 6) AS v FROM a")
add("ter_aspect", lambda s, d: rounded(terrain.aspect(dem(s))), _W + _OUT + "round(asp, 6) AS v FROM a")
add("ter_curvature", lambda s, d: rounded(terrain.curvature(dem(s))), _W + _OUT + "round(CASE WHEN g = 0 AND h = 0 THEN 0 ELSE -2 * (d + f) END, 6) + 0 AS v FROM a")
add("ter_hillshade", lambda s, d: rounded(terrain.hillshade(dem(s))), _W + _OUT + "round(acos(greatest(least(sin(pi() / 2 - sl) * sin(radians(45)) + cos(pi() / 2 - sl) * cos(radians(45)) * cos(radians(asp) - radians(315)), 1), -1)), 6) AS v FROM a")
add("ter_ruggedness", lambda s, d: rounded(terrain.ruggedness(dem(s))), _W + _OUT + "round(sqrt(sum(pow((t - z) * q, 2)) / sum(q)), 6) AS v FROM (SELECT cx, cy, z, unnest([n, ne, e, se, s, sw, w, nw]) AS t, unnest([1, sqrt(0.5), 1, sqrt(0.5), 1, sqrt(0.5), 1, sqrt(0.5)]) AS q FROM w) WHERE t IS NOT NULL GROUP BY 1, 2, 3")
add("ter_filter", lambda s, d: terrain.keep(dem(s), [(0, 20), (60, 70)]), _OUT + "CASE WHEN v BETWEEN 0 AND 20 OR v BETWEEN 60 AND 70 THEN v END AS v FROM dem")
add("ter_flow_direction", lambda s, d: whole(terrain.flow_direction(dem(s))), _W + _OUT + "v FROM dir")
add("ter_flow_connectivity", lambda s, d: whole(terrain.flow_connectivity(dem(s))), _W + _OUT + "(SELECT count(*) FROM edges WHERE tx = dem.cx AND ty = dem.cy)::INT AS v FROM dem")
add("ter_flow_width", lambda s, d: rounded(terrain.flow_width(dem(s))), _W + _OUT + "round(CASE WHEN v >= 0 AND v % 2 = 1 THEN sqrt(0.5) ELSE 1 END, 6) AS v FROM dir")
_WALK = "walk AS (SELECT * FROM (WITH RECURSIVE p AS (SELECT cx, cy, cx::BIGINT AS ox, cy::BIGINT AS oy, 0.0::DOUBLE AS len FROM dem UNION ALL SELECT p.cx, p.cy, e.tx, e.ty, len + step FROM p JOIN edges e ON e.cx = p.ox AND e.cy = p.oy) SELECT * FROM p))"
add("ter_flow_length", lambda s, d: rounded(terrain.flow_length(dem(s))), _W + ", " + _WALK + _OUT + "round(max(len), 6) AS v FROM walk GROUP BY 2, 3")
add("ter_flow_accumulation", lambda s, d: rounded(terrain.flow_accumulation(dem(s))), _W + ", " + _WALK + "SELECT 'B1' AS band, ox::INT AS cx, oy::INT AS cy, count(*)::DOUBLE AS v FROM walk GROUP BY 2, 3")
add("ter_watershed", lambda s, d: whole(terrain.watershed_basins(dem(s), 3)), _W + ", " + _WALK + ", o AS (SELECT cx, cy, arg_max(ox, len) AS ox, arg_max(oy, len) AS oy FROM walk GROUP BY 1, 2), b AS (SELECT ox, oy, row_number() OVER (ORDER BY oy, ox) AS id FROM o GROUP BY 1, 2 HAVING count(*) >= 3) " + _OUT + "coalesce(id, 0)::INT AS v FROM o LEFT JOIN b USING (ox, oy)")
add("ter_flow_accumulation_mfd", lambda s, d: rounded(terrain.flow_accumulation(dem(s), method="mfd"), places=4))
add("ter_slope_length", lambda s, d: rounded(terrain.slope_length(dem(s)), places=4))
add("ter_strahler", lambda s, d: whole(terrain.strahler_order(dem(s))))
add("ter_pits", lambda s, d: terrain.pits(dem(s)), _W + _OUT + "z AS v FROM w WHERE n IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND w IS NOT NULL AND least(n, ne, e, se, s, sw, w, nw) >= z")
add("ter_fill_pits", lambda s, d: rounded(terrain.fill_pits(dem(s))))
add("ter_pit_routes", lambda s, d: whole(terrain.pit_routes(dem(s))))
add("ter_channels", lambda s, d: rounded(terrain.channel_network(dem(s), 4.0), "length"))
add("ter_feature_points", lambda s, d: rounded(terrain.feature_points(dem(s), 0.7), "vip"))
add("ter_tin", lambda s, d: terrain.tin(dem(s), 0.7))
