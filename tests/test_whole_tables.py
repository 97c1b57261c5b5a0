"""Queries and operators over all rows of their tables, not over the first few."""

import math

import pytest

from terralith.functions import geometry as G
from terralith.operators import spatial, terrain
from terralith.plans import fixtures, q_feature, registry

from .compare import SF

QUERIES = registry.queries()


def test_voronoi_of_all_suppliers(spark):
    sf = SF.replace("0.001", "0.01")
    at = [(r.x, r.y) for r in fixtures.qp(spark, sf).collect()]
    got = {(r.x, r.y): G.area(G.from_wkt(r.geom)) for r in spatial.voronoi_cells(fixtures.qp(spark, sf), "POLYGON ((-180 -90, 180 -90, 180 90, -180 90, -180 -90))").collect()}
    want = {p: G.area(c) for p, c in zip(at, G.voronoi(at, G.box(-180, -90, 180, 90)))}
    assert len(at) == 100 and got == {p: pytest.approx(a, abs=1e-6) for p, a in want.items()}
    assert QUERIES["int_voronoi_area"](spark, sf).first().v == 64800


def test_tin_of_all_cells(spark):
    points = {(r.cx + 0.5, r.cy + 0.5) for r in terrain.feature_points(fixtures.dem(spark), 0.7).collect()}
    rings = [G.from_wkt(r.geom)[1][0] for r in QUERIES["ter_tin"](spark, SF).collect()]
    assert {tuple(p) for r in rings for p in r} == points and max(x for x, _ in points) > 60
    xs, ys = [x for x, _ in points], [y for _, y in points]
    area = sum(G.area(("Polygon", [r])) for r in rings)
    assert area <= (max(xs) - min(xs)) * (max(ys) - min(ys)) + 1e-6


def test_predictions_and_overlays_of_all_rows(spark):
    assert QUERIES["reg_gwr_predict"](spark, SF).count() == 144
    got = QUERIES["geo_buffer_overlay"](spark, SF).collect()
    assert {r.id for r in got} == set(range(25)) and len(got) > 25


def test_distances_and_buffers_of_all_boxes(spark):
    """The queries of these operators have SQL with id filters; here they run over every box."""
    box = {r.id: r for r in fixtures.boxes(spark, SF).collect()}
    far = {(a, b): math.hypot(max(0, p.xmin - q.xmax, q.xmin - p.xmax), max(0, p.ymin - q.ymax, q.ymin - p.ymax)) for a, p in box.items() for b, q in box.items()}
    poly = q_feature._poly(spark, SF)
    got = {(r.a, r.b): r.dist for r in spatial.within_distance(poly, poly, 36.0, 36.0).collect()}
    assert got == {k: pytest.approx(v) for k, v in far.items() if v <= 36}
    near = {r.a: (r.min_dist, r.nearest) for r in spatial.nearest_within(poly, poly.where("id > 9"), 40.0, 36.0).collect()}
    best = {a: min((far[a, b], b) for b in box if b > 9) for a in box}
    assert near == {a: v for a, v in best.items() if v[0] <= 40}
    area = [r.v for r in poly.select(G.measure("area")(G.shape("buffer", 1.0, 16)("geom")).alias("v")).collect()]
    assert area == [pytest.approx(2592 + 216 + 64 * math.sin(2 * math.pi / 64) / 2, abs=0.01)] * 25
