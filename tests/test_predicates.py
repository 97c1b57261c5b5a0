"""Relations of geometries with holes, dents, shared edges and several parts, drawn by hand."""

import pytest
from pyspark.sql import functions as F

from terralith.functions import geometry as G
from terralith.operators import spatial

SHAPES = {
    "square": "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))",
    "ring": "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))",  # the square with a hole
    "plug": "POLYGON ((3 3, 7 3, 7 7, 3 7, 3 3))",  # fills the hole
    "seed": "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))",  # lies in the hole
    "cup": "POLYGON ((0 0, 10 0, 10 10, 7 10, 7 3, 3 3, 3 10, 0 10, 0 0))",  # open above
    "drop": "POLYGON ((4 5, 6 5, 6 9, 4 9, 4 5))",  # in the cup's dent
    "next": "POLYGON ((10 2, 15 2, 15 8, 10 8, 10 2))",  # shares part of the square's edge
    "corner": "POLYGON ((10 10, 12 10, 12 12, 10 12, 10 10))",
    "across": "POLYGON ((5 -5, 15 -5, 15 5, 5 5, 5 -5))",
    "far": "POLYGON ((50 50, 51 50, 51 51, 50 51, 50 50))",
    "turned": "POLYGON ((10 10, 0 10, 0 0, 10 0, 10 10))",  # the square from another corner
    "two": "MULTIPOLYGON (((1 1, 2 1, 2 2, 1 2, 1 1)), ((8 8, 9 8, 9 9, 8 9, 8 8)))",
    "line": "LINESTRING (-5 5, 15 5)",
    "rim": "LINESTRING (0 0, 10 0)",
    "dot": "POINT (5 5)",
    "edge_dot": "POINT (10 5)",
}
# Pairs that hold, beside each shape with itself where the relation has that.
TRUE = {
    "Contains": {("square", "plug"), ("square", "seed"), ("square", "ring"), ("ring", "cup"), ("ring", "two"), ("square", "two"), ("square", "drop"), ("square", "cup"), ("square", "dot"), ("plug", "seed"), ("plug", "dot"), ("seed", "dot"), ("cup", "two"), ("square", "turned")},
    "Touches": {("ring", "plug"), ("square", "next"), ("ring", "next"), ("cup", "next"), ("square", "corner"), ("ring", "corner"), ("cup", "corner"), ("square", "edge_dot"), ("square", "rim"), ("ring", "rim")},
    "Overlaps": {("square", "across"), ("cup", "across"), ("next", "across"), ("ring", "across"), ("ring", "drop"), ("plug", "drop"), ("seed", "drop"), ("plug", "across"), ("seed", "across")},
    "Crosses": {("line", "square"), ("line", "ring"), ("line", "cup"), ("line", "plug"), ("line", "seed"), ("line", "next")},
    "Disjoint": {("square", "far"), ("ring", "seed"), ("ring", "dot"), ("cup", "drop"), ("cup", "dot"), ("cup", "seed"), ("two", "seed"), ("far", "line"), ("corner", "line"), ("two", "across")},
    "Equals": {("square", "turned")},
}
# Pairs that don't, where a box alone would say otherwise.
FALSE = {
    "Contains": {("ring", "seed"), ("ring", "plug"), ("ring", "dot"), ("cup", "drop"), ("plug", "ring"), ("square", "across"), ("square", "edge_dot"), ("square", "rim"), ("square", "line"), ("two", "dot")},
    "Touches": {("ring", "seed"), ("square", "across"), ("square", "plug"), ("square", "far"), ("cup", "drop"), ("line", "square")},
    "Overlaps": {("square", "next"), ("square", "plug"), ("ring", "plug"), ("cup", "drop"), ("square", "turned"), ("square", "corner")},
    "Crosses": {("line", "far"), ("rim", "square"), ("line", "corner")},
    "Disjoint": {("square", "corner"), ("square", "next"), ("ring", "plug"), ("line", "square"), ("square", "seed"), ("square", "edge_dot")},
    "Equals": {("square", "ring"), ("plug", "seed"), ("square", "cup")},
}


def holds(name, a, b):
    return G.PREDICATES[name](G.from_wkt(SHAPES[a]), G.from_wkt(SHAPES[b]))


@pytest.mark.parametrize("name", TRUE)
def test_by_hand(name):
    wrong = [p for p in TRUE[name] if not holds(name, *p)] + [p for p in FALSE[name] if holds(name, *p)]
    assert not wrong
    if name in ("Touches", "Overlaps", "Disjoint", "Equals"):
        assert all(holds(name, b, a) for a, b in TRUE[name])


def test_relations_between_them():
    for a in SHAPES:
        for b in SHAPES:
            inside, outside = holds("Contains", a, b), holds("Disjoint", a, b)
            assert holds("Within", b, a) == inside and holds("CoveredBy", b, a) == holds("Covers", a, b) and holds("Intersects", a, b) != outside
            assert not inside or holds("Covers", a, b)
            assert holds("Equals", a, b) == (holds("Covers", a, b) and holds("Covers", b, a))
            assert sum([outside, holds("Touches", a, b), holds("Overlaps", a, b), holds("Crosses", a, b)]) <= 1
    assert holds("Covers", "square", "rim") and holds("Covers", "square", "edge_dot") and not holds("Contains", "square", "rim")
    assert holds("OrderingEquals", "square", "square") and not holds("OrderingEquals", "square", "turned")


@pytest.mark.parametrize("name", ["Contains", "Touches", "Overlaps", "Crosses", "Intersects"])
def test_joins_find_the_same_pairs(spark, name):
    df = spark.createDataFrame(list(SHAPES.items()), "id string, geom string")
    want = {(a, b) for a in SHAPES for b in SHAPES if holds(name, a, b)}
    for cell in (1.0, 7.0, spatial.cell_size(spatial.with_bounds(df))):
        got = [tuple(r) for r in spatial.join(df, df, name, cell).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()]
        assert set(got) == want and len(got) == len(want)


def test_overlays_with_holes():
    area = lambda a, b, op: G.area(G.overlay(G.from_wkt(SHAPES[a]), G.from_wkt(SHAPES[b]), op))
    assert area("ring", "plug", "union") == pytest.approx(100) and area("ring", "plug", "intersection") == pytest.approx(0)
    assert area("square", "plug", "difference") == pytest.approx(84) and area("ring", "across", "intersection") == pytest.approx(25 - 4)
    assert area("cup", "drop", "union") == pytest.approx(72 + 8) and area("square", "two", "difference") == pytest.approx(98)
    assert area("ring", "across", "symmetric_difference") == pytest.approx(84 + 100 - 2 * 21)
