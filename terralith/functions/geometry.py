"""Planar geometry in plain Python, and Arrow functions over WKT columns.

A geometry is (type, coordinates) with GeoJSON's nesting: a point is (x, y), a line a list
of points, a polygon a list of closed rings, a multi-geometry a list of those, and a
collection a list of geometries. Overlay cuts all edges where they meet, keeps the pieces
that the operation asks for by where their middles lie, and joins them to rings.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Geom = tuple[str, list | tuple]
_NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
_BY_UPPER = {n.upper(): n for n in (*_NAMES, "LinearRing")}
_DEPTH = {"Point": 0, "LineString": 1, "LinearRing": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
EPS = 1e-12

# --- text and bytes ---


def from_wkt(text: str) -> Geom:
    tokens = re.findall(r"[A-Za-z]+|[-+0-9.eE]+|[(),]", re.sub(r"^\s*SRID=\d+;", "", text))
    at = 0

    def nest(depth: int):
        nonlocal at
        if tokens[at] != "(":  # EMPTY
            at += 1
            return []
        at += 1
        out = []
        while True:
            if depth == 0:
                p = []
                while tokens[at] not in "(),":
                    p.append(float(tokens[at]))
                    at += 1
                out.append(tuple(p[:2]))
            elif depth == 1 and tokens[at] not in "(":  # MULTIPOINT may leave out inner brackets
                p = []
                while tokens[at] not in "(),":
                    p.append(float(tokens[at]))
                    at += 1
                out.append(tuple(p[:2]))
            elif depth == 1:
                out.append(nest(0)[0])
            else:
                out.append(nest(depth - 1))
            at += 1
            if tokens[at - 1] == ")":
                return out

    def one() -> Geom:
        nonlocal at
        name = _BY_UPPER[tokens[at].upper()]
        at += 1
        if at < len(tokens) and tokens[at].upper() in ("Z", "M", "ZM"):
            at += 1
        if name == "GeometryCollection":
            parts = []
            if tokens[at] == "(":
                while tokens[at] != ")":
                    at += 1
                    parts.append(one())
            at += 1
            return name, parts
        if name == "Point":
            p = nest(0)
            return name, p[0] if p else ()
        return name, nest(_DEPTH[name])

    return one()


def _num(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))


def to_wkt(g: Geom) -> str:
    kind, c = g
    if kind == "GeometryCollection":
        return "GEOMETRYCOLLECTION " + (f"({', '.join(map(to_wkt, c))})" if c else "EMPTY")
    if not c:
        return f"{kind.upper()} EMPTY"

    def nest(x, depth: int) -> str:
        return f"{_num(x[0])} {_num(x[1])}" if depth == 0 else "(" + ", ".join(nest(y, depth - 1) for y in x) + ")"

    return f"{kind.upper()} ({nest(c, 0)})" if kind == "Point" else f"{kind.upper()} {nest(c, _DEPTH[kind])}"


def from_wkb(data: bytes) -> Geom:
    at = 0

    def one() -> Geom:
        nonlocal at
        end = "<" if data[at] else ">"
        code = struct.unpack_from(end + "I", data, at + 1)[0]
        at += 5
        if code & 0x20000000:
            at += 4
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (code % 10000 // 1000 + 1) // 2
        kind = _NAMES[(code & 0xFFFF) % 1000 - 1]

        def point() -> tuple:
            nonlocal at
            p = struct.unpack_from(f"{end}{size}d", data, at)
            at += 8 * size
            return p[:2]

        def count() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(end + "I", data, at - 4)[0]

        if kind == "Point":
            p = point()
            return kind, () if math.isnan(p[0]) else p
        if kind == "LineString":
            return kind, [point() for _ in range(count())]
        if kind == "Polygon":
            return kind, [[point() for _ in range(count())] for _ in range(count())]
        parts = [one() for _ in range(count())]
        return kind, parts if kind == "GeometryCollection" else [p[1] for p in parts]

    return one()


def to_wkb(g: Geom) -> bytes:
    kind, c = g
    head = struct.pack("<BI", 1, _NAMES.index("LineString" if kind == "LinearRing" else kind) + 1)
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)
    if kind == "Point":
        return head + struct.pack("<2d", *(c or (math.nan, math.nan)))
    if kind in ("LineString", "LinearRing"):
        return head + line(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
    parts = c if kind == "GeometryCollection" else [(kind[5:], x) for x in c]
    return head + struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts))


def from_geojson(text: str | dict) -> Geom:
    d = json.loads(text) if isinstance(text, str) else text
    if d["type"] == "Feature":
        return from_geojson(d["geometry"])
    if d["type"] == "GeometryCollection":
        return d["type"], [from_geojson(x) for x in d["geometries"]]

    def tup(x):
        return tuple(x[:2]) if x and not isinstance(x[0], (list, tuple)) else [tup(y) for y in x]

    return d["type"], tup(d["coordinates"])


def to_geojson(g: Geom) -> str:
    kind, c = g
    if kind == "GeometryCollection":
        return json.dumps({"type": kind, "geometries": [json.loads(to_geojson(x)) for x in c]})
    return json.dumps({"type": "LineString" if kind == "LinearRing" else kind, "coordinates": c})


# --- parts ---


def parts(g: Geom) -> list[Geom]:
    """Simple geometries of a geometry."""
    kind, c = g
    if kind == "GeometryCollection":
        return [p for x in c for p in parts(x)]
    if kind.startswith("Multi"):
        return [(kind[5:], x) for x in c]
    return [("LineString" if kind == "LinearRing" else kind, c)] if c else []


def _join(ps: list[Geom]) -> Geom:
    """The narrowest geometry of simple ones."""
    ps = [p for p in ps if p[1]]
    if len(ps) == 1:
        return ps[0]
    kinds = {p[0] for p in ps}
    if len(kinds) == 1:
        return "Multi" + kinds.pop(), [p[1] for p in ps]
    return "GeometryCollection", ps


def polygons(g: Geom) -> list[list]:
    return [c for k, c in parts(g) if k == "Polygon"]


def coordinates(g: Geom) -> list[tuple]:
    out = []
    for k, c in parts(g):
        out += [c] if k == "Point" else c if k == "LineString" else [p for r in c for p in r]
    return out


def dimension(g: Geom) -> int:
    return max(({"Point": 0, "LineString": 1, "Polygon": 2}[k] for k, _ in parts(g)), default=-1)


def segments(g: Geom) -> list[tuple]:
    out = []
    for k, c in parts(g):
        for line in [c] if k == "LineString" else c if k == "Polygon" else []:
            out += [(a, b) for a, b in zip(line, line[1:]) if a != b]
    return out


def bounds(g: Geom) -> tuple[float, float, float, float]:
    xs, ys = zip(*coordinates(g))
    return min(xs), min(ys), max(xs), max(ys)


def box(x0: float, y0: float, x1: float, y1: float) -> Geom:
    return "Polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def envelope(g: Geom) -> Geom:
    return box(*bounds(g))


# --- measures ---


def ring_area(r: list) -> float:
    return sum((a[0] - r[0][0]) * (b[1] - r[0][1]) - (b[0] - r[0][0]) * (a[1] - r[0][1]) for a, b in zip(r, r[1:])) / 2


def area(g: Geom) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in polygons(g) if p)


def length(g: Geom) -> float:
    return sum(math.dist(a, b) for a, b in segments(g))


def perimeter(g: Geom) -> float:
    return sum(length(("Polygon", p)) for p in polygons(g))


EARTH = 6371008.8


def haversine(a: tuple, b: tuple) -> float:
    x, y, u, v = map(math.radians, (*a, *b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def geodesic_length(g: Geom) -> float:
    return sum(haversine(a, b) for a, b in segments(g))


def geodesic_area(g: Geom) -> float:
    """Area on a sphere of polygons in degrees."""

    def ring(r: list) -> float:
        return abs(sum(math.radians(b[0] - a[0]) * (2 + math.sin(math.radians(a[1])) + math.sin(math.radians(b[1]))) for a, b in zip(r, r[1:]))) * EARTH**2 / 2

    return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in polygons(g))


def centroid(g: Geom) -> Geom:
    d, sx, sy, sw = dimension(g), 0.0, 0.0, 0.0
    if d == 2:
        for p in polygons(g):
            for i, r in enumerate(p):
                sign = (1 if i == 0 else -1) * (1 if ring_area(r) >= 0 else -1)
                for a, b in zip(r, r[1:]):
                    w = sign * (a[0] * b[1] - b[0] * a[1])
                    sx, sy, sw = sx + (a[0] + b[0]) * w, sy + (a[1] + b[1]) * w, sw + 3 * w
    if d == 1 or d == 2 and sw == 0:
        sx = sy = sw = 0.0
        for a, b in segments(g):
            w = math.dist(a, b)
            sx, sy, sw = sx + w * (a[0] + b[0]) / 2, sy + w * (a[1] + b[1]) / 2, sw + w
    if sw == 0:
        ps = coordinates(g)
        sx, sy, sw = sum(p[0] for p in ps), sum(p[1] for p in ps), len(ps)
    return "Point", (sx / sw, sy / sw)


def convex_hull(g: Geom) -> Geom:
    ps = sorted(set(coordinates(g)))
    if len(ps) < 3:
        return ("Point", ps[0]) if len(ps) == 1 else ("LineString", ps)

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = half(ps)[:-1] + half(reversed(ps))[:-1]
    return ("Polygon", [[*ring, ring[0]]]) if len(ring) > 2 else ("LineString", ring)


def boundary(g: Geom) -> Geom:
    out: list[Geom] = []
    for k, c in parts(g):
        if k == "Polygon":
            out += [("LineString", r) for r in c]
        elif k == "LineString" and c[0] != c[-1]:
            out += [("Point", c[0]), ("Point", c[-1])]
    return _join(out)


def is_unbounded(g: Geom) -> bool:
    """Whether the boundary is empty by dimension, as of points."""
    return dimension(g) <= 0


# --- distance and place ---


def _nearest_on(p: tuple, a: tuple, b: tuple) -> tuple:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)
    return a if t <= 0 else b if t >= 1 else (a[0] + t * dx, a[1] + t * dy)


def _meet(a: tuple, b: tuple, c: tuple, d: tuple) -> list[tuple]:
    """Points where two segments meet; the ends of the common piece if they lie on one line."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    size = max(abs(rx), abs(ry)) * max(abs(sx), abs(sy))
    cross, qx, qy = rx * sy - ry * sx, c[0] - a[0], c[1] - a[1]
    if abs(cross) <= EPS * size:
        if abs(qx * ry - qy * rx) > 1e-9 * max(abs(rx), abs(ry)) * max(abs(rx), abs(ry), abs(qx), abs(qy)):
            return []
        rr = rx * rx + ry * ry
        t0, t1 = sorted(((qx * rx + qy * ry) / rr, ((qx + sx) * rx + (qy + sy) * ry) / rr))
        lo, hi = max(t0, 0.0), min(t1, 1.0)
        return [(a[0] + t * rx, a[1] + t * ry) for t in ((lo, hi) if hi > lo else (lo,))] if lo <= hi + EPS else []
    t, u = (qx * sy - qy * sx) / cross, (qx * ry - qy * rx) / cross
    if -EPS <= t <= 1 + EPS and -EPS <= u <= 1 + EPS:
        for end, v in ((a, 0), (b, 1)):
            if abs(t - v) <= EPS:
                return [end]
        for end, v in ((c, 0), (d, 1)):
            if abs(u - v) <= EPS:
                return [end]
        return [(a[0] + t * rx, a[1] + t * ry)]
    return []


def _in_ring(p: tuple, ring: list) -> str:
    """i, b or e: inside, on the ring, outside."""
    x, y = p
    inside, tol = False, 1e-10 * max(1.0, abs(x), abs(y))
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if min(x0, x1) - tol <= x <= max(x0, x1) + tol and min(y0, y1) - tol <= y <= max(y0, y1) + tol:
            dx, dy = x1 - x0, y1 - y0
            n = math.hypot(dx, dy)
            if n == 0 or abs(dx * (y - y0) - dy * (x - x0)) <= tol * n:
                return "b"
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            inside = not inside
    return "i" if inside else "e"


def locate(p: tuple, g: Geom) -> str:
    """i, b or e: in the interior, on the boundary, or outside of a geometry."""
    best = "e"
    for k, c in parts(g):
        if k == "Point":
            w = "i" if c == p else "e"
        elif k == "LineString":
            on = any(math.dist(p, _nearest_on(p, a, b)) <= 1e-10 * max(1.0, abs(p[0]), abs(p[1])) for a, b in zip(c, c[1:]) if a != b)
            w = "e" if not on else "b" if c[0] != c[-1] and p in (c[0], c[-1]) else "i"
        else:
            w = _in_ring(p, c[0])
            for h in c[1:]:
                if w == "i":
                    w = {"i": "e", "b": "b", "e": "i"}[_in_ring(p, h)]
        if w == "i":
            return "i"
        best = "b" if w == "b" else best
    return best


def closest_points(a: Geom, b: Geom) -> tuple[tuple, tuple]:
    """The pair of points of a and b that are nearest; equal where they intersect."""
    sa, sb, pa_, pb = segments(a), segments(b), coordinates(a), coordinates(b)
    for p in pb:
        if dimension(a) == 2 and locate(p, a) != "e":
            return p, p
    for p in pa_:
        if dimension(b) == 2 and locate(p, b) != "e":
            return p, p
    for s in sa:
        for t in sb:
            if m := _meet(*s, *t):
                return m[0], m[0]
    best = (math.inf, (), ())
    for p in pa_:
        for q in [_nearest_on(p, *s) for s in sb] + [x[1] for x in parts(b) if x[0] == "Point"]:
            best = min(best, (math.dist(p, q), p, q))
    for q in pb:
        for p in [_nearest_on(q, *s) for s in sa] + [x[1] for x in parts(a) if x[0] == "Point"]:
            best = min(best, (math.dist(p, q), p, q))
    return best[1], best[2]


def distance(a: Geom, b: Geom) -> float:
    p, q = closest_points(a, b)
    return math.dist(p, q)


# --- relations ---


def _pieces(g: Geom, by: Geom) -> list[tuple]:
    """Segments of g, cut where they meet segments of the other."""
    other, out = segments(by), []
    for a, b in segments(g):
        cuts = [a, b]
        lo, hi = (min(a[0], b[0]), min(a[1], b[1])), (max(a[0], b[0]), max(a[1], b[1]))
        for c, d in other:
            if max(c[0], d[0]) >= lo[0] - 1e-9 and min(c[0], d[0]) <= hi[0] + 1e-9 and max(c[1], d[1]) >= lo[1] - 1e-9 and min(c[1], d[1]) <= hi[1] + 1e-9:
                cuts += _meet(a, b, c, d)
        for k, p in parts(by):
            if k == "Point" and math.dist(p, _nearest_on(p, a, b)) <= EPS:
                cuts.append(p)
        k = 0 if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else 1
        cuts = sorted(set(cuts), key=lambda p: p[k], reverse=b[k] < a[k])
        out += [(p, q) for p, q in zip(cuts, cuts[1:]) if math.dist(p, q) > 1e-11 * max(1.0, abs(p[0]), abs(p[1]))]
    return out


def _middle(s: tuple) -> tuple:
    return (s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2


def _places(g: Geom, by: Geom) -> set[str]:
    """Where the pieces and points of g lie in the other."""
    out = {locate(_middle(s), by) for s in _pieces(g, by)}
    return out | {locate(c, by) for k, c in parts(g) if k == "Point"}


def intersects(a: Geom, b: Geom) -> bool:
    if not parts(a) or not parts(b):
        return False
    p, q = bounds(a), bounds(b)
    if p[2] < q[0] or q[2] < p[0] or p[3] < q[1] or q[3] < p[1]:
        return False
    return distance(a, b) <= 1e-12 * max(1.0, *map(abs, p))


def _interiors(a: Geom, b: Geom) -> bool:
    da, db = dimension(a), dimension(b)
    if da == db == 2:
        if "i" in _places(a, b) or "i" in _places(b, a):
            return True
        return bool(set.intersection(*map(set, _noded(a, b))))
    if da < db:
        a, b, da, db = b, a, db, da
    if db == 0:
        return any(locate(c, a) == "i" for _, c in parts(b))
    if da == 2:
        return "i" in _places(b, a)
    if any(locate(_middle(s), a) == "i" for s in _pieces(b, a)):
        return True
    return any(locate(m, a) == "i" and locate(m, b) == "i" for s in segments(a) for t in segments(b) for m in _meet(*s, *t))


def covers(a: Geom, b: Geom) -> bool:
    """No point of b is outside of a."""
    if not parts(b) or "e" in _places(b, a):
        return False
    if dimension(b) == 2:
        return dimension(a) == 2 and "i" not in _places(a, b)
    return True


def contains(a: Geom, b: Geom) -> bool:
    return covers(a, b) and _interiors(a, b)


def touches(a: Geom, b: Geom) -> bool:
    return intersects(a, b) and not _interiors(a, b)


def overlaps(a: Geom, b: Geom) -> bool:
    if dimension(a) != dimension(b) or not _interiors(a, b) or covers(a, b) or covers(b, a):
        return False
    return dimension(a) != 1 or any(locate(_middle(s), a) == "i" for s in _pieces(b, a))


def crosses(a: Geom, b: Geom) -> bool:
    if not _interiors(a, b) or covers(a, b) or covers(b, a):
        return False
    if dimension(a) == dimension(b):
        return dimension(a) == 1 and not any(locate(_middle(s), a) == "i" for s in _pieces(b, a))
    return True


PREDICATES = {
    "Contains": contains,
    "Within": lambda a, b: contains(b, a),
    "Covers": covers,
    "CoveredBy": lambda a, b: covers(b, a),
    "Intersects": intersects,
    "Disjoint": lambda a, b: not intersects(a, b),
    "Touches": touches,
    "Overlaps": overlaps,
    "Crosses": crosses,
    "Equals": lambda a, b: covers(a, b) and covers(b, a),
    "OrderingEquals": lambda a, b: a == b,
}

# --- overlay ---


def _turned(p: list) -> list:
    """A polygon with its shell anticlockwise and its holes clockwise: the interior is on the left."""
    return [r if (ring_area(r) > 0) == (i == 0) else r[::-1] for i, r in enumerate(p)]


class _Snap:
    """One point for all points that are nearly equal."""

    def __init__(self, tol: float):
        self.tol, self.cells = tol, {}

    def __call__(self, p: tuple) -> tuple:
        i, j = math.floor(p[0] / self.tol), math.floor(p[1] / self.tol)
        for x in (i, i - 1, i + 1):
            for y in (j, j - 1, j + 1):
                q = self.cells.get((x, y))
                if q is not None and math.dist(p, q) <= self.tol:
                    return q
        self.cells[i, j] = p
        return p


def _noded(a: Geom, b: Geom) -> tuple[list[tuple], list[tuple]]:
    """Directed pieces of the rings of two areas, interior on the left, cut at the same points."""
    sides = [[s for p in polygons(g) for r in _turned(p) for s in zip(r, r[1:])] for g in (a, b)]
    points = [p for side in sides for s in side for p in s]
    snap = _Snap(1e-10 * max([1e-300, *(max(abs(x), abs(y)) for x, y in points)]))
    sides = [[(p, q) for p, q in ((snap(p), snap(q)) for p, q in side) if p != q] for side in sides]
    cuts = [[[p, q] for p, q in side] for side in sides]
    box_ = lambda s: (min(s[0][0], s[1][0]), min(s[0][1], s[1][1]), max(s[0][0], s[1][0]), max(s[0][1], s[1][1]))
    boxes = [box_(s) for s in sides[1]]
    tol = snap.tol
    for i, s in enumerate(sides[0]):
        x0, y0, x1, y1 = box_(s)
        for j, t in enumerate(sides[1]):
            u = boxes[j]
            if u[0] <= x1 + tol and u[2] >= x0 - tol and u[1] <= y1 + tol and u[3] >= y0 - tol:
                ends = [e for e in t if math.dist(e, _nearest_on(e, *s)) <= tol], [e for e in s if math.dist(e, _nearest_on(e, *t)) <= tol]
                met = [] if len(ends[0]) + len(ends[1]) > 1 else [snap(m) for m in _meet(*s, *t)]
                cuts[0][i] += ends[0] + met
                cuts[1][j] += ends[1] + met
    out = []
    for side, cut in zip(sides, cuts):
        pieces = []
        for (p, q), c in zip(side, cut):
            c = sorted(set(c), key=lambda x: (x[0] - p[0]) * (q[0] - p[0]) + (x[1] - p[1]) * (q[1] - p[1]))  # noqa: B023
            pieces += [(x, y) for x, y in zip(c, c[1:]) if x != y]
        have = set(pieces)
        out.append([x for x in dict.fromkeys(pieces) if (x[1], x[0]) not in have])
    return out[0], out[1]


def _rings(edges: list[tuple]) -> list[list]:
    """Closed rings of directed edges; where several go on, the sharpest turn to the left."""
    out_of = defaultdict(list)
    for p, q in edges:
        out_of[p].append(q)
    rings = []
    for start in list(out_of):
        while out_of[start]:
            ring, at, before = [start], start, None
            while True:
                choices = out_of[at]
                if not choices:
                    ring = []
                    break
                if before is None or len(choices) == 1:
                    k = 0
                else:
                    back = math.atan2(before[1] - at[1], before[0] - at[0])
                    angle = lambda i: (back - math.atan2(choices[i][1] - at[1], choices[i][0] - at[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                    k = min(range(len(choices)), key=angle)
                before, at = at, choices.pop(k)
                ring.append(at)
                if at == start:
                    break
            if len(ring) > 3:
                rings.append(ring)
    return rings


def _clean(r: list) -> list:
    """A ring without points between two others on a line."""
    r, n = r[:-1], len(r) - 1
    keep = [r[i] for i in range(n) if abs((r[i][0] - r[i - 1][0]) * (r[(i + 1) % n][1] - r[i][1]) - (r[i][1] - r[i - 1][1]) * (r[(i + 1) % n][0] - r[i][0])) > 1e-12 * max(1.0, math.dist(r[i], r[i - 1]) * math.dist(r[(i + 1) % n], r[i]))]
    return [*keep, keep[0]] if len(keep) > 2 else []


def _polygon(edges: list[tuple]) -> Geom:
    rings = [c for r in _rings(edges) if (c := _clean(r))]
    shells = [[r] for r in rings if ring_area(r) > 0]
    for h in rings:
        if ring_area(h) < 0:
            probe = _middle((h[0], h[1]))
            over = [s for s in shells if _in_ring(probe, s[0]) != "e" and ring_area(s[0]) > -ring_area(h)]
            if over:
                min(over, key=lambda s: ring_area(s[0])).append(h)
    return _join([("Polygon", s) for s in shells])


def _areas(a: Geom, b: Geom, op: str) -> Geom:
    pa_, pb = _noded(a, b)
    sa, sb = set(pa_), set(pb)
    want = "i" if op == "intersection" else "e"
    out = []
    for s in pa_:
        if s in sb:
            if op != "difference":
                out.append(s)
        elif (s[1], s[0]) in sb:
            if op == "difference":
                out.append(s)
        elif locate(_middle(s), b) == want:
            out.append(s)
    for s in pb:
        if s in sa or (s[1], s[0]) in sa:
            continue
        w = locate(_middle(s), a)
        if op == "difference":
            if w == "i":
                out.append((s[1], s[0]))
        elif w == want:
            out.append(s)
    return _polygon(out)


def _lines(a: Geom, b: Geom, inside: bool) -> list[Geom]:
    """Pieces of a's lines that lie in b, or outside of it, joined end to end."""
    out: list[list] = []
    for p, q in _pieces(a, b):
        if (locate(_middle((p, q)), b) != "e") == inside:
            if out and out[-1][-1] == p:
                out[-1].append(q)
            else:
                out.append([p, q])
    return [("LineString", x) for x in out]


def overlay(a: Geom, b: Geom, op: str) -> Geom:
    """intersection, union, difference or symmetric difference."""
    if op == "symmetric_difference":
        return _join(parts(overlay(a, b, "difference")) + parts(overlay(b, a, "difference")))
    area_a, area_b = ("MultiPolygon", polygons(a)), ("MultiPolygon", polygons(b))
    line_a = ("GeometryCollection", [p for p in parts(a) if p[0] == "LineString"])
    line_b = ("GeometryCollection", [p for p in parts(b) if p[0] == "LineString"])
    dots_a = [p for p in parts(a) if p[0] == "Point"]
    dots_b = [p for p in parts(b) if p[0] == "Point"]
    out: list[Geom] = []
    if op == "union":
        out += parts(_areas(area_a, area_b, op)) if area_a[1] and area_b[1] else parts(area_a) + parts(area_b)
        left = _lines(line_a, area_b, False) if area_b[1] else parts(line_a)
        right = _lines(line_b, a, False) if parts(a) else parts(line_b)
        out += left + right + [p for p in dots_a if locate(p[1], b) == "e"] + [p for p in dots_b if locate(p[1], a) == "e"] + [p for p in dots_a if p in dots_b]
        return _join(out)
    if op == "difference":
        out += parts(_areas(area_a, area_b, op)) if area_a[1] and area_b[1] else parts(area_a)
        return _join(out + _lines(line_a, b, False) + [p for p in dots_a if locate(p[1], b) == "e"])
    shared: list[Geom] = []
    if area_a[1] and area_b[1]:
        out += parts(_areas(area_a, area_b, op))
        back = {(q, p) for p, q in _noded(area_a, area_b)[1]}
        shared = [("LineString", list(s)) for s in _noded(area_a, area_b)[0] if s in back]
    lines = shared + _lines(line_a, b, True) + (_lines(line_b, area_a, True) if area_a[1] else [])
    dots = [p for p in dots_a if locate(p[1], b) != "e"] + [p for p in dots_b if locate(p[1], a) != "e" and p not in dots_a]
    if not out and not lines:
        meets = {m for s in segments(a) for t in segments(b) for m in _meet(*s, *t)}
        dots += [("Point", m) for m in sorted(meets) if ("Point", m) not in dots]
    return _join(out + lines + dots)


def union_all(gs: list[Geom]) -> Geom:
    """Union of many, by halves."""
    if not gs:
        return "GeometryCollection", []
    while len(gs) > 1:
        gs = [overlay(gs[i], gs[i + 1], "union") if i + 1 < len(gs) else gs[i] for i in range(0, len(gs), 2)]
    return gs[0]


def dissolve(g: Geom) -> Geom:
    return union_all(parts(g))


def buffer(g: Geom, d: float, quarter: int = 8) -> Geom:
    """All within d (> 0), or the polygon without all within -d of its boundary (< 0)."""
    if d == 0 or not parts(g):
        return dissolve(g)

    def capsule(a: tuple, b: tuple) -> Geom:
        t, n = math.atan2(b[1] - a[1], b[0] - a[0]), 2 * quarter
        half = lambda c, from_: [(c[0] + abs(d) * math.cos(from_ + math.pi * i / n), c[1] + abs(d) * math.sin(from_ + math.pi * i / n)) for i in range(n + 1)]
        ring = half(b, t - math.pi / 2) + half(a, t + math.pi / 2)
        return "Polygon", [[*ring, ring[0]]]

    around = [capsule(a, b) for a, b in segments(g)] + [capsule(c, c) for k, c in parts(g) if k == "Point"]
    if d < 0:
        return overlay(g, union_all(around), "difference")
    return union_all(parts(("MultiPolygon", polygons(g))) + around)


# --- shape changes ---


def simplify(g: Geom, tolerance: float) -> Geom:
    """Douglas and Peucker; a ring keeps at least four points."""

    def line(ps: list) -> list:
        if len(ps) < 3:
            return ps
        d = [math.dist(p, _nearest_on(p, ps[0], ps[-1]) if ps[0] != ps[-1] else ps[0]) for p in ps]
        k = max(range(len(ps)), key=d.__getitem__)
        return [ps[0], ps[-1]] if d[k] <= tolerance else line(ps[: k + 1])[:-1] + line(ps[k:])

    out = []
    for k, c in parts(g):
        if k == "LineString":
            c = line(c)
        elif k == "Polygon":
            c = [s if len(s := line(r)) > 3 else r for r in c]
        out.append((k, c))
    return _join(out)


def densify(g: Geom, most: float) -> Geom:
    """Points put in so that no segment is longer than ``most``."""

    def line(ps: list) -> list:
        out = ps[:1]
        for a, b in zip(ps, ps[1:]):
            n = max(1, math.ceil(math.dist(a, b) / most - 1e-12))
            out += [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(1, n)] + [b]
        return out

    return _join([(k, line(c) if k == "LineString" else [line(r) for r in c] if k == "Polygon" else c) for k, c in parts(g)])


def cut_lines(g: Geom, at: list[float]) -> Geom:
    """Lines cut at distances from their beginning."""
    out = []
    for k, c in parts(g):
        if k != "LineString":
            continue
        now, gone, left = [c[0]], 0.0, sorted(x for x in at if x > 0)
        for a, b in zip(c, c[1:]):
            n = math.dist(a, b)
            while left and left[0] < gone + n:
                t = (left.pop(0) - gone) / n
                p = (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
                if p != now[-1]:
                    out.append(("LineString", [*now, p]))
                    now = [p]
            now.append(b) if b != now[-1] else None
            gone += n
        if len(now) > 1:
            out.append(("LineString", now))
    return _join(out)


def moved(g: Geom, f) -> Geom:
    """A geometry with every point sent through f."""

    def go(x):
        return tuple(f(*x)) if x and not isinstance(x[0], (list, tuple)) else [go(y) for y in x]

    return (g[0], [moved(x, f) for x in g[1]]) if g[0] == "GeometryCollection" else (g[0], go(g[1]))


def reproject(g: Geom, source: str, target: str) -> Geom:
    """From one system to another, by the formulas of ``crs``."""
    from . import crs

    if crs.code(source) == crs.code(target):
        return g
    return moved(g, lambda x, y: tuple(float(v) for v in crs.transform(x, y, source, target)))


def build(kind: str, coordinates: str | list) -> Geom:
    """A geometry from nested coordinate lists, or their JSON text; a collection's members are WKT or geometries."""
    import json

    value = json.loads(coordinates) if isinstance(coordinates, str) and kind != "GeometryCollection" else coordinates
    if kind == "GeometryCollection":
        members = json.loads(value) if isinstance(value, str) else value
        return (kind, [from_wkt(m) if isinstance(m, str) else (m["type"], build(m["type"], m["coordinates"])[1]) if isinstance(m, dict) else m for m in members])

    def nest(v: list, depth: int):
        if depth:
            return [nest(x, depth - 1) for x in v]
        if len(v) < 2:
            raise ValueError("a point needs two coordinates")
        return (float(v[0]), float(v[1]))

    c = nest(value, _DEPTH[kind])
    closed = {"LinearRing": [c], "Polygon": c, "MultiPolygon": [r for p in c for r in p] if kind == "MultiPolygon" else []}.get(kind, [])
    if any(len(r) < 4 or r[0] != r[-1] for r in closed):
        raise ValueError("a ring must have four points at least and end where it begins")
    if kind == "LineString" and len(c) == 1:
        raise ValueError("a line needs two points")
    return ("LineString" if kind == "LinearRing" else kind, c)


def built(kind: str):
    """A column function: JSON text of nested coordinates -> WKT."""
    return _udf("string", lambda t: to_wkt(build(kind, t)))


def any_point(g: Geom) -> tuple | None:
    """Some point of a geometry: its first; none of an empty one."""
    return next(iter(coordinates(g)), None)


def delaunay(points: list[tuple]) -> list[tuple[int, int, int]]:
    """Triangles (indices) of points, by insertion and removal of circumcircles."""
    n = len(points)
    if n < 3:
        return []
    p = np.array(points, float)
    mid, span = (p.max(0) + p.min(0)) / 2, max(np.ptp(p, 0).max(), 1e-9) * 1e3
    q = np.vstack([p, mid + [[-span, -span], [span, -span], [0, span]]])

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = q[list(t)] - q[t[0]]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-300:
            return (0.0, 0.0, math.inf)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return (ux + q[t[0]][0], uy + q[t[0]][1], ux * ux + uy * uy)

    tri = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in dict.fromkeys(sorted(range(n), key=lambda i: points[i])):
        x, y = q[i]
        bad = [t for t, (cx, cy, r) in tri.items() if (x - cx) ** 2 + (y - cy) ** 2 < r * (1 - 1e-12)]
        edges = defaultdict(int)
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[tuple(sorted(e))] += 1
            del tri[t]
        for (a, b), k in edges.items():
            if k == 1:
                t = (a, b, i)
                tri[t] = circle(t)
    out = []
    for t in tri:
        if max(t) < n:
            a, b, c = (points[k] for k in t)
            s = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            if s:
                out.append(t if s > 0 else (t[0], t[2], t[1]))
    return out


def voronoi(points: list[tuple], frame: Geom | None = None, only: list[tuple] | None = None) -> list[Geom]:
    """The cell of each distinct point (or of those in ``only``), cut by half planes from a frame (the points' box, widened)."""
    ps = list(dict.fromkeys(points))
    if frame is None:
        x0, y0, x1, y1 = bounds(("MultiPoint", ps))
        m = max(x1 - x0, y1 - y0) or 1.0
        frame = box(x0 - m, y0 - m, x1 + m, y1 + m)
    out = []
    for p in ps if only is None else only:
        ring = _turned(frame[1])[0][:-1]
        for q in sorted((q for q in ps if q != p), key=lambda q: math.dist(p, q)):
            if ring and math.dist(p, q) / 2 > max(math.dist(p, r) for r in ring):
                break
            mx, my, nx, ny = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, q[0] - p[0], q[1] - p[1]
            side = [(r[0] - mx) * nx + (r[1] - my) * ny for r in ring]
            new = []
            for i, r in enumerate(ring):
                j = (i + 1) % len(ring)
                if side[i] <= 0:
                    new.append(r)
                if side[i] * side[j] < 0:
                    t = side[i] / (side[i] - side[j])
                    new.append((r[0] + t * (ring[j][0] - r[0]), r[1] + t * (ring[j][1] - r[1])))
            ring = new
        out.append(("Polygon", [[*ring, ring[0]]]) if ring else ("Polygon", []))
    return out


# --- Arrow functions over WKT columns ---


def _udf(kind: str, f, n: int = 1):
    arrow = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}[kind]
    call = lambda *v: None if any(x is None for x in v) else f(*v)
    if n == 1:

        @F.arrow_udf(kind)
        def one(a: pa.Array) -> pa.Array:
            return pa.array([call(x) for x in a.to_pylist()], arrow)

        return one

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([call(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], arrow)

    return two


def measure(name: str, *args):
    """A column function WKT -> number: area, length, perimeter, geodesic_area, geodesic_length."""
    f = globals()[name]
    return _udf("double", lambda t: float(f(from_wkt(t), *args)))


def shape(name: str, *args):
    """A column function WKT -> WKT: envelope, centroid, convex_hull, boundary, buffer, simplify, densify, ..."""
    f = globals()[name]
    return _udf("string", lambda t: to_wkt(f(from_wkt(t), *args)))


@lru_cache(4096)
def _parsed(text: str) -> Geom:
    """A parsed geometry that is only read; a join meets each one in many candidate pairs, a literal in all."""
    return from_wkt(text)


def predicate(name: str):
    """A column function (WKT, WKT) -> boolean, by the names in ``PREDICATES``."""
    f = PREDICATES[name]
    return _udf("boolean", lambda a, b: f(_parsed(a), _parsed(b)), 2)


def overlaid(op: str):
    """A column function (WKT, WKT) -> WKT."""
    return _udf("string", lambda a, b: to_wkt(overlay(_parsed(a), _parsed(b), op)), 2)


def between():
    """A column function (WKT, WKT) -> distance."""
    return _udf("double", lambda a, b: distance(_parsed(a), _parsed(b)), 2)


def inside_xy(wkt: str):
    """A function (x, y) of numpy arrays: whether a fixed polygon covers the points."""
    rings = [np.array(r, float) for p in polygons(from_wkt(wkt)) for r in p]

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(a), bool)
        for r in rings:
            for (x0, y0), (x1, y1) in zip(r, r[1:]):
                if y0 != y1:
                    inside ^= ((y0 > b) != (y1 > b)) & (a < (x1 - x0) * (b - y0) / (y1 - y0) + x0)
        return inside

    return f


def covers_xy(wkt: str):
    """A column function (x, y) -> whether a fixed polygon covers the point; vectorised."""
    test = inside_xy(wkt)

    @F.arrow_udf("boolean")
    def f(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(test(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)))

    return f


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def to_geojson_column():
    return _udf("string", lambda t: to_geojson(from_wkt(t)))


def from_geojson_column():
    return _udf("string", lambda t: to_wkt(from_geojson(t)))


def to_wkb_column():
    return _udf("binary", lambda t: to_wkb(from_wkt(t)))


def from_wkb_column():
    return _udf("string", lambda t: to_wkt(from_wkb(t)))


def type_column():
    return _udf("string", lambda t: from_wkt(t)[0])


def closest(side: int | None):
    """A column function (WKT, WKT) -> the point of the first (0) or second (1) nearest to the other, or both (None)."""

    def f(a: str, b: str) -> str:
        p = closest_points(from_wkt(a), from_wkt(b))
        return to_wkt(("MultiPoint", list(p)) if side is None else ("Point", p[side]))

    return _udf("string", f, 2)


def coordinates_column():
    """A column function WKT -> JSON text of its coordinates."""
    import json

    return _udf("string", lambda t: json.dumps(coordinates(from_wkt(t))))


def unbounded_column():
    return _udf("boolean", lambda t: bool(is_unbounded(from_wkt(t))))


def parts_column():
    """A column function WKT -> WKT of each simple part."""

    @F.arrow_udf("array<string>")
    def f(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [to_wkt(p) for p in parts(from_wkt(t))] for t in a.to_pylist()], pa.list_(pa.string()))

    return f
