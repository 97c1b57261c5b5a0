"""What larger tables ask of queries: systems without their matrix, many points of one place, many places within reach."""

import numpy as np
import pytest

from terralith.operators import interpolation, spatial, statistics

from .test_models import kriged


@pytest.fixture(scope="module")
def doubled(spark):
    """300 places, some of them of two or three points with their own values; x, y and mean value of each place."""
    r = np.random.default_rng(3)
    x, y = r.uniform(-100, 100, 300).round(2), r.uniform(-50, 50, 300).round(2)
    v, n = np.sin(x / 30) * y, r.integers(1, 4, 300)
    at = np.repeat(np.arange(300), n)
    own = v[at] + np.concatenate([np.arange(k) - (k - 1) / 2 for k in n])
    df = spark.createDataFrame([(i, float(x[a]), float(y[a]), float(own[i])) for i, a in enumerate(at)], "id long, x double, y double, v double")
    return df.repartition(5), x, y, v


def cells(x, y, cols, rows):
    return {(i, j): (x.min() + (i + 0.5) * np.ptp(x) / cols, y.max() - (j + 0.5) * np.ptp(y) / rows) for i in range(cols) for j in range(rows)}


def test_ordinary_kriging_without_its_matrix(doubled, monkeypatch):
    df, x, y, v = doubled
    monkeypatch.setattr(interpolation, "DIRECT", 10)
    for nugget in (0.0, 5.0):
        got = {(r.cx, r.cy): (r.v, r.variance) for r in interpolation.kriging(df, "v", 4, 3, nugget=nugget, sill=90.0, reach=70.0).collect()}
        assert got == {k: pytest.approx(kriged(x, y, v, *c, (nugget, 90.0, 70.0)), abs=1e-5) for k, c in cells(x, y, 4, 3).items()}


def test_variogram_counts_pairs_of_points(doubled, spark):
    df = doubled[0]
    t = df.toPandas()
    x, y, v = (t[c].to_numpy() for c in "xyv")
    i, j = np.triu_indices(len(x), 1)
    h, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (v[i] - v[j]) ** 2
    k = np.floor(h / (h.max() / 2 / 8)).astype(int)
    want = [g[k == b].mean() for b in range(8)]
    assert interpolation.empirical_variogram(spark.sparkContext, *interpolation._places(df, "v"), 8)[1] == pytest.approx(want)


def test_simple_kriging_without_its_matrix(doubled, monkeypatch):
    df, x, y, v = doubled
    monkeypatch.setattr(interpolation, "DIRECT", 10)
    got = {(r.cx, r.cy): (r.v, r.variance) for r in interpolation.kriging(df, "v", 4, 3, sill=100.0, reach=90.0, mean=1.0).collect()}
    assert got == {k: pytest.approx(kriged(x, y, v, *c, (0.0, 100.0, 90.0), 1.0), abs=1e-5) for k, c in cells(x, y, 4, 3).items()}


def test_thin_plate_without_its_matrix(doubled, monkeypatch):
    df = doubled[0]
    want = {(r.cx, r.cy): r.v for r in interpolation.thin_plate_spline(df, "v", 7, 5).collect()}
    monkeypatch.setattr(interpolation, "DIRECT", 10)
    assert {(r.cx, r.cy): r.v for r in interpolation.thin_plate_spline(df, "v", 7, 5).collect()} == pytest.approx(want, abs=1e-6)


def test_linear_takes_the_delaunay_triangles(doubled):
    """Against all triangles with an empty circle; also where four places of a grid are on one circle."""
    _, x, y, v = doubled
    x, y, v = x[:60], y[:60], v[:60]
    hull = interpolation._hull(x, y)
    for gx, gy in np.random.default_rng(5).uniform([-80, -40], [80, 40], (25, 2)):
        got = interpolation._triangle(x - gx, y - gy, hull)
        if got is not None:
            (a, b, c), s = got
            m = np.linalg.solve(2 * np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]]), [x[b] ** 2 - x[a] ** 2 + y[b] ** 2 - y[a] ** 2, x[c] ** 2 - x[a] ** 2 + y[c] ** 2 - y[a] ** 2])
            assert (np.hypot(x - m[0], y - m[1]) > np.hypot(x[a] - m[0], y[a] - m[1]) - 1e-7).all() and s.min() > -1e-9
            assert (s @ x[[a, b, c]], s @ y[[a, b, c]]) == pytest.approx((gx, gy))
    gx, gy = (a.ravel().astype(float) for a in np.meshgrid(np.arange(6), np.arange(6)))
    hull = interpolation._hull(gx, gy)
    assert sorted(hull) == [0, 5, 30, 35]
    for px, py in np.random.default_rng(6).uniform(0, 5, (20, 2)):
        (a, b, c), s = interpolation._triangle(gx - px, gy - py, hull)
        assert {int(np.floor(px)) + 6 * int(np.floor(py))} <= {a, b, c} and s.min() >= 0 and max(np.ptp(gx[[a, b, c]]), np.ptp(gy[[a, b, c]])) == 1


def test_ripley_counts_points_of_one_place_and_not_an_id_with_itself(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(r.integers(0, 70, 90), r.integers(0, 12, (90, 2)))]
    got = [row.k for row in statistics.ripley_k(spark.createDataFrame(rows, "id long, x double, y double")).collect()]
    (x0, y0), (x1, y1) = ([f(v[c] for v in rows) for c in (1, 2)] for f in (min, max))
    step, n = max(x1 - x0, y1 - y0) * 0.25 / 10, len(rows)
    d = [np.hypot(a[1] - b[1], a[2] - b[2]) for a in rows for b in rows if a[0] != b[0]]
    assert got == pytest.approx([np.sqrt((x1 - x0) * (y1 - y0) * sum(np.floor(v / step) < i for v in d) / (np.pi * n * (n - 1))) for i in range(1, 11)])


def test_ripley_joins_no_pairs(spark, monkeypatch):
    """The only join is that of ids that occur twice."""
    seen, join = [], statistics.distance_join
    monkeypatch.setattr(statistics, "distance_join", lambda a, b, d: (seen.append(a.count()), join(a, b, d))[1])
    statistics.ripley_k(spark.range(50).selectExpr("id", "cast(id % 7 as double) as x", "cast(id % 5 as double) as y")).collect()
    assert sum(seen) == 0


def _crowd(spark, n, m):
    """n points of m places each."""
    return spark.range(n).selectExpr("id", f"cast(id % {m} % 9 as double) as x", f"cast(id % {m} div 9 as double) as y")


def test_distance_joins_of_points_of_one_place(spark):
    a, b = _crowd(spark, 90, 40), _crowd(spark, 150, 60)
    p, q = ([(r.id, r.x, r.y) for r in t.collect()] for t in (a, b))
    want = {(i, j): round(float(np.hypot(x - u, y - v)), 6) for i, x, y in p for j, u, v in q if np.hypot(x - u, y - v) < 2}
    got = [(r.a.id, r.b.id, r.dist) for r in spatial.distance_join(a, b, 2.0, places=6).collect()]
    assert len(got) == len(want) and {g[:2]: g[2] for g in got} == want
    lists = {i: ",".join(map(str, sorted(j for k, j in want if k == i))) for i, _ in want}
    assert {r.id: r.matched for r in spatial.distance_join_grouped(a, b, 2.0, text=",").collect()} == lists
    twice = {r.g: r.matched for r in spatial.distance_join_grouped(a.selectExpr("id % 50 as g", "x", "y"), b.withColumnRenamed("id", "g"), 2.0, key="g").collect()}
    assert twice == {g: sorted(j for i, j in want if i % 50 == g) for g in {i % 50 for i, _ in want}}


def test_nearest_of_crowded_places(spark, monkeypatch):
    """Of a place only as many points are joined as can be among the nearest."""
    rows, near = [], spatial._near
    monkeypatch.setattr(spatial, "_near", lambda a, b, d, limit: (rows.append((a.count(), b.count())), near(a, b, d, limit))[1])
    p = _crowd(spark, 400, 40)
    got = {}
    for r in spatial.knn(p, p, 3, exclude_same=True).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.dist, r.id))
    at = [(r.id, r.x, r.y) for r in p.collect()]
    assert {i: sorted(g) for i, g in got.items()} == {i: [(n, *s) for n, s in enumerate(sorted((float(np.hypot(x - u, y - v)), j) for j, u, v in at if j != i)[:3], 1)] for i, x, y in at}
    assert max(a for a, _ in rows) == 40 and max(b for _, b in rows) == 160


def test_dbscan_of_crowds_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_near", lambda *a: pytest.fail("pairs are joined"))
    r = np.random.default_rng(4)
    for eps, least in ((5.0, 3), (9.0, 6), (14.0, 4)):
        xy = np.repeat(r.integers(0, 100, (70, 2)), r.integers(1, 4, 70), 0).astype(float)
        near = (xy[:, None, 0] - xy[:, 0]) ** 2 + (xy[:, None, 1] - xy[:, 1]) ** 2 <= eps * eps
        core = near.sum(1) >= least
        label = np.where(core, np.arange(len(xy)), len(xy))
        for _ in range(len(xy)):
            label = np.where(core, np.where(near & core, label, len(xy)).min(1), label)
        want = {i: int(label[i]) if core[i] else int(label[np.flatnonzero(near[i] & core)[0]]) if (near[i] & core).any() else None for i in range(len(xy))}
        df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "id long, x double, y double")
        assert {row.id: row.cluster for row in spatial.dbscan(df, eps, least).collect()} == want


def test_voronoi_cells_take_the_points_around(spark, monkeypatch):
    from terralith.functions import geometry as G

    at = [tuple(map(float, p)) for p in np.random.default_rng(9).uniform(0, 100, (400, 2))] + [(900.0, 900.0)]
    df = spark.createDataFrame(at, "x double, y double")
    got = {(r.x, r.y): G.area(G.from_wkt(r.geom)) for r in spatial.voronoi_cells(df, G.to_wkt(G.box(-10, -10, 1000, 1000))).collect()}
    assert got == {p: pytest.approx(G.area(c), abs=1e-6) for p, c in zip(at, G.voronoi(at, G.box(-10, -10, 1000, 1000)))}
