"""Interpolation of points (id, x, y, value) to the cell centres of a grid.

Nearest neighbour and inverse distance are joins. Thin plates and kriging solve one system of
all places, which is in their nature: up to ``DIRECT`` places in one task, and more of them
without the matrix, by all tasks (``systems``). The cells are evaluated in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .spatial import distance_join, knn
from .systems import NotDefinite, System, blocks, spread

DIRECT = 1500  # places whose matrix one task holds and solves


def grid(points: DataFrame, cols: int, rows: int) -> DataFrame:
    """(id, cx, cy, x, y): cell centres over the points' box, rows from north to south."""
    b = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    n = points.sparkSession.range(cols * rows).select("id", (F.col("id") % cols).cast("int").alias("cx"), F.floor(F.col("id") / cols).cast("int").alias("cy"))
    x = F.col("x0") + (F.col("cx") + 0.5) * (F.col("x1") - F.col("x0")) / cols
    y = F.col("y1") - (F.col("cy") + 0.5) * (F.col("y1") - F.col("y0")) / rows
    return n.crossJoin(F.broadcast(b)).select("id", "cx", "cy", x.alias("x"), y.alias("y"))


def nearest(points: DataFrame, value: str, cols: int = 20, rows: int = 20) -> DataFrame:
    """(cx, cy, v): the value of the nearest point, ties by id."""
    g = grid(points, cols, rows)
    hit = knn(g, points, 1).select("qid", F.col("id").alias("pid"))
    return g.join(hit, g["id"] == hit["qid"]).join(points.select(F.col("id").alias("pid"), F.col(value).cast("double").alias("v")), "pid").select("cx", "cy", "v")


def idw(points: DataFrame, value: str, cols: int = 20, rows: int = 20, power: float = 2.0, k: int | None = None, mask: str | None = None, default: float | None = None, radius: float | None = None) -> DataFrame:
    """(cx, cy, v): mean weighted by 1 / distance^power of all points, of the k nearest, or of those within a radius.

    At a point's own place its value is taken. Outside of a mask polygon there are no
    cells; negative results become ``default`` if one is given.
    """
    g = grid(points, cols, rows)
    g = g.where(G.covers_xy(mask)("x", "y")) if mask else g
    v = points.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col(value).cast("double").alias("pv")).where("pv is not null")
    w = F.when(F.col("dist") > 0, 1 / F.pow("dist", F.lit(power)))
    mean = F.coalesce(F.avg(F.when(F.col("dist") == 0, F.col("pv"))), F.sum(w * F.col("pv")) / F.sum(w))
    if k or radius:
        if k:
            near = knn(g, points.where(F.col(value).isNotNull()), k).select("qid", F.col("id").alias("pid"), "dist")
        else:
            near = distance_join(g.select("id", "x", "y"), points.where(F.col(value).isNotNull()).select("id", "x", "y"), float(radius), "less_equal").select(F.col("a.id").alias("qid"), F.col("b.id").alias("pid"), "dist")
        out = g.join(near, g["id"] == near["qid"]).join(v, "pid").groupBy("cx", "cy").agg(mean.alias("v"))
    else:
        out = _all_points(points.sparkSession, g, v, power)
    return out if default is None else out.withColumn("v", F.when(F.col("v") < 0, default).otherwise(F.col("v")))


def _all_points(spark, g: DataFrame, v: DataFrame, power: float) -> DataFrame:
    """Every point weighs on every cell. The cells, whose number the caller sets, go to all tasks; each task sums
    its own points for each cell, so what is shuffled is a row a cell and task and not a row a pair."""
    at = g.select("cx", "cy", "x", "y").toPandas()
    cells = spark.sparkContext.broadcast((at.cx.to_numpy(np.int32), at.cy.to_numpy(np.int32), at.x.to_numpy(), at.y.to_numpy()))

    def run(batches):
        cx, cy, x, y = cells.value
        top, bottom, here, hits = np.zeros((4, len(x)))
        some = False
        for b in batches:
            px, py, pv = (b.column(c).to_numpy() for c in ("px", "py", "pv"))
            for a in range(0, len(px), 256):
                d = np.hypot(x[:, None] - px[a : a + 256], y[:, None] - py[a : a + 256])
                on = d == 0
                w = np.where(on, 0.0, np.where(on, 1.0, d) ** -power)
                top += w @ pv[a : a + 256]
                bottom += w.sum(1)
                here += on @ pv[a : a + 256]
                hits += on.sum(1)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(cx), pa.array(cy), pa.array(top), pa.array(bottom), pa.array(here), pa.array(hits)], ["cx", "cy", "top", "bottom", "here", "hits"])

    part = v.mapInArrow(run, "cx int, cy int, top double, bottom double, here double, hits double")
    whole = F.when(F.sum("hits") > 0, F.sum("here") / F.sum("hits")).otherwise(F.sum("top") / F.sum("bottom"))
    return part.groupBy("cx", "cy").agg(whole.alias("v"))


def _solved(points: DataFrame, value: str, cols: int, rows: int, solve, evaluate, columns: str = "v double", merge: bool = False) -> DataFrame:
    """One task solves from all points (``merge``: from all places); the cells join its state and are evaluated in batches."""
    import pickle

    rows_ = points.select("id", "x", "y", F.col(value).cast("double").alias("v")).dropna()
    if merge:
        rows_ = rows_.groupBy("x", "y").agg(F.min("id").alias("id"), F.avg("v").alias("v"))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x, y, v = (t[c].to_numpy() for c in ("x", "y", "v"))
        return pa.table({"state": pa.array([pickle.dumps(solve(x, y, v))], pa.binary())})

    state = rows_.groupBy().applyInArrow(one, "state binary")

    names = ["cx", "cy", *(c.split()[0] for c in columns.split(", "))]

    def run(mine: pa.Table, given: pa.Table) -> pa.Table:
        if not mine.num_rows or not given.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n in ("cx", "cy") else pa.float64()) for n in names})
        held, out = pickle.loads(given["state"][0].as_py()), []
        x, y = mine["x"].to_numpy(), mine["y"].to_numpy()
        for a in range(0, len(x), 4096):
            got = evaluate(held, x[a : a + 4096], y[a : a + 4096])
            out.append(got if isinstance(got, tuple) else (got,))
        return pa.table(dict(zip(names, [mine["cx"], mine["cy"], *(np.concatenate(c) for c in zip(*out))])))

    parts = max(1, min(32, cols * rows // 4096 + 1))  # tasks; each gets the state once
    g = grid(points, cols, rows).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    each = state.select("state", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return g.groupBy("part").cogroup(each.groupBy("part")).applyInArrow(run, f"cx int, cy int, {columns}")


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Corners of the convex hull, counterclockwise."""
    order = np.lexsort((y, x)).tolist()
    xs, ys, half = x.tolist(), y.tolist(), []
    for line in (order, order[::-1]):
        c: list[int] = []
        for i in line:
            while len(c) > 1 and (xs[c[-1]] - xs[c[-2]]) * (ys[i] - ys[c[-2]]) - (ys[c[-1]] - ys[c[-2]]) * (xs[i] - xs[c[-2]]) <= 0:
                c.pop()
            c.append(i)
        half.append(c[:-1] if len(c) > 1 else c)
    return list(dict.fromkeys(half[0] + half[1]))


def _places(points: DataFrame, value: str) -> tuple[np.ndarray, ...]:
    """x, y, number of points, their values' mean and variance of each distinct place, in the order of the least id.

    Points of one place have equal rows in a system, so its least-norm solution shares their place's weight equally."""
    p = points.select("id", "x", "y", F.col(value).cast("double").alias("v")).dropna()
    t = p.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).toArrow().sort_by("id")
    return tuple(t[c].to_numpy() for c in ("x", "y", "n", "m", "s"))


def _at_cells(points: DataFrame, cols: int, rows: int, state, evaluate) -> DataFrame:
    """(cx, cy, v): evaluate(state, x, y) at the cells, by tasks that share the state."""
    held = points.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        for b in batches:
            v = evaluate(held.value, b["x"].to_numpy(), b["y"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["cx"], b["cy"], pa.array(v, pa.float64())], ["cx", "cy", "v"])

    return grid(points, cols, rows).select("cx", "cy", "x", "y").mapInArrow(run, "cx int, cy int, v double")


def _shares(x: np.ndarray, y: np.ndarray, abc) -> np.ndarray:
    """Barycentric coordinates of the origin in a triangle of places relative to it."""
    (ax, bx, cx), (ay, by, cy) = x[list(abc)], y[list(abc)]
    u, v, w = bx * cy - cx * by, cx * ay - ax * cy, ax * by - bx * ay
    return np.array([u, v, w]) / (u + v + w)


def _triangle(x: np.ndarray, y: np.ndarray, hull: list[int]) -> tuple[tuple[int, int, int], np.ndarray] | None:
    """The Delaunay triangle around the origin and the origin's shares of its corners; None outside of the hull.

    It is the facet under the origin of the lower hull of the places lifted to x^2 + y^2: from a triangle of the hull's
    corners, the place farthest below the triangle's plane takes the place of a corner until none is below. Where more
    than three places are on its circle, they are cut from the one that is least by x and y."""
    best = None
    for b, c in zip(hull[1:], hull[2:]):
        s = _shares(x, y, (hull[0], b, c))
        if best is None or s.min() > best[1].min():
            best = (hull[0], b, c), s
    if best is None or best[1].min() < -1e-12:
        return None
    abc, z = list(best[0]), x * x + y * y
    for _ in range(10_000):
        a, b, c = abc
        plane = np.linalg.solve(np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]]), [z[b] - z[a], z[c] - z[a]])
        over = z - (z[a] + (x - x[a]) * plane[0] + (y - y[a]) * plane[1])
        near = 1e-9 * max(float(((x[abc] - plane[0] / 2) ** 2 + (y[abc] - plane[1] / 2) ** 2).max()), 1e-300)
        over[abc] = 0.0
        d = int(over.argmin())
        if over[d] >= -near:
            break
        s, t = _shares(x, y, abc), _shares(x - x[d], y - y[d], abc)
        abc[int(np.where(t > 1e-12, np.maximum(s, 0) / np.where(t > 1e-12, t, 1), np.inf).argmin())] = d
    ring = np.flatnonzero(np.abs(over) <= near)
    if len(ring) > 3:
        ring = ring[np.argsort(np.arctan2(y[ring] - y[ring].mean(), x[ring] - x[ring].mean()))]
        ring = np.roll(ring, -int(np.lexsort((y[ring], x[ring]))[0])).tolist()
        abc = max(((ring[0], b, c) for b, c in zip(ring[1:], ring[2:])), key=lambda i: _shares(x, y, i).min())
    return tuple(abc), _shares(x, y, abc)


def linear(points: DataFrame, value: str, cols: int = 20, rows: int = 20) -> DataFrame:
    """(cx, cy, v): barycentric in Delaunay triangles; outside of the hull the nearest point's value.

    Of the triangles only those around a cell are made, each from all places in a few passes. Of points of one place
    the one of the least id counts."""
    p = points.select("id", "x", "y", F.col(value).cast("double").alias("v")).dropna()
    t = p.groupBy("x", "y").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v")).toArrow().sort_by("id")
    x, y, v = (t[c].to_numpy() for c in ("x", "y", "v"))
    if not len(x):
        return points.sparkSession.createDataFrame([], "cx int, cy int, v double")

    def evaluate(s, gx, gy):
        x, y, v, hull = s
        out = np.empty(len(gx))
        for i in range(len(gx)):
            px, py = x - gx[i], y - gy[i]
            got = _triangle(px, py, hull)
            out[i] = v[(px**2 + py**2).argmin()] if got is None else got[1] @ v[list(got[0])]
        return out

    return _at_cells(points, cols, rows, (x, y, v, _hull(x, y)), evaluate)


def _phi(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0)


def thin_plate_spline(points: DataFrame, value: str, cols: int = 20, rows: int = 20) -> DataFrame:
    """(cx, cy, v): the surface through all points that bends least."""

    def solve(x, y, v):
        # in centred units of the largest reach: the surface stays the same, the system is well conditioned
        x0, y0 = x.mean(), y.mean()
        unit = max(np.ptp(x), np.ptp(y)) or 1.0
        x, y, n = (x - x0) / unit, (y - y0) / unit, len(x)
        p = np.column_stack([np.ones(n), x, y])
        a = np.block([[_phi((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2), p], [p.T, np.zeros((3, 3))]])
        return x, y, x0, y0, unit, np.linalg.lstsq(a, np.concatenate([v, np.zeros(3)]), rcond=None)[0]

    def evaluate(s, gx, gy):
        x, y, x0, y0, unit, w = s
        gx, gy = (gx - x0) / unit, (gy - y0) / unit
        out = w[-3] + w[-2] * gx + w[-1] * gy
        for i, j, d in blocks(x, y, 0, len(gx), at=(gx, gy)):
            out[i] += _phi(d) @ w[:-3][j]
        return out

    x, y, _, v, _ = _places(points, value)
    if len(x) > DIRECT:
        x0, y0 = x.mean(), y.mean()
        unit = max(np.ptp(x), np.ptp(y)) or 1.0
        x, y = (x - x0) / unit, (y - y0) / unit
        system = System(points.sparkSession.sparkContext, x, y, _phi, 1)
        w, c = system.solve(v[:, None])
        system.close()
        return _at_cells(points, cols, rows, (x, y, x0, y0, unit, np.concatenate([w[:, 0], c[:, 0]])), evaluate)
    return _solved(points, value, cols, rows, solve, evaluate, merge=True)


def b_spline(points: DataFrame, value: str, cols: int = 20, rows: int = 20, knots: int = 8, ridge: float = 1e-3) -> DataFrame:
    """(cx, cy, v): a cubic uniform B-spline surface by ridge regression."""

    def basis(t: np.ndarray) -> np.ndarray:
        i = np.minimum(np.floor(t).astype(int), knots - 1)
        u = t - i
        out = np.zeros((len(t), knots + 3))
        for k, f in enumerate(((1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3)):
            out[np.arange(len(t)), i + k] = f / 6
        return out

    def design(box, x, y):
        x0, y0, x1, y1 = box
        bx, by = basis(np.clip((x - x0) / (x1 - x0), 0, 1) * knots), basis(np.clip((y - y0) / (y1 - y0), 0, 1) * knots)
        return (bx[:, :, None] * by[:, None, :]).reshape(len(x), -1)

    p = points.select("x", "y", F.col(value).cast("double").alias("v")).dropna()
    x0, y0, x1, y1, middle = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.avg("v")).first()
    if x0 is None:
        return points.sparkSession.createDataFrame([], "cx int, cy int, v double")
    box = x0, y0, max(x1, x0 + 1e-9), max(y1, y0 + 1e-9)

    def sums(batches):  # each task's part of the normal equations
        size = (knots + 3) ** 2
        whole = np.zeros((size, size + 1))
        for b in batches:
            x, y, v = (b[c].to_numpy() for c in ("x", "y", "v"))
            for i in range(0, len(x), 4096):
                a = design(box, x[i : i + 4096], y[i : i + 4096])
                whole += a.T @ np.column_stack([a, v[i : i + 4096] - middle])
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["part"])

    whole = sum(np.frombuffer(r.part).reshape((knots + 3) ** 2, -1) for r in p.mapInArrow(sums, "part binary").toLocalIterator())
    w = np.linalg.solve(whole[:, :-1] + ridge * np.eye(len(whole)), whole[:, -1])
    return _at_cells(points, cols, rows, (box, middle, w), lambda s, x, y: design(s[0], x, y) @ s[2] + s[1])


def variogram(model: str, nugget: float, sill: float, reach: float):
    """gamma(h) of Sph, Exp, Gau or Lin; 0 at 0."""

    def f(h: np.ndarray) -> np.ndarray:
        t = h / reach
        if model == "Sph":
            t = np.minimum(t, 1.0)
            rise = t * (1.5 - 0.5 * t * t)
        else:
            rise = {"Exp": lambda: 1 - np.exp(-3 * t), "Gau": lambda: 1 - np.exp(-3 * t * t), "Lin": lambda: np.minimum(t, 1.0)}[model]()
        g = nugget + (sill - nugget) * rise
        return np.where(h > 0, g, 0.0) if nugget else g  # no rise at 0

    return f


def empirical_variogram(sc, x: np.ndarray, y: np.ndarray, n: np.ndarray, v: np.ndarray, s: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and half squared differences of all pairs of points, as means of bins up to half of the largest distance.

    Of distinct places with their number of points, mean and variance; each task goes over its part of the pairs."""
    hull = np.array(_hull(x, y))
    longest = np.hypot(x[hull, None] - x[hull], y[hull, None] - y[hull]).max()
    width = longest / 2 / bins or 1.0
    shared = sc.broadcast((x, y, n, v, s))

    def work(begin: int, end: int):
        x, y, n, v, s = shared.value
        count, total = np.zeros(bins + 1), np.zeros(bins + 1)
        for i, j, d in blocks(x, y, begin, end):
            k = np.minimum(np.sqrt(d) / width, bins).astype(np.int32).ravel()
            m = n[i, None] * n[j]
            count += np.bincount(k, m.ravel(), bins + 1)
            total += np.bincount(k, (m * ((v[i, None] - v[j]) ** 2 + s[i, None] + s[j])).ravel(), bins + 1)
        return count, total

    count, total = (np.sum(c, 0)[:bins] / 2 for c in zip(*spread(sc, work, len(x))))
    shared.destroy()
    count[0] -= n.sum() / 2  # a point with itself
    total = total / 2
    some = count > 0.25
    return (np.arange(bins)[some] + 0.5) * width, total[some] / count[some]


def fit_variogram(h: np.ndarray, g: np.ndarray, model: str) -> tuple[float, float, float]:
    """(nugget, sill, range) of least squares: a search over ranges, linear in the rest."""
    best = (np.inf, 0.0, float(g.max()) if len(g) else 1.0, float(h.max()) if len(h) else 1.0)
    for reach in np.linspace(0.1, 2, 40) * (h.max() if len(h) else 1.0):
        r = variogram(model, 0.0, 1.0, reach)(h)
        a = np.column_stack([1 - r, r])
        c = np.maximum(np.linalg.lstsq(a, g, rcond=None)[0], 0)
        e = float(((a @ c - g) ** 2).sum())
        if e < best[0]:
            best = (e, float(c[0]), float(max(c[1], 1e-12)), float(reach))
    return best[1:]


def kriging(points: DataFrame, value: str, cols: int = 20, rows: int = 20, model: str = "Sph", bins: int = 20, nugget: float | None = None, sill: float | None = None, reach: float | None = None, mean: float | None = None) -> DataFrame:
    """(cx, cy, v, variance): ordinary kriging, or simple kriging around a known mean.

    The variogram is fitted to the points unless nugget, sill and range are given.
    """

    sc = points.sparkSession.sparkContext
    px, py, pn, pv, ps = _places(points, value)
    if not len(px):
        return points.sparkSession.createDataFrame([], "cx int, cy int, v double, variance double")
    par = (nugget or 0.0, sill, reach) if sill and reach else fit_variogram(*empirical_variogram(sc, px, py, pn, pv, ps, bins), model)
    if len(px) > DIRECT:
        try:
            return _kriged(points, px, py, pv, cols, rows, model, par, mean)
        except NotDefinite:
            pass  # such a variogram's matrix can only be solved as a whole

    def solve(x, y, v):
        f = variogram(model, *par)
        g = f(np.hypot(x[:, None] - x, y[:, None] - y))
        if mean is not None:
            return x, y, v, par, np.linalg.pinv(par[1] - g)
        n = len(x)
        return x, y, v, par, np.linalg.pinv(np.block([[g, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]]))

    def evaluate(s, gx, gy):
        x, y, v, par, inv = s
        g = variogram(model, *par)(np.hypot(gx[:, None] - x, gy[:, None] - y))
        if mean is not None:
            c = par[1] - g
            w = c @ inv
            return mean + w @ (v - mean), par[1] - (w * c).sum(1)
        b = np.column_stack([g, np.ones(len(gx))])
        w = b @ inv
        return w[:, :-1] @ v, (w * b).sum(1)

    return _solved(points, value, cols, rows, solve, evaluate, "v double, variance double", merge=True)


def _kriged(points: DataFrame, x: np.ndarray, y: np.ndarray, v: np.ndarray, cols: int, rows: int, model: str, par: tuple, mean: float | None) -> DataFrame:
    """Kriging of more places than a matrix could hold: the weights of some cells at a time."""
    f = variogram(model, *par)
    kernel = (lambda d: -f(np.sqrt(d))) if mean is None else (lambda d: par[1] - f(np.sqrt(d)))
    at = grid(points, cols, rows).select("cx", "cy", "x", "y").toArrow()
    cx, cy, gx, gy = (at[c].to_numpy() for c in ("cx", "cy", "x", "y"))
    system = System(points.sparkSession.sparkContext, x, y, kernel, 0 if mean is None else None)
    step, out = max(1, 2**22 // len(x)), []
    for a in range(0, len(gx), step):
        b = kernel((x[:, None] - gx[a : a + step]) ** 2 + (y[:, None] - gy[a : a + step]) ** 2)
        w, c = system.solve(b, np.ones((1, b.shape[1])) if mean is None else None)
        out.append((w.T @ v, -(w * b).sum(0) - c[0]) if mean is None else (mean + w.T @ (v - mean), par[1] - (w * b).sum(0)))
    system.close()
    v, variance = (np.concatenate(o) for o in zip(*out))
    return points.sparkSession.createDataFrame(pa.table({"cx": pa.array(cx, pa.int32()), "cy": pa.array(cy, pa.int32()), "v": v, "variance": variance}))


def local_kriging(points: DataFrame, value: str, cols: int = 20, rows: int = 20, model: str = "Sph", nugget: float = 0.0, sill: float = 1.0, reach: float = 1.0, k: int = 16) -> DataFrame:
    """(cx, cy, v, variance): ordinary kriging from each cell's k nearest points, with a given variogram.

    A cell's system has k + 1 unknowns, whatever the number of points; cells are solved in
    Arrow batches. With k as large as the number of points it is ``kriging``.
    """
    p = points.select("id", "x", "y", F.col(value).cast("double").alias("v")).dropna()
    g = grid(points, cols, rows)
    near = knn(g, p, k).select(F.col("qid").alias("cell"), F.col("id").alias("pid"), "rank")
    sets = near.join(p.select(F.col("id").alias("pid"), "x", "y", "v"), "pid").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "v"))).alias("n"))
    at = g.join(sets, g["id"] == sets["cell"]).select("cx", "cy", "x", "y", "n")
    f = variogram(model, nugget, sill, reach)

    @F.arrow_udf("struct<v: double, variance: double>")
    def solve(x: pa.Array, y: pa.Array, n: pa.Array) -> pa.Array:
        flat, sizes = n.flatten(), np.diff(n.offsets.to_numpy())
        px, py, pv = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "v"))
        gx, gy, begin = x.to_numpy(), y.to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        value_, variance = np.zeros(len(gx)), np.zeros(len(gx))
        for m in np.unique(sizes):
            i = np.flatnonzero(sizes == m)
            j = begin[i][:, None] + np.arange(m)
            a = np.ones((len(i), m + 1, m + 1))
            a[:, :m, :m] = f(np.hypot(px[j][:, :, None] - px[j][:, None, :], py[j][:, :, None] - py[j][:, None, :]))
            a[:, m, m] = 0
            b = np.ones((len(i), m + 1))
            b[:, :m] = f(np.hypot(gx[i][:, None] - px[j], gy[i][:, None] - py[j]))
            w = (np.linalg.pinv(a) @ b[:, :, None])[:, :, 0]
            value_[i], variance[i] = (w[:, :m] * pv[j]).sum(1), (w * b).sum(1)
        return pa.StructArray.from_arrays([pa.array(value_), pa.array(variance)], ["v", "variance"])

    return at.select("cx", "cy", solve("x", "y", "n").alias("s")).select("cx", "cy", "s.v", "s.variance")
