"""Global, spatially autoregressive and geographically weighted regression.

Least squares and generalised linear models need only sums, so Spark aggregates X'WX and
X'Wy and the driver solves a system as large as the number of variables. Geographically
weighted models aggregate the same sums for every location over a join of locations and
observations (by grid cells where the kernel ends at the bandwidth) and solve them in
Arrow batches. Autoregressive models need the weights' eigenvalues; one task fits them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from .spatial import distance_join, knn


def _sums(w: Column | None, xs: list[Column], y: Column) -> list[Column]:
    one = w if w is not None else F.lit(1.0)
    k = len(xs)
    return [F.sum(one * xs[i] * xs[j]) for i in range(k) for j in range(i, k)] + [F.sum(one * x * y) for x in xs]


def _system(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    a, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[at] or 0.0
            at += 1
    return a, np.array([v or 0.0 for v in row[at : at + k]])


def _x(xs: list[str], intercept: bool) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [F.col(x).cast("double") for x in xs]


def _eta(beta: np.ndarray, xs: list[Column]) -> Column:
    out = F.lit(0.0)
    for b, x in zip(beta, xs):
        out = out + float(b) * x
    return out


def ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> tuple[DataFrame, dict]:
    """(rows with yhat and residual, {coefficients, r2, adjusted_r2, f, aic})."""
    df = df.dropna(subset=[y, *xs])
    cols, t = _x(xs, intercept), F.col(y).cast("double")
    k = len(cols)
    row = df.agg(*_sums(None, cols, t), F.count("*"), F.sum(t), F.sum(t * t)).first()
    a, b = _system(row, k)
    beta = np.linalg.pinv(a) @ b
    n, s, ss = row[-3], row[-2] or 0.0, row[-1] or 0.0
    got = df.withColumn("yhat", _eta(beta, cols)).withColumn("residual", t - F.col("yhat"))
    rss = got.agg(F.sum(F.col("residual") ** 2)).first()[0] or 0.0
    sst = ss - s * s / n if intercept and n else ss
    p = k - intercept
    r2 = 1 - rss / sst if sst else math.nan
    info = {"coefficients": dict(zip((["intercept"] if intercept else []) + xs, map(float, beta))), "r2": r2, "n": n, "rss": rss}
    if n > k:
        info |= {"adjusted_r2": 1 - (1 - r2) * (n - intercept) / (n - k), "f": (sst - rss) / p / (rss / (n - k)) if p and rss else math.nan, "aic": n * math.log(rss / n) + 2 * k if rss > 0 else -math.inf}
    return got, info


def glm(df: DataFrame, y: str, xs: list[str], family: str, intercept: bool = True, most: int = 100, epsilon: float = 1e-8) -> tuple[DataFrame, dict]:
    """Logistic or poisson regression by reweighted least squares; one aggregation a round."""
    df = checkpointed(df.dropna(subset=[y, *xs]))
    cols, t = _x(xs, intercept), F.col(y).cast("double")
    k = len(cols)
    beta = np.zeros(k)
    if family == "poisson" and intercept:
        beta[0] = math.log(max(df.agg(F.avg(t)).first()[0] or 1.0, 1e-9))

    def mean(b: np.ndarray) -> Column:
        e = F.least(F.greatest(_eta(b, cols), F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-e)) if family == "logistic" else F.exp(e)

    for rounds in range(1, most + 1):  # noqa: B007
        mu, eta = mean(beta), _eta(beta, cols)
        w = mu * (1 - mu) if family == "logistic" else mu
        a, b = _system(df.agg(*_sums(w, cols, eta + (t - mu) / F.greatest(w, F.lit(1e-12)))).first(), k)
        new = np.linalg.pinv(a) @ b
        done = np.abs(new - beta).max() < epsilon * (1 + np.abs(beta).max())
        beta = new
        if done:
            break
    else:
        raise ValueError(f"no convergence in {most} rounds")
    mu = mean(beta)
    if family == "logistic":
        dev = -2 * (t * F.log(mu) + (1 - t) * F.log(1 - mu))
        loglik = -dev / 2
    else:
        dev = 2 * (F.when(t > 0, t * F.log(t / mu)).otherwise(0.0) - (t - mu))
        loglik = t * F.log(mu) - mu
    got = df.withColumn("yhat", mu).withColumn("residual", t - F.col("yhat"))
    d = df.agg(F.sum(dev), F.sum(loglik)).first()
    return got, {"coefficients": dict(zip((["intercept"] if intercept else []) + xs, map(float, beta))), "deviance": d[0], "aic": -2 * (d[1] or 0.0) + 2 * k, "rounds": rounds}


# --- spatially autoregressive models ---


def _golden(f, lo: float, hi: float, tol: float = 1e-8) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def nelder_mead(f, start: np.ndarray, step: float = 0.1, tol: float = 1e-9, most: int = 2000) -> np.ndarray:
    """The minimum of a function of a few variables by the simplex of Nelder and Mead; an infinite value is out of bounds."""
    n = len(start)
    points = np.vstack([start, *[start + step * e for e in np.eye(n)]])
    values = np.array([f(p) for p in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(points[1:] - points[0]).max() < tol and abs(values[-1] - values[0]) <= tol * (1 + abs(values[0])):
            return points[0]
        middle = points[:-1].mean(0)
        at = lambda t: middle + t * (points[-1] - middle)  # noqa: B023, E731
        mirror = f(at(-1))
        if mirror < values[0]:
            far = f(at(-2))
            points[-1], values[-1] = (at(-2), far) if far < mirror else (at(-1), mirror)
        elif mirror < values[-2]:
            points[-1], values[-1] = at(-1), mirror
        else:
            t = -0.5 if mirror < values[-1] else 0.5
            near = f(at(t))
            if near < min(mirror, values[-1]):
                points[-1], values[-1] = at(t), near
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    raise ValueError(f"no convergence in {most} steps")


def fit_sar(x: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str) -> dict:
    """Maximum likelihood of y = rho W y + X b + u, u = lambda W u + e; lag, error, sac or durbin (lag with WX)."""
    n = len(y)
    if kind == "durbin":
        wx = w @ x
        x, kind = np.column_stack([x, wx[:, np.ptp(wx, axis=0) > 1e-12]]), "lag"
    ev = np.linalg.eigvals(w).real
    lo, hi = 1 / ev.min() + 1e-6 if ev.min() < 0 else -0.99, 1 / ev.max() - 1e-6

    def parts(rho: float, lam: float):
        ys = y - rho * (w @ y)
        xs, yt = x - lam * (w @ x), ys - lam * (w @ ys)
        b = np.linalg.lstsq(xs, yt, rcond=None)[0]
        e = yt - xs @ b
        return b, e, e @ e / n

    def minus(rho: float, lam: float) -> float:
        s2 = parts(rho, lam)[2]
        return n / 2 * math.log(2 * math.pi * s2) + n / 2 - np.log(np.abs(1 - rho * ev)).sum() - np.log(np.abs(1 - lam * ev)).sum()

    if kind == "lag":
        rho, lam = _golden(lambda r: minus(r, 0.0), lo, hi), 0.0
    elif kind == "error":
        rho, lam = 0.0, _golden(lambda v: minus(0.0, v), lo, hi)
    else:
        inside = lambda v: lo < v[0] < hi and lo < v[1] < hi
        rho, lam = nelder_mead(lambda v: minus(*v) if inside(v) else math.inf, np.zeros(2))
    b, e, s2 = parts(rho, lam)
    fitted = np.linalg.solve(np.eye(n) - rho * w, x @ b) if rho else x @ b
    return {"rho": rho, "lambda": lam, "beta": b, "sigma2": s2, "loglik": -minus(rho, lam), "fitted": fitted, "residual": y - fitted}


def spatial_regression(df: DataFrame, y: str, xs: list[str], weights: DataFrame, kind: str = "lag") -> DataFrame:
    """(id, yhat, residual, rho, lambda, loglik, beta) of each row; kind is lag, error, sac or durbin.

    The likelihood needs all eigenvalues of the n by n weights, so one task fits it: for
    samples of some thousands.
    """
    rows = df.dropna(subset=[y, *xs]).select("id", F.array(F.col(y).cast("double"), *[F.col(x).cast("double") for x in xs]).alias("v"))
    nb = weights.groupBy("i").agg(F.collect_list(F.struct("j", "w")).alias("nb"))
    t = rows.join(nb, rows["id"] == nb["i"], "left").select("id", "v", "nb")
    kind_id = df.schema["id"].dataType.simpleString()

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t["id"].to_pylist()
        place = {i: k for k, i in enumerate(ids)}
        v = np.array(t["v"].to_pylist(), float).reshape(len(ids), -1)
        w = np.zeros((len(ids), len(ids)))
        for k, nb in enumerate(t["nb"].to_pylist()):
            for e in nb or []:
                if e["j"] in place:
                    w[k, place[e["j"]]] = e["w"]
        r = fit_sar(np.column_stack([np.ones(len(ids)), v[:, 1:]]), v[:, 0], w, kind)
        n = len(ids)
        return pa.table({"id": t["id"], "yhat": r["fitted"], "residual": r["residual"], "rho": np.full(n, r["rho"]), "lambda": np.full(n, r["lambda"]), "loglik": np.full(n, r["loglik"]), "beta": pa.array([[float(b) for b in r["beta"]]] * n)})

    return t.groupBy().applyInArrow(fit, f"id {kind_id}, yhat double, residual double, rho double, lambda double, loglik double, beta array<double>")


# --- geographically weighted models ---

COMPACT = ("bisquare", "tricube", "boxcar")
# Kernels are followed until their weight is LEAST, which no sum of doubles can see; in bandwidths.
LEAST = 1e-17
REACH = {"gaussian": math.sqrt(-2 * math.log(LEAST)), "exponential": -math.log(LEAST), "bisquare": 1.0, "tricube": 1.0, "boxcar": 1.0}


def kernel(name: str, d: Column, bw: Column) -> Column:
    t = d / bw
    return {
        "gaussian": lambda: F.exp(-0.5 * t * t),
        "exponential": lambda: F.exp(-t),
        "bisquare": lambda: F.when(t < 1, (1 - t * t) ** 2).otherwise(0.0),
        "tricube": lambda: F.when(t < 1, (1 - t**3) ** 3).otherwise(0.0),
        "boxcar": lambda: F.when(t <= 1, 1.0).otherwise(0.0),
    }[name]()


def weighted_pairs(places: DataFrame, observations: DataFrame, bandwidth: float, name: str = "gaussian", adaptive: bool = False, lam: float | None = None) -> DataFrame:
    """(i, o, w): each place's id, each observation as a struct, and its weight.

    Adaptive: the bandwidth is a number of neighbours, and a place's own bandwidth the
    distance of the last of them. With ``lam`` the distance joins space and time (column t):
    lam ds + (1 - lam) dt + 2 sqrt(lam (1 - lam) ds dt), for observations that aren't later.
    """
    k = int(bandwidth)
    if lam is not None:
        return _in_time(places, observations, bandwidth, name, adaptive, lam)
    if adaptive and name in COMPACT:  # the weight is 0 at the last of the k neighbours and beyond (boxcar: 1 up to it)
        near = knn(places.select("id", "x", "y"), observations, k)
        far = near.groupBy("qid").agg(F.max("dist").alias("bw"))
        pairs = near.join(far, "qid").join(observations.select(F.col("id").alias("__o"), F.struct(*observations.columns).alias("o")), F.col("id") == F.col("__o"))
        return pairs.select(F.col("qid").alias("i"), "o", kernel(name, F.col("dist"), _wider(F.col("bw"))).alias("w")).where("w > 0")
    if adaptive:
        far = checkpointed(knn(places.select("id", "x", "y"), observations, k).groupBy("qid").agg(F.max("dist").alias("bw")))
        widest = far.agg(F.max("bw")).first()[0] or 0.0
        near = distance_join(places.select("id", "x", "y").join(far, F.col("id") == F.col("qid")).select("id", "x", "y", "bw"), observations, max(widest, 1e-12) * REACH[name], "less_equal")
        return near.select(F.col("a.id").alias("i"), F.col("b").alias("o"), kernel(name, F.col("dist"), _wider(F.col("a.bw"))).alias("w")).where(F.col("w") > LEAST)
    near = distance_join(places.select("id", "x", "y"), observations, bandwidth * REACH[name], "less_equal")
    return near.select(F.col("a.id").alias("i"), F.col("b").alias("o"), kernel(name, F.col("dist"), F.lit(float(bandwidth))).alias("w")).where(F.col("w") > LEAST)


def _wider(bw: Column) -> Column:
    return F.greatest(bw, F.lit(1e-12)) * (1 + 1e-9)


def _in_time(places: DataFrame, observations: DataFrame, bandwidth: float, name: str, adaptive: bool, lam: float) -> DataFrame:
    """Pairs by the distance in space and time. Neither part of it can be longer than the whole, so with a fixed
    bandwidth candidates come from a join by distance; an adaptive one needs all pairs."""
    d = lambda ds, dt: lam * ds + (1 - lam) * dt + 2 * F.sqrt(lam * (1 - lam) * ds * dt)
    if adaptive or lam <= 0:
        p, o = places.select(F.struct(*places.columns).alias("p")), observations.select(F.struct(*observations.columns).alias("o"))
        ds = F.sqrt((F.col("p.x") - F.col("o.x")) ** 2 + (F.col("p.y") - F.col("o.y")) ** 2)
        dt = F.col("p.t") - F.col("o.t")
        pairs = p.crossJoin(o).where(dt >= 0).select(F.col("p.id").alias("i"), "o", d(ds, dt).alias("d"))
    else:
        near = distance_join(places.select("id", "x", "y", "t"), observations, bandwidth * REACH[name] / lam, "less_equal")
        dt = F.col("a.t") - F.col("b.t")
        pairs = near.where(dt >= 0).select(F.col("a.id").alias("i"), F.col("b").alias("o"), d(F.col("dist"), dt).alias("d"))
    if adaptive:
        far = pairs.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d"))).where(F.col("r") <= int(bandwidth)).groupBy("i").agg(F.max("d").alias("bw"))
        pairs, bw = pairs.join(far, "i"), _wider(F.col("bw"))
    else:
        bw = F.lit(float(bandwidth))
    return pairs.select("i", "o", kernel(name, F.col("d"), bw).alias("w")).where(F.col("w") > LEAST)


def gwr(df: DataFrame, y: str, xs: list[str], bandwidth: float, kernel_name: str = "gaussian", adaptive: bool = False, lam: float | None = None, places: DataFrame | None = None) -> DataFrame:
    """(id, beta, yhat, residual): local coefficients (intercept first) at every place.

    Without ``places`` these are the observations (id, x, y, and t if ``lam`` is given);
    with them, residuals are null. This is GWR, and GTWR with ``lam``.
    """
    df = df.dropna(subset=[y, *xs])
    k = len(xs) + 1
    obs = df.select("id", "x", "y", *(["t"] if lam is not None else []), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs, 1)], F.col(y).cast("double").alias("v0"))
    at = obs if places is None else places.select("id", "x", "y", *(["t"] if lam is not None else []), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs, 1)])
    pairs = weighted_pairs(at, obs, bandwidth, kernel_name, adaptive, lam)
    cols = [F.lit(1.0)] + [F.col(f"o.v{i}") for i in range(1, k)]
    sums = pairs.groupBy("i").agg(F.array(*_sums(F.col("w"), cols, F.col("o.v0"))).alias("s"))

    @F.arrow_udf("array<double>")
    def solve(s: pa.Array) -> pa.Array:
        out = []
        for row in s.to_pylist():
            a, b = _system(row, k)
            out.append((np.linalg.pinv(a) @ b).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    got = at.join(sums.select("i", solve("s").alias("beta")), at["id"] == F.col("i"))
    yhat = F.element_at("beta", 1)
    for i in range(1, k):
        yhat = yhat + F.element_at("beta", i + 1) * F.col(f"v{i}")
    got = got.withColumn("yhat", yhat)
    return got.select("id", "beta", "yhat", (F.col("v0") - F.col("yhat") if places is None else F.lit(None).cast("double")).alias("residual"))


def gwr_cv(df: DataFrame, y: str, xs: list[str], bandwidth: float, kernel_name: str, adaptive: bool) -> float:
    """Sum of squared errors when each place is predicted without its own observation."""
    df = df.dropna(subset=[y, *xs])
    k = len(xs) + 1
    obs = df.select("id", "x", "y", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs, 1)], F.col(y).cast("double").alias("v0"))
    pairs = weighted_pairs(obs, obs, bandwidth, kernel_name, adaptive).where("i != o.id")
    cols = [F.lit(1.0)] + [F.col(f"o.v{i}") for i in range(1, k)]
    sums = pairs.groupBy("i").agg(F.array(*_sums(F.col("w"), cols, F.col("o.v0"))).alias("s"))

    @F.arrow_udf("double")
    def predict(s: pa.Array, v: pa.Array) -> pa.Array:
        out = []
        for row, x in zip(s.to_pylist(), v.to_pylist()):
            a, b = _system(row, k)
            out.append(float(np.linalg.pinv(a) @ b @ np.array(x)))
        return pa.array(out)

    got = obs.join(sums, obs["id"] == sums["i"]).select((F.col("v0") - predict("s", F.array(F.lit(1.0), *[F.col(f"v{i}") for i in range(1, k)]))).alias("e"))
    return got.agg(F.sum(F.col("e") ** 2)).first()[0] or math.inf


def gwr_bandwidth(df: DataFrame, y: str, xs: list[str], kernel_name: str = "gaussian", adaptive: bool = False, rounds: int = 12) -> float:
    """The bandwidth of least cross-validation error, by golden section."""
    b = df.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    lo, hi = (len(xs) + 3, b[2]) if adaptive else (math.hypot(b[0], b[1]) / 50, math.hypot(b[0], b[1]))
    tol = max(1.0 if adaptive else 0.0, (hi - lo) * 0.618**rounds)
    best = _golden(lambda v: gwr_cv(df, y, xs, round(v) if adaptive else v, kernel_name, adaptive), lo, hi, tol)
    return round(best) if adaptive else best


def gwr_select(df: DataFrame, y: str, xs: list[str], bandwidth: float, kernel_name: str = "gaussian", adaptive: bool = False, least: float = 3.0) -> list[str]:
    """Variables added one by one while n log(CV / n) falls by at least ``least``."""
    n, chosen, best = df.count(), [], math.inf
    while len(chosen) < len(xs):
        scores = {x: n * math.log(gwr_cv(df, y, [*chosen, x], bandwidth, kernel_name, adaptive) / n) for x in xs if x not in chosen}
        x = min(scores, key=lambda v: (scores[v], v))
        if scores[x] > best - least:
            break
        chosen.append(x)
        best = scores[x]
    return chosen


def gwr_generalized(df: DataFrame, y: str, xs: list[str], bandwidth: float, family: str = "poisson", kernel_name: str = "gaussian", adaptive: bool = False, most: int = 50) -> DataFrame:
    """(id, beta, yhat): local poisson or logistic models; each round one weighted aggregation."""
    df = df.dropna(subset=[y, *xs])
    k = len(xs) + 1
    obs = df.select("id", "x", "y", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs, 1)], F.col(y).cast("double").alias("v0"))
    pairs = checkpointed(weighted_pairs(obs, obs, bandwidth, kernel_name, adaptive))
    mean = obs.agg(F.avg("v0")).first()[0] or 0.5
    start = math.log(max(mean, 1e-9)) if family == "poisson" else 0.0
    beta = obs.select(F.col("id").alias("i"), F.array(F.lit(start), *[F.lit(0.0)] * (k - 1)).alias("beta"))
    cols = [F.lit(1.0)] + [F.col(f"o.v{i}") for i in range(1, k)]

    @F.arrow_udf("array<double>")
    def solve(s: pa.Array) -> pa.Array:
        return pa.array([(np.linalg.pinv((ab := _system(row, k))[0]) @ ab[1]).tolist() for row in s.to_pylist()], pa.list_(pa.float64()))

    def eta_of(c: list[Column]) -> Column:
        e = F.element_at("beta", 1)
        for i in range(1, k):
            e = e + F.element_at("beta", i + 1) * c[i]
        return F.least(F.greatest(e, F.lit(-30.0)), F.lit(30.0))

    for r in range(most):
        t = pairs.join(beta, "i").withColumn("eta", eta_of(cols))
        mu = F.exp("eta") if family == "poisson" else 1 / (1 + F.exp(-F.col("eta")))
        g = mu if family == "poisson" else F.greatest(mu * (1 - mu), F.lit(1e-9))
        z = F.col("eta") + (F.col("o.v0") - mu) / g
        new = checkpointed(t.groupBy("i").agg(F.array(*_sums(F.col("w") * g, cols, z)).alias("s")).select("i", solve("s").alias("beta")))
        moved = new.join(beta.withColumnRenamed("beta", "old"), "i").agg(F.max(F.array_max(F.zip_with("beta", "old", lambda a, b: F.abs(a - b))))).first()[0]
        beta = new
        if moved is None or moved < 1e-8:
            break
        if r == most - 1:
            raise ValueError(f"no convergence in {most} rounds: coefficients still moved by {moved:.3g}")
    own = [F.lit(1.0)] + [F.col(f"v{i}") for i in range(1, k)]
    t = obs.join(beta, obs["id"] == beta["i"]).withColumn("eta", eta_of(own))
    return t.select("id", "beta", (F.exp("eta") if family == "poisson" else 1 / (1 + F.exp(-F.col("eta")))).alias("yhat"))


def mgwr(df: DataFrame, y: str, xs: list[str], bandwidths: list[float], kernel_name: str = "bisquare", adaptive: bool = True, rounds: int = 20, tol: float = 1e-5) -> DataFrame:
    """(id, beta, yhat): a bandwidth for each term (intercept first), by backfitting local smooths.

    It ends when the squared error changes by less than ``tol``, or after ``rounds`` rounds.
    """
    df = df.dropna(subset=[y, *xs])
    k = len(xs) + 1
    obs = checkpointed(df.select("id", "x", "y", F.lit(1.0).alias("v1"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs, 2)], F.col(y).cast("double").alias("v0")))
    shape = obs.select("id", "x", "y", *[f"v{i}" for i in range(1, k + 1)])
    pairs = [checkpointed(weighted_pairs(shape.select("id", "x", "y"), shape.select("id", "x", "y", f"v{i}"), bandwidths[i - 1], kernel_name, adaptive).select("i", F.col("o.id").alias("j"), F.col(f"o.v{i}").alias("x"), "w")) for i in range(1, k + 1)]
    state = checkpointed(obs.select("id", "v0", *[f"v{i}" for i in range(1, k + 1)], *[(F.lit(0.0)).alias(f"b{i}") for i in range(1, k + 1)]))
    before = math.inf
    fit = lambda: sum((F.col(f"b{i}") * F.col(f"v{i}") for i in range(1, k + 1)), F.lit(0.0))
    for _ in range(rounds):
        for i in range(1, k + 1):
            part = state.select(F.col("id").alias("j"), (F.col("v0") - fit() + F.col(f"b{i}") * F.col(f"v{i}")).alias("r"))
            new = pairs[i - 1].join(part, "j").groupBy("i").agg((F.sum(F.col("w") * F.col("x") * F.col("r")) / F.nullif(F.sum(F.col("w") * F.col("x") ** 2), F.lit(0.0))).alias("nb"))
            state = checkpointed(state.join(new, state["id"] == new["i"]).withColumn(f"b{i}", F.coalesce("nb", F.lit(0.0))).drop("i", "nb"))
        rss = state.agg(F.sum((F.col("v0") - fit()) ** 2)).first()[0] or 0.0
        if abs(before - rss) <= tol * max(rss, 1e-12):
            break
        before = rss
    return state.select("id", F.array(*[f"b{i}" for i in range(1, k + 1)]).alias("beta"), fit().alias("yhat"))


def gw_average(df: DataFrame, names: list[str], bandwidth: float, kernel_name: str = "gaussian", adaptive: bool = False) -> DataFrame:
    """(id, <name>_mean, _sd, _skew, _cv): local moments."""
    obs = df.select("id", "x", "y", *[F.col(n).cast("double").alias(n) for n in names])
    pairs = weighted_pairs(obs.select("id", "x", "y"), obs, bandwidth, kernel_name, adaptive)
    w, out = F.col("w"), []
    for n in names:
        v = F.col(f"o.{n}")
        m1, m2, m3 = (F.sum(w * v**p) / F.sum(w) for p in (1, 2, 3))
        var = F.greatest(m2 - m1 * m1, F.lit(0.0))
        out += [m1.alias(f"{n}_mean"), F.sqrt(var).alias(f"{n}_sd"), ((m3 - 3 * m1 * m2 + 2 * m1**3) / F.nullif(F.pow(var, F.lit(1.5)), F.lit(0.0))).alias(f"{n}_skew"), (F.sqrt(var) / F.nullif(m1, F.lit(0.0))).alias(f"{n}_cv")]
    return pairs.groupBy(F.col("i").alias("id")).agg(*out)


def gw_correlation(df: DataFrame, a: str, b: str, bandwidth: float, kernel_name: str = "gaussian", adaptive: bool = False) -> DataFrame:
    """(id, cov, corr): local covariance and correlation."""
    obs = df.select("id", "x", "y", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    pairs = weighted_pairs(obs.select("id", "x", "y"), obs, bandwidth, kernel_name, adaptive)
    w, u, v = F.col("w"), F.col("o.a"), F.col("o.b")
    m = lambda c: F.sum(w * c) / F.sum(w)
    cov = m(u * v) - m(u) * m(v)
    return pairs.groupBy(F.col("i").alias("id")).agg(cov.alias("cov"), (cov / F.nullif(F.sqrt((m(u * u) - m(u) ** 2) * (m(v * v) - m(v) ** 2)), F.lit(0.0))).alias("corr"))


def gw_pca(df: DataFrame, names: list[str], bandwidth: float, keep: int = 2, kernel_name: str = "gaussian", adaptive: bool = False, robust: bool = False) -> DataFrame:
    """(id, variance, share, loading): local principal components; loadings of the first.

    ``robust`` takes the covariance from each place's neighbours by ``robust_covariance``, so
    a task then holds one place's neighbours; use a compact kernel.
    """
    obs = df.select("id", "x", "y", *[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    if robust:
        return _robust_pca(obs, weighted_pairs(obs.select("id", "x", "y"), obs, bandwidth, kernel_name, adaptive), len(names), keep)
    pairs, k, w = weighted_pairs(obs.select("id", "x", "y"), obs, bandwidth, kernel_name, adaptive), len(names), F.col("w")
    v = [F.col(f"o.v{i}") for i in range(k)]
    s = pairs.groupBy(F.col("i").alias("id")).agg(F.array(F.sum(w), *[F.sum(w * a) for a in v], *[F.sum(w * v[i] * v[j]) for i in range(k) for j in range(i, k)]).alias("s"))

    @F.arrow_udf("struct<variance: array<double>, share: array<double>, loading: array<double>>")
    def solve(a: pa.Array) -> pa.Array:
        out = []
        for row in a.to_pylist():
            total, mean, cov, at = row[0], np.array(row[1 : k + 1]) / row[0], np.zeros((k, k)), k + 1
            for i in range(k):
                for j in range(i, k):
                    cov[i, j] = cov[j, i] = row[at] / total - mean[i] * mean[j]
                    at += 1
            out.append(_components(cov, keep))
        return pa.array(out, pa.struct([(n, pa.list_(pa.float64())) for n in ("variance", "share", "loading")]))

    return s.select("id", solve("s").alias("p")).select("id", "p.*")


def _components(cov: np.ndarray, keep: int) -> dict:
    val, vec = np.linalg.eigh(cov)
    o = np.argsort(-val)
    first = vec[:, o[0]] * np.sign(vec[np.abs(vec[:, o[0]]).argmax(), o[0]])
    return {"variance": val[o[:keep]].tolist(), "share": (val[o[:keep]] / max(val.sum(), 1e-300)).tolist(), "loading": first.tolist()}


def weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    """The least value at which half of the weight is reached."""
    o = np.argsort(v, kind="stable")
    return float(v[o][np.searchsorted(np.cumsum(w[o]), 0.5 * w.sum())])


def robust_covariance(x: np.ndarray, w: np.ndarray, share: float = 0.75) -> np.ndarray:
    """Weighted covariance of the ``share`` of the weight that lies closest, by concentration steps from the
    weighted medians and median deviations; then of all rows within the 97.5 % point of the distances."""
    k = x.shape[1]
    centre = np.array([weighted_median(c, w) for c in x.T])
    scale = np.array([1.4826 * weighted_median(np.abs(c - m), w) for c, m in zip(x.T, centre)])
    cov = np.diag(np.where(scale > 0, scale, x.std(0) + 1e-12) ** 2)

    def moments_(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = w * use
        m = u @ x / u.sum()
        return m, (x - m).T @ ((x - m) * u[:, None]) / u.sum()

    before = None
    for _ in range(100):  # the determinant falls with each step, over finitely many subsets
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
        o = np.argsort(d, kind="stable")
        use = np.zeros(len(x), bool)
        use[o[: int(np.searchsorted(np.cumsum(w[o]), share * w.sum())) + 1]] = True
        if before is not None and (use == before).all():
            break
        before = use
        centre, cov = moments_(use)
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
    cov = cov * (weighted_median(d, w) / _chi2_quantile(0.5, k))
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
    return moments_(d <= _chi2_quantile(0.975, k))[1]


def _chi2_quantile(p: float, k: int) -> float:
    from ..functions import distributions as D

    lo, hi = 0.0, 10.0 * k + 50
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if D.chi2_sf(mid, k) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def _robust_pca(obs: DataFrame, pairs: DataFrame, k: int, keep: int) -> DataFrame:
    rows = pairs.select(F.col("i").alias("id"), "w", *[F.col(f"o.v{i}").alias(f"v{i}") for i in range(k)], F.col("o.id").alias("j"))
    kind = obs.schema["id"].dataType.simpleString()

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("j")
        got = _components(robust_covariance(np.stack([t[f"v{i}"].to_numpy() for i in range(k)], 1), t["w"].to_numpy()), keep)
        return pa.table({"id": t["id"].combine_chunks()[:1], **{n: pa.array([got[n]], pa.list_(pa.float64())) for n in ("variance", "share", "loading")}})

    return rows.groupBy("id").applyInArrow(solve, f"id {kind}, variance array<double>, share array<double>, loading array<double>")


def gw_discriminant(df: DataFrame, label: str, names: list[str], bandwidth: float, kernel_name: str = "gaussian", adaptive: bool = False) -> DataFrame:
    """(id, predicted): local linear discriminant analysis with a weighted pooled covariance."""
    obs = df.select("id", "x", "y", F.col(label).cast("string").alias("c"), *[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    pairs, k, w = weighted_pairs(obs.select("id", "x", "y"), obs, bandwidth, kernel_name, adaptive), len(names), F.col("w")
    v = [F.col(f"o.v{i}") for i in range(k)]
    each = pairs.groupBy("i", F.col("o.c").alias("c")).agg(F.array(F.sum(w), *[F.sum(w * a) for a in v], *[F.sum(w * v[i] * v[j]) for i in range(k) for j in range(i, k)]).alias("s"))
    t = each.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("m"))
    t = obs.join(t, obs["id"] == t["i"]).select("id", F.array(*[f"v{i}" for i in range(k)]).alias("x"), "m")

    @F.arrow_udf("string")
    def predict(x: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for a, classes in zip(x.to_pylist(), m.to_pylist()):
            total, pooled, means = sum(c["s"][0] for c in classes), np.zeros((k, k)), []
            for c in classes:
                s = c["s"]
                mu, at = np.array(s[1 : k + 1]) / s[0], k + 1
                for i in range(k):
                    for j in range(i, k):
                        q = s[at] - s[0] * mu[i] * mu[j]
                        pooled[i, j] += q
                        pooled[j, i] = pooled[i, j]
                        at += 1
                means.append(mu)
            inv = np.linalg.pinv(pooled / total)
            score = [mu @ inv @ np.array(a) - 0.5 * mu @ inv @ mu + math.log(c["s"][0] / total) for c, mu in zip(classes, means)]
            out.append(classes[int(np.argmax(score))]["c"])
        return pa.array(out, pa.string())

    return t.select("id", predict("x", "m").alias("predicted"))


# --- bandwidths of multiscale models, and diagnostics ---


def _one_term_cv(obs: DataFrame, bandwidth: float, kernel_name: str, adaptive: bool) -> float:
    """Squared error of local regressions of r on v alone, each place predicted without itself; obs is (id, x, y, v, r)."""
    pairs = weighted_pairs(obs.select("id", "x", "y"), obs, bandwidth, kernel_name, adaptive).where(F.col("i") != F.col("o.id"))
    beta = pairs.groupBy("i").agg((F.sum(F.col("w") * F.col("o.v") * F.col("o.r")) / F.nullif(F.sum(F.col("w") * F.col("o.v") ** 2), F.lit(0.0))).alias("b"))
    return obs.join(beta, F.col("id") == F.col("i")).agg(F.sum((F.col("r") - F.coalesce("b", F.lit(0.0)) * F.col("v")) ** 2)).first()[0] or math.inf


def mgwr_bandwidths(df: DataFrame, y: str, xs: list[str], kernel_name: str = "bisquare", adaptive: bool = True, tol: float = 1.0) -> list[float]:
    """A bandwidth for each term, intercept first: golden section over the cross-validation error of the term's own
    local regression on what the other terms, as least squares has them, leave over."""
    df = df.dropna(subset=[y, *xs])
    got, info = ols(df, y, xs)
    beta = [info["coefficients"]["intercept"], *(info["coefficients"][x] for x in xs)]
    b = df.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    lo, hi = (4, b[2] - 1) if adaptive else (math.hypot(b[0], b[1]) / 50, math.hypot(b[0], b[1]))
    out = []
    for i, x in enumerate([None, *xs]):
        v = F.lit(1.0) if x is None else F.col(x).cast("double")
        obs = checkpointed(got.select("id", "x", "y", v.alias("v"), (F.col("residual") + float(beta[i]) * v).alias("r")))
        best = _golden(lambda w: _one_term_cv(obs, round(w) if adaptive else w, kernel_name, adaptive), lo, hi, tol if adaptive else (hi - lo) * 0.01)  # noqa: B023
        out.append(float(round(best)) if adaptive else best)
    return out


def ols_diagnostics(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """(term, coefficient, std_error, t, p) of least squares."""
    from ..functions import distributions as D

    df = df.dropna(subset=[y, *xs])
    cols, t = _x(xs, intercept), F.col(y).cast("double")
    k = len(cols)
    row = df.agg(*_sums(None, cols, t), F.count("*"), F.sum(t * t)).first()
    a, b = _system(row, k)
    inv = np.linalg.pinv(a)
    beta, n = inv @ b, row[-2]
    s2 = max((row[-1] or 0.0) - float(beta @ b), 0.0) / max(n - k, 1)
    se = np.sqrt(s2 * np.diag(inv))
    names = (["intercept"] if intercept else []) + xs
    stats = [(v / e if e > 0 else math.nan) for v, e in zip(beta, se)]
    return df.sparkSession.createDataFrame([(nm, float(v), float(e), float(s), float(D.t_two_sided(s, n - k))) for nm, v, e, s in zip(names, beta, se, stats)], "term string, coefficient double, std_error double, t double, p double")


def sar_diagnostics(df: DataFrame, y: str, xs: list[str], weights: DataFrame, kind: str = "lag") -> DataFrame:
    """(rho, lambda, loglik, aic, ols_loglik, ols_aic, lr, p, rmse): a spatial model against least squares by likelihood ratio."""
    from ..functions import distributions as D

    fit = spatial_regression(df, y, xs, weights, kind)
    got, info = ols(df, y, xs)
    n, k = info["n"], len(xs) + 1
    plain = -n / 2 * (math.log(2 * math.pi * info["rss"] / n) + 1)
    r = fit.agg(F.first("rho"), F.first("lambda"), F.first("loglik"), F.first(F.size("beta")), F.sqrt(F.avg(F.col("residual") ** 2))).first()
    extra = (2 if kind == "sac" else 1) + (r[3] - k)
    lr = max(2 * (r[2] - plain), 0.0)
    row = (r[0], r[1], r[2], -2 * r[2] + 2 * (r[3] + 1 + (2 if kind == "sac" else 1)), plain, -2 * plain + 2 * (k + 1), lr, D.chi2_sf(lr, extra), r[4])
    return df.sparkSession.createDataFrame([tuple(map(float, row))], "rho double, lambda double, loglik double, aic double, ols_loglik double, ols_aic double, lr double, p double, rmse double")


def gwr_diagnostics(df: DataFrame, y: str, xs: list[str], bandwidth: float, kernel_name: str = "gaussian", adaptive: bool = False) -> DataFrame:
    """(n, rss, trace, trace2, edf, r2, adjusted_r2, aic, aicc): from the traces of S and S'S of the fit yhat = S y."""
    df = df.dropna(subset=[y, *xs])
    k = len(xs) + 1
    obs = df.select("id", "x", "y", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(xs, 1)], F.col(y).cast("double").alias("v0"))
    pairs = checkpointed(weighted_pairs(obs, obs, bandwidth, kernel_name, adaptive))
    cols = [F.lit(1.0)] + [F.col(f"o.v{i}") for i in range(1, k)]
    sums = pairs.groupBy("i").agg(F.array(*_sums(F.col("w"), cols, F.col("o.v0"))).alias("s"))

    @F.arrow_udf("array<double>")
    def row(s: pa.Array, v: pa.Array) -> pa.Array:
        """x_i' (X' W_i X)^-1, and yhat at its end."""
        out = []
        for a, x in zip(s.to_pylist(), v.to_pylist()):
            m, b = _system(a, k)
            r = np.array(x) @ np.linalg.pinv(m)
            out.append([*r.tolist(), float(r @ b)])
        return pa.array(out, pa.list_(pa.float64()))

    own = F.array(F.lit(1.0), *[F.col(f"v{i}") for i in range(1, k)])
    at = checkpointed(obs.join(sums, F.col("id") == F.col("i")).select("i", "v0", row("s", own).alias("r")))
    s = F.col("w") * sum((F.element_at("r", j + 1) * cols[j] for j in range(1, k)), F.element_at("r", 1))
    hat = pairs.join(at.select("i", "r"), "i").agg(F.sum(F.when(F.col("i") == F.col("o.id"), s)).alias("trace"), F.sum(s * s).alias("trace2"))
    fit = at.agg(F.count("*").cast("double").alias("n"), F.sum((F.col("v0") - F.element_at("r", -1)) ** 2).alias("rss"), (F.var_pop("v0") * F.count("*")).alias("sst"))
    t = fit.crossJoin(F.broadcast(hat)).withColumn("edf", F.col("n") - 2 * F.col("trace") + F.col("trace2"))  # one row each
    n, rss, tr = F.col("n"), F.col("rss"), F.col("trace")
    like = n * F.log(rss / n) + n * math.log(2 * math.pi)
    r2 = 1 - rss / F.col("sst")
    return t.select("n", "rss", "trace", "trace2", "edf", r2.alias("r2"), (1 - (1 - r2) * (n - 1) / (F.col("edf") - 1)).alias("adjusted_r2"), (like + n + tr).alias("aic"), (like + n * (n + tr) / (n - 2 - tr)).alias("aicc"))
