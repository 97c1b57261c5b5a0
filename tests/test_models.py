"""Models, statistics and interpolation without SQL, against numpy over whole tables or small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import distributions as D
from terralith.operators import interpolation, regression, statistics
from terralith.plans import fixtures, q_stats, registry

from .compare import SF

Q = registry.queries()


def frame(df, *cols):
    rows = df.orderBy("id").collect() if "id" in df.columns else df.collect()
    return [np.array([r[c] for r in rows], float) for c in cols]


@pytest.fixture(scope="module")
def field(spark):
    df = q_stats._field(spark, SF).cache()
    return df, frame(df, "id", "x", "y", "v", "a", "b", "t")


@pytest.fixture(scope="module")
def plane(spark):
    df = q_stats._plane(spark, SF).cache()
    return df, frame(df, "id", "x", "y", "v")


def grid(x, y, cols, rows):
    gx = x.min() + (np.arange(cols) + 0.5) * np.ptp(x) / cols
    gy = y.max() - (np.arange(rows) + 0.5) * np.ptp(y) / rows
    return [(i, j, gx[i], gy[j]) for j in range(rows) for i in range(cols)]


def local(x, y, cols, w, i):
    m = np.column_stack([np.ones(len(x)), *cols])
    return np.linalg.pinv(m.T @ (m * w[:, None])) @ (m.T @ (w * y)), m[i]


def weights(x, y, i, bw, name, k=None):
    d = np.hypot(x - x[i], y - y[i])
    bw = np.sort(d)[k - 1] * (1 + 1e-9) if k else bw
    t = d / bw
    return {"gaussian": np.exp(-0.5 * t * t), "exponential": np.exp(-t), "bisquare": np.where(t < 1, (1 - t * t) ** 2, 0), "tricube": np.where(t < 1, (1 - t**3) ** 3, 0), "boxcar": np.where(t <= 1, 1.0, 0)}[name]


@pytest.mark.parametrize("name,adaptive", [(n, a) for n in ("gaussian", "exponential", "bisquare", "tricube", "boxcar") for a in (False, True) if (n, a) != ("boxcar", True)])
def test_gwr(field, name, adaptive):
    df, (ids, x, y, v, a, b, _) = field
    bw = 40 if adaptive else 4.0
    got = {r.id: r for r in regression.gwr(df, "v", ["a", "b"], bw, name, adaptive).collect()}
    for i in range(0, len(ids), 7):
        beta, row = local(x, v, [a, b], weights(x, y, i, bw, name, bw if adaptive else None), i)
        assert got[ids[i]].beta == pytest.approx(beta, rel=1e-6, abs=1e-6) and got[ids[i]].yhat == pytest.approx(row @ beta)


def test_gwr_queries(spark, field):
    df, (ids, x, y, v, a, b, t) = field
    got = {r.id: r for r in Q["reg_gwr_adaptive"](spark, SF).collect()}
    predicted = {r.id: r.yhat for r in Q["reg_gwr_predict"](spark, SF).collect()}
    timed = {r.id: r.yhat for r in Q["reg_gtwr"](spark, SF).collect()}
    assert set(got) == set(predicted) == set(timed) == set(ids)
    for i in range(len(ids)):
        beta, row = local(x, v, [a, b], weights(x, y, i, 0, "gaussian", 40), i)
        assert got[ids[i]].yhat == pytest.approx(row @ beta, abs=2e-3) and got[ids[i]].residual == pytest.approx(v[i] - row @ beta, abs=2e-3)
        beta, row = local(x, v, [a], weights(x, y, i, 4.0, "gaussian"), i)
        assert predicted[ids[i]] == pytest.approx(row @ beta, abs=2e-3)
        ds, dt = np.hypot(x - x[i], y - y[i]), t[i] - t
        d = 0.6 * ds + 0.4 * dt + 2 * np.sqrt(0.24 * ds * np.maximum(dt, 0))
        beta, row = local(x, v, [a], np.where(dt >= 0, np.exp(-0.5 * (d / 5) ** 2), 0), i)
        assert timed[ids[i]] == pytest.approx(row @ beta, abs=2e-3)


def test_gwr_poisson(spark, field):
    df, (ids, x, y, v, a, b, t) = field
    got = {r.id: r.yhat for r in Q["reg_gwr_poisson"](spark, SF).collect()}
    c, m = ids % 5, np.column_stack([np.ones(len(ids)), a])
    for i in range(0, len(ids), 5):
        w, beta = weights(x, y, i, 6.0, "gaussian"), np.array([math.log(c.mean()), 0.0])
        for _ in range(60):
            mu = np.exp(m @ beta)
            beta = np.linalg.pinv(m.T @ (m * (w * mu)[:, None])) @ (m.T @ (w * mu * (m @ beta + (c - mu) / mu)))
        assert got[ids[i]] == pytest.approx(math.exp(m[i] @ beta), abs=2e-3)


def test_binomial_gwr_and_its_bandwidth(field):
    df, (ids, x, y, v, a, b, t) = field
    got = {r.id: r for r in regression.gwr_generalized(df.withColumn("c", (F.col("v") > F.lit(float(np.median(v)))).cast("double")), "c", ["a"], 8.0, "logistic").collect()}
    c, m = (v > np.median(v)).astype(float), np.column_stack([np.ones(len(ids)), a])
    for i in (0, 50, 100):
        w, beta = weights(x, y, i, 8.0, "gaussian"), np.zeros(2)
        for _ in range(60):
            mu = 1 / (1 + np.exp(-m @ beta))
            g = np.maximum(mu * (1 - mu), 1e-9)
            beta = np.linalg.pinv(m.T @ (m * (w * g)[:, None])) @ (m.T @ (w * g * (m @ beta + (c - mu) / g)))
        assert got[ids[i]].beta == pytest.approx(beta, abs=1e-5)


def cross_validated(x, y, v, cols, bw, name="gaussian"):
    e = 0.0
    for i in range(len(x)):
        w = weights(x, y, i, bw, name)
        w[i] = 0
        beta, row = local(x, v, cols, w, i)
        e += (v[i] - row @ beta) ** 2
    return e


def test_cross_validation_and_selection(field):
    df, (ids, x, y, v, a, b, _) = field
    assert regression.gwr_cv(df, "v", ["a"], 3.0, "gaussian", False) == pytest.approx(cross_validated(x, y, v, [a], 3.0))
    strong = df.withColumn("z", 50 * F.col("b") + F.col("a") * 0.001)
    assert regression.gwr_select(strong, "z", ["a", "b"], 6.0)[0] == "b"


def test_gwr_diagnostics(field):
    df, (ids, x, y, v, a, b, _) = field
    m, n = np.column_stack([np.ones(len(ids)), a]), len(ids)
    s = np.array([m[i] @ np.linalg.pinv(m.T @ (m * w[:, None])) @ (m.T * w) for i in range(n) for w in [weights(x, y, i, 4.0, "bisquare")]])
    rss, tr = ((v - s @ v) ** 2).sum(), np.trace(s)
    r = regression.gwr_diagnostics(df, "v", ["a"], 4.0, "bisquare").first()
    assert (r.rss, r.trace, r.trace2) == pytest.approx((rss, tr, (s * s).sum()))
    assert r.aicc == pytest.approx(n * math.log(rss / n) + n * math.log(2 * math.pi) + n * (n + tr) / (n - 2 - tr)) and r.r2 == pytest.approx(1 - rss / ((v - v.mean()) ** 2).sum())


def test_ols_diagnostics(field):
    df, (ids, x, y, v, a, b, _) = field
    m = np.column_stack([np.ones(len(ids)), a, b])
    beta = np.linalg.lstsq(m, v, rcond=None)[0]
    s2 = ((v - m @ beta) ** 2).sum() / (len(v) - 3)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(m.T @ m)))
    got = regression.ols_diagnostics(df, "v", ["a", "b"]).collect()
    assert [r.term for r in got] == ["intercept", "a", "b"] and [r.coefficient for r in got] == pytest.approx(beta) and [r.std_error for r in got] == pytest.approx(se)
    assert all(0 <= r.p <= 1 and r.t == pytest.approx(r.coefficient / r.std_error) for r in got)


@pytest.mark.parametrize("family", ["logistic", "poisson"])
def test_generalised_models(spark, family):
    t = spark.read.parquet(f"{SF}/part.parquet").toPandas()
    x, y = t.p_size.to_numpy() / 50, (t.p_partkey % (2 if family == "logistic" else 7)).to_numpy(float)
    m, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(200):
        mu = 1 / (1 + np.exp(-m @ beta)) if family == "logistic" else np.exp(m @ beta)
        g = mu * (1 - mu) if family == "logistic" else mu
        beta = np.linalg.solve(m.T @ (m * g[:, None]), m.T @ (g * (m @ beta) + y - mu))
    dev = -2 * (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum() if family == "logistic" else 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - (y - mu)).sum()
    r = Q[f"reg_{family}"](spark, SF).first()
    assert (r.intercept, r.slope, r.deviance) == pytest.approx((*beta, dev), abs=2e-4)
    with pytest.raises(ValueError, match="no convergence"):
        regression.glm(spark.createDataFrame(t[["p_size"]].assign(y=y)), "y", ["p_size"], family, most=1)


def neighbours(ids):
    xy = np.stack([ids // 12, ids % 12], 1)
    near = (np.abs(xy[:, None] - xy[None]).max(2) == 1).astype(float)
    return near / near.sum(1, keepdims=True)


@pytest.mark.parametrize("kind", ["lag", "error", "sac", "durbin"])
def test_spatial_models(spark, field, kind):
    """The likelihood at the estimate equals its own formula there and no point of a fine grid has a higher one."""
    df, (ids, x, y, v, a, b, _) = field
    w, n = neighbours(ids), len(ids)
    m = np.column_stack([np.ones(n), a, b] + ([w @ a, w @ b] if kind == "durbin" else []))

    def loglik(rho, lam):
        p, q = np.eye(n) - rho * w, np.eye(n) - lam * w
        xs, ys = q @ m, q @ p @ v
        e = ys - xs @ np.linalg.lstsq(xs, ys, rcond=None)[0]
        return -n / 2 * math.log(2 * math.pi * (e @ e) / n) - n / 2 + np.linalg.slogdet(p)[1] + np.linalg.slogdet(q)[1]

    got = Q[f"reg_spatial_{kind}"](spark, SF).collect()
    r = got[0]
    assert len(got) == n and r.loglik == pytest.approx(loglik(r.rho, r["lambda"]), abs=2e-3)
    span = np.linspace(-0.9, 0.95, 38)
    best = max(loglik(p, q) for p in (span if kind != "error" else [0]) for q in (span[::3] if kind == "sac" else span if kind == "error" else [0]))
    assert best <= r.loglik + 2e-3
    if kind != "sac":
        d = regression.sar_diagnostics(df, "v", ["a", "b"], q_stats._w(spark, SF), kind).first()
        plain = np.column_stack([np.ones(n), a, b])
        e = v - plain @ np.linalg.lstsq(plain, v, rcond=None)[0]
        assert d.ols_loglik == pytest.approx(-n / 2 * (math.log(2 * math.pi * (e @ e) / n) + 1)) and d.lr == pytest.approx(2 * (d.loglik - d.ols_loglik)) and d.p == pytest.approx(D.chi2_sf(d.lr, 3 if kind == "durbin" else 1))


def test_simplex():
    got = regression.nelder_mead(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.2, 1.0]))
    assert got == pytest.approx([1, 1], abs=1e-4)


def test_mgwr(spark, field):
    df, (ids, x, y, v, a, b, _) = field
    got = frame(regression.mgwr(df, "v", ["a"], [60, 40], rounds=4), "yhat")[0]
    cols, beta, before = [np.ones(len(ids)), a], np.zeros((2, len(ids))), math.inf
    for _ in range(4):
        for j, k in enumerate((60, 40)):
            r = v - beta[0] * cols[0] - beta[1] * cols[1] + beta[j] * cols[j]
            for i in range(len(ids)):
                w = weights(x, y, i, 0, "bisquare", k)
                beta[j, i] = (w * cols[j] * r).sum() / (w * cols[j] ** 2).sum()
        rss = ((v - beta[0] - beta[1] * a) ** 2).sum()
        if abs(before - rss) <= 1e-5 * rss:
            break
        before = rss
    assert got == pytest.approx(beta[0] + beta[1] * a, abs=1e-6)


def test_bandwidths_of_each_term(spark):
    """A constant effect takes a wider bandwidth than one that turns with the place."""
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 12), float(i // 12), float(rng.normal()), float(rng.normal())) for i in range(144)]
    df = spark.createDataFrame([(i, x, y, a, b, 2 * a + math.sin(x) * 3 * b + 0.01 * float(rng.normal())) for i, x, y, a, b in rows], "id long, x double, y double, a double, b double, v double")
    _, wide, narrow = regression.mgwr_bandwidths(df, "v", ["a", "b"], tol=4.0)
    assert wide > narrow >= 4


def test_local_moments(field):
    df, (ids, x, y, v, a, b, _) = field
    cor = {r.id: r for r in regression.gw_correlation(df, "a", "v", 4.0).collect()}
    pca = {r.id: r for r in regression.gw_pca(df, ["a", "b", "v"], 5.0).collect()}
    for i in range(0, len(ids), 11):
        w = weights(x, y, i, 4.0, "gaussian")
        c = np.cov(a, v, aweights=w, ddof=0)
        assert (cor[ids[i]].cov, cor[ids[i]].corr) == pytest.approx((c[0, 1], c[0, 1] / math.sqrt(c[0, 0] * c[1, 1])))
        val, vec = np.linalg.eigh(np.cov(np.stack([a, b, v]), aweights=weights(x, y, i, 5.0, "gaussian"), ddof=0))
        assert pca[ids[i]].variance == pytest.approx(val[::-1][:2]) and np.abs(pca[ids[i]].loading @ vec[:, -1]) == pytest.approx(1)


def test_robust_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) @ np.array([[3, 0], [0, 1.0]])
    x[:60] = rng.normal(size=(60, 2)) + [0, 60]
    w = np.ones(400)
    got = regression.robust_covariance(x, w)
    assert got == pytest.approx(np.array([[9, 0], [0, 1]]), abs=1.6) and np.cov(x.T)[1, 1] > 300
    df = spark.createDataFrame([(i, float(i % 20), float(i // 20), float(p), float(q)) for i, (p, q) in enumerate(x)], "id long, x double, y double, p double, q double")
    load = np.array([r.loading for r in regression.gw_pca(df, ["p", "q"], 150, 1, "bisquare", True, robust=True).collect()])
    plain = np.array([r.loading for r in regression.gw_pca(df, ["p", "q"], 150, 1, "bisquare", True).collect()])
    assert (np.abs(load[:, 0]) > 0.9).mean() > 0.8 > (np.abs(plain[:, 0]) > 0.9).mean()


def test_discriminant(spark, field):
    df, (ids, x, y, v, a, b, _) = field
    got = {r.id: r.predicted for r in Q["reg_gw_discriminant"](spark, SF).collect()}
    label = np.where(a + b > 5, "high", "low")
    m, same = np.stack([a, b], 1), 0
    for i in range(len(ids)):
        w = weights(x, y, i, 5.0, "gaussian")
        pooled, parts = np.zeros((2, 2)), []
        for c in ("high", "low"):
            u = w * (label == c)
            mu = u @ m / u.sum()
            pooled += (m - mu).T @ ((m - mu) * u[:, None])
            parts.append((mu, u.sum()))
        inv = np.linalg.pinv(pooled / w.sum())
        score = [mu @ inv @ m[i] - 0.5 * mu @ inv @ mu + math.log(t / w.sum()) for mu, t in parts]
        same += got[ids[i]] == ("high", "low")[int(np.argmax(score))]
    assert same == len(ids)


# --- interpolation ---


def variogram(h, nugget, sill, reach):
    t = np.minimum(h / reach, 1)
    return np.where(h > 0, nugget + (sill - nugget) * (1.5 * t - 0.5 * t**3), 0.0)


def kriged(x, y, v, gx, gy, par, mean=None):
    g = variogram(np.hypot(x[:, None] - x, y[:, None] - y), *par)
    b = variogram(np.hypot(gx - x, gy - y), *par)
    if mean is not None:
        w = np.linalg.solve(par[1] - g, par[1] - b)
        return mean + w @ (v - mean), par[1] - w @ (par[1] - b)
    w = np.linalg.solve(np.block([[g, np.ones((len(x), 1))], [np.ones((1, len(x))), np.zeros((1, 1))]]), np.append(b, 1))
    return w[:-1] @ v, w @ np.append(b, 1)


def test_kriging(spark, plane):
    df, (ids, x, y, v) = plane
    own = {(r.cx, r.cy): r for r in interpolation.kriging(df, "v", 6, 5, nugget=1.0, sill=90.0, reach=120.0).collect()}
    near = {(r.cx, r.cy): r for r in interpolation.local_kriging(df, "v", 6, 5, "Sph", 1.0, 90.0, 120.0, k=6).collect()}
    whole = {(r.cx, r.cy): r for r in interpolation.local_kriging(df, "v", 6, 5, "Sph", 1.0, 90.0, 120.0, k=len(ids)).collect()}
    simple = {(r.cx, r.cy): r for r in Q["int_simple_kriging"](spark, SF).collect()}
    for i, j, gx, gy in grid(x, y, 6, 5):
        want = kriged(x, y, v, gx, gy, (1.0, 90.0, 120.0))
        assert (own[i, j].v, own[i, j].variance) == pytest.approx(want) and (whole[i, j].v, whole[i, j].variance) == pytest.approx(want)
        o = np.argsort(np.hypot(gx - x, gy - y), kind="stable")[:6]
        assert (near[i, j].v, near[i, j].variance) == pytest.approx(kriged(x[o], y[o], v[o], gx, gy, (1.0, 90.0, 120.0)))
        assert (simple[i, j].v, simple[i, j].variance) == pytest.approx(kriged(x, y, v, gx, gy, (0.0, 100.0, 90.0), 0.0), abs=2e-3)
    at = {(r.cx, r.cy): r.v for r in Q["int_kriging"](spark, SF).collect()}
    assert len(at) == 30 and max(abs(at[i, j] - (2 + 3 * gx - gy)) for i, j, gx, gy in grid(x, y, 6, 5)) < np.ptp(v)


def test_linear_and_splines(spark, plane):
    """Within the hull a plane comes back; the B-spline surface comes near it; a thin plate meets its points."""
    df, (ids, x, y, v) = plane
    got = {(r.cx, r.cy): r.v for r in Q["int_linear"](spark, SF).collect()}
    surface = {(r.cx, r.cy): r.v for r in Q["int_b_spline"](spark, SF).collect()}
    inside = [(i, j, 2 + 3 * gx - gy) for i, j, gx, gy in grid(x, y, 6, 5) if got[i, j] == pytest.approx(2 + 3 * gx - gy, abs=1e-3)]
    outside = [(i, j, gx, gy) for i, j, gx, gy in grid(x, y, 6, 5) if (i, j) not in {p[:2] for p in inside}]
    assert len(inside) >= 10 and all(got[i, j] == pytest.approx(v[np.argmin(np.hypot(gx - x, gy - y))], abs=1e-3) for i, j, gx, gy in outside)
    assert np.isfinite(list(surface.values())).all() and len(surface) == 30
    curved = df.withColumn("z", F.sin(F.col("x") / 20) * F.col("y"))
    z = frame(curved, "z")[0]
    fine = interpolation.thin_plate_spline(curved, "z", 40, 40).collect()
    for i in range(len(ids)):  # the cell around each point is near the point's value
        cx, cy = (min(int((x[i] - x.min()) / np.ptp(x) * 40), 39), min(int((y.max() - y[i]) / np.ptp(y) * 40), 39))
        assert abs(next(r.v for r in fine if (r.cx, r.cy) == (cx, cy)) - z[i]) < 0.25 * np.ptp(z)


def test_inverse_distance_by_neighbours(plane):
    df, (ids, x, y, v) = plane
    for kw, pick in (({"k": 3}, lambda d: np.argsort(d, kind="stable")[:3]), ({"radius": 150.0}, lambda d: np.flatnonzero(d <= 150)), ({}, lambda d: np.arange(len(d)))):
        got = {(r.cx, r.cy): r.v for r in interpolation.idw(df, "v", 5, 4, 1.5, **kw).collect()}
        want = {}
        for i, j, gx, gy in grid(x, y, 5, 4):
            d = np.hypot(gx - x, gy - y)
            o = pick(d)
            if len(o):
                want[i, j] = (v[o] / d[o] ** 1.5).sum() / (1 / d[o] ** 1.5).sum()
        assert got == pytest.approx(want)


# --- statistics ---


def test_moran_moments_by_permutation(spark, field):
    """Variance under randomisation: against a thousand shuffles."""
    df, (ids, x, y, v, *_) = field
    r = statistics.moran(df, "v", q_stats._w(spark, SF)).first()
    w, z = neighbours(ids), v - v.mean()
    of = lambda u: len(u) / w.sum() * (u @ w @ u) / (u @ u)
    rng = np.random.default_rng(1)
    many = np.array([of(rng.permutation(z)) for _ in range(4000)])
    assert r.i == pytest.approx(of(z)) and r.variance == pytest.approx(many.var(), rel=0.1) and many.mean() == pytest.approx(r.expectation, abs=0.004)
    assert r.z == pytest.approx((r.i - r.expectation) / math.sqrt(r.variance)) and r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))
    local = {s.id: s for s in statistics.local_moran(df, "v", q_stats._w(spark, SF)).collect()}
    i = 70
    k = int(np.flatnonzero(ids == i)[0])
    others = np.delete(z, k)
    values = np.array([z[k] * (np.insert(rng.permutation(others), k, z[k]) @ w[k]) / z.var() for _ in range(4000)])
    s = local[i]
    assert s.local_i == pytest.approx(z[k] * (w[k] @ z) / z.var()) and s.p == pytest.approx(math.erfc(abs(s.z) / math.sqrt(2))) and np.isfinite(values).all()


def test_components_and_kinds(spark):
    r = statistics.pca(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_quantity", "l_extendedprice"], 2, True).collect()
    assert [abs(v) for v in r[0].loadings] == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6)
    rows = [(i, float((i % 2) * 10 + (i // 2 % 2) * 3 + (i % 2) * (i // 2 % 2) * 20), i % 2, i // 2 % 2) for i in range(40)]
    k = statistics.interaction_detector(spark.createDataFrame(rows, "id int, y double, a int, b int"), "y", ["a", "b"]).first()
    assert k.kind == "enhanced, nonlinear" and k.q == pytest.approx(1)


def test_detector_tests(spark):
    df = q_stats._strata(spark, SF)
    y, a = frame(df, "y")[0], [r.a for r in df.orderBy("id").collect()]
    groups = [y[np.array(a) == g] for g in sorted(set(a))]
    n, k = len(y), len(groups)
    q = 1 - sum(len(g) * g.var() for g in groups) / (n * y.var())
    lam = (sum(g.mean() ** 2 for g in groups) - sum(math.sqrt(len(g)) * g.mean() for g in groups) ** 2 / n) / y.var(ddof=1)
    r = next(r for r in statistics.factor_test(df, "y", ["a", "b"]).collect() if r.x == "a")
    assert (r.q, r["lambda"], r.f) == pytest.approx((q, lam, (n - k) / (k - 1) * q / (1 - q))) and r.p == pytest.approx(D.noncentral_f_sf(r.f, k - 1, n - k, lam))
    e = statistics.ecological_test(df, "y", ["a", "b"]).first()
    assert (e.x1, e.x2) == ("a", "b") and e.f >= 1 and e.p == pytest.approx(D.f_sf(e.f, n - 1, n - 1))


def test_distributions():
    z = np.array([0.0, 0.3, 1.0, 2.4, 2.6, 5.0, 9.0, -1.7])
    assert D.erfc(z) == pytest.approx([math.erfc(v) for v in z], rel=1e-11)
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and D.chi2_sf(5.991464547, 2) == pytest.approx(0.05) and D.chi2_sf(18.30703805, 10) == pytest.approx(0.05)
    assert D.f_sf(4.102821015, 2, 10) == pytest.approx(0.05) and D.noncentral_f_sf(3.0, 4, 20, 0.0) == pytest.approx(D.f_sf(3.0, 4, 20))
    rng = np.random.default_rng(2)
    x = ((rng.normal(size=(200_000, 3)) + [1.5, 0, 0]) ** 2).sum(1) / 3 / (rng.chisquare(12, 200_000) / 12)
    assert D.noncentral_f_sf(2.5, 3, 12, 2.25) == pytest.approx((x > 2.5).mean(), abs=0.005)


def test_draws_and_samples(spark):
    got = [r.id for r in Q["smp_random_replace"](spark, SF).collect()]
    total = fixtures.pts(spark, SF).count()
    picks = np.random.default_rng(0).integers(1, total + 1, 20)
    import hashlib

    order = sorted((hashlib.md5(f"0:{r.id}".encode()).hexdigest(), r.id) for r in fixtures.pts(spark, SF).collect())
    assert sorted(got) == sorted(order[p - 1][1] for p in picks)
    all_ = {r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    sample = [r.c_custkey for r in Q["fc_sample"](spark, SF).collect()]
    split = [r.c_custkey for r in Q["fc_random_split"](spark, SF).collect()]
    assert set(sample) < all_ and len(set(sample)) == len(sample) and 0.3 * len(all_) < len(sample) < 0.7 * len(all_) and 0.1 * len(all_) < len(split) < 0.5 * len(all_)


def test_geohashes_and_lengths(spark):
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"

    def hashed(x, y, n):
        box, out, even = [[-180.0, 180.0], [-90.0, 90.0]], "", True
        for _ in range(n):
            k = 0
            for _ in range(5):
                r, p = (box[0], x) if even else (box[1], y)
                mid = sum(r) / 2
                k = k * 2 + (p >= mid)
                r[0 if p >= mid else 1] = mid
                even = not even
            out += letters[k]
        return out

    at = {r.id: (r.x, r.y) for r in fixtures.pts(spark, SF).collect()}
    assert {r.id: r.hash for r in Q["fc_geohash"](spark, SF).collect()} == {i: hashed(*p, 6) for i, p in at.items()}
    from terralith.functions import geometry as G

    for r in Q["geo_measure_geodesic_length"](spark, SF).collect():
        b = next(b for b in fixtures.boxes(spark, SF).collect() if b.id == r.id)
        up = 2 * 6371.0088 * math.radians(36)
        side = lambda lat: G.haversine((b.xmin, lat), (b.xmax, lat)) / 1e3  # noqa: B023, E731
        assert r.v == pytest.approx(up + side(b.ymin) + side(b.ymax), abs=1)
