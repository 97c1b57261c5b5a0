"""Spatial statistics over points (id, x, y, properties) and weights as edge lists (i, j, w)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from ..session import checkpointed, numbered, running
from .spatial import distance_join, join, knn
from .systems import blocks, spread


def two_sided(z: Column) -> Column:
    """Two-sided p value of a standard normal variable."""

    @F.arrow_udf("double")
    def f(a: pa.Array) -> pa.Array:
        v = a.to_numpy(zero_copy_only=False).astype(float)
        return pa.array(D.normal_two_sided(v), mask=np.isnan(v))

    return f(z)


def average_nearest_neighbor(points: DataFrame) -> DataFrame:
    """(observed, expected, ann, z, p) of mean nearest-neighbour distances in the points' box."""
    near = knn(points, points, 1, exclude_same=True).agg(F.avg("dist").alias("observed"))
    box = points.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    t = near.crossJoin(box).withColumn("expected", 0.5 / F.sqrt(F.col("n") / F.col("area"))).withColumn("se", 0.26136 / F.sqrt(F.col("n") * F.col("n") / F.col("area")))
    z = (F.col("observed") - F.col("expected")) / F.col("se")
    return t.select("observed", "expected", (F.col("observed") / F.col("expected")).alias("ann"), z.alias("z"), two_sided(z).alias("p"))


def descriptive(df: DataFrame, names: list[str]) -> DataFrame:
    """(property, count, sum, stdev, variance, max, min), population forms, in one pass."""
    one = lambda n: F.struct(F.lit(n).alias("property"), F.count(n).alias("count"), F.sum(n).cast("double").alias("sum"), F.stddev_pop(n).alias("stdev"), F.var_pop(n).alias("variance"), F.max(n).cast("double").alias("max"), F.min(n).cast("double").alias("min"))
    return df.agg(F.array(*map(one, names)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def kernel_density(points: DataFrame, cols: int, rows: int, x0: float, y0: float, x1: float, y1: float, kernel: list[list[float]], weight: str | None = None) -> DataFrame:
    """(cx, cy, v): each point adds a kernel (of odd size) around its cell."""
    h, w = len(kernel), len(kernel[0])
    if h % 2 == 0 or w % 2 == 0:
        raise ValueError("the kernel's size must be odd")
    cx, cy = F.floor((F.col("x") - x0) / ((x1 - x0) / cols)), F.floor((y1 - F.col("y")) / ((y1 - y0) / rows))
    at = F.explode(F.array(*[F.struct(F.lit(i - w // 2).alias("dx"), F.lit(j - h // 2).alias("dy"), F.lit(float(kernel[j][i])).alias("k")) for j in range(h) for i in range(w)])).alias("o")
    m = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = points.select(F.least(cx, F.lit(cols - 1)).cast("int").alias("cx"), F.least(cy, F.lit(rows - 1)).cast("int").alias("cy"), m.alias("m")).groupBy("cx", "cy").agg(F.sum("m").alias("m"))
    t = cells.select("cx", "cy", "m", at).select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), (F.col("m") * F.col("o.k")).alias("p"))
    return t.where((F.col("cx") >= 0) & (F.col("cx") < cols) & (F.col("cy") >= 0) & (F.col("cy") < rows)).groupBy("cx", "cy").agg(F.sum("p").alias("v"))


def moments(df: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance) of columns, from one aggregation."""
    k = len(names)
    t = df.dropna(subset=names).select(*[F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    row = t.agg(F.count("*"), *[F.avg(f"c{i}") for i in range(k)], *[F.covar_pop(f"c{i}", f"c{j}") for i in range(k) for j in range(i, k)]).first()
    n, mean, cov = row[0], np.array([v or 0.0 for v in row[1 : k + 1]]), np.zeros((k, k))
    for v, (i, j) in zip(row[k + 1 :], [(i, j) for i in range(k) for j in range(i, k)]):
        cov[i, j] = cov[j, i] = v or 0.0
    return n, mean, cov


def pca(df: DataFrame, names: list[str], keep: int = 2, scale: bool = False) -> DataFrame:
    """(component, variance, share, loadings); a loading vector's largest element is positive."""
    _, _, cov = moments(df, names)
    if scale:
        d = np.sqrt(np.diag(cov))
        cov = cov / np.where(d > 0, np.outer(d, d), 1)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:keep]
    rows = []
    for i, o in enumerate(order, 1):
        v = vec[:, o] * np.sign(vec[np.abs(vec[:, o]).argmax(), o])
        rows.append((i, float(val[o]), float(val[o] / val.sum()) if val.sum() else 0.0, [float(x) for x in v]))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, share double, loadings array<double>")


def correlation(df: DataFrame, names: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) of all pairs; spearman is pearson of average ranks."""
    t = df.dropna(subset=names).select(*names)
    if method == "spearman":
        for n in names:
            ranks = running(t.groupBy(n).agg(F.count("*").alias("__c")), n, amount="__c", name="__to")
            t = t.join(ranks.select(n, (F.col("__to") - (F.col("__c") - 1) / 2).alias("__r")), n).drop(n).withColumnRenamed("__r", n)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return t.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def ripley_k(points: DataFrame, steps: int = 10) -> DataFrame:
    """(r, k): sqrt(A * pairs nearer than r / (pi n (n - 1))) at distances up to a quarter of the longer side.

    All pairs of places are counted, in small blocks by all tasks; points of one place count together."""
    b = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    n, w, h = b
    step = max(w, h) * 0.25 / steps
    p = points.select("id", "x", "y").dropna()
    at = p.groupBy("x", "y").agg(F.count("*").cast("double").alias("n")).toArrow()
    shared = points.sparkSession.sparkContext.broadcast(tuple(at[c].to_numpy() for c in ("x", "y", "n")))

    def work(begin: int, end: int):
        x, y, n = shared.value
        m = np.zeros(steps + 1)
        for i, j, d in blocks(x, y, begin, end):
            m += np.bincount(np.minimum(np.sqrt(d) / step, steps).astype(np.int32).ravel(), (n[i, None] * n[j]).ravel(), steps + 1)
        return m

    m = np.zeros(steps)
    if at.num_rows and step:
        m += np.sum(spread(points.sparkSession.sparkContext, work, at.num_rows), 0)[:steps]
        often = p.groupBy("id").agg(F.count("*").alias("c"))  # rows of one id are no pairs: each with itself, and those of an id that occurs again
        m[0] -= often.where("c = 1").count()
        again = p.join(often.where("c > 1").select("id"), "id", "left_semi")
        for r in distance_join(again, again, step * (steps + 1)).where("a.id = b.id").select(F.floor(F.col("dist") / step).cast("int").alias("bin")).groupBy("bin").count().collect():
            if r[0] < steps:
                m[r[0]] -= r[1]
    shared.destroy()
    rows = [(i * step, math.sqrt(w * h * c / (math.pi * n * (n - 1)))) for i, c in enumerate(np.cumsum(m).tolist(), 1)]
    return points.sparkSession.createDataFrame(rows, "r double, k double")


# --- weights ---


def styled(edges: DataFrame, style: str = "W") -> DataFrame:
    """B as they are, W rows sum to 1, C all sum to n, U all sum to 1, S variance stabilised."""
    if style == "B":
        return edges
    row = edges.groupBy("i").agg(F.sum("w").alias("s"), F.sum(F.col("w") ** 2).alias("q"))
    if style == "W":
        return edges.join(row, "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))
    n = row.agg(F.count("*").alias("n"), F.sum("s").alias("t"))
    if style in ("C", "U"):
        return edges.crossJoin(F.broadcast(n)).select("i", "j", (F.col("w") * (F.col("n") if style == "C" else 1) / F.col("t")).alias("w"))
    e = edges.join(row, "i").select("i", "j", (F.col("w") / F.sqrt("q")).alias("w"))
    return styled(e, "C")


def knn_weights(points: DataFrame, k: int = 4, style: str = "W") -> DataFrame:
    e = knn(points, points, k, exclude_same=True).select(F.col("qid").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))
    return styled(e, style)


def distance_weights(points: DataFrame, d: float, style: str = "W") -> DataFrame:
    p = points.select("id", "x", "y")
    e = distance_join(p, p, d, "less_equal").where("a.id != b.id").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.lit(1.0).alias("w"))
    return styled(e, style)


def contiguity_weights(polygons: DataFrame, cell: float, style: str = "W", rook: bool = False) -> DataFrame:
    """Polygons that share a border (rook) or at least a point."""
    from ..functions import geometry as G

    pairs = join(polygons, polygons, "Touches", cell).where("a.id != b.id")
    if rook:
        pairs = pairs.where(G.measure("length")(G.overlaid("intersection")(F.col("a.geom"), F.col("b.geom"))) > 0)
    return styled(pairs.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.lit(1.0).alias("w")), style)


def grid_weights(cells: DataFrame, style: str = "W", queen: bool = True) -> DataFrame:
    """Neighbours of cells (id, cx, cy) on a grid."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (queen or not (a and b))]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in near])).alias("o")
    out = cells.select(F.col("id").alias("i"), "cx", "cy", o).select("i", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    return styled(out.join(cells.select(F.col("id").alias("j"), "cx", "cy"), ["cx", "cy"]).select("i", "j", F.lit(1.0).alias("w")), style)


# --- autocorrelation ---


def _centred(df: DataFrame, name: str) -> DataFrame:
    m = df.agg(F.avg(name).alias("m"), F.count(name).alias("n"), F.var_pop(name).alias("v"))
    return df.select("id", F.col(name).cast("double").alias("v0")).crossJoin(F.broadcast(m)).select("id", "v0", (F.col("v0") - F.col("m")).alias("z"), "n", F.col("v").alias("m2"), F.col("m").alias("mean"))


def moran(df: DataFrame, name: str, weights: DataFrame) -> DataFrame:
    """(i, expectation, variance, z, p) of Moran's I under randomisation."""
    c = checkpointed(_centred(df, name))
    e = weights.join(c.select(F.col("id").alias("i"), F.col("z").alias("a")), "i").join(c.select(F.col("id").alias("j"), F.col("z").alias("b")), "j")
    num = e.agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("x"), F.sum("w").alias("s0"))
    back = weights.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("u"))
    s1 = weights.join(back, ["i", "j"], "full").agg((F.sum((F.coalesce("w", F.lit(0.0)) + F.coalesce("u", F.lit(0.0))) ** 2) / 2).alias("s1"))
    ends = weights.select(F.col("i").alias("k"), "w").unionByName(weights.select(F.col("j").alias("k"), "w")).groupBy("k").agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") ** 2).alias("s2"))
    own = c.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") ** 2).alias("q2"), F.sum(F.col("z") ** 4).alias("q4"))
    t = num.crossJoin(s1).crossJoin(s2).crossJoin(own)
    n, s0, s1_, s2_ = (F.col(x) for x in ("n", "s0", "s1", "s2"))
    i, ei = n / s0 * F.col("x") / F.col("q2"), -1 / (n - 1)
    k = n * F.col("q4") / F.col("q2") ** 2
    var = (n * ((n * n - 3 * n + 3) * s1_ - n * s2_ + 3 * s0 * s0) - k * (n * (n - 1) * s1_ - 2 * n * s2_ + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ei * ei
    z = (i - ei) / F.sqrt(var)
    return t.select(i.alias("i"), ei.alias("expectation"), var.alias("variance"), z.alias("z"), two_sided(z).alias("p"))


def local_moran(df: DataFrame, name: str, weights: DataFrame) -> DataFrame:
    """(id, local_i, expectation, variance, z, p) of each feature with neighbours."""
    c = checkpointed(_centred(df, name))
    q4 = c.agg((F.avg(F.col("z") ** 4) / F.first("m2") ** 2).alias("b2"))
    lag = weights.join(c.select(F.col("id").alias("j"), F.col("z").alias("b")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("b")).alias("lag"), F.sum("w").alias("wi"), F.sum(F.col("w") ** 2).alias("wi2"))
    t = c.join(lag, c["id"] == lag["i"]).crossJoin(F.broadcast(q4))
    n, wi, wi2, b2 = F.col("n").cast("double"), F.col("wi"), F.col("wi2"), F.col("b2")
    i, e = F.col("z") * F.col("lag") / F.col("m2"), -wi / (n - 1)
    var = wi2 * (n - b2) / (n - 1) + (wi * wi - wi2) * (2 * b2 - n) / ((n - 1) * (n - 2)) - e * e
    z = (i - e) / F.sqrt(var)
    return t.select("id", i.alias("local_i"), e.alias("expectation"), var.alias("variance"), z.alias("z"), two_sided(z).alias("p"))


def geary(df: DataFrame, name: str, weights: DataFrame) -> DataFrame:
    """(c): Geary's C."""
    c = checkpointed(_centred(df, name))
    e = weights.join(c.select(F.col("id").alias("i"), F.col("v0").alias("a")), "i").join(c.select(F.col("id").alias("j"), F.col("v0").alias("b")), "j")
    num = e.agg(F.sum(F.col("w") * (F.col("a") - F.col("b")) ** 2).alias("x"), F.sum("w").alias("s0"))
    own = c.agg(F.count("*").alias("n"), F.sum(F.col("z") ** 2).alias("q"))
    return num.crossJoin(own).select(((F.col("n") - 1) * F.col("x") / (2 * F.col("s0") * F.col("q"))).alias("c"))


def local_geary(df: DataFrame, name: str, weights: DataFrame) -> DataFrame:
    """(id, local_c): sum of w (x_i - x_j)^2 over the variance."""
    c = checkpointed(_centred(df, name))
    e = weights.join(c.select(F.col("id").alias("i"), F.col("v0").alias("a"), "m2"), "i").join(c.select(F.col("id").alias("j"), F.col("v0").alias("b")), "j")
    return e.groupBy(F.col("i").alias("id")).agg((F.sum(F.col("w") * (F.col("a") - F.col("b")) ** 2) / F.first("m2")).alias("local_c"))


def getis_ord(df: DataFrame, name: str, weights: DataFrame, star: bool = False) -> DataFrame:
    """(id, g): z scores of Getis and Ord; with ``star`` a feature is its own neighbour of weight 1."""
    c = checkpointed(_centred(df, name))
    if star:
        weights = weights.unionByName(c.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w")))
    lag = weights.join(c.select(F.col("id").alias("j"), F.col("v0").alias("b")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("b")).alias("x"), F.sum("w").alias("s"), F.sum(F.col("w") ** 2).alias("q"))
    t = c.join(lag, c["id"] == lag["i"])
    n, v = F.col("n").cast("double"), F.col("v0")
    if star:
        mean, var, k = F.col("mean"), F.col("m2"), n
    else:  # mean and variance of the others
        mean, k = (F.col("mean") * n - v) / (n - 1), n - 1
        var = ((F.col("m2") + F.col("mean") ** 2) * n - v * v) / (n - 1) - mean * mean
    return t.select("id", ((F.col("x") - mean * F.col("s")) / F.sqrt(var * (k * F.col("q") - F.col("s") ** 2) / (k - 1))).alias("g"))


def acf(series: DataFrame, value: str, order: str, lags: int = 20) -> DataFrame:
    """(lag, acf) for 0 to ``lags`` of a series in the order of a column."""
    if lags <= 0:
        raise ValueError("need a positive lag")
    t = numbered(series.select(F.col(order).alias("o"), F.col(value).cast("double").alias("v")), "o", "v", name="t").select("t", "v")
    m = t.agg(F.avg("v").alias("m"))
    t = checkpointed(t.crossJoin(F.broadcast(m)).select("t", (F.col("v") - F.col("m")).alias("z")))
    k = F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")
    late = t.select(k, "t", F.col("z").alias("a")).withColumn("u", F.col("t") - F.col("lag"))
    num = late.join(t.select(F.col("t").alias("u"), "z"), "u").groupBy("lag").agg(F.sum(F.col("a") * F.col("z")).alias("x"))
    return num.crossJoin(t.agg(F.sum(F.col("z") ** 2).alias("d"))).select("lag", (F.col("x") / F.col("d")).alias("acf"))


# --- sampling ---


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def random_sampling(df: DataFrame, n: int = 10, seed: int = 0, replace: bool = False, key: str = "id") -> DataFrame:
    """n rows by the order of a hash of the key; with ``replace`` n independent draws."""
    if not replace:
        return df.orderBy(_draw(key, seed), key).limit(n)
    total = df.count()
    if not total:
        return df
    picks = np.random.default_rng(seed).integers(1, total + 1, n)
    t = numbered(df.withColumn("__d", _draw(key, seed)), "__d", key, name="__r").drop("__d")
    return t.join(F.broadcast(df.sparkSession.createDataFrame([(int(p),) for p in picks], "__r long")), "__r").drop("__r")


def regular_sampling(points: DataFrame, nx: int = 10, ny: int = 10, seed: int = 0) -> DataFrame:
    """One point of each cell of an nx by ny grid over the points' box."""
    b = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    cell = lambda c, n: F.least(F.floor((F.col(c) - F.col(f"{c}0")) * n / F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0))), F.lit(n - 1))
    t = points.crossJoin(F.broadcast(b)).withColumns({"__i": F.coalesce(cell("x", nx), F.lit(0)), "__j": F.coalesce(cell("y", ny), F.lit(0))})
    w = Window.partitionBy("__i", "__j").orderBy(_draw("id", seed), "id")
    return t.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*points.columns)


def stratified_sampling(df: DataFrame, stratum: str, n: int = 10, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows of each stratum, or all if it has fewer."""
    w = Window.partitionBy(stratum).orderBy(_draw(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def continuous_sampling(df: DataFrame, gap: int, key: str = "id") -> DataFrame:
    """Every gap-th row in the key's order, from the first."""
    return numbered(df, key, name="__r").where((F.col("__r") - 1) % gap == 0).drop("__r")


def sandwich(df: DataFrame, y: str, knowledge: str, reporting: str) -> DataFrame:
    """(reporting unit, mean, variance): zone means weighted by their shares of a reporting unit."""
    zone = df.groupBy(knowledge).agg(F.avg(y).alias("m"), (F.var_samp(y) / F.count(y)).alias("v"))
    part = df.groupBy(reporting, knowledge).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(reporting)))
    return part.join(zone, knowledge).groupBy(reporting).agg(F.sum(F.col("share") * F.col("m")).alias("mean"), F.sum(F.col("share") ** 2 * F.coalesce("v", F.lit(0.0))).alias("variance"))


def sandwich_size(df: DataFrame, y: str, accuracy: float = 0.05) -> DataFrame:
    """(n): sample size for a relative accuracy at 99 % confidence."""
    return df.agg(F.ceil((2.5758 * F.stddev_samp(y) / (F.avg(y) * accuracy)) ** 2).alias("n"))


# --- geographical detectors ---


def _q(df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    each = df.groupBy(*keys).agg(F.count(y).alias("n"), F.var_pop(y).alias("v"), F.sum(y).alias("s"))
    total = df.agg((F.count(y) * F.var_pop(y)).alias("sst"))
    return each.agg(F.sum(F.col("n") * F.col("v")).alias("ssw")).crossJoin(total).select((1 - F.col("ssw") / F.nullif(F.col("sst"), F.lit(0.0))).alias("q"))


def factor_detector(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(x, q) of each factor."""
    out = None
    for x in xs:
        one = _q(df, y, [x]).select(F.lit(x).alias("x"), "q")
        out = one if out is None else out.unionByName(one)
    return out


def interaction_detector(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(x1, x2, q1, q2, q, kind) of each pair of factors."""
    single, out = factor_detector(df, y, xs), None
    for i, a in enumerate(xs):
        for b in xs[i + 1 :]:
            one = _q(df, y, [a, b]).select(F.lit(a).alias("x1"), F.lit(b).alias("x2"), "q")
            out = one if out is None else out.unionByName(one)
    t = out.join(single.select(F.col("x").alias("x1"), F.col("q").alias("q1")), "x1").join(single.select(F.col("x").alias("x2"), F.col("q").alias("q2")), "x2")
    low, high, both = F.least("q1", "q2"), F.greatest("q1", "q2"), F.col("q1") + F.col("q2")
    kind = F.when(F.col("q") < low, "weakened, nonlinear").when(F.col("q") < high, "weakened, one factor").when(F.col("q") > both, "enhanced, nonlinear").when(F.col("q") == both, "independent").otherwise("enhanced, two factors")
    return t.select("x1", "x2", "q1", "q2", "q", kind.alias("kind"))


def ecological_detector(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(x1, x2, ratio): the larger over the smaller q of each pair."""
    f = checkpointed(factor_detector(df, y, xs))
    a, b = (f.select(F.col("x").alias(f"x{k}"), F.col("q").alias(f"q{k}")) for k in (1, 2))
    return a.join(b, F.col("x1") < F.col("x2")).select("x1", "x2", (F.greatest("q1", "q2") / F.nullif(F.least("q1", "q2"), F.lit(0.0))).alias("ratio"))


def risk_detector(df: DataFrame, y: str, x: str) -> DataFrame:
    """(stratum1, stratum2, mean1, mean2, t, df): Welch's test of each pair of strata."""
    s = df.groupBy(F.col(x).alias("s")).agg(F.avg(y).alias("m"), F.var_samp(y).alias("v"), F.count(y).cast("double").alias("n"))
    a, b = (s.select(*[F.col(c).alias(f"{c}{k}") for c in s.columns]) for k in (1, 2))
    t = a.join(b, F.col("s1") < F.col("s2"))
    u, w = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return t.select(F.col("s1").alias("stratum1"), F.col("s2").alias("stratum2"), F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), ((F.col("m1") - F.col("m2")) / F.sqrt(u + w)).alias("t"), ((u + w) ** 2 / (u * u / (F.col("n1") - 1) + w * w / (F.col("n2") - 1))).alias("df"))




def factor_test(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(x, q, f, lambda, p): factor detector with the test of q by the non-central F distribution."""

    @F.arrow_udf("double")
    def tail(f: pa.Array, a: pa.Array, b: pa.Array, lam: pa.Array) -> pa.Array:
        return pa.array([None if None in v else D.noncentral_f_sf(*v) for v in zip(*(c.to_pylist() for c in (f, a, b, lam)))], pa.float64())

    out = None
    for x in xs:
        each = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(y).cast("double").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
        n, m = F.sum("n"), F.sum(F.col("n") * F.col("m"))
        total = (F.sum(F.col("n") * (F.col("v") + F.col("m") ** 2)) - m * m / n) / n
        t = each.agg(F.count("*").cast("double").alias("l"), n.alias("n"), (1 - F.sum(F.col("n") * F.col("v")) / (n * total)).alias("q"), ((F.sum(F.col("m") ** 2) - F.sum(F.sqrt("n") * F.col("m")) ** 2 / n) / (total * n / (n - 1))).alias("lambda"))
        one = t.select(F.lit(x).alias("x"), "q", ((F.col("n") - F.col("l")) / (F.col("l") - 1) * F.col("q") / (1 - F.col("q"))).alias("f"), "lambda", (F.col("l") - 1).alias("a"), (F.col("n") - F.col("l")).alias("b"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("p", tail("f", "a", "b", F.greatest("lambda", F.lit(0.0)))).select("x", "q", "f", "lambda", "p")


def ecological_test(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(x1, x2, f, p): whether the within-strata variances of each pair of factors differ, by an F test."""

    @F.arrow_udf("double")
    def tail(f: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if a is None else D.f_sf(a, b - 1, b - 1) for a, b in zip(f.to_pylist(), n.to_pylist())], pa.float64())

    one = None
    for x in xs:
        ssw = df.groupBy(x).agg((F.count(y) * F.var_pop(y)).alias("s")).agg(F.sum("s").alias("s")).select(F.lit(x).alias("x"), "s")
        one = ssw if one is None else one.unionByName(ssw)
    a, b = (checkpointed(one).select(F.col("x").alias(f"x{k}"), F.col("s").alias(f"s{k}")) for k in (1, 2))
    n = df.agg(F.count(y).cast("double").alias("n"))
    pairs = a.join(b, F.col("x1") < F.col("x2")).crossJoin(F.broadcast(n))  # pairs of factors, and one row
    f = F.greatest("s1", "s2") / F.nullif(F.least("s1", "s2"), F.lit(0.0))
    return pairs.select("x1", "x2", f.alias("f"), tail(f, "n").alias("p"))
