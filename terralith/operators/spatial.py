"""Spatial queries and joins.

Joins go by grid cells: each side's box is exploded to the cells it touches, cells join by
equality, and a pair is kept only in the cell of its reference point, so no distinct is
needed. The exact predicate then runs on candidate pairs. Points and boxes need no Python.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..session import checkpointed, connected


def with_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Adds xmin, ymin, xmax and ymax of a WKT column."""

    @F.arrow_udf("struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    def box(a: pa.Array) -> pa.Array:
        rows = [None if t is None else G.bounds(g) if G.coordinates(g := G.from_wkt(t)) else None for t in a.to_pylist()]
        return pa.array([None if r is None else dict(zip(("xmin", "ymin", "xmax", "ymax"), r)) for r in rows], pa.struct([(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")]))

    return df.withColumn("__b", box(geom)).select(*df.columns, "__b.*")


def cell_size(df: DataFrame) -> float:
    """A grid cell's edge for boxes (xmin to ymax): the larger of their 90th percentile edge and the edge at which
    the cells over their extent are as many as the boxes, so that neither a box nor a cell holds many of the other."""
    edge = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    r = df.agg(F.percentile_approx(edge, 0.9), F.count("*"), F.max("xmax") - F.min("xmin"), F.max("ymax") - F.min("ymin")).first()
    if not r[1]:
        return 1.0
    return float(max(r[0] or 0.0, math.sqrt((r[2] or 0.0) * (r[3] or 0.0) / r[1]))) or 1.0


def delaunay_cells(points: DataFrame) -> DataFrame:
    """(triangle, geom): Delaunay triangles of the distinct points; the triangulation is one task's."""
    p = points.select("x", "y").dropna().distinct()

    def make(t: pa.Table) -> pa.Table:
        ps = sorted(zip(t["x"].to_pylist(), t["y"].to_pylist()))
        tri = sorted(tuple(sorted(v)) for v in G.delaunay(ps)) if len(ps) > 2 else []
        return pa.table({"triangle": pa.array(range(len(tri)), pa.int32()), "geom": pa.array([G.to_wkt(("Polygon", [[ps[a], ps[b], ps[c], ps[a]]])) for a, b, c in tri], pa.string())})

    return p.groupBy().applyInArrow(make, "triangle int, geom string")


def _cells(df: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - grow) / cell), F.floor((F.col(hi) + grow) / cell))
    return df.withColumn("gx", F.explode(span("xmin", "xmax"))).withColumn("gy", F.explode(span("ymin", "ymax")))


def box_pairs(a: DataFrame, b: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """Structs a and b of all rows whose boxes (xmin to ymax), the first grown, meet."""
    left = _cells(a, cell, grow).select("gx", "gy", F.struct(*a.columns).alias("a"))
    right = _cells(b, cell).select("gx", "gy", F.struct(*b.columns).alias("b"))
    low = lambda n: F.floor(F.greatest(F.col(f"a.{n}") - grow, F.col(f"b.{n}")) / cell)
    meet = (F.col("a.xmin") - grow <= F.col("b.xmax")) & (F.col("a.xmax") + grow >= F.col("b.xmin")) & (F.col("a.ymin") - grow <= F.col("b.ymax")) & (F.col("a.ymax") + grow >= F.col("b.ymin"))
    return left.join(right, ["gx", "gy"]).where(meet & (F.col("gx") == low("xmin")) & (F.col("gy") == low("ymin"))).select("a", "b")


def join(a: DataFrame, b: DataFrame, predicate: str = "Contains", cell: float = 1.0, geom_a: str = "geom", geom_b: str = "geom") -> DataFrame:
    """Pairs (structs a and b) of WKT features for which ``predicate(a, b)`` holds."""
    test = G.predicate(predicate)
    if predicate == "Disjoint":
        both = a.select(F.struct(*a.columns).alias("a")).crossJoin(b.select(F.struct(*b.columns).alias("b")))
        return both.where(test(F.col(f"a.{geom_a}"), F.col(f"b.{geom_b}")))
    pairs = box_pairs(with_bounds(a, geom_a), with_bounds(b, geom_b), cell)
    return pairs.where(test(F.col(f"a.{geom_a}"), F.col(f"b.{geom_b}")))


def join_grouped(a: DataFrame, b: DataFrame, predicate: str = "Contains", cell: float = 1.0, key: str = "id", order: str = "id") -> DataFrame:
    """(key, matched): each row of ``a`` that has matches, with the keys of its matches in order."""
    got = join(a, b, predicate, cell)
    return got.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sort_array(F.collect_list(f"b.{order}")).alias("matched"))


def query(df: DataFrame, wkt: str, predicate: str = "Intersects", geom: str = "geom", count: bool = False) -> DataFrame:
    """Rows whose geometry stands so to a fixed one; or their number."""
    x0, y0, x1, y1 = G.bounds(G.from_wkt(wkt))
    if predicate != "Disjoint" and {"xmin", "ymin", "xmax", "ymax"} <= set(df.columns):
        df = df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    got = df.where(G.predicate(predicate)(F.col(geom), F.lit(wkt)))
    return got.agg(F.count("*").alias("count")) if count else got


# --- points (id, x, y) and boxes (id, xmin, ymin, xmax, ymax), without Python ---


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs (structs p and b); boxes are half open, so tiles of a plane share no point."""
    p = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell)).select("gx", "gy", F.struct(*points.columns).alias("p"))
    b = _cells(boxes, cell).select("gx", "gy", F.struct(*boxes.columns).alias("b"))
    inside = (F.col("p.x") >= F.col("b.xmin")) & (F.col("p.x") < F.col("b.xmax")) & (F.col("p.y") >= F.col("b.ymin")) & (F.col("p.y") < F.col("b.ymax"))
    return p.join(b, ["gx", "gy"]).where(inside).select("p", "b")


RULES = {
    "sum": F.sum,
    "mean": F.avg,
    "median": F.median,
    "mode": lambda c: F.mode(c, True),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "count": F.count,
}


def reduce(pairs: DataFrame, key: Column, rules: list[tuple[str, str]], order: Column, side: str = "b") -> DataFrame:
    """One row a key, with ``property_rule`` columns: first, last, concat, or a rule of ``RULES``."""
    out = []
    for prop, rule in rules:
        c = F.col(f"{side}.{prop}")
        if rule == "first":
            v = F.min_by(c, order)
        elif rule == "last":
            v = F.max_by(c, order)
        elif rule == "concat":
            v = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), c.cast("string").alias("v")))), lambda x: x["v"]), ",")
        else:
            v = RULES[rule](c)
        out.append(v.alias(f"{prop}_{rule}"))
    return pairs.groupBy(key.alias("id")).agg(*out)


def _dist(a: str = "a", b: str = "b") -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def _near(a: DataFrame, b: DataFrame, d: float, limit: str) -> DataFrame:
    """(structs a and b, dist) of rows nearer than d; each row of b is sent to the nine cells around it, of width d."""
    cell = float(d) or 1.0
    left = a.select(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"), F.struct(*a.columns).alias("a"))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    right = b.select(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"), F.struct(*b.columns).alias("b"))
    right = right.select("j", "b", "i", near.alias("k")).select("b", "j", (F.col("i") + F.col("k")).alias("gx"), near.alias("k")).select("b", "gx", (F.col("j") + F.col("k")).alias("gy"))
    got = left.join(right, ["gx", "gy"]).select("a", "b", _dist().alias("dist"))
    return got.where(F.col("dist") <= d if limit == "less_equal" else F.col("dist") < d)


def _at_places(df: DataFrame, what: Column) -> DataFrame:
    """(x, y, rows): of each place, a list of its rows."""
    return df.where("x is not null and y is not null").groupBy("x", "y").agg(F.collect_list(what).alias("rows"))


def distance_join(a: DataFrame, b: DataFrame, d: float, limit: str = "less_than", places: int | None = None) -> DataFrame:
    """(structs a and b, dist) of points nearer than d; ``less_equal`` takes d itself as well.

    Places are joined, and their points listed after that. ``places`` rounds the distances, once for all points of two places.
    """
    got = _near(_at_places(a, F.struct(*a.columns)), _at_places(b, F.struct(*b.columns)), d, limit)
    dist = F.col("dist") if places is None else F.round("dist", places).alias("dist")
    return got.select(dist, "b", F.explode("a.rows").alias("__a")).select(F.col("__a").alias("a"), F.explode("b.rows").alias("b"), "dist")


def distance_join_grouped(a: DataFrame, b: DataFrame, d: float, limit: str = "less_than", key: str = "id", text: str | None = None) -> DataFrame:
    """(key, matched): each row of ``a`` that has matches, with the keys of its matches in order, as one string between which ``text`` stands if given.

    A place's list is made once and given to all of its rows."""
    keys = a.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    again = a.join(keys, key, "left_semi")  # rows that share a key share a list of all of them
    once = a.join(keys, key, "left_anti")
    done = (lambda c: c) if text is None else (lambda c: F.array_join(c, text))
    at = _at_places(once, F.col(key))
    pairs = _near(at.select("x", "y"), _at_places(b, F.col(key)), d, limit)
    lists = pairs.groupBy("a.x", "a.y").agg(F.sort_array(F.flatten(F.collect_list("b.rows"))).alias("matched")).where(F.size("matched") > 0)
    got = at.join(lists.select("x", "y", done(F.col("matched")).alias("matched")), ["x", "y"]).select(F.explode("rows").alias(key), "matched")
    rest = distance_join(again.select(key, "x", "y"), b, d, limit).groupBy(F.col(f"a.{key}").alias(key)).agg(done(F.sort_array(F.collect_list(f"b.{key}"))).alias("matched"))
    return got.unionByName(rest)


def nearest_to(points: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """The k points nearest to a place, by distance and id."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return points.withColumn("dist", d).orderBy("dist", "id").limit(k)


def knn(queries: DataFrame, points: DataFrame, k: int, exclude_same: bool = False) -> DataFrame:
    """(qid, id, dist, rank): the k nearest points of every query, ties by id; exact.

    A distance join with a radius r finds all points within r; a query with k of them is
    done. The others go on with twice the radius, until it spans everything. Places are
    searched for, once for all queries of a place, and of the points of one place only
    those of the least ids, which are all that can be among the k.
    """
    q, p = queries.select("id", "x", "y"), points.select("id", "x", "y").dropna(subset=["x", "y"])
    n = p.select("x", "y").distinct().count()
    ends = p.unionByName(q).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n or ends[0] is None:
        return q.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
    m = k + exclude_same  # a query's own id takes one place
    least = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    p = checkpointed(p.withColumn("__n", least).where(F.col("__n") <= m).drop("__n"))
    left = checkpointed(q.select("x", "y").dropna().distinct().select(F.struct("x", "y").alias("id"), "x", "y"))
    w, h = max(ends[1] - ends[0], 1e-9), max(ends[3] - ends[2], 1e-9)
    whole = math.hypot(w, h) * 1.01
    r = min(whole, math.sqrt(w * h * (m + 1) / n / math.pi) * 1.5 or whole)
    order, out = Window.partitionBy("qid").orderBy("dist", "id"), None
    while True:
        hit = _near(left, p, r, "less_equal").select(F.col("a.id").alias("qid"), F.col("b.id").alias("id"), "dist")
        ranked = checkpointed(hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m))
        if r >= whole:
            out = ranked if out is None else out.unionByName(ranked)
            break
        full = ranked.groupBy("qid").agg(F.max("rank").alias("n")).where(F.col("n") == m).select("qid")
        done = ranked.join(full, "qid", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = checkpointed(left.join(full, left["id"] == full["qid"], "left_anti"))
        if left.isEmpty():
            break
        r = min(whole, 2 * r)
    lists = out.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("near")).select("qid.x", "qid.y", "near")
    got = q.withColumnRenamed("id", "qid").join(lists, ["x", "y"])
    near = F.filter("near", lambda s: s["id"] != F.col("qid")) if exclude_same else F.col("near")
    got = got.select("qid", F.posexplode(F.slice(near, 1, k)).alias("i", "s"))
    return got.select("qid", "s.id", "s.dist", (F.col("i") + 1).cast("int").alias("rank"))


def _around(cells: DataFrame) -> DataFrame:
    """Each row for the 25 cells around its cell (gx, gy), as (kx, ky)."""
    off = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    return cells.withColumn("o", off).withColumn("kx", F.col("gx") + F.col("o")).withColumn("o", off).withColumn("ky", F.col("gy") + F.col("o")).drop("o")


def _reach(x, y, u, v, eps: float, most: int = 2**18):
    """(rows, matrix of which of (u, v) are within eps) in pieces of the rows (x, y)."""
    step = max(1, most // max(1, len(u)))
    for i in range(0, len(x), step):
        yield slice(i, i + step), (x[i : i + step, None] - u) ** 2 + (y[i : i + step, None] - v) ** 2 <= eps * eps


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster): the least core id of the cluster, or null for noise.

    A core point has ``least`` points within eps, itself among them; a border point joins
    the cluster of its least core neighbour. Points of one place go together. Places of one
    cell, whose diagonal is eps, are all neighbours: a cell of ``least`` points has only
    cores, and the cores of a cell are linked by their least id. Pairs of places are only
    looked at until a cell is known to be linked to the next, and are never listed.
    """
    p = points.select("id", "x", "y")
    kind = p.schema["id"].dataType.simpleString()
    side = eps / math.sqrt(2) * (1 - 1e-9) or 1e-9
    at = p.dropna().groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("gx", F.floor(F.col("x") / side)).withColumn("gy", F.floor(F.col("y") / side))

    def parted(t: pa.Table):
        c = {k: t[k].to_numpy() for k in t.column_names}
        own = (c["gx"] == c["kx"]) & (c["gy"] == c["ky"])
        return c, own, {k: v[own] for k, v in c.items()}

    def cores(t: pa.Table) -> pa.Table:
        c, own, mine = parted(t)
        core = np.full(len(mine["x"]), mine["n"].sum() >= least)
        if len(core) and not core[0]:
            for i, within in _reach(mine["x"], mine["y"], c["x"], c["y"], eps):
                core[i] = within @ c["n"] >= least
        return t.select(["x", "y", "id", "gx", "gy"]).filter(pa.array(own)).append_column("core", pa.array(core))

    found = checkpointed(_around(at).groupBy("kx", "ky").applyInArrow(cores, f"x double, y double, id {kind}, gx bigint, gy bigint, core boolean"))

    def links(t: pa.Table) -> pa.Table:
        """c: a core place and its cell's least core; l: the least cores of two cells within reach; b: a border place and its least core neighbour."""
        c, own, mine = parted(t)
        a, b, what = [], [], []
        is_core = c["core"].astype(bool)
        if len(mine["x"]):
            here = mine["core"].astype(bool)
            x, y = mine["x"][here], mine["y"][here]
            if here.any():
                low = mine["id"][here].min()
                a, b, what = list(mine["id"][here]), [low] * len(x), ["c"] * len(x)
                for dx, dy in [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]:
                    there = is_core & (c["gx"] - c["kx"] == dx) & (c["gy"] - c["ky"] == dy)
                    u, v = c["x"][there], c["y"][there]
                    if len(u):  # only places that may reach the other cell's box
                        s = np.hypot(np.maximum(0, np.maximum(u.min() - x, x - u.max())), np.maximum(0, np.maximum(v.min() - y, y - v.max()))) <= eps * (1 + 1e-9)
                        if any(within.any() for _, within in _reach(x[s], y[s], u, v, eps)):
                            a, b, what = [*a, low], [*b, c["id"][there].min()], [*what, "l"]
            ids = np.sort(c["id"][is_core])
            by = np.argsort(c["id"][is_core], kind="stable")
            u, v = c["x"][is_core][by], c["y"][is_core][by]
            if len(u) and not here.all():
                edge = mine["id"][~here]
                for i, within in _reach(mine["x"][~here], mine["y"][~here], u, v, eps):
                    hit = within.any(1)
                    first = ids[within.argmax(1)[hit]]
                    a, b, what = [*a, *edge[i][hit]], [*b, *first], [*what, *["b"] * len(first)]
        return pa.table({"what": pa.array(what, pa.string()), "a": pa.array(a, t.schema.field("id").type), "b": pa.array(b, t.schema.field("id").type)})

    got = checkpointed(_around(found).groupBy("kx", "ky").applyInArrow(links, f"what string, a {kind}, b {kind}"))
    comp = connected(got.where("what = 'l'").select("a", "b"))
    c = got.where("what = 'c'").join(comp.withColumnRenamed("id", "b"), "b", "left").select(F.col("a").alias("id"), F.coalesce("comp", "b").alias("cluster"))
    c = checkpointed(c)
    edge = got.where("what = 'b'").select(F.col("a").alias("own"), F.col("b").alias("id")).join(c, "id").select(F.col("own").alias("id"), "cluster")
    place = found.select("x", "y", "id").join(c.unionByName(edge), "id").select("x", "y", "cluster")
    return p.join(place, ["x", "y"], "left").select("id", "cluster")


# --- overlay of collections ---


def intersection(a: DataFrame, b: DataFrame, cell: float = 1.0, geom: str = "geom") -> DataFrame:
    """Rows of a with the geometry's common part with each row of b that it meets."""
    got = join(a, b, "Intersects", cell)
    return got.select(*[F.col(f"a.{c}") for c in a.columns if c != geom], G.overlaid("intersection")(F.col(f"a.{geom}"), F.col(f"b.{geom}")).alias(geom))


def _union_udaf(df: DataFrame, keys: list[str], geom: str, op: str = "union") -> DataFrame:
    """One geometry a group: first within Spark's partitions, then of those."""

    def fold(t: pa.Table) -> pa.Table:
        gs = [G.from_wkt(x) for x in t[geom].to_pylist() if x is not None]
        if op == "union":
            g = G.union_all(gs)
        else:
            g = gs[0] if gs else ("GeometryCollection", [])
            for x in gs[1:]:
                g = G.overlay(g, x, op)
        return pa.table({**{k: t[k].combine_chunks()[:1] for k in keys}, geom: pa.array([G.to_wkt(g)])})

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{geom} string"])
    salted = df.select(*keys, geom, F.pmod(F.xxhash64(geom), F.lit(16)).alias("__salt"))
    part = salted.groupBy(*keys, "__salt").applyInArrow(fold, schema)
    return part.groupBy(*keys).applyInArrow(fold, schema)


def union_aggregate(df: DataFrame, geom: str = "geom") -> DataFrame:
    return _union_udaf(df.select(geom), [], geom)


def intersection_aggregate(df: DataFrame, geom: str = "geom") -> DataFrame:
    return _union_udaf(df.select(geom), [], geom, "intersection")


def union(a: DataFrame, b: DataFrame, geom: str = "geom") -> DataFrame:
    return union_aggregate(a.select(geom).unionByName(b.select(geom)), geom)


def erase(a: DataFrame, b: DataFrame, cell: float = 1.0, key: str = "id", geom: str = "geom") -> DataFrame:
    """Rows of a without the parts that rows of b cover; rows that vanish go."""
    hit = join(a, b, "Intersects", cell).select(F.col(f"a.{key}").alias(key), F.col(f"b.{geom}").alias(geom))
    cover = _union_udaf(hit, [key], geom).withColumnRenamed(geom, "__cover")
    got = a.join(cover, key, "left").withColumn(geom, F.coalesce(G.overlaid("difference")(F.col(geom), F.col("__cover")), F.col(geom)))
    return got.drop("__cover").where(~F.col(geom).contains("EMPTY"))


def difference(a: DataFrame, b: DataFrame, cell: float = 1.0, geom: str = "geom") -> DataFrame:
    """For each pair that intersects, a without b, with the columns of a."""
    got = join(a, b, "Intersects", cell)
    return got.select(*[F.col(f"a.{c}") for c in a.columns if c != geom], G.overlaid("difference")(F.col(f"a.{geom}"), F.col(f"b.{geom}")).alias(geom))


def difference_with(df: DataFrame, wkt: str, geom: str = "geom") -> DataFrame:
    hit = G.predicate("Intersects")(F.col(geom), F.lit(wkt))
    return df.withColumn(geom, F.when(hit, G.overlaid("difference")(F.col(geom), F.lit(wkt))).otherwise(F.col(geom)))


def buffer_overlay(a: DataFrame, b: DataFrame, d: float, cell: float = 1.0, geom: str = "geom") -> DataFrame:
    """Buffers of a, cut to b."""
    return intersection(a.withColumn(geom, G.shape("buffer", d)(F.col(geom))), b, cell, geom)


def within_distance(a: DataFrame, b: DataFrame, d: float, cell: float = 1.0, key: str = "id", geom: str = "geom") -> DataFrame:
    """(a, b, dist) keys of pairs of WKT features at most d apart."""
    pairs = box_pairs(with_bounds(a, geom), with_bounds(b, geom), cell, d)
    got = pairs.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), G.between()(F.col(f"a.{geom}"), F.col(f"b.{geom}")).alias("dist"))
    return got.where(F.col("dist") <= d)


def nearest_within(a: DataFrame, b: DataFrame, d: float, cell: float = 1.0, key: str = "id", geom: str = "geom") -> DataFrame:
    """(a, min_dist, nearest): the nearest feature of b within d."""
    return within_distance(a, b, d, cell, key, geom).groupBy("a").agg(F.min("dist").alias("min_dist"), F.min(F.struct("dist", "b"))["b"].alias("nearest"))


def neighbourhood(df: DataFrame, cell: float = 1.0, key: str = "id", geom: str = "geom") -> DataFrame:
    """(key, area, length, node_count): shared area with overlapping and shared border with touching others."""
    pairs = join(df, df, "Intersects", cell, geom, geom).where(F.col(f"a.{key}") != F.col(f"b.{key}"))
    common = pairs.select(F.col(f"a.{key}").alias(key), G.overlaid("intersection")(F.col(f"a.{geom}"), F.col(f"b.{geom}")).alias("g"))
    each = common.groupBy(key).agg(F.sum(G.measure("area")("g")).alias("area"), F.sum(F.when(G.measure("area")("g") == 0, G.measure("length")("g")).otherwise(0.0)).alias("length"), F.count("*").alias("node_count"))
    return df.select(key).join(each, key, "left").na.fill(0, ["area", "length", "node_count"])


def rasterize(points: DataFrame, value: str, cols: int, rows: int, x0: float, y0: float, x1: float, y1: float, how: str = "last") -> DataFrame:
    """(band, cx, cy, v): property of the point with the greatest id in each cell (or its mean, sum or count)."""
    cx = F.floor((F.col("x") - x0) / ((x1 - x0) / cols)).cast("int")
    cy = F.floor((y1 - F.col("y")) / ((y1 - y0) / rows)).cast("int")
    v = F.col(value).cast("double")
    f = {"last": F.max_by(v, "id"), "mean": F.avg(v), "sum": F.sum(v), "count": F.count(v).cast("double")}[how]
    t = points.withColumns({"cx": cx, "cy": cy}).where((F.col("cx") >= 0) & (F.col("cx") < cols) & (F.col("cy") >= 0) & (F.col("cy") < rows))
    return t.groupBy("cx", "cy").agg(f.alias("v")).select(F.lit(value).alias("band"), "cx", "cy", "v")


def land_suitability(land: DataFrame, ecology: DataFrame, urban: DataFrame, slope: DataFrame, steep: float = 4, small: float = 3333.33, joined: float = 6666.67, gap: float = 10.0, least: float = 200.0, cell: float = 1000.0) -> DataFrame:
    """(id, geom, reason): what makes farmland unfit: parts in ecology or urban zones or on steep slopes, and fragments.

    What is left after the zones is a fragment if it is smaller than ``small`` and it and
    its neighbours within ``gap`` are together smaller than ``joined``. Parts of less than
    ``least`` area are left out.
    """
    zones = [("ecology", ecology), ("urban", urban), ("slope", slope.where(F.col("grade").cast("double") > steep))]
    left, out = land.select("id", "geom"), None
    for reason, z in zones:
        part = intersection(left, z.select("geom"), cell).withColumn("reason", F.lit(reason))
        out = part if out is None else out.unionByName(part)
        left = checkpointed(erase(left, z.select("geom"), cell))
    sized = checkpointed(left.withColumn("area", G.measure("area")("geom")))
    near = within_distance(sized, sized, gap, cell).where("a != b").join(sized.select(F.col("id").alias("b"), F.col("area").alias("other")), "b").groupBy("a").agg(F.sum("other").alias("other"))
    bits = sized.join(near, sized["id"] == near["a"], "left").where((F.col("area") < small) & (F.col("area") + F.coalesce("other", F.lit(0.0)) < joined))
    out = out.unionByName(bits.select("id", "geom", F.lit("fragment").alias("reason")))
    return out.where(G.measure("area")("geom") > least)


def voronoi_cells(df: DataFrame, frame: str, parts: int = 16) -> DataFrame:
    """(x, y, geom): the cell of each distinct point within a WKT frame; ``parts`` tasks, which share the points.

    A cell is cut by the points of the grid cells around its own, of ever more of them until
    no point beyond can be near enough to cut it."""
    at = df.select("x", "y").dropna().distinct()
    t = at.toArrow()
    x, y = t["x"].to_numpy(), t["y"].to_numpy()
    if not len(x):
        return df.sparkSession.createDataFrame([], "x double, y double, geom string")
    x0, y0 = x.min(), y.min()
    size = max(math.sqrt(max(np.ptp(x), 1e-9) * max(np.ptp(y), 1e-9) / len(x)) * 2, max(np.ptp(x), np.ptp(y)) / 4096) or 1.0
    gx, gy = np.floor((x - x0) / size).astype(int), np.floor((y - y0) / size).astype(int)
    wide, high = gx.max() + 1, gy.max() + 1
    order = np.lexsort((gy, gx))
    shared = df.sparkSession.sparkContext.broadcast((x[order], y[order], (gx * high + gy)[order]))
    area = G.from_wkt(frame)

    def run(batches):
        x, y, cell = shared.value
        for b in batches:
            cells = []
            for p in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                i, j, r = int((p[0] - x0) // size), int((p[1] - y0) // size), 1
                while True:
                    columns = np.arange(max(0, i - r), min(wide, i + r + 1))
                    lo, hi = np.searchsorted(cell, columns * high + max(0, j - r)), np.searchsorted(cell, columns * high + min(high - 1, j + r), "right")
                    k = np.concatenate([np.arange(u, v) for u, v in zip(lo, hi)])
                    got = G.voronoi([p, *zip(x[k].tolist(), y[k].tolist())], area, [p])[0]
                    far = max((math.dist(p, c) for c in G.coordinates(got)), default=0.0)
                    if 2 * far < r * size * (1 - 1e-9) or r > max(wide, high):
                        break
                    r *= 2
                cells.append(G.to_wkt(got))
            yield pa.RecordBatch.from_arrays([b["x"], b["y"], pa.array(cells, pa.string())], ["x", "y", "geom"])

    return at.repartition(parts, "x", "y").mapInArrow(run, "x double, y double, geom string")
