"""Operators on tiles against the same on cell tables, and flow along tiles against plain loops."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import cellmath
from terralith.operators import collection, focal, raster, terrain, tiles

KIND = "band string, cx int, cy int, v double"


def cells(spark, seed=1, n=21, bands=("a", "b"), high=60.0, holes=True):
    """An irregular raster with NoData, missing cells and negative indices."""
    rng = np.random.default_rng(seed)
    rows = [(b, x - 5, y - 3, None if holes and rng.random() < 0.1 else float(rng.integers(-5, high))) for b in bands for x in range(n) for y in range(n - 4) if not holes or rng.random() < 0.9]
    return spark.createDataFrame(rows, KIND)


def rows(df):
    t = tiles.cells_of(df)
    return {tuple(r[c] for c in sorted(t.columns) if c != "v"): None if r["v"] is None else round(r["v"], 9) for r in t.collect()}


@pytest.fixture(scope="module")
def one(spark):
    return cells(spark).cache()


@pytest.fixture(scope="module")
def two(spark):
    return cells(spark, 2).cache()


def test_round_trip_keeps_the_outline(spark, one):
    assert rows(tiles.to_tiles(one, 8)) == rows(one)
    images = one.withColumn("cov_id", F.lit("x"))
    assert rows(tiles.to_tiles(images, 8)) == rows(images)


LOCAL = {
    "filter": lambda t: raster.local(t, lambda v: cellmath.within(v, 5, 30)),
    "sqrt": lambda t: raster.unary(raster.unary(t, "abs"), "sqrt"),
    "remove_zero": lambda t: raster.unary(t, "remove_zero"),
    "divide": lambda t: raster.constant(t, "divide_num", 4),
    "reclass": lambda t: raster.local(t, lambda v: cellmath.reclass(v, [(0, 9, 1)], None)),
    "hsv_there_and_back": lambda t: raster.hsv_to_rgb(raster.rgb_to_hsv(raster.add_bands(raster.unary(t, "abs"), raster.rename(raster.select_bands(raster.unary(t, "abs"), ["a"]), ["a"], ["c"])), "a", "b", "c")),
    "ndvi": lambda t: raster.normalized_difference(t, "a", "b"),
    "stack": lambda t: raster.stack(raster.select_bands(t, ["b"]), 2),
    "into_one": lambda t: raster.into_one(t),
    "percentiles": lambda t: raster.percentile_range(t, 0.2, 0.8),
    "styles": lambda t: raster.add_styles(t),
    "gamma": lambda t: raster.add_styles(t, low=0, high=50, gamma=2.0),
    "palette": lambda t: raster.add_styles(raster.select_bands(raster.unmask(t, raster.local(t, lambda v: F.lit(1.0))), ["a"]), low=0, high=50, palette=[(1, 2, 3), (4, 5, 6), (7, 8, 9)]),
    "box": lambda t: raster.clip_box(t, -2, -1, 9, 7),
    "polygon": lambda t: raster.clip(t, "POLYGON ((-4 -3, 12 -1, 3 11, -4 -3))"),
}


@pytest.mark.parametrize("name", LOCAL)
def test_local(one, name):
    want, got = rows(LOCAL[name](one)), rows(LOCAL[name](tiles.to_tiles(one, 8)))
    if name in ("palette", "ndvi"):  # a cell table drops NoData there
        want, got = ({k: v for k, v in r.items() if v is not None} for r in (want, got))
    assert got == want and want


@pytest.mark.parametrize("name", ["add", "divide", "mini", "and", "bitwise_xor", "atan2"])
def test_two_rasters(one, two, name):
    assert rows(raster.binary(tiles.to_tiles(one, 8), tiles.to_tiles(two, 8), name)) == rows(raster.binary(one, two, name))


def test_masks_and_overlays(one, two):
    a, b = tiles.to_tiles(one, 8), tiles.to_tiles(two, 8)
    for f in (raster.overlay, raster.unmask, lambda x, y: raster.mask(x, raster.select_bands(y, ["a"]), 3.0, 7.0), lambda x, y: raster.update_mask(x, y), lambda x, y: raster.combine(x, raster.rename(y, ["a", "b"], ["p", "q"]), lambda v, w: v - w, True)):
        assert rows(f(a, b)) == rows(f(one, two))


@pytest.mark.parametrize("pad", ["zero", "null"])
@pytest.mark.parametrize("stat", ["mean", "sum", "sd", "max", "min", "median", "mode", "entropy"])
def test_focal(one, stat, pad):
    for kernel in ("square", "circle"):
        want, got = rows(focal.focal(one, stat, 2, kernel, pad)), rows(focal.focal(tiles.to_tiles(one, 8), stat, 2, kernel, pad))
        assert {k: v for k, v in got.items() if v is not None} == {k: pytest.approx(v, abs=1e-7) for k, v in want.items()}


@pytest.mark.parametrize("name", ["slope", "aspect", "gradient", "convolve", "t_slope", "t_aspect", "curvature", "hillshade", "ruggedness", "pits", "vip"])
def test_windows(one, name):
    f = {"slope": focal.slope, "aspect": focal.aspect, "gradient": focal.gradient, "convolve": lambda t: focal.convolve(t, focal.kirsch()), "t_slope": terrain.slope, "t_aspect": terrain.aspect, "curvature": terrain.curvature, "hillshade": terrain.hillshade, "ruggedness": terrain.ruggedness, "pits": terrain.pits, "vip": lambda t: terrain.feature_points(t, 10.0)}[name]
    some = lambda df: {k: v for k, v in rows(df.drop("vip")).items() if v is not None}
    want = some(f(one))
    assert some(f(tiles.to_tiles(one, 8))) == {k: pytest.approx(v, abs=1e-7) for k, v in want.items()} and want


def test_a_window_wider_than_a_tile_is_refused(one):
    with pytest.raises(Exception, match="wider than a tile"):
        focal.focal(tiles.to_tiles(one, 4), "mean", 5).collect()


@pytest.mark.parametrize("how", ["mean", "min", "max", "sum", "median", "mode", "or", "and", "cat", "count"])
def test_stacks(spark, how):
    images = collection.merge_coverages([cells(spark, k, high=6.0) for k in (3, 4, 5)], ["x", "y", "z"])
    assert rows(collection.reduce(tiles.to_tiles(images, 8), how)) == rows(collection.reduce(images, how))


@pytest.mark.parametrize("factor,how", [(-2, "mean"), (-4, "nearest"), (3, "nearest"), (2, "bilinear"), (2, "cubic")])
def test_grids(one, factor, how):
    whole = raster.resample(one, factor, how)
    some = lambda df: {k: v for k, v in rows(df).items() if v is not None}
    assert some(raster.resample(tiles.to_tiles(one, 8), factor, how)) == {k: pytest.approx(v, abs=1e-7) for k, v in some(whole).items()}


def test_regions(spark, one):
    regions = spark.createDataFrame([(1, -4.0, -3.0, 6.0, 9.0), (2, 0.0, 0.0, 40.0, 3.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    assert {tuple(r) for r in raster.sample_regions(tiles.to_tiles(one, 8), regions).select("id", "sample", "band", "cx", "cy", "v").collect()} == {tuple(r) for r in raster.sample_regions(one, regions).collect()}


# --- flow ---


@pytest.fixture(scope="module")
def land(spark):
    """Elevations with a slope, noise, a lake and holes, as {(x, y): z}."""
    rng = np.random.default_rng(7)
    z = {(x, y): float(np.round(3 * x + 2 * y + rng.random() * 12, 3)) for x in range(27) for y in range(22) if rng.random() > 0.03}
    z |= {k: 1.0 + 0.001 * (k[0] * 31 + k[1]) for k in z if 9 <= k[0] <= 14 and 8 <= k[1] <= 12}
    df = spark.createDataFrame([("b", x, y, v) for (x, y), v in z.items()], KIND)
    return z, tiles.to_tiles(df, 8).cache()


def near(z, c):
    return [(k, (c[0] + dx, c[1] + dy), math.hypot(dx, dy)) for k, (dx, dy) in enumerate(terrain.D8) if (c[0] + dx, c[1] + dy) in z]


def directions(z):
    out = {}
    for c in z:
        best = max(((z[c] - z[n]) / d, -k, n) for k, n, d in near(z, c)) if near(z, c) else (0, 0, c)
        out[c] = (-best[1], best[2]) if best[0] > 0 else (-1, None)
    return out


def got_of(df):
    return {(r.cx, r.cy): r.v for r in tiles.cells_of(df).collect() if r.v is not None}


def test_accumulation(land):
    z, t = land
    d, order = directions(z), sorted(z, key=lambda c: -z[c])
    acc, mfd, length, strahler, above = dict.fromkeys(z, 2.0), dict.fromkeys(z, 2.0), {}, {}, {c: [] for c in z}
    for c in order:
        got = sorted((strahler[a] for a in above[c]), reverse=True)
        strahler[c] = 1 if not got else got[0] + (len(got) > 1 and got[0] == got[1])
        if d[c][1]:
            acc[d[c][1]] += acc[c]
            above[d[c][1]].append(c)
        down = [(n, ((z[c] - z[n]) / w) ** 1.1) for _, n, w in near(z, c) if z[n] < z[c]]
        for n, s in down:
            mfd[n] += mfd[c] * s / sum(x for _, x in down)
    for c in reversed(order):
        length[c] = 0.0 if d[c][1] is None else length[d[c][1]] + math.dist(c, d[c][1])
    assert got_of(terrain.flow_direction(t)) == {c: float(k) for c, (k, _) in d.items()}
    assert got_of(terrain.flow_connectivity(t)) == {c: float(len(v)) for c, v in above.items()}
    assert got_of(terrain.flow_accumulation(t, 2.0)) == acc and max(acc.values()) > 100
    assert got_of(terrain.flow_accumulation(t, 2.0, "mfd")) == pytest.approx(mfd)
    assert got_of(terrain.strahler_order(t)) == strahler and max(strahler.values()) > 2
    assert got_of(terrain.flow_length(t)) == pytest.approx(length)

    def outlet(c):
        while d[c][1]:
            c = d[c][1]
        return c

    ends = {c: outlet(c) for c in z}
    size = {e: sum(x == e for x in ends.values()) for e in set(ends.values())}
    number = {e: i for i, e in enumerate(sorted((e for e in size if size[e] >= 4), key=lambda e: (e[1], e[0])), 1)}
    assert got_of(terrain.watershed_basins(t, 4)) == {c: number.get(e, 0) for c, e in ends.items()} and len(number) > 3


def test_slope_lengths(land):
    z, t = land
    steep, d = got_of(terrain.slope(t)), directions(z)
    out = dict.fromkeys(z, 0.0)
    for c in sorted(z, key=lambda c: -z[c]):
        n = d[c][1]
        if n and steep[n] > 0.5 * steep[c]:
            out[n] = max(out[n], out[c] + math.dist(c, n))
    assert got_of(terrain.slope_length(t)) == pytest.approx(out) and max(out.values()) > 5


def test_filled_pits_and_routes(land):
    z, t = land
    level = {c: v for c, v in z.items() if len(near(z, c)) < 8}
    heap = [(v, c) for c, v in level.items()]
    heapq.heapify(heap)
    done = set()
    while heap:
        w, c = heapq.heappop(heap)
        if c in done:
            continue
        done.add(c)
        for _, n, dist in near(z, c):
            new = max(z[n], w + 0.001 * dist)
            if new < level.get(n, math.inf):
                level[n] = new
                heapq.heappush(heap, (new, n))
    assert got_of(terrain.fill_pits(t)) == pytest.approx(level) and sum(level[c] > z[c] for c in z) > 20
    d = directions(level)
    assert got_of(terrain.pit_routes(t)) == {c: d[c][0] + 1 if level[c] > z[c] else 0 for c in z}
    assert all(d[c][1] or len(near(z, c)) < 8 for c in z)


def test_channels_as_reaches(land):
    z, t = land
    d, acc = directions(z), got_of(terrain.flow_accumulation(t))
    edges = {c: d[c][1] for c in z if acc[c] >= 4 and d[c][1]}
    single = terrain.channel_network(t, 4.0).collect()
    assert {tuple(map(int, r.segment.split("_"))) for r in single} == set(edges)
    into = {}
    for c, n in edges.items():
        into.setdefault(n, []).append(c)
    want = set()
    for c in edges:
        if len(into.get(c, [])) != 1:
            path = [c, edges[c]]
            while path[-1] in edges and len(into[path[-1]]) == 1:
                path.append(edges[path[-1]])
            want.add(tuple(path))
    got = {tuple(tuple(int(float(v)) for v in p.split()) for p in r.geom[12:-1].split(", ")) for r in terrain.channel_network(t, 4.0, joined=True).collect()}
    assert got == want and any(len(p) > 3 for p in want)
