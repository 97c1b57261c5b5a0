"""Terrain and hydrology on tile tables (band, tx, ty, cells) or cell tables (band, cx, cy, v); rows grow to the south.

Local measures come from the 3 x 3 window. Whatever follows the flow is solved within each
tile, with the values that its rim had in the round before, until no tile changes: a round
takes one exchange of rims, and the rounds are as many as the longest path has tiles. Cell
tables are turned into tiles for that and back. Nothing ends a solution early.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from . import tiles
from .focal import _window3
from .tiles import NAN, cells_of, from_tiles, tiled, to_tiles

# Directions 0 to 7 from the north, clockwise: (dx, dy).
D8 = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
_SIGN = {-1: "m", 0: "0", 1: "p"}


def _z(dx: int, dy: int) -> Column:
    return F.col(f"z_{_SIGN[dx]}{_SIGN[dy]}")


def _parts(size: float) -> dict[str, Column]:
    """Zevenbergen and Thorne's derivatives; a missing neighbour is the mirror of the opposite one."""
    z = F.col("z_00")
    n, s, e, w = (F.coalesce(_z(*a), 2 * z - _z(*b), z) for a, b in (((0, -1), (0, 1)), ((0, 1), (0, -1)), ((1, 0), (-1, 0)), ((-1, 0), (1, 0))))
    return {"g": (e - w) / (2 * size), "h": (n - s) / (2 * size), "d": ((e + w) / 2 - z) / size**2, "e": ((n + s) / 2 - z) / size**2}


def _sides(z, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same derivatives g, h, d and e of windows."""
    c = z(0, 0)

    def side(a: tuple, b: tuple) -> np.ndarray:
        one, other = z(*a), z(*b)
        return np.where(~np.isnan(one), one, np.where(~np.isnan(other), 2 * c - other, c))

    n, s, e, w = side((0, -1), (0, 1)), side((0, 1), (0, -1)), side((1, 0), (-1, 0)), side((-1, 0), (1, 0))
    return (e - w) / (2 * size), (n - s) / (2 * size), ((e + w) / 2 - c) / size**2, ((n + s) / 2 - c) / size**2


def _steep(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.arctan(np.hypot(g, h))


def _facing(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(g != 0, np.degrees(math.pi + np.arctan2(h, g)), np.where(h > 0, 270.0, np.where(h < 0, 90.0, 0.0)))


def _local(dem: DataFrame, f) -> DataFrame:
    return _window3(dem).select("band", "cx", "cy", f.alias("v"))


def _slope(p: dict) -> Column:
    return F.atan(F.sqrt(p["g"] ** 2 + p["h"] ** 2))


def _aspect(p: dict) -> Column:
    """Degrees; where the east-west part is 0: 270, 90 or 0 by the sign of the other."""
    g, h = p["g"], p["h"]
    return F.when(g != 0, F.degrees(math.pi + F.atan2(h, g))).when(h > 0, 270.0).when(h < 0, 90.0).otherwise(0.0)


def slope(dem: DataFrame, size: float = 1.0) -> DataFrame:
    """Degrees."""
    if tiled(dem):
        return tiles.window3(dem, lambda z: np.degrees(_steep(*_sides(z, size)[:2])))
    return _local(dem, F.degrees(_slope(_parts(size))))


def aspect(dem: DataFrame, size: float = 1.0) -> DataFrame:
    if tiled(dem):
        return tiles.window3(dem, lambda z: _facing(*_sides(z, size)[:2]))
    return _local(dem, _aspect(_parts(size)))


def curvature(dem: DataFrame, size: float = 1.0) -> DataFrame:
    if tiled(dem):

        def bent(z) -> np.ndarray:
            g, h, d, e = _sides(z, size)
            return np.where((g == 0) & (h == 0), 0.0, -2 * (d + e))

        return tiles.window3(dem, bent)
    p = _parts(size)
    return _local(dem, F.when((p["g"] == 0) & (p["h"] == 0), 0.0).otherwise(-2 * (p["d"] + p["e"])))


def hillshade(dem: DataFrame, size: float = 1.0, azimuth: float = 315.0, declination: float = 45.0) -> DataFrame:
    """Angle in radians between the surface and the light."""
    p, az, dec = _parts(size), math.radians(azimuth), math.radians(declination)
    if tiled(dem):

        def lit(z) -> np.ndarray:
            g, h, _, _ = _sides(z, size)
            d = math.pi / 2 - _steep(g, h)
            return np.arccos(np.clip(np.sin(d) * math.sin(dec) + np.cos(d) * math.cos(dec) * np.cos(np.radians(_facing(g, h)) - az), -1, 1))

        return tiles.window3(dem, lit)
    d = math.pi / 2 - _slope(p)
    c = F.sin(d) * math.sin(dec) + F.cos(d) * math.cos(dec) * F.cos(F.radians(_aspect(p)) - az)
    return _local(dem, F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))))


def ruggedness(dem: DataFrame) -> DataFrame:
    """Root of the mean square difference to the four nearest and diagonal neighbours, weighted by 1 / distance."""
    if tiled(dem):

        def rough(z) -> np.ndarray:
            w = {d: 1 / math.hypot(*d) for d in D8}
            num = sum(np.nan_to_num(((z(*d) - z(0, 0)) * w[d]) ** 2) for d in D8)
            den = sum(np.where(np.isnan(z(*d)), 0.0, w[d]) for d in D8)
            return np.sqrt(np.where(den > 0, num / den, NAN))

        return tiles.window3(dem, rough)
    num, den = F.lit(0.0), F.lit(0.0)
    for dx, dy in D8:
        w = 1 / math.hypot(dx, dy)
        has = _z(dx, dy).isNotNull()
        num = num + F.when(has, ((_z(dx, dy) - F.col("z_00")) * w) ** 2).otherwise(0.0)
        den = den + F.when(has, w).otherwise(0.0)
    return _local(dem, F.sqrt(num / F.nullif(den, F.lit(0.0))))


def keep(dem: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """Values in any range; the rest is NoData."""

    def kept(v: Column) -> Column:
        hit = F.lit(False)
        for a, b in ranges:
            hit = hit | v.between(a, b)
        return F.when(hit, v)

    return tiles.local(dem, kept) if tiled(dem) else dem.withColumn("v", kept(F.col("v")))


def _steepest() -> Column:
    """Struct (drop, -direction) of the steepest descent, the earliest direction of equals."""
    one = [F.struct(((F.col("z_00") - _z(dx, dy)) / math.hypot(dx, dy)).alias("drop"), F.lit(-k).alias("k")) for k, (dx, dy) in enumerate(D8)]
    return F.array_max(F.filter(F.array(*one), lambda x: x["drop"] > 0))


def flow_direction(dem: DataFrame) -> DataFrame:
    """0 to 7 from the north, clockwise; -1 without a lower neighbour."""
    if tiled(dem):
        return tiles.window3(dem, lambda z: _direction([(z(0, 0) - z(*d)) / math.hypot(*d) for d in D8]).astype(float))
    return _local(dem, F.coalesce(-_steepest()["k"], F.lit(-1)).cast("int"))


# --- along the flow, tile by tile ---


def _direction(drops: list[np.ndarray]) -> np.ndarray:
    """The steepest descent, the earliest direction of equals; -1 where nothing descends."""
    drop = np.nan_to_num(np.stack(drops), nan=-np.inf)
    return np.where(drop.max(0) > 0, drop.argmax(0), -1)


def _ring(a: np.ndarray, k: int) -> np.ndarray:
    """An array without its outer k cells."""
    return a[k : len(a) - k, k : len(a) - k]


class Flow:
    """Where the water of a tile and of the ring of cells around it goes.

    ``z`` has a rim of two cells, so that the ring's own windows are whole. ``share[k]`` is the
    part of each cell's water, ring included, that goes in direction k: all of it by d8, or by
    mfd to all lower neighbours in proportion to slope ** convergence.
    """

    def __init__(self, z: np.ndarray, method: str = "d8", convergence: float = 1.1):
        self.z = z
        with np.errstate(invalid="ignore", divide="ignore"):
            at = lambda dx, dy: tiles.shifted(z, 1, dx, dy)
            drop = [(at(0, 0) - at(*d)) / math.hypot(*d) for d in D8]
            self.direction = _direction(drop)
            if method == "d8":
                self.share = [(self.direction == k).astype(float) for k in range(8)]
            elif method == "mfd":
                part = [np.where(d > 0, np.power(np.maximum(np.nan_to_num(d), 0), convergence), 0.0) for d in drop]
                total = sum(part)
                self.share = [p / np.where(total > 0, total, 1) for p in part]
            else:
                raise ValueError(f"no such method: {method}")

    def from_above(self, ring: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(values, shares) of the neighbours that drain into the cells, by direction; ``ring`` has the ring's values."""
        at = lambda a, dx, dy: tiles.shifted(a, 1, -dx, -dy)
        return [(at(ring, *d), at(self.share[k], *d)) for k, d in enumerate(D8)]

    def below(self, ring: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """The value where each cell's water goes; ``otherwise`` where it stays."""
        own, out = _ring(self.direction, 1), otherwise.copy()
        for k, d in enumerate(D8):
            out = np.where(own == k, tiles.shifted(ring, 1, *d), out)
        return out

    def step(self) -> np.ndarray:
        own = _ring(self.direction, 1)
        return np.where(own < 0, 0.0, np.where(own % 2 == 1, math.sqrt(2), 1.0))


def _solved(ring: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The inner cells' fixpoint of f, the ring staying as it is."""
    ring = ring.copy()
    for _ in range(ring.size + 2):  # a path has no more cells than that
        new, old = f(ring), _ring(ring, 1)
        if ((new == old) | (np.isnan(new) & np.isnan(old))).all():
            return new
        ring[1:-1, 1:-1] = new
    raise ValueError("the directions form a cycle")


def exchanged(state: DataFrame, f: Callable[[np.ndarray, np.ndarray, tuple[int, int]], np.ndarray]) -> DataFrame:
    """One round: (keys, cells, value, changed) from f(elevation, value, place), both with a rim of two cells."""
    keys = [c for c in state.columns if c not in ("cells", "value", "changed")]
    s, r = tiles.edge(), 2
    span = {-1: (F.lit(0), F.lit(r)), 0: (F.lit(0), s), 1: (s - r, F.lit(r))}

    def piece(c: str, dx: int, dy: int) -> Column:
        if (dx, dy) == (0, 0):
            return F.col(c)
        (x, w), (y, h) = span[dx], span[dy]
        return F.flatten(F.transform(F.sequence(y, y + h - 1), lambda row: F.slice(c, row * s + x + 1, w)))

    each = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), piece("cells", dx, dy).alias("cells"), piece("value", dx, dy).alias("value")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("e")
    own = [k for k in keys if k not in ("tx", "ty")]
    sent = state.select(*own, "tx", "ty", each).select(*own, (F.col("tx") + F.col("e.dx")).alias("tx"), (F.col("ty") + F.col("e.dy")).alias("ty"), F.col("e.dx").alias("dx"), F.col("e.dy").alias("dy"), "e.cells", "e.value")
    kinds = {k: state.schema[k].dataType.simpleString() for k in keys}

    def run(t: pa.Table) -> pa.Table:
        dx, dy = t["dx"].to_pylist(), t["dy"].to_pylist()
        mine = [i for i in range(len(dx)) if dx[i] == dy[i] == 0]
        none = pa.array([], pa.list_(pa.float64()))
        if not mine:
            return t.select(keys).slice(0, 0).append_column("cells", none).append_column("value", none).append_column("changed", pa.array([], pa.bool_()))
        both, held = [], []
        for name in ("cells", "value"):
            parts = t[name].combine_chunks()
            n = int(round(len(parts[mine[0]].values) ** 0.5))
            p = np.full((n + 2 * r, n + 2 * r), NAN)
            to = {1: slice(0, r), 0: slice(r, r + n), -1: slice(r + n, n + 2 * r)}
            for i in range(len(dx)):
                rows, cols = to[dy[i]], to[dx[i]]
                p[rows, cols] = parts[i].values.to_numpy(zero_copy_only=False).reshape(rows.stop - rows.start, cols.stop - cols.start)
            both.append(p)
            held.append(parts[mine[0]].values)
        old = _ring(both[1], r)
        tx, ty = (t[c][mine[0]].as_py() for c in ("tx", "ty"))
        new = np.where(np.isnan(_ring(both[0], r)), NAN, f(both[0], both[1], (tx * n, ty * n)))
        has = np.array(held[0].is_valid()).reshape(n, n)
        changed = not ((new == old) | (np.isnan(new) & np.isnan(old))).all()
        return pa.table({**{k: t[k].combine_chunks()[mine[0] : mine[0] + 1] for k in keys}, "cells": t["cells"].combine_chunks()[mine[0] : mine[0] + 1], "value": tiles._listed(new, has), "changed": pa.array([changed])})

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "cells array<double>", "value array<double>", "changed boolean"])
    return sent.groupBy(*keys).applyInArrow(run, schema)


def swept(dem: DataFrame, start: float, f: Callable[[np.ndarray, np.ndarray, tuple[int, int]], np.ndarray]) -> DataFrame:
    """A raster of values that depend on each other along the flow: rounds of ``exchanged`` until none changes.

    Values begin as ``start``. A cell table gives a cell table.
    """
    if not tiled(dem):
        return from_tiles(swept(to_tiles(dem), start, f)).where("v is not null")
    keys = tiles.keys_of(dem)
    begin = F.transform("cells", lambda x: F.when(x.isNotNull(), F.when(F.isnan(x), F.lit(NAN)).otherwise(F.lit(float(start)))))
    state = dem.select(*keys, "cells", begin.alias("value"))
    while True:
        state = checkpointed(exchanged(state, f))
        if state.where("changed").isEmpty():
            return state.select(*keys, F.col("value").alias("cells"))


def flow_connectivity(dem: DataFrame) -> DataFrame:
    """Neighbours that drain into each cell."""
    if not tiled(dem):
        return from_tiles(flow_connectivity(to_tiles(dem))).where("v is not null").withColumn("v", F.col("v").cast("int"))
    return tiles.around(dem, 2, lambda p: sum(s for _, s in Flow(p).from_above(_ring(p, 1))))


def flow_width(dem: DataFrame, size: float = 1.0) -> DataFrame:
    """Width across the flow: the cell size, or that over root 2 for diagonal flow."""
    width = lambda v: F.when(v < 0, float(size)).otherwise(F.when(v % 2 == 1, size / math.sqrt(2)).otherwise(float(size)))
    d = flow_direction(dem)
    return tiles.local(d, width) if tiled(d) else d.withColumn("v", width(F.col("v")))


def flow_length(dem: DataFrame, size: float = 1.0) -> DataFrame:
    """Distance along the flow to the outlet."""

    def f(z: np.ndarray, length: np.ndarray, _) -> np.ndarray:
        flow = Flow(z)
        step, zero = flow.step(), np.zeros_like(flow.step())
        return _solved(_ring(length, 1), lambda ring: flow.below(ring, zero) + step)

    got = swept(dem, 0.0, f)
    return tiles.local(got, lambda v: v * float(size)) if tiled(got) else got.withColumn("v", F.col("v") * size)


_WIDE = float(1 << 26)  # more than a raster has columns


def outlets(dem: DataFrame) -> DataFrame:
    """The outlet each cell drains to, as (row + 2**25) * 2**26 + column + 2**25, which doubles hold exactly."""

    def f(z: np.ndarray, label: np.ndarray, at: tuple[int, int]) -> np.ndarray:
        flow, n = Flow(z), len(z) - 4
        x, y = np.meshgrid(at[0] + np.arange(n), at[1] + np.arange(n))
        own = (y + _WIDE / 2) * _WIDE + x + _WIDE / 2
        return _solved(_ring(label, 1), lambda ring: flow.below(ring, own))

    return swept(dem, -1.0, f)


def watershed_basins(dem: DataFrame, least: int = 1) -> DataFrame:
    """Basins by outlet, numbered from 1 in the outlets' order; smaller ones than ``least`` cells are 0.

    Numbers are given in the order of bands and outlets by ranges, so no task sees all basins.
    """
    t = checkpointed(cells_of(outlets(dem)).where("v is not null"))
    n = t.groupBy("band", "v").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    parts = checkpointed(n.select("band", "v").repartitionByRange("band", "v").sortWithinPartitions("band", "v").withColumn("p", F.spark_partition_id()))
    within = parts.withColumn("i", F.row_number().over(Window.partitionBy("p", "band").orderBy("v")))
    sizes = parts.groupBy("band", "p").agg(F.count("*").alias("m"))  # a row a partition and band
    before = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("band").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = within.join(before, ["band", "p"]).select("band", "v", (F.col("i") + F.col("before")).cast("int").alias("id"))
    got = t.join(number, ["band", "v"], "left").select("band", "cx", "cy", F.coalesce("id", F.lit(0)).alias("v"))
    return to_tiles(got) if tiled(dem) else got


def flow_accumulation(dem: DataFrame, area: float = 1.0, method: str = "d8", convergence: float = 1.1) -> DataFrame:
    """Area that drains through each cell, its own among it; by d8 or mfd (see ``Flow``)."""

    def f(z: np.ndarray, total: np.ndarray, _) -> np.ndarray:
        flow = Flow(z, method, convergence)
        return _solved(_ring(total, 1), lambda ring: area + sum(np.nan_to_num(v) * s for v, s in flow.from_above(ring)))

    return swept(dem, area, f)


def strahler_order(dem: DataFrame) -> DataFrame:
    """1 at sources; one more than the largest order that drains in, if two have it."""

    def f(z: np.ndarray, order: np.ndarray, _) -> np.ndarray:
        flow = Flow(z)

        def merged(ring: np.ndarray) -> np.ndarray:
            above = np.stack([np.where(s > 0, np.nan_to_num(v), 0.0) for v, s in flow.from_above(ring)])
            top = above.max(0)
            return np.where(top == 0, 1.0, top + ((above == top).sum(0) > 1))

        return _solved(_ring(order, 1), merged)

    got = swept(dem, 1.0, f)
    return got if tiled(got) else got.withColumn("v", F.col("v").cast("int"))


def slope_length(dem: DataFrame, size: float = 1.0) -> DataFrame:
    """Longest way of water from above: passed on where the slope stays over half of the one above."""

    def f(z: np.ndarray, length: np.ndarray, _) -> np.ndarray:
        flow = Flow(z)
        with np.errstate(invalid="ignore"):
            steep = _steep(*_sides(lambda dx, dy: tiles.shifted(z, 1, dx, dy), size)[:2])
            on = [s * (_ring(steep, 1) > 0.5 * a) for (a, s) in flow.from_above(steep)]
        step = [math.hypot(*d) * size for d in D8]
        return _solved(_ring(length, 1), lambda ring: np.max([np.where(o > 0, np.nan_to_num(v) + w, 0.0) for (v, _), o, w in zip(flow.from_above(ring), on, step)], 0))

    return swept(dem, 0.0, f)


def pits(dem: DataFrame) -> DataFrame:
    """Cells inside the raster without a lower neighbour: rows (band, cx, cy, v)."""
    if tiled(dem):

        def low(z) -> tuple[np.ndarray, np.ndarray]:
            around = np.stack([z(*d) for d in D8])
            return z(0, 0), ~np.isnan(around).any(0) & (around >= z(0, 0)).all(0)

        return from_tiles(tiles.window3(dem, low))
    inner = F.lit(True)
    for dx, dy in D8:
        inner = inner & _z(dx, dy).isNotNull()
    return _window3(dem).where(inner & _steepest().isNull()).select("band", "cx", "cy", F.col("z_00").alias("v"))


def _flooded(z: np.ndarray, water: np.ndarray, epsilon: float) -> np.ndarray:
    """Lowest water levels inside a rim of one cell with known levels: a shortest-path search over the tile."""
    n = len(z) - 2
    level = np.where(np.isnan(z), np.inf, water)
    gap = np.stack([np.isnan(tiles.shifted(z, 1, *d)) for d in D8]).any(0)
    inner = level[1:-1, 1:-1]
    inner[...] = np.where(gap, z[1:-1, 1:-1], inner)  # cells at the raster's own rim keep their height
    heap = [(level[y, x], y, x) for y, x in zip(*np.nonzero(np.isfinite(level)))]
    heapq.heapify(heap)
    heights, levels, steps = z.tolist(), level.tolist(), [(dx, dy, epsilon * math.hypot(dx, dy)) for dx, dy in D8]
    while heap:
        w, y, x = heapq.heappop(heap)
        if w > levels[y][x]:
            continue
        for dx, dy, more in steps:
            j, i = y + dy, x + dx
            if 1 <= j <= n and 1 <= i <= n:
                new = max(heights[j][i], w + more)
                if new < levels[j][i]:  # never where there is no cell: NaN compares as false
                    levels[j][i] = new
                    heapq.heappush(heap, (new, j, i))
    return np.array(levels)[1:-1, 1:-1]


def fill_pits(dem: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """Sinks raised so that every cell drains to the rim: w = max(z, least neighbour + epsilon * distance).

    Starts from high water everywhere but on the rim; each round lowers it within the tiles as
    far as it goes.
    """
    return swept(dem, float("inf"), lambda z, w, _: _flooded(_ring(z, 1), _ring(w, 1), epsilon))


def pit_routes(dem: DataFrame) -> DataFrame:
    """For cells that only drain after filling, the direction they then take; 0 none, else 1 to 8."""
    if not tiled(dem):
        return from_tiles(pit_routes(to_tiles(dem))).where("v is not null").withColumn("v", F.col("v").cast("int"))
    filled = fill_pits(dem)
    raised = tiles.combine(filled, dem, lambda w, z: (w > z).cast("double"))
    return tiles.combine(flow_direction(filled), raised, lambda d, r: F.when(r == 1, d + 1).otherwise(0.0))


def channel_network(dem: DataFrame, threshold: float, init: str = "ge", joined: bool = False) -> DataFrame:
    """(band, segment, order_, length, geom): channels where accumulation is ge, eq or le a threshold.

    Without ``joined`` a channel is a cell's edge to the next. With it edges are joined to
    reaches: from a source or a confluence down to the next confluence or the outlet.
    """
    t = tiles.tiles_of(dem)
    a, direction, order = cells_of(flow_accumulation(t)), cells_of(flow_direction(t)), cells_of(strahler_order(t))
    pick = {"ge": F.col("v") >= threshold, "eq": F.col("v") == threshold, "le": F.col("v") <= threshold}[init]
    x, y = (F.element_at(F.array(*[F.lit(d[i]) for d in D8]), F.col("v").cast("int") + 1) for i in (0, 1))
    e = direction.where("v >= 0").select("band", "cx", "cy", (F.col("cx") + x).alias("tx"), (F.col("cy") + y).alias("ty"), F.sqrt((x * x + y * y).cast("double")).alias("step"))
    e = e.join(a.where(pick).select("band", "cx", "cy"), ["band", "cx", "cy"], "left_semi")
    got = checkpointed(e.join(order.select("band", "cx", "cy", F.col("v").cast("int").alias("order_")), ["band", "cx", "cy"]))
    point = lambda cx, cy: F.concat((cx + 0.5).cast("string"), F.lit(" "), (cy + 0.5).cast("string"))
    if not joined:
        line = F.concat(F.lit("LINESTRING ("), point(F.col("cx"), F.col("cy")), F.lit(", "), point(F.col("tx"), F.col("ty")), F.lit(")"))
        return got.select("band", F.concat_ws("_", "cx", "cy").alias("segment"), "order_", F.col("step").alias("length"), line.alias("geom"))
    arrive = got.groupBy("band", F.col("tx").alias("cx"), F.col("ty").alias("cy")).agg(F.count("*").alias("n"))
    marked = checkpointed(got.join(arrive, ["band", "cx", "cy"], "left").withColumn("head", F.coalesce("n", F.lit(0)) != 1).drop("n"))
    # the head of each edge's reach by pointer jumping up the single predecessors
    up = marked.select("band", F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    now = checkpointed(marked.where("head").select("band", "cx", "cy", F.col("cx").alias("hx"), F.col("cy").alias("hy"), F.lit(0).alias("k"), F.lit(True).alias("done")).unionByName(marked.where("not head").join(up, ["band", "cx", "cy"]).select("band", "cx", "cy", F.col("px").alias("hx"), F.col("py").alias("hy"), F.lit(1).alias("k"), F.lit(False).alias("done"))))
    while not now.where("not done").isEmpty():
        over = now.select("band", F.col("cx").alias("hx"), F.col("cy").alias("hy"), F.col("hx").alias("nx"), F.col("hy").alias("ny"), F.col("k").alias("more"), F.col("done").alias("end"))
        moved = now.where("not done").join(over, ["band", "hx", "hy"]).select("band", "cx", "cy", F.col("nx").alias("hx"), F.col("ny").alias("hy"), (F.col("k") + F.col("more")).alias("k"), F.col("end").alias("done"))
        now = checkpointed(now.where("done").unionByName(moved))
    reach = got.join(now.select("band", "cx", "cy", "hx", "hy", "k"), ["band", "cx", "cy"])
    way = F.array_sort(F.collect_list(F.struct("k", point(F.col("cx"), F.col("cy")).alias("a"), point(F.col("tx"), F.col("ty")).alias("b"))))
    each = reach.groupBy("band", "hx", "hy").agg(F.max("order_").alias("order_"), F.sum("step").alias("length"), way.alias("w"))
    line = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", F.element_at("w", 1)["a"], F.array_join(F.transform("w", lambda w: w["b"]), ", ")), F.lit(")"))
    return each.select("band", F.concat_ws("_", "hx", "hy").alias("segment"), "order_", "length", line.alias("geom"))


def feature_points(dem: DataFrame, threshold: float) -> DataFrame:
    """Very important points: mean distance of a cell from the chords of its four pairs of opposite neighbours."""
    if tiled(dem):

        def vip(z) -> np.ndarray:
            total, n = 0.0, 0
            for dx, dy in D8[:4]:
                a, b, run = z(dx, dy), z(-dx, -dy), 2 * math.hypot(dx, dy)
                has = ~np.isnan(a) & ~np.isnan(b)
                total = total + np.where(has, np.abs(z(0, 0) - (a + b) / 2) * run / np.hypot(a - b, run), 0.0)
                n = n + has
            return np.where(n > 0, total / np.maximum(n, 1), NAN)

        important = tiles.local(tiles.window3(dem, vip), lambda v: F.when(v >= threshold, v))
        both = important.join(dem.select(*tiles.KEY, F.col("cells").alias("z")), tiles.KEY)
        got = both.select(*tiles.KEY, tiles.edge().alias("s"), F.posexplode(F.arrays_zip("cells", "z")).alias("i", "e")).where("e.cells is not null and not isnan(e.cells)")
        return got.select("band", (F.col("tx") * F.col("s") + F.col("i") % F.col("s")).cast("int").alias("cx"), (F.col("ty") * F.col("s") + F.floor(F.col("i") / F.col("s"))).cast("int").alias("cy"), F.col("e.z").alias("v"), F.col("e.cells").alias("vip"))
    total, n = F.lit(0.0), F.lit(0)
    for dx, dy in D8[:4]:
        a, b = _z(dx, dy), _z(-dx, -dy)
        has = a.isNotNull() & b.isNotNull()
        run = 2 * math.hypot(dx, dy)
        chord = F.sqrt((a - b) ** 2 + run**2)
        total = total + F.when(has, F.abs(F.col("z_00") - (a + b) / 2) * run / chord).otherwise(0.0)
        n = n + has.cast("int")
    t = _window3(dem).select("band", "cx", "cy", F.col("z_00").alias("v"), (total / F.nullif(n, F.lit(0))).alias("vip"))
    return t.where(F.col("vip") >= threshold)


def tin(dem: DataFrame, threshold: float) -> DataFrame:
    """(band, triangle, geom): Delaunay triangles of the important points; one task a band."""
    from ..functions import geometry as G

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cy", "ascending"), ("cx", "ascending")])
        ps = list(zip((x + 0.5 for x in t["cx"].to_pylist()), (y + 0.5 for y in t["cy"].to_pylist())))
        tri = G.delaunay(ps)
        wkt = [G.to_wkt(("Polygon", [[ps[a], ps[b], ps[c], ps[a]]])) for a, b, c in tri]
        return pa.table({"band": pa.array([t["band"][0].as_py()] * len(tri), pa.string()), "triangle": pa.array(range(len(tri)), pa.int32()), "geom": pa.array(wkt, pa.string())})

    return feature_points(dem, threshold).select("band", "cx", "cy").groupBy("band").applyInArrow(make, "band string, triangle int, geom string")
