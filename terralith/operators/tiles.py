"""Rasters as tiles: (band, tx, ty, cells), one row for 256 x 256 cells of a band.

``cells`` holds a square tile's values in row order; NULL is outside of the raster and NaN is
NoData, so a tile knows its raster's outline. Every operator of ``raster``, ``focal``,
``collection``, ``cube`` and the local ones of ``terrain`` takes either this or a cell table:

* local operators are one ``transform`` over the array, two rasters meet in one equi-join of
  tiles and a ``zip_with``; both stay in the JVM and shuffle 8 bytes a cell at most
* neighbourhood operators exchange halos: a tile goes to its own group and a strip of it, as
  wide as the window's radius, to each of the eight around it; numpy then works on whole
  windows. A group is one tile and its rim, whatever the raster's size
* stacks of images are reduced in strips of a tile, so that a task holds a strip of each image

Coarser and finer grids keep the tile grid and change the tiles' own size, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 256
KEY = ["band", "tx", "ty"]
NAN = float("nan")
STRIPS = 16


def tiled(df: DataFrame) -> bool:
    return "cells" in df.columns


def keys_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "cells"]


def edge(cells: str = "cells") -> Column:
    """Cells along a tile's edge."""
    return F.sqrt(F.size(cells)).cast("int")


def size_of(tiles: DataFrame) -> int:
    """Cells along the edge of a table's tiles, from one of its rows."""
    row = tiles.select(edge().alias("s")).first()
    return row["s"] if row else SIZE


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "cells array<double>"])


def _listed(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """One array value; NULL where the raster has no cell."""
    flat = np.ascontiguousarray(values, np.float64).ravel()
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=~np.ascontiguousarray(has).ravel()))


def _square(x: pa.Array) -> np.ndarray:
    v = x.to_numpy(zero_copy_only=False).astype(np.float64)
    n = int(round(len(v) ** 0.5))
    return v.reshape(n, n)


# --- to and from cell tables ---


def to_tiles(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of a cell table (band, cx, cy, v and keys such as cov_id); a NULL v is NoData."""
    more = [c for c in cells.columns if c not in ("band", "cx", "cy", "v")]
    at = (F.pmod("cy", F.lit(size)) * size + F.pmod("cx", F.lit(size))).cast("int")
    place = lambda c: F.floor(F.col(c) / size).cast("int")
    t = cells.select(*more, "band", place("cx").alias("tx"), place("cy").alias("ty"), at.alias("i"), F.col("v").cast("double").alias("v"))
    keys = [*more, *KEY]

    def make(t: pa.Table) -> pa.Table:
        out, has, i = np.full(size * size, NAN), np.zeros(size * size, bool), t["i"].to_numpy()
        out[i], has[i] = t["v"].to_numpy(zero_copy_only=False), True
        return pa.table({**{k: t[k].combine_chunks()[:1] for k in keys}, "cells": _listed(out, has)})

    return t.groupBy(*keys).applyInArrow(make, _schema(t.withColumn("cells", F.array("v")), keys))


def from_tiles(tiles: DataFrame) -> DataFrame:
    """The cell table of a tile table."""
    more = [c for c in keys_of(tiles) if c not in KEY]
    t = tiles.select(*more, *KEY, edge().alias("__s"), F.posexplode("cells").alias("__i", "v")).where("v is not null")
    cx, cy = F.col("tx") * F.col("__s") + F.col("__i") % F.col("__s"), F.col("ty") * F.col("__s") + F.floor(F.col("__i") / F.col("__s"))
    return t.select(*more, "band", cx.cast("int").alias("cx"), cy.cast("int").alias("cy"), F.nullif("v", F.lit(NAN)).alias("v"))


def cells_of(df: DataFrame) -> DataFrame:
    return from_tiles(df) if tiled(df) else df


def tiles_of(df: DataFrame) -> DataFrame:
    return df if tiled(df) else to_tiles(df)


# --- cell by cell ---


def _kept(value: Column, *of: Column) -> Column:
    """``value``, with NoData as NaN, where all rasters have a cell."""
    has = of[0].isNotNull()
    for c in of[1:]:
        has = has & c.isNotNull()
    return F.when(has, F.coalesce(value.cast("double"), F.lit(NAN)))


def data(c: Column) -> Column:
    """A tile's element with NoData as NULL."""
    return F.nullif(c, F.lit(NAN))


def local(tiles: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return tiles.withColumn("cells", F.transform("cells", lambda x: _kept(f(data(x)), x)))


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: _kept(f(data(x), data(y)), x, y))


def combine(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], keys: list[str] | None = None) -> DataFrame:
    """f of two rasters' cells that both have; tiles join by ``keys``."""
    keys = keys or KEY
    other = b.select(*keys, F.col("cells").alias("__b"))
    return a.join(other, keys).select(*a.columns[: a.columns.index("cells")], zipped(F.col("cells"), F.col("__b"), f).alias("cells"))


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of either raster; where both have a value, that of ``a``; NoData alone leaves no cell."""
    other = b.select(*KEY, F.col("cells").alias("__b"))
    first = F.when(F.col("cells").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("cells")).otherwise(F.zip_with("cells", "__b", lambda x, y: F.coalesce(data(x), data(y))))
    return a.join(other, KEY, "full").select(*KEY, F.transform(first, data).alias("cells"))


def unmask(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(*KEY, F.col("cells").alias("__b"))
    filled = F.when(F.col("__b").isNull(), F.col("cells")).otherwise(F.zip_with("cells", "__b", lambda x, y: F.when(x.isNotNull(), F.coalesce(data(x), data(y), F.lit(NAN)))))
    return a.join(other, KEY, "left").select(*KEY, filled.alias("cells"))


def side_by_side(tiles: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """(tx, ty, b0, b1, ...): the named bands' arrays of the tiles that have all of them; one group a tile."""
    keys = keys or ["tx", "ty"]
    got = tiles.where(F.col("band").isin(bands)).groupBy(*keys).agg(*[F.any_value(F.when(F.col("band") == b, F.col("cells")), True).alias(f"b{i}") for i, b in enumerate(bands)])
    return got.dropna(subset=[f"b{i}" for i in range(len(bands))])


def from_bands(t: DataFrame, n: int, make: Callable[..., dict[str, Column]]) -> DataFrame:
    """Bands computed from n bands side by side: ``make`` gives name -> value of n cells; all must have data."""
    row = F.arrays_zip(*[f"b{i}" for i in range(n)])

    def band(name: str) -> Column:
        def value(x: Column) -> Column:
            v = [data(x[f"b{i}"]) for i in range(n)]
            has = v[0].isNotNull()
            for c in v[1:]:
                has = has & c.isNotNull()
            return F.when(has, F.coalesce(make(*v)[name].cast("double"), F.lit(NAN)))

        return F.struct(F.lit(name).alias("band"), F.transform(row, value).alias("cells"))

    names = list(make(*[F.lit(0.0)] * n))
    return t.select("tx", "ty", F.explode(F.array(*map(band, names))).alias("e")).select("e.band", "tx", "ty", "e.cells")


def cut_box(tiles: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Cells with index in [x0, x1) x [y0, y1); tiles outside are pruned by their keys."""
    s = edge()
    near = tiles.where(((F.col("tx") + 1) * s > x0) & (F.col("tx") * s < x1) & ((F.col("ty") + 1) * s > y0) & (F.col("ty") * s < y1))
    near = near.withColumn("__s", s)

    def inside(v: Column, i: Column) -> Column:
        x, y = F.col("tx") * F.col("__s") + i % F.col("__s"), F.col("ty") * F.col("__s") + F.floor(i / F.col("__s"))
        return F.when((x >= x0) & (x < x1) & (y >= y0) & (y < y1), v)

    return near.withColumn("cells", F.transform("cells", inside)).drop("__s")


def cut_polygon(tiles: DataFrame, wkt: str) -> DataFrame:
    """Cells whose centre lies in a polygon of cell coordinates."""
    from ..functions import geometry as G

    x0, y0, x1, y1 = G.bounds(G.from_wkt(wkt))
    near = cut_box(tiles, int(np.floor(x0)), int(np.floor(y0)), int(np.ceil(x1)), int(np.ceil(y1)))
    test = G.inside_xy(wkt)

    @F.arrow_udf("array<double>")
    def cut(tx: pa.Array, ty: pa.Array, cells: pa.Array) -> pa.Array:
        out = []
        for x, y, c in zip(tx.to_pylist(), ty.to_pylist(), cells):
            has, v = np.array(c.values.is_valid()), _square(c.values)
            n = len(v)
            px, py = np.meshgrid(x * n + np.arange(n) + 0.5, y * n + np.arange(n) + 0.5)
            out.append(_listed(v, has & test(px.ravel(), py.ravel())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return near.withColumn("cells", cut("tx", "ty", "cells"))


# --- neighbourhoods ---


def around(tiles: DataFrame, r: int, f: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """f(window) for each tile with a rim of r cells, NaN where there is nothing.

    ``f`` returns the new cells, which stay where the tile has data; or new cells and where
    they are.
    """
    keys = keys_of(tiles)
    s = edge()
    span = {-1: (F.lit(0), F.lit(r)), 0: (F.lit(0), s), 1: (s - r, F.lit(r))}  # what goes to the left, stays, goes to the right

    def piece(dx: int, dy: int) -> Column:
        if (dx, dy) == (0, 0):
            return F.col("cells")
        (x, w), (y, h) = span[dx], span[dy]
        return F.flatten(F.transform(F.sequence(y, y + h - 1), lambda row: F.slice("cells", row * s + x + 1, w)))

    at = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)] if r else [(0, 0)]
    each = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), piece(dx, dy).alias("part")) for dx, dy in at])).alias("__e")
    own = [k for k in keys if k not in ("tx", "ty")]
    fits = F.raise_error(F.lit("the window is wider than a tile"))
    sent = tiles.select(*own, "tx", "ty", F.when(s >= r, F.col("cells")).otherwise(fits).alias("cells")).select(*own, "tx", "ty", each)
    sent = sent.select(*own, (F.col("tx") + F.col("__e.dx")).alias("tx"), (F.col("ty") + F.col("__e.dy")).alias("ty"), F.col("__e.dx").alias("__dx"), F.col("__e.dy").alias("__dy"), F.col("__e.part").alias("cells"))

    def run(t: pa.Table) -> pa.Table:
        dx, dy, parts = t["__dx"].to_pylist(), t["__dy"].to_pylist(), t["cells"].combine_chunks()
        mine = [i for i in range(len(dx)) if dx[i] == dy[i] == 0]
        if not mine:
            return t.select(keys).slice(0, 0).append_column("cells", pa.array([], pa.list_(pa.float64())))
        middle = _square(parts[mine[0]].values)
        n = len(middle)
        p = np.full((n + 2 * r, n + 2 * r), NAN)
        to = {1: slice(0, r), 0: slice(r, r + n), -1: slice(r + n, n + 2 * r)}
        for i in range(len(dx)):
            v = parts[i].values.to_numpy(zero_copy_only=False)
            rows, cols = to[dy[i]], to[dx[i]]
            p[rows, cols] = v.reshape(rows.stop - rows.start, cols.stop - cols.start)
        got = f(p)
        new, has = got if isinstance(got, tuple) else (got, ~np.isnan(middle))
        return pa.table({**{k: t[k].combine_chunks()[mine[0] : mine[0] + 1] for k in keys}, "cells": _listed(new, has)})

    return sent.groupBy(*keys).applyInArrow(run, _schema(tiles, keys))


def shifted(p: np.ndarray, r: int, dx: int, dy: int) -> np.ndarray:
    """The neighbours at an offset of all cells inside the rim."""
    n = len(p) - 2 * r
    return p[r + dy : r + dy + n, r + dx : r + dx + n]


def _runs(stack: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(value, length, ends here) for every place of stacks that are sorted along their first axis; NaN ends nothing."""
    run = np.zeros(stack.shape[1:], np.int64)
    for i in range(len(stack)):
        same = stack[i] == stack[i - 1] if i else np.zeros(stack.shape[1:], bool)
        run = np.where(same, run + 1, 1)
        ends = (stack[i] != stack[i + 1]) if i + 1 < len(stack) else np.ones(stack.shape[1:], bool)
        yield stack[i], run, ends & ~np.isnan(stack[i])


def mode_of(stack: np.ndarray) -> np.ndarray:
    """The most frequent value, the least of equally frequent ones."""
    stack = np.sort(stack, 0)
    best, value = np.zeros(stack.shape[1:], np.int64), np.full(stack.shape[1:], NAN)
    for v, n, ends in _runs(stack):
        won = ends & (n > best)
        best, value = np.where(won, n, best), np.where(won, v, value)
    return value


def entropy_of(stack: np.ndarray) -> np.ndarray:
    """Entropy in bits of the whole parts."""
    stack = np.sort(np.trunc(stack), 0)
    size = np.maximum((~np.isnan(stack)).sum(0), 1)
    out = np.zeros(stack.shape[1:])
    for _, n, ends in _runs(stack):
        out -= np.where(ends, n / size * np.log2(n / size), 0.0)
    return out


def focal(tiles: DataFrame, stat: str, offsets: list[tuple[int, int]], zero: bool) -> DataFrame:
    """mean, sum, sd, max, min, median, mode or entropy of the window's cells; ``zero`` counts missing ones as 0."""
    r = max(max(abs(a), abs(b)) for a, b in offsets)

    def f(p: np.ndarray) -> np.ndarray:
        p = np.nan_to_num(p, nan=0.0) if zero else p
        seen = [shifted(p, r, dx, dy) for dx, dy in offsets]
        if stat in ("mean", "sum", "sd"):
            n = float(len(seen)) if zero else sum((~np.isnan(v)).astype(float) for v in seen)
            total = sum(np.nan_to_num(v, nan=0.0) for v in seen)
            if stat == "sum":
                return total
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = total / n
                return mean if stat == "mean" else np.sqrt(np.maximum(sum(np.nan_to_num(v, nan=0.0) ** 2 for v in seen) / n - mean * mean, 0))
        if stat in ("max", "min"):
            out = seen[0].copy()
            for v in seen[1:]:
                (np.fmax if stat == "max" else np.fmin)(out, v, out=out)
            return out
        out = np.empty_like(seen[0])
        rows = max(1, 4_000_000 // (len(seen) * len(out)))  # the stack of a few rows at a time
        for a in range(0, len(out), rows):
            stack = np.stack([v[a : a + rows] for v in seen])
            if stat == "median":
                out[a : a + rows] = np.median(stack, 0) if zero else _nanmedian(stack)
            else:
                out[a : a + rows] = (mode_of if stat == "mode" else entropy_of)(stack)
        return out

    return around(tiles, r, f)


def _nanmedian(stack: np.ndarray) -> np.ndarray:
    stack = np.sort(stack, 0)  # NaN last
    n = (~np.isnan(stack)).sum(0)
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, len(stack) - 1)
    return (np.take_along_axis(stack, low[None], 0)[0] + np.take_along_axis(stack, high[None], 0)[0]) / 2


def convolve(tiles: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    r = max(max(abs(a), abs(b)) for a, b, _ in offsets)

    def f(p: np.ndarray) -> np.ndarray:
        p = np.nan_to_num(p, nan=0.0)
        return sum(w * shifted(p, r, dx, dy) for dx, dy, w in offsets)

    return around(tiles, r, f)


def window3(tiles: DataFrame, f: Callable[[Callable[[int, int], np.ndarray]], np.ndarray | tuple]) -> DataFrame:
    """f(z), where z(dx, dy) are the neighbours at an offset, NaN where there is none."""

    def run(p: np.ndarray):
        with np.errstate(invalid="ignore", divide="ignore"):
            return f(lambda dx, dy: shifted(p, 1, dx, dy))

    return around(tiles, 1, run)


# --- stacks of images ---


def _reduce(stack: np.ndarray, has: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(value, where there is one) of a stack (images, cells)."""
    ok = ~np.isnan(stack)
    some, n = ok.any(0), ok.sum(0)
    if how == "mean":
        return np.where(some, np.where(ok, stack, 0).sum(0) / np.maximum(n, 1), NAN), some
    if how == "mean_of_present":
        return np.where(some, np.where(ok, stack, 0).sum(0) / np.maximum(n, 1), NAN), has.any(0)
    if how in ("sum", "count"):
        return (np.where(ok, stack, 0).sum(0) if how == "sum" else n.astype(float)), some
    if how in ("min", "max"):
        return (np.fmin if how == "min" else np.fmax).reduce(stack, 0), some
    if how in ("or", "and"):
        whole = np.where(ok, stack, 0 if how == "or" else -1).astype(np.int64)
        return (np.bitwise_or if how == "or" else np.bitwise_and).reduce(whole, 0).astype(float), some
    if how == "cat":
        return np.take_along_axis(stack, ok.argmax(0)[None], 0)[0], some
    return {"median": _nanmedian, "mode": mode_of}[how](stack), some


def reduced(tiles: DataFrame, how: str, keys: list[str] | None = None, order: str = "cov_id") -> DataFrame:
    """One raster of all images of a tile: mean, min, max, sum, median, mode, or, and, count, or cat (first by ``order``)."""
    keys = keys or KEY
    step = F.greatest(F.floor(F.size("cells") / STRIPS), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("cells") / step).cast("int") - 1), lambda i: F.slice("cells", i * step + 1, step))
    rank = [F.col(order).alias("__o")] if order in tiles.columns else [F.lit(0).alias("__o")]
    sent = tiles.select(*keys, *rank, F.posexplode(parts).alias("__k", "cells"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__o", "ascending")])
        parts = t["cells"].combine_chunks()
        v = parts.flatten()
        stack, has = (x.reshape(len(parts), -1) for x in (v.to_numpy(zero_copy_only=False).astype(np.float64), np.array(v.is_valid())))
        new, some = _reduce(stack, has, how)
        return pa.table({**{k: t[k].combine_chunks()[:1] for k in [*keys, "__k"]}, "cells": _listed(new, some)})

    done = sent.groupBy(*keys, "__k").applyInArrow(run, _schema(sent, [*keys, "__k"]))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__k", "cells"))), lambda x: x["cells"]))
    return done.groupBy(*keys).agg(whole.alias("cells"))


# --- grids ---


def coarser(tiles: DataFrame, k: int, how: str) -> DataFrame | None:
    """Blocks of k x k cells in one; tiles keep their places. The tiles' edge must be a multiple of k."""

    @F.arrow_udf("array<double>")
    def down(cells: pa.Array) -> pa.Array:
        out = []
        for c in cells:
            has, v = np.array(c.values.is_valid()), _square(c.values)
            n = len(v)
            if n % k:
                raise ValueError(f"tiles of {n} cells can't be cut into blocks of {k}")
            has = has.reshape(n, n)
            if how == "nearest":
                out.append(_listed(v[k // 2 :: k, k // 2 :: k], has[k // 2 :: k, k // 2 :: k]))
                continue
            block = lambda a: a.reshape(n // k, k, n // k, k)
            ok = block(~np.isnan(v))
            total, m = block(np.nan_to_num(v, nan=0.0)).sum((1, 3)), ok.sum((1, 3))
            out.append(_listed(np.where(m > 0, total / np.maximum(m, 1), NAN), block(has).any((1, 3))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return tiles.withColumn("cells", down("cells"))


def finer(tiles: DataFrame, k: int) -> DataFrame:
    """Each cell k x k times."""

    @F.arrow_udf("array<double>")
    def up(cells: pa.Array) -> pa.Array:
        out = []
        for c in cells:
            v = _square(c.values)
            has = np.array(c.values.is_valid()).reshape(v.shape)
            out.append(_listed(*(x.repeat(k, 0).repeat(k, 1) for x in (v, has))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return tiles.withColumn("cells", up("cells"))


def interpolated(tiles: DataFrame, k: int, reach: int, weight: Callable[[float], float]) -> DataFrame:
    """A grid k times finer by separable weights of the cells around, of those that have data."""

    def f(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(p) - 2 * reach
        top, bottom = np.zeros((n * k, n * k)), np.zeros((n * k, n * k))
        for j in range(k):
            for i in range(k):
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        w = weight((i + 0.5) / k - 0.5 - dx) * weight((j + 0.5) / k - 0.5 - dy)
                        if w:
                            v = shifted(p, reach, dx, dy)
                            top[j::k, i::k] += np.where(np.isnan(v), 0, v * w)
                            bottom[j::k, i::k] += np.where(np.isnan(v), 0, w)
        has = ~np.isnan(shifted(p, reach, 0, 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(bottom != 0, top / bottom, NAN), has.repeat(k, 0).repeat(k, 1)

    return around(tiles, reach, f)


def in_regions(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of the tiles that regions' boxes (id, xmin, ymin, xmax, ymax) touch, with the regions' columns."""
    size = tiles.select(edge().alias("s")).limit(1)
    wide = regions.crossJoin(F.broadcast(size))  # one row
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("s")).cast("int"), F.floor(F.col(hi) / F.col("s")).cast("int"))
    at = wide.withColumn("tx", F.explode(span("xmin", "xmax"))).withColumn("ty", F.explode(span("ymin", "ymax"))).drop("s")
    return from_tiles(tiles.join(at, ["tx", "ty"]))


# --- reference systems ---


def warped(tiles: DataFrame, source: tuple[str, float, float, float], target: tuple[str, float, float, float], how: str = "nearest", size: int = SIZE) -> DataFrame:
    """The raster on another grid; a grid is (crs, x of column 0's left, y of row 0's top, cell size).

    Every source tile goes to the target tiles that its outline, sent through the formulas,
    can touch; a target tile then takes the nearest source cell of each of its cell centres,
    or weights the four around it (``bilinear``, of those that have data).
    """
    from ..functions import crs

    (a, ax, ay, ac), (b, bx, by, bc) = source, target
    keys = keys_of(tiles)

    @F.arrow_udf("array<struct<x: int, y: int>>")
    def touched(tx: pa.Array, ty: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for i, j, m in zip(tx.to_pylist(), ty.to_pylist(), n.to_pylist()):
            t = np.linspace(-1, m + 1, 33)
            u, v = (np.concatenate([g.ravel() for g in np.meshgrid(t, t)[k : k + 1]]) for k in (0, 1))
            x, y = crs.transform(ax + (i * m + u) * ac, ay - (j * m + v) * ac, a, b)
            c, r = (x - bx) / bc / size, (by - y) / bc / size
            ok = np.isfinite(c) & np.isfinite(r)
            span = lambda w: range(int(np.floor(w[ok].min() - 0.02)), int(np.floor(w[ok].max() + 0.02)) + 1) if ok.any() else range(0)
            out.append([{"x": p, "y": q} for p in span(c) for q in span(r)])
        return pa.array(out, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))

    own = [k for k in keys if k not in ("tx", "ty")]
    sent = tiles.select(*own, F.col("tx").alias("__sx"), F.col("ty").alias("__sy"), "cells", F.explode(touched("tx", "ty", edge())).alias("__t"))
    sent = sent.select(*own, F.col("__t.x").alias("tx"), F.col("__t.y").alias("ty"), "__sx", "__sy", "cells")

    def run(t: pa.Table) -> pa.Table:
        tx, ty = t["tx"][0].as_py(), t["ty"][0].as_py()
        sx, sy, parts = t["__sx"].to_pylist(), t["__sy"].to_pylist(), t["cells"].combine_chunks()
        m = int(round(len(parts[0].values) ** 0.5))
        x, y = np.meshgrid(bx + (tx * size + np.arange(size) + 0.5) * bc, by - (ty * size + np.arange(size) + 0.5) * bc)
        px, py = crs.transform(x.ravel(), y.ravel(), b, a)
        col, row = (px - ax) / ac, (ay - py) / ac
        place = {p: i for i, p in enumerate(zip(sx, sy))}
        values = [p.values.to_numpy(zero_copy_only=False) for p in parts]
        masks = [np.array(p.values.is_valid()) for p in parts]

        def pick(c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Values and presence at whole source columns and rows."""
            out, has = np.full(len(c), NAN), np.zeros(len(c), bool)
            ok = np.isfinite(c) & np.isfinite(r)
            c, r = np.where(ok, c, 0).astype(np.int64), np.where(ok, r, 0).astype(np.int64)
            for (i, j), k in place.items():
                at = ok & (c // m == i) & (r // m == j)
                f = (r[at] - j * m) * m + c[at] - i * m
                out[at], has[at] = values[k][f], masks[k][f]
            return out, has

        near, has = pick(np.floor(col), np.floor(row))
        if how == "bilinear":
            top, bottom = np.zeros(len(col)), np.zeros(len(col))
            c0, r0 = np.floor(col - 0.5), np.floor(row - 0.5)
            for dc in (0, 1):
                for dr in (0, 1):
                    w = (1 - np.abs(col - 0.5 - c0 - dc)) * (1 - np.abs(row - 0.5 - r0 - dr))
                    v, _ = pick(c0 + dc, r0 + dr)
                    ok = ~np.isnan(v) & (w > 0)
                    top, bottom = top + np.where(ok, v * w, 0), bottom + np.where(ok, w, 0)
            near = np.where(has & ~np.isnan(near), top / np.where(bottom > 0, bottom, 1), near)
        if not has.any():
            return t.select(keys).slice(0, 0).append_column("cells", pa.array([], pa.list_(pa.float64())))
        return pa.table({**{k: t[k].combine_chunks()[:1] for k in keys}, "cells": _listed(near, has)})

    return sent.groupBy(*keys).applyInArrow(run, _schema(tiles, keys))
