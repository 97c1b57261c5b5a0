"""Kernels and neighbourhood operators.

On tiles, halos are exchanged and numpy works on whole windows (see ``tiles``). On cell
tables, which are for small or sparse rasters, every cell sends its value to the cells whose window holds it, and one aggregation per
target gathers them: no join and no copy of the raster on the driver. Only cells that the
raster has get a result. With ``pad="zero"`` missing neighbours count as 0, with "null"
they don't count.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles

Kernel = list[list[float]]


def _made(rows: Kernel, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    """Weights by magnitude; normalised by the sum of the positive ones."""
    total = sum(w for r in rows for w in r if w > 0) if normalize else 1.0
    return [[w * magnitude / (total or 1.0) for w in r] for r in rows]


def _by(radius: int, f, normalize: bool, magnitude: float) -> Kernel:
    span = range(-radius, radius + 1)
    return _made([[float(f(x, y)) for x in span] for y in span], normalize, magnitude)


def fixed(weights: str) -> Kernel:
    import json

    return [[float(w) for w in r] for r in json.loads(weights)]


def square(radius: int, normalize: bool = True, value: float = 1.0) -> Kernel:
    n = 2 * radius + 1
    return [[1 / (n * n) if normalize else value] * n for _ in range(n)]


def rectangle(x: int, y: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _made([[1.0] * (2 * x + 1) for _ in range(2 * y + 1)], normalize, magnitude)


def circle(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: x * x + y * y <= radius * radius, normalize, magnitude)


def diamond(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: abs(x) + abs(y) <= radius, normalize, magnitude)


def octagon(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: abs(x) + abs(y) <= math.sqrt(2) * radius, normalize, magnitude)


def plus(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: x == 0 or y == 0, normalize, magnitude)


def chebyshev(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: max(abs(x), abs(y)), normalize, magnitude)


def manhattan(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: abs(x) + abs(y), normalize, magnitude)


def euclidean(radius: int, normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _by(radius, math.hypot, normalize, magnitude)


def gaussian(radius: int, sigma: float = 1.0, normalize: bool = True, magnitude: float = 1.0) -> Kernel:
    return _by(radius, lambda x, y: math.exp(-(x * x + y * y) / (2 * sigma**2)) / (2 * math.pi * sigma**2), normalize, magnitude)


def plain() -> Kernel:
    return [[1.0, 1.0, 1.0], [1.0, 0.0, 1.0], [1.0, 1.0, 1.0]]


def prewitt(normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _made([[1, 0, -1]] * 3, normalize, magnitude)


def kirsch(normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _made([[5, 5, 5], [-3, 0, -3], [-3, -3, -3]], normalize, magnitude)


def compass(normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return [[w * magnitude / (5 if normalize else 1) for w in r] for r in ([1, 1, -1], [1, -2, -1], [1, 1, -1])]


def roberts(normalize: bool = False, magnitude: float = 1.0) -> Kernel:
    return _made([[1, 0], [0, -1]], normalize, magnitude)


def sobel(axis: str) -> Kernel:
    return [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]] if axis == "x" else [[1.0, 2.0, 1.0], [0.0, 0.0, 0.0], [-1.0, -2.0, -1.0]]


def laplacian4() -> Kernel:
    return [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]


def laplacian8() -> Kernel:
    return [[1.0, 1.0, 1.0], [1.0, -8.0, 1.0], [1.0, 1.0, 1.0]]


def inverse(k: Kernel) -> Kernel:
    return [[1 / w if w else 0.0 for w in r] for r in k]


def add(a: Kernel, b: Kernel) -> Kernel:
    return [[x + y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


def rotate(k: Kernel, times: int) -> Kernel:
    """Quarter turns to the right."""
    for _ in range(times % 4):
        k = [list(r) for r in zip(*k[::-1])]
    return k


def offsets(k: Kernel) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of the neighbours that a cell's window covers."""
    h, w = len(k), len(k[0])
    return [(x - w // 2, y - h // 2, k[y][x]) for y in range(h) for x in range(w)]


def _sent(cells: DataFrame, where: list[tuple[int, int, float]]) -> DataFrame:
    """Each value at every target that sees it: (band, cx, cy, dx, dy, w, v)."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(float(w)).alias("w")) for a, b, w in where])).alias("o")
    t = cells.where("v is not null").select("band", "cx", "cy", "v", each)
    return t.select("band", (F.col("cx") - F.col("o.dx")).alias("cx"), (F.col("cy") - F.col("o.dy")).alias("cy"), "o.dx", "o.dy", "o.w", "v")


def _own() -> Column:
    return F.max(((F.col("dx") == 0) & (F.col("dy") == 0)).cast("int"))


def focal(cells: DataFrame, stat: str, radius: int, kernel: str = "square", pad: str = "zero") -> DataFrame:
    """mean, median, max, min, mode, sum, sd or entropy of each cell's window.

    Of equally frequent values ``mode`` is the least. Entropy is of whole parts in bits.
    """
    shape = [(a, b, w) for a, b, w in offsets(square(radius, False) if kernel == "square" else circle(radius)) if w]
    if (0, 0) not in {(a, b) for a, b, _ in shape}:
        raise ValueError("the window must hold its centre")
    if tiles.tiled(cells):
        if stat not in ("mean", "median", "max", "min", "mode", "sum", "sd", "entropy"):
            raise ValueError(f"no such statistic: {stat}")
        return tiles.focal(cells, stat, [(a, b) for a, b, _ in shape], pad == "zero")
    sent, n = _sent(cells, shape), len(shape)
    group = sent.groupBy("band", "cx", "cy")
    zero = pad == "zero"
    v = F.col("v")
    short = F.count("*") < n
    if stat in ("mean", "sum", "sd"):
        size = F.lit(float(n)) if zero else F.count("*").cast("double")
        mean = F.sum("v") / size
        value = {"mean": mean, "sum": F.sum("v"), "sd": F.sqrt(F.greatest(F.sum(v * v) / size - mean * mean, F.lit(0.0)))}[stat]
    elif stat in ("max", "min"):
        f, g = (F.max, F.greatest) if stat == "max" else (F.min, F.least)
        value = F.when(short, g(f("v"), F.lit(0.0))).otherwise(f("v")) if zero else f("v")
    elif stat == "median":
        all_ = F.sort_array(F.concat(F.collect_list("v"), F.array_repeat(F.lit(0.0), (n - F.count("*")).cast("int"))) if zero else F.collect_list("v"))
        half = F.size(all_)
        value = (F.element_at(all_, F.floor((half + 1) / 2).cast("int")) + F.element_at(all_, F.floor((half + 2) / 2).cast("int"))) / 2
    elif stat in ("mode", "entropy"):
        k = v.cast("long").cast("double") if stat == "entropy" else v
        parts = sent.groupBy("band", "cx", "cy", k.alias("k")).agg(F.count("*").alias("m"), _own().alias("own"))
        whole = parts.groupBy("band", "cx", "cy")
        pads = F.lit(float(n)) - F.sum("m") if zero else F.lit(0.0)
        if stat == "mode":
            zeros = F.coalesce(F.max(F.when(F.col("k") == 0, F.col("m"))), F.lit(0)) + pads
            top = F.min(F.struct((-F.col("m")).alias("a"), F.col("k").alias("b")))
            won = (zeros > -top["a"]) | ((zeros == -top["a"]) & (top["b"] > 0))
            value = F.when(won & (zeros > 0), 0.0).otherwise(top["b"])
        else:
            size = F.lit(float(n)) if zero else F.sum("m").cast("double")
            p = lambda c: -(c / n) * F.log2(c / n)
            if zero:
                zeros = F.coalesce(F.max(F.when(F.col("k") == 0, F.col("m"))), F.lit(0)) + pads
                value = F.coalesce(F.sum(F.when(F.col("k") != 0, p(F.col("m")))), F.lit(0.0)) + F.when(zeros > 0, p(zeros)).otherwise(0.0)
            else:
                m = F.col("m")
                value = F.log2(size) - F.sum(m * F.log2(m.cast("double"))) / size
        return whole.agg(value.alias("v"), F.max("own").alias("own")).where("own = 1").select("band", "cx", "cy", "v")
    else:
        raise ValueError(f"no such statistic: {stat}")
    return group.agg(value.alias("v"), _own().alias("own")).where("own = 1").select("band", "cx", "cy", "v")


def convolve(cells: DataFrame, kernel: Kernel) -> DataFrame:
    """Sum of weight times neighbour; what lies outside counts as 0."""
    at = offsets(kernel)
    if tiles.tiled(cells):
        return tiles.convolve(cells, at)
    return _sent(cells, at if any((a, b) == (0, 0) for a, b, _ in at) else [*at, (0, 0, 0.0)]).groupBy("band", "cx", "cy").agg(F.sum(F.col("w") * F.col("v")).alias("v"), _own().alias("own")).where("own = 1").select("band", "cx", "cy", "v")


def gradient(cells: DataFrame) -> DataFrame:
    """Length of the pair of Sobel derivatives, in one aggregation."""
    if tiles.tiled(cells):
        sides = [[o for o in offsets(sobel(k)) if o[2]] for k in "xy"]
        return tiles.window3(cells, lambda z: np.hypot(*(sum(w * np.nan_to_num(z(a, b)) for a, b, w in side) for side in sides)))
    x, y = ({(a, b): w for a, b, w in offsets(sobel(k))} for k in "xy")
    weight = lambda t: sum((F.when((F.col("dx") == a) & (F.col("dy") == b), w).otherwise(0.0) for (a, b), w in t.items() if w), F.lit(0.0))
    sent = _sent(cells, [(a, b, 0.0) for a, b in x])
    g = sent.groupBy("band", "cx", "cy").agg(F.sum(F.col("v") * weight(x)).alias("gx"), F.sum(F.col("v") * weight(y)).alias("gy"), _own().alias("own"))
    return g.where("own = 1").select("band", "cx", "cy", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("v"))


def neighbours(cells: DataFrame, radius: int = 1) -> DataFrame:
    """(band, cx, cy, v, n): each cell with its neighbours as structs (dx, dy, v) in n."""
    at = [(a, b, 0.0) for a, b, _ in offsets(square(radius, False))]
    one = F.struct("dy", "dx", "v")
    g = _sent(cells, at).groupBy("band", "cx", "cy").agg(F.sort_array(F.collect_list(F.when((F.col("dx") != 0) | (F.col("dy") != 0), one))).alias("n"), F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("v"))).alias("v"))
    return g.where("v is not null")


def _window3(cells: DataFrame) -> DataFrame:
    """(band, cx, cy, z, z_<dx><dy>): the 3 x 3 window in columns; m, 0 and p for -1, 0 and 1."""
    sign = {-1: "m", 0: "0", 1: "p"}
    at = [(a, b, 0.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    cols = [F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col("v"))).alias(f"z_{sign[a]}{sign[b]}") for a, b, _ in at]
    return _sent(cells, at).groupBy("band", "cx", "cy").agg(*cols).where("z_00 is not null")


def _horn(cells: DataFrame, size: float, z_factor: float) -> tuple[DataFrame, Column, Column]:
    """Derivatives by Horn's weights; what lies outside counts as 0."""
    t = _window3(cells)
    z = lambda n: F.coalesce(F.col(f"z_{n}"), F.lit(0.0)) * z_factor
    dx = (z("pm") + 2 * z("p0") + z("pp") - z("mm") - 2 * z("m0") - z("mp")) / (8 * size)
    dy = (z("mp") + 2 * z("0p") + z("pp") - z("mm") - 2 * z("0m") - z("pm")) / (8 * size)
    return t, dx, dy


def _horn_of(z, size: float, z_factor: float) -> tuple[np.ndarray, np.ndarray]:
    at = lambda a, b: np.nan_to_num(z(a, b)) * z_factor
    dx = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) / (8 * size)
    dy = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) / (8 * size)
    return dx, dy


def slope(cells: DataFrame, size: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """Steepness in degrees."""
    if tiles.tiled(cells):
        return tiles.window3(cells, lambda z: np.degrees(np.arctan(np.hypot(*_horn_of(z, size, z_factor)))))
    t, dx, dy = _horn(cells, size, z_factor)
    return t.select("band", "cx", "cy", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("v"))


def aspect(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Direction of descent in degrees from north, clockwise; rows grow to the south. Flat: -1."""
    if tiles.tiled(cells):

        def turned(z) -> np.ndarray:
            dx, dy = _horn_of(z, size, 1.0)
            return np.where((dx == 0) & (dy == 0), -1.0, np.mod(np.degrees(np.arctan2(-dx, dy)) + 360, 360.0))

        return tiles.window3(cells, turned)
    t, dx, dy = _horn(cells, size, 1.0)
    d = F.degrees(F.atan2(-dx, dy))
    return t.select("band", "cx", "cy", F.when((dx == 0) & (dy == 0), -1.0).otherwise(F.pmod(d + 360, F.lit(360.0))).alias("v"))
