"""Raster ("coverage") operators over tile tables and cell tables.

A tile table (band, tx, ty, cells) has one row for each 256 x 256 cells; see ``tiles``. It is
the form for rasters of any size. A cell table has one row for each cell and band: (band, cx,
cy, v), with NULL (or no row) as NoData; every operator takes and returns either form.
Further columns, such as ``cov_id`` or ``ts``, are kept where an operator works cell by cell.
Grids of two rasters agree by their cell indices: an inner join on (cx, cy) is the
intersection of their extents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cellmath
from ..session import checkpointed
from . import tiles
from .tiles import cells_of, from_tiles, tiled, to_tiles  # noqa: F401

KEY = ["band", "cx", "cy"]


def local(cells: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """v -> f(v), cell by cell."""
    if tiled(cells):
        return tiles.local(cells, f)
    return cells.withColumn("v", f(F.col("v")))


def unary(cells: DataFrame, name: str) -> DataFrame:
    return local(cells, cellmath.UNARY[name])


def constant(cells: DataFrame, name: str, c: float) -> DataFrame:
    if name in ("divide_num", "mod_num") and float(c) == 0:
        raise ValueError("the divisor is zero")
    return local(cells, lambda v: cellmath.CONSTANT[name](v, c))


def _numbered(cells: DataFrame) -> DataFrame:
    """Adds ``i``, the number of each band in alphabetical order; bands are few, and counted over the whole raster."""
    n = cells.select("band").distinct().withColumn("i", F.row_number().over(Window.orderBy("band")))
    return cells.join(n, "band")


def combine(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], by_position: bool = False) -> DataFrame:
    """f(a, b) of the cells that both have, bands matched by name, or by their order.

    By position, the bands of each side are numbered in alphabetical order and the result
    keeps the names of ``a``.
    """
    if tiled(a):
        if by_position:
            a, b = _numbered(a), _numbered(b)
            return tiles.combine(a.select("i", *tiles.KEY, "cells"), b.select("i", "tx", "ty", "cells"), f, ["i", "tx", "ty"]).select(*tiles.KEY, "cells")
        return tiles.combine(a.select(*tiles.KEY, "cells"), b, f)
    if by_position:
        a, b = _numbered(a), _numbered(b).select("i", "cx", "cy", F.col("v").alias("w"))
        return a.join(b, ["i", "cx", "cy"]).select(*KEY, f(F.col("v"), F.col("w")).alias("v"))
    b = b.select(*KEY, F.col("v").alias("w"))
    return a.select(*KEY, "v").join(b, KEY).select(*KEY, f(F.col("v"), F.col("w")).alias("v"))


def binary(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return combine(a, b, cellmath.BINARY[name])


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of either raster; where both have a value, that of ``a``."""
    if tiled(a):
        return tiles.overlay(a, b)
    both = a.select(*KEY, F.struct(F.lit(0).alias("o"), "v").alias("s")).unionByName(b.select(*KEY, F.struct(F.lit(1).alias("o"), "v").alias("s")))
    return both.where("s.v is not null").groupBy(*KEY).agg(F.min("s").alias("s")).select(*KEY, F.col("s.v").alias("v"))


def normalized_difference(cells: DataFrame, first: str, second: str, name: str = "nd") -> DataFrame:
    """(first - second) / (first + second); one pass, since both bands of a cell are one group."""
    if tiled(cells):
        t = tiles.side_by_side(cells, [first, second])
        return t.select(F.lit(name).alias("band"), "tx", "ty", tiles.zipped(F.col("b0"), F.col("b1"), lambda a, b: (a - b) / F.nullif(a + b, F.lit(0.0))).alias("cells"))
    of = lambda b: F.max(F.when(F.col("band") == b, F.col("v")))
    both = cells.where(F.col("band").isin(first, second)).groupBy("cx", "cy").agg(of(first).alias("a"), of(second).alias("b"))
    return both.where("a is not null and b is not null").select(F.lit(name).alias("band"), "cx", "cy", ((F.col("a") - F.col("b")) / F.nullif(F.col("a") + F.col("b"), F.lit(0.0))).alias("v"))


def _against(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells with the mask's value as ``m``: a mask of one band serves all bands."""
    one = mask.agg(F.count_distinct("band")).first()[0] <= 1
    keys = ["cx", "cy"] if one else KEY
    return cells.join(mask.select(*keys, F.col("v").alias("m")), keys)


def mask(cells: DataFrame, by: DataFrame, read: float, write: float | None) -> DataFrame:
    """``write`` where the mask equals ``read``, else the value."""
    if tiled(cells):
        keys = ["tx", "ty"] if by.agg(F.count_distinct("band")).first()[0] <= 1 else tiles.KEY
        return tiles.combine(cells.select(*tiles.KEY, "cells"), by, lambda v, m: F.when(m == read, F.lit(write).cast("double")).otherwise(v), keys)
    return _against(cells, by).select(*KEY, F.when(F.col("m") == read, F.lit(write).cast("double")).otherwise(F.col("v")).alias("v"))


def update_mask(cells: DataFrame, by: DataFrame) -> DataFrame:
    """NoData where the mask is 0."""
    return mask(cells, by, 0.0, None)


def unmask(cells: DataFrame, by: DataFrame) -> DataFrame:
    """NoData (rows with NULL) filled from the second raster."""
    if tiled(cells):
        return tiles.unmask(cells, by)
    other = by.select(*KEY, F.col("v").alias("w"))
    return cells.join(other, KEY, "left").select(*KEY, F.coalesce("v", "w").alias("v"))


def select_bands(cells: DataFrame, bands: list[str]) -> DataFrame:
    """The named bands; a band named twice is an error, a missing one leaves nothing."""
    if len(set(bands)) != len(bands):
        raise ValueError("a band is named twice")
    have = cells.where(F.col("band").isin(bands)).select("band").distinct().agg(F.count("*").alias("n"))
    got = cells.where(F.col("band").isin(bands))
    return got.join(F.broadcast(have.where(F.col("n") == len(bands)).select(F.lit(1).alias("ok"))), how="cross").drop("ok")


def add_bands(dst: DataFrame, src: DataFrame, names: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Bands of both; with ``overwrite`` those of ``src`` replace bands of the same name."""
    src = src.where(F.col("band").isin(names)) if names else src
    if overwrite:
        dst = dst.join(src.select("band").distinct(), "band", "left_anti")
    own = [*tiles.KEY, "cells"] if tiled(dst) else [*KEY, "v"]
    return dst.select(*own).unionByName(src.select(*own))


def rename(cells: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Bands renamed by position in ``old``."""
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    pairs = [F.lit(x) for p in zip(old, new) for x in p]
    return cells.withColumn("band", F.coalesce(F.element_at(F.create_map(*pairs), F.col("band")), F.col("band")))


def band_names(cells: DataFrame) -> DataFrame:
    return cells.agg(F.array_join(F.sort_array(F.collect_set("band")), ",").alias("bands"))


def band_num(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("band").alias("n"))


def slice_bands(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Bands number [start, end) in alphabetical order."""
    if not 0 <= start < end:
        raise ValueError("need 0 <= start < end")
    n = cells.select("band").distinct().withColumn("i", F.row_number().over(Window.orderBy("band")) - 1)
    return cells.join(n.where((F.col("i") >= start) & (F.col("i") < end)).select("band"), "band")


def into_one(cells: DataFrame, bands: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Mean of the bands in one band, named after the first."""
    got = cells.where(F.col("band").isin(bands)) if bands else cells
    if name or bands:
        named = lambda t: t.withColumn("band", F.lit(name or bands[0]))
    else:
        first = cells.agg(F.min("band").alias("band"))
        named = lambda t: t.crossJoin(F.broadcast(first))  # noqa: E731  # one row
    if tiled(cells):
        return named(tiles.reduced(got, "mean_of_present", ["tx", "ty"], "band")).select(*tiles.KEY, "cells")
    return named(got.groupBy("cx", "cy").agg(F.avg("v").alias("v"))).select(*KEY, "v")


def stack(cells: DataFrame, n: int) -> DataFrame:
    """One band n times, as B1 to Bn."""
    return cells.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("B"), i.cast("string")))).alias("band"), *[c for c in cells.columns if c != "band"])


def percentile_range(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Values between the places int(n * low) and int(n * high) of the n sorted distinct values.

    The distinct values are ranked once, by a range partitioning and the sizes of its parts,
    so no task sorts them all.
    """
    values = cells_of(cells).where("v is not null").select("v").distinct()
    parts = checkpointed(values.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sizes = {r["p"]: r["count"] for r in parts.groupBy("p").count().collect()}  # a row a partition
    n = sum(sizes.values())
    if n == 0:
        return cells
    ends, begin = [], {}
    for p in sorted(sizes):
        begin[p] = sum(sizes[q] for q in sizes if q < p)
    for share in (low, high):
        at = min(int(n * share), n - 1)
        p = max(q for q in begin if begin[q] <= at)
        ends.append(parts.where(F.col("p") == p).orderBy("v").offset(at - begin[p]).limit(1).first()["v"])
    return local(cells, lambda v: F.when((v >= ends[0]) & (v <= ends[1]), v))


def histogram(cells: DataFrame) -> DataFrame:
    """(value, n) of the whole parts of all cells."""
    return cells_of(cells).where("v is not null").groupBy(F.col("v").cast("int").alias("value")).agg(F.count("*").alias("n"))


def area(cells: DataFrame, ranges: list[str], resolution: float) -> DataFrame:
    """Area of the cells of the first band in any "low:high" range, open, one end may miss; "x:x" is equality."""
    v, hit = F.col("v"), F.lit(False)
    for r in ranges:
        a, _, b = r.partition(":")
        one = F.lit(True)
        if a and b and float(a) == float(b):
            one = v == float(a)
        else:
            one = one & (v > float(a)) if a else one
            one = one & (v < float(b)) if b else one
        hit = hit | one
    first = cells_of(cells).where("v is not null").select(F.col("band"), "v")
    name = F.broadcast(first.agg(F.min("band").alias("band")))
    return first.join(name, "band").where(hit).agg((F.count("*") * float(resolution) ** 2).alias("area"))


def resample(cells: DataFrame, factor: int, how: str = "nearest") -> DataFrame:
    """A grid ``factor`` times finer (> 0) or -factor times coarser (< 0).

    Coarser by ``nearest`` takes the block's middle cell, otherwise ``mean``. Finer by
    ``nearest`` repeats a cell; ``bilinear`` and ``cubic`` weight cells by their distance.
    """
    if factor in (0, 1, -1):
        return cells if tiled(cells) else cells.select(*KEY, "v")
    if tiled(cells) and factor < 0:
        return tiles.coarser(cells, -factor, how)
    if tiled(cells) and how == "nearest":
        return tiles.finer(cells, factor)
    if factor < 0:
        k = -factor
        block = [F.floor(F.col(c) / k).cast("int").alias(c) for c in ("cx", "cy")]
        if how == "nearest":
            return cells.where((F.pmod("cx", F.lit(k)) == k // 2) & (F.pmod("cy", F.lit(k)) == k // 2)).select("band", *block, "v")
        return cells.groupBy("band", *block).agg(F.avg("v").alias("v"))
    if how == "nearest":
        each = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
        fine = cells.select(*KEY, "v", each.alias("i")).select("*", each.alias("j"))
        return fine.select("band", (F.col("cx") * factor + F.col("i")).cast("int").alias("cx"), (F.col("cy") * factor + F.col("j")).cast("int").alias("cy"), "v")
    reach = 1 if how == "bilinear" else 2

    def weight(t: float) -> float:
        t = abs(t)
        if how == "bilinear":
            return max(0.0, 1 - t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    if tiled(cells):
        return tiles.interpolated(cells, factor, reach, weight)
    axis = [(o * factor + k, weight((k + 0.5) / factor - 0.5 + o)) for o in range(-reach, reach + 1) for k in range(factor)]
    offsets = [(dx, dy, wx * wy) for dx, wx in axis for dy, wy in axis if wx * wy]
    lit = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("w")) for a, b, w in offsets])).alias("o")
    put = cells.where("v is not null").select(*KEY, "v", lit)
    at = [(F.col(c) * factor + F.col(f"o.d{c[1]}")).cast("int").alias(c) for c in ("cx", "cy")]
    got = put.select("band", *at, (F.col("v") * F.col("o.w")).alias("p"), F.col("o.w").alias("w")).groupBy(*KEY).agg((F.sum("p") / F.nullif(F.sum("w"), F.lit(0.0))).alias("v"))
    inside = resample(cells.where("v is not null"), factor, "nearest").select(*KEY)
    return got.join(inside, KEY)


def clip_box(cells: DataFrame, xmin: int, ymin: int, xmax: int, ymax: int) -> DataFrame:
    """Cells with index in [xmin, xmax) x [ymin, ymax)."""
    if tiled(cells):
        return tiles.cut_box(cells, xmin, ymin, xmax, ymax)
    return cells.where((F.col("cx") >= xmin) & (F.col("cx") < xmax) & (F.col("cy") >= ymin) & (F.col("cy") < ymax))


def clip(cells: DataFrame, wkt: str) -> DataFrame:
    """Cells whose centre lies in a polygon of cell coordinates; its box is tested first."""
    if tiled(cells):
        return tiles.cut_polygon(cells, wkt)
    from ..functions import geometry as G

    g = G.from_wkt(wkt)
    x0, y0, x1, y1 = G.bounds(g)
    near = cells.where((F.col("cx") + 0.5 >= x0) & (F.col("cx") + 0.5 <= x1) & (F.col("cy") + 0.5 >= y0) & (F.col("cy") + 0.5 <= y1))
    return near.where(G.covers_xy(wkt)(F.col("cx") + 0.5, F.col("cy") + 0.5))


def _hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    hi = F.greatest(r, g, b)
    d = hi - F.least(r, g, b)
    turn = F.when(hi == r, (g - b) / d).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    h = F.when(d == 0, 0.0).otherwise(F.when(turn < 0, turn + 360).otherwise(turn))
    return {"H": h, "S": F.when(hi == 0, 0.0).otherwise(d / hi), "V": hi}


def _rgb(h: Column, s: Column, w: Column) -> dict[str, Column]:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
        return (w - w * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))) * 255

    return {"R": channel(5), "G": channel(3), "B": channel(1)}


def _three(cells: DataFrame, bands: list[str], f: Callable[..., dict[str, Column]]) -> DataFrame:
    """Bands computed from three bands, of the cells that have all of them."""
    if tiled(cells):
        return tiles.from_bands(tiles.side_by_side(cells, bands), 3, f)
    of = lambda b: F.max(F.when(F.col("band") == b, F.col("v")))
    t = cells.groupBy("cx", "cy").agg(*[of(b).alias(n) for n, b in zip("abc", bands)]).where("a is not null and b is not null and c is not null")
    return _long(t, f(F.col("a"), F.col("b"), F.col("c")))


def rgb_to_hsv(cells: DataFrame, red: str, green: str, blue: str) -> DataFrame:
    """Bands H (0 to 360), S and V (0 to 1) of three bands of 0 to 255."""
    return _three(cells, [red, green, blue], lambda r, g, b: _hsv(r / 255.0, g / 255.0, b / 255.0))


def hsv_to_rgb(cells: DataFrame, hue: str = "H", saturation: str = "S", value: str = "V") -> DataFrame:
    """Bands R, G and B of 0 to 255."""
    return _three(cells, [hue, saturation, value], _rgb)


def _long(t: DataFrame, bands: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), c.cast("double").alias("v")) for n, c in bands.items()])).alias("e")
    return t.select("cx", "cy", each).select("e.band", "cx", "cy", "e.v")


def gain_bias(cells: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """(band, gain, bias) that stretch each band's range to [low, high]."""
    m = cells_of(cells).groupBy("band").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    gain = F.lit(high - low) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    return m.select("band", F.coalesce(gain, F.lit(0.0)).alias("gain"), (low - F.col("a") * F.coalesce(gain, F.lit(0.0))).alias("bias"))


def add_styles(cells: DataFrame, low: float | None = None, high: float | None = None, gain: float | None = None, bias: float | None = None, gamma: float = 1.0, palette: list[tuple[int, int, int]] | None = None, bands: list[str] | None = None) -> DataFrame:
    """Bands for display as whole numbers of 0 to 255.

    Either gain and bias or low and high stretch the values; neither means each band's own
    range. A palette turns one band into R, G and B by classes of equal width.
    """
    if (gain is not None or bias is not None) and (low is not None or high is not None):
        raise ValueError("give gain and bias, or low and high, not both")
    cells = cells.where(F.col("band").isin(bands)) if bands else cells
    shown = lambda unit: F.pow(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)), F.lit(1.0 / gamma))
    if gain is not None or bias is not None:
        unit = lambda v: shown((v * float(1 if gain is None else gain) + float(bias or 0)) / 255.0)
    elif low is not None:
        unit = lambda v: shown((v - float(low)) / (float(high) - float(low)))
    else:
        own = gain_bias(cells, 0.0, 1.0).withColumnsRenamed({"gain": "__g", "bias": "__b"})
        cells = cells.join(F.broadcast(own), "band")  # a row a band
        unit = lambda v: shown(v * F.col("__g") + F.col("__b"))
    if palette:
        n = len(palette)
        place = lambda v: F.least(F.floor(unit(v) * n), F.lit(n - 1)).cast("int") + 1
        colour = lambda k: lambda v: F.element_at(F.array(*[F.lit(float(p[k])) for p in palette]), place(v))
        out = None
        for k, c in enumerate("RGB"):
            one = local(cells if tiled(cells) else cells.where("v is not null"), colour(k)).withColumn("band", F.lit(c)).drop("__g", "__b")
            out = one if out is None else out.unionByName(one)
        return out
    return local(cells, lambda v: F.floor(1 + 254 * unit(v)).cast("double")).drop("__g", "__b")


def factor_detector(dependent: DataFrame, factor: DataFrame) -> DataFrame:
    """(q, n, strata): share of the dependent raster's variance that the factor's classes explain."""
    if tiled(dependent):
        pair = dependent.select("tx", "ty", "cells").join(factor.select("tx", "ty", F.col("cells").alias("k")), ["tx", "ty"])
        both = pair.select(F.explode(F.arrays_zip("cells", "k")).alias("e")).select(tiles.data(F.col("e.cells")).alias("v"), tiles.data(F.col("e.k")).alias("k")).where("v is not null and k is not null")
    else:
        both = dependent.select("cx", "cy", "v").join(factor.select("cx", "cy", F.col("v").alias("k")), ["cx", "cy"]).where("v is not null and k is not null")
    each = both.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    total = F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")
    return each.agg((1 - within / F.nullif(total, F.lit(0.0))).alias("q"), F.sum("n").alias("n"), F.count("*").alias("strata"))


def metadata(cells: DataFrame, crs: str = "EPSG:4326", x0: float = 0.0, y0: float = 0.0, size: float = 1.0) -> DataFrame:
    """(crs, xmin, ymin, xmax, ymax, resolution) of cells of ``size`` whose index 0 begins at (x0, y0)."""
    cells = cells_of(cells)
    return cells.agg(F.lit(crs).alias("crs"), (x0 + F.min("cx") * size).alias("xmin"), (y0 + F.min("cy") * size).alias("ymin"), (x0 + (F.max("cx") + 1) * size).alias("xmax"), (y0 + (F.max("cy") + 1) * size).alias("ymax"), F.lit(float(size)).alias("resolution"))


def matrix_size(z: int) -> tuple[int, int]:
    """(columns, rows) of the world's tile matrix in degrees at a zoom level."""
    return (1, 1) if z == 0 else (1 << z, 1 << (z - 1))


def extent_to_tiles(extents: DataFrame, z: int) -> DataFrame:
    """(tx, ty) of the tiles of each extent (xmin, ymin, xmax, ymax), row 0 in the north."""
    cols, rows = matrix_size(z)
    w, h = 360 / cols, 180 / rows
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    xs = F.sequence(at((F.col("xmin") + 180) / w, cols), at((F.col("xmax") + 180) / w, cols))
    ys = F.sequence(at((90 - F.col("ymax")) / h, rows), at((90 - F.col("ymin")) / h, rows))
    return extents.select("*", F.explode(xs).alias("tx")).select("*", F.explode(ys).alias("ty"))


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """All levels, each of half the resolution of the one before; level 0 is the raster."""
    out, now = cells.select(F.lit(0).alias("level"), "*"), cells
    for k in range(1, levels + 1):
        now = resample(now, -2, "mean")
        out = out.unionByName(now.select(F.lit(k).alias("level"), "*"))
    return out


def sample_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, sample, band, cx, cy, v): cells whose centre is in a region's box (id, xmin, ymin, xmax, ymax)."""
    inside = (F.col("cx") + 0.5 >= F.col("xmin")) & (F.col("cx") + 0.5 < F.col("xmax")) & (F.col("cy") + 0.5 >= F.col("ymin")) & (F.col("cy") + 0.5 < F.col("ymax"))
    got = tiles.in_regions(cells, regions).where(inside) if tiled(cells) else cells.join(regions, inside)
    return got.withColumn("sample", F.row_number().over(Window.partitionBy("id").orderBy("cy", "cx", "band"))).select("id", "sample", *KEY, "v")


def as_date(seconds: Column) -> Column:
    """Date text of seconds since 1970."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def reproject(cells: DataFrame, source: tuple[str, float, float, float], target: tuple[str, float, float, float], how: str = "nearest", size: int | None = None) -> DataFrame:
    """The raster on another grid (crs, left, top, cell size), in tiles as large as its own; see ``tiles.warped``."""
    if not tiled(cells):
        return from_tiles(tiles.warped(to_tiles(cells), source, target, how))
    return tiles.warped(cells, source, target, how, size or tiles.size_of(cells))


def aligned(a: DataFrame, b: DataFrame, grid_a: tuple[str, float, float, float], grid_b: tuple[str, float, float, float]) -> tuple[DataFrame, DataFrame, tuple[str, float, float, float]]:
    """Both rasters on one grid, the finer one's: the coarser is resampled, to the other's system if they differ.

    Cell sizes are compared in the first raster's units at its own corner; binary operators
    then meet in the extents' intersection.
    """
    from ..functions import crs

    x, y = grid_b[1], grid_b[2]
    u, v = crs.transform([x, x + grid_b[3]], [y, y], grid_b[0], grid_a[0])
    size_b = float(((u[1] - u[0]) ** 2 + (v[1] - v[0]) ** 2) ** 0.5)
    if size_b < grid_a[3] * (1 - 1e-9):
        return reproject(a, grid_a, grid_b, size=tiles.size_of(b) if tiled(b) else None), b, grid_b
    same = tuple(grid_a) == tuple(grid_b)
    return a, b if same else reproject(b, grid_b, grid_a, size=tiles.size_of(a) if tiled(a) else None), grid_a


def band_types(cells: DataFrame) -> DataFrame:
    """(band, kind): the smallest cell type that holds a band's values: int8 to int32, float or double."""
    v = F.col("v")
    t = cells_of(cells).where("v is not null").groupBy("band").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.bool_and(v == F.floor(v)).alias("whole"), F.bool_and(v.cast("float").cast("double") == v).alias("single"))
    kind = F.when(F.col("single"), "float").otherwise("double")
    for name in reversed(("int8", "uint8", "int16", "uint16", "int32")):
        low, high, _, none = cellmath.CELL_TYPES[name]
        kind = F.when(F.col("whole") & (F.col("a") >= low + (none == low)) & (F.col("b") <= high) & ((F.col("a") > none) | (F.col("b") < none) | F.lit(none not in (0,))), name).otherwise(kind)
    return t.select("band", kind.alias("kind"))
