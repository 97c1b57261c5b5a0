"""Data cubes: tile or cell tables with time, product and platform (product, platform, ts, band, tx, ty, cells or cx, cy, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cellmath
from . import tiles

KEY = ["product", "platform", "ts", "band", "cx", "cy"]
TILE_KEY = ["product", "platform", "ts", "band", "tx", "ty"]


def load(cube: DataFrame, products: list[str] | None = None, bands: list[str] | None = None, start: str | None = None, end: str | None = None, extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A subset; on a cube partitioned by product and band Spark prunes the folders."""
    if products:
        cube = cube.where(F.col("product").isin(products))
    if bands:
        cube = cube.where(F.col("band").isin(bands))
    if start:
        cube = cube.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        cube = cube.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if extent:
        x0, y0, x1, y1 = extent
        if tiles.tiled(cube):
            return tiles.cut_box(cube, x0, y0, x1, y1)
        cube = cube.where(F.col("cx").between(x0, x1 - 1) & F.col("cy").between(y0, y1 - 1))
    return cube


def calibrate(cube: DataFrame, gain: float, offset: float) -> DataFrame:
    return tiles.local(cube, lambda v: v * gain + offset) if tiles.tiled(cube) else cube.withColumn("v", F.col("v") * gain + offset)


def constant(cube: DataFrame, name: str, c: float) -> DataFrame:
    """add_num, subtract_num, multiply_num or divide_num."""
    if tiles.tiled(cube):
        return tiles.local(cube, lambda v: cellmath.CONSTANT[name](v, c))
    return cube.withColumn("v", cellmath.CONSTANT[name](F.col("v"), c))


def combine(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """add, subtract, multiply or divide cells of the same product, time and band."""
    if tiles.tiled(a):
        return tiles.combine(a.select(*TILE_KEY, "cells"), b, cellmath.BINARY[name], TILE_KEY)
    w = b.select(*KEY, F.col("v").alias("w"))
    return a.select(*KEY, "v").join(w, KEY).select(*KEY, cellmath.BINARY[name](F.col("v"), F.col("w")).alias("v"))


def normalized_difference(cube: DataFrame, band1: str, platform1: str, band2: str, platform2: str) -> DataFrame:
    """(a - b) / (a + b) of the means over time of two (band, platform) pairs, as band NDVI."""
    if tiles.tiled(cube):
        one, two = (tiles.reduced(cube.where((F.col("band") == b) & (F.col("platform") == p)), "mean", ["tx", "ty"], "ts") for b, p in ((band1, platform1), (band2, platform2)))
        got = tiles.combine(one, two, lambda a, b: (a - b) / F.nullif(a + b, F.lit(0.0)), ["tx", "ty"])
        return got.select(F.lit("NDVI").alias("band"), "tx", "ty", "cells")
    is1, is2 = ((F.col("band") == b) & (F.col("platform") == p) for b, p in ((band1, platform1), (band2, platform2)))
    g = cube.where(is1 | is2).groupBy("cx", "cy").agg(F.avg(F.when(is1, F.col("v"))).alias("a"), F.avg(F.when(is2, F.col("v"))).alias("b"))
    return g.where("a is not null and b is not null").select(F.lit("NDVI").alias("band"), "cx", "cy", ((F.col("a") - F.col("b")) / F.nullif(F.col("a") + F.col("b"), F.lit(0.0))).alias("v"))
