"""Coverage collections: one tile table (cov_id, band, tx, ty, cells) or cell table (cov_id, band, cx, cy, v) for all images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

KEY = ["band", "cx", "cy"]


def merge_coverages(coverages: list[DataFrame], names: list[str]) -> DataFrame:
    """One collection of named coverages."""
    if len(coverages) != len(names):
        raise ValueError("coverages and names differ in number")
    parts = [c.select(F.lit(n).alias("cov_id"), *([*tiles.KEY, "cells"] if tiles.tiled(c) else [*KEY, "v"])) for c, n in zip(coverages, names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Reducers skip NoData. The least of equally frequent values is the mode.


def _reducer(how: str):
    v = F.col("v")
    whole = v.cast("long")
    return {
        "mean": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "sum": lambda: F.sum(v),
        "median": lambda: F.median(v),
        "mode": lambda: F.mode(v, True),
        "or": lambda: F.bit_or(whole).cast("double"),
        "and": lambda: F.bit_and(whole).cast("double"),
        "cat": lambda: F.min_by("v", "cov_id"),
        "count": lambda: F.count(v).cast("double"),
    }[how]()


def reduce(collection: DataFrame, how: str) -> DataFrame:
    """mean, min, max, sum, median, mode, or, and, count, or cat (first by ``cov_id``) of each cell."""
    if tiles.tiled(collection):
        return tiles.reduced(collection, how)
    return collection.where("v is not null").groupBy(*KEY).agg(_reducer(how).alias("v"))


def mosaic(collection: DataFrame, how: str = "mean", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One raster of all images, cut to a window (cx and cy from, cx and cy below)."""
    if window:
        x0, y0, x1, y1 = window
        if tiles.tiled(collection):
            return reduce(tiles.cut_box(collection, x0, y0, x1, y1), how)
        collection = collection.where((F.col("cx") >= x0) & (F.col("cx") < x1) & (F.col("cy") >= y0) & (F.col("cy") < y1))
    return reduce(collection, how)


# --- catalog: one row an image (cov_id, product, sensor, time, crs, cloud, xmin, ymin, xmax, ymax) ---


def equals(field: str, value):
    return lambda df: df.where(F.col(field) == F.lit(value))


def date(start: str | None = None, end: str | None = None, field: str = "time"):
    def f(df: DataFrame) -> DataFrame:
        df = df.where(F.col(field) >= F.lit(start).cast("timestamp")) if start else df
        return df.where(F.col(field) <= F.lit(end).cast("timestamp")) if end else df

    return f


def bounds(xmin: float, ymin: float, xmax: float, ymax: float):
    return lambda df: df.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))


def cloud(low: float = 0, high: float = 100, field: str = "cloud"):
    return lambda df: df.where(F.col(field).between(low, high))


def ids(values: list, field: str = "cov_id"):
    return lambda df: df.where(F.col(field).isin(values))


def all_of(*filters):
    """A filter that applies others in order."""

    def f(df: DataFrame) -> DataFrame:
        for g in filters:
            df = g(df)
        return df

    return f


def load(catalog: DataFrame, cells: DataFrame, *filters) -> DataFrame:
    """Cells of the images that pass all catalog filters; the catalog is filtered first."""
    return cells.join(all_of(*filters)(catalog).select("cov_id"), "cov_id", "left_semi")
