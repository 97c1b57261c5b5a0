"""All registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from . import fixtures, q_feature, q_raster, q_stats, q_terrain  # noqa: F401  (they register their queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the nation box they lie in, reduced and ranked: scan, spatial join, aggregate, sort."""
    pairs = spatial.points_in_boxes(fixtures.pts(spark, d), fixtures.boxes(spark, d), 36.0)
    got = spatial.reduce(pairs, F.col("b.id"), [("v", "count"), ("v", "mean"), ("v", "max")], F.col("p.id"), "p")
    return got.select("id", "v_count", F.round("v_mean", 6).alias("v_mean"), "v_max").orderBy(F.desc("v_count"), "id")


fixtures.add("flagship", flagship, "SELECT b.id, count(v) AS v_count, round(avg(v), 6) AS v_mean, max(v) AS v_max FROM pts JOIN boxes b ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY 1")


def queries() -> dict:
    return dict(fixtures.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(fixtures.ORACLES)
