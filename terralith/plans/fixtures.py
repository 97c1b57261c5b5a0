"""Tables that the queries derive from the shared test tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTE = """WITH r AS (SELECT l_returnflag AS band, (l_partkey % 64)::INT AS cx, (l_orderkey % 64)::INT AS cy, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
r2 AS (SELECT l_returnflag AS band, ((l_partkey + l_suppkey) % 64)::INT AS cx, ((l_orderkey + 7) % 64)::INT AS cy, sum(l_linenumber)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3),
coll AS (SELECT l_linestatus AS cov_id, l_returnflag AS band, (l_partkey % 64)::INT AS cx, (l_orderkey % 64)::INT AS cy, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
dem AS (SELECT 'B1' AS band, a.range::INT AS cx, b.range::INT AS cy, ((a.range * 17 + b.range * 31) % 101)::DOUBLE AS v FROM range(64) a, range(64) b),
pts AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS x, CAST((c_custkey * 104729) % 18000 AS DOUBLE) / 100 - 90 AS y, c_acctbal AS v, c_mktsegment AS k FROM customer),
qp AS (SELECT s_suppkey AS id, CAST((s_suppkey * 6007) % 36000 AS DOUBLE) / 100 - 180 AS x, CAST((s_suppkey * 7477) % 18000 AS DOUBLE) / 100 - 90 AS y FROM supplier),
boxes AS (SELECT n_nationkey AS id, n_name AS name, CAST((n_nationkey % 5) * 72 - 180 AS DOUBLE) AS xmin, CAST(n_nationkey - n_nationkey % 5 AS DOUBLE) / 5 * 36 - 90 AS ymin,
    CAST((n_nationkey % 5) * 72 - 108 AS DOUBLE) AS xmax, CAST(n_nationkey - n_nationkey % 5 AS DOUBLE) / 5 * 36 - 54 AS ymax FROM nation) """


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None, cte: bool = True) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = (CTE if cte else "") + sql


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def r1(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("band"), (F.col("l_partkey") % 64).cast("int").alias("cx"), (F.col("l_orderkey") % 64).cast("int").alias("cy")).agg(F.sum("l_quantity").alias("v"))


def r2(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("band"), ((F.col("l_partkey") + F.col("l_suppkey")) % 64).cast("int").alias("cx"), ((F.col("l_orderkey") + 7) % 64).cast("int").alias("cy")).agg(F.sum("l_linenumber").cast("double").alias("v"))


def coll(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    return t.groupBy(F.col("l_linestatus").alias("cov_id"), F.col("l_returnflag").alias("band"), (F.col("l_partkey") % 64).cast("int").alias("cx"), (F.col("l_orderkey") % 64).cast("int").alias("cy")).agg(F.sum("l_quantity").alias("v"))


def dem(s: SparkSession, d: str = "") -> DataFrame:
    a, b = s.range(64).select(F.col("id").alias("a")), s.range(64).select(F.col("id").alias("b"))
    return a.crossJoin(b).select(F.lit("B1").alias("band"), F.col("a").cast("int").alias("cx"), F.col("b").cast("int").alias("cy"), ((F.col("a") * 17 + F.col("b") * 31) % 101).cast("double").alias("v"))


def pts(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(s, d, "customer").select(c.alias("id"), (((c * 7919) % 36000).cast("double") / 100 - 180).alias("x"), (((c * 104729) % 18000).cast("double") / 100 - 90).alias("y"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("k"))


def qp(s: SparkSession, d: str) -> DataFrame:
    c = F.col("s_suppkey")
    return table(s, d, "supplier").select(c.alias("id"), (((c * 6007) % 36000).cast("double") / 100 - 180).alias("x"), (((c * 7477) % 18000).cast("double") / 100 - 90).alias("y"))


def boxes(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = ((n % 5) * 72 - 180).cast("double"), (n - n % 5).cast("double") / 5 * 36 - 90
    return table(s, d, "nation").select(n.alias("id"), F.col("n_name").alias("name"), x.alias("xmin"), y.alias("ymin"), (x + 72).alias("xmax"), (y + 36).alias("ymax"))


TILE = 32  # so that the 64 x 64 test rasters have four tiles a band and halos are exchanged


def tiled(cells: DataFrame) -> DataFrame:
    from ..operators import tiles

    return tiles.to_tiles(cells, TILE)


def as_cells(df: DataFrame) -> DataFrame:
    from ..operators import tiles

    return tiles.cells_of(df)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    df = as_cells(df)
    return df.withColumns({c: F.round(c, places) for c in cols or ("v",)})
