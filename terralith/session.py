"""Session and lineage helpers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session(app: str = "terralith", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; ``conf`` adds settings."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package's modules to the Python workers, unless they find them by themselves.

    They do where the package is installed, on ``PYTHONPATH`` or in the working directory of
    a local session; else Spark sends a zip of its sources, once a context.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    paths = {str(Path(p or ".").resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in paths or (sc.master.startswith("local") and Path.cwd() == root) or "site-packages" in root.parts or getattr(sc, "_terralith_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="terralith-")) / "terralith_sources.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "terralith").rglob("*.py")):
            z.write(f, f.relative_to(root))
    before = list(sys.path)
    sc.addPyFile(str(name))  # the driver itself keeps its own sources
    sys.path[:] = before
    sc._terralith_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def running(df: DataFrame, *order: str, amount: str | None = None, name: str = "row") -> DataFrame:
    """Adds the running sum of a column in the order of columns (own row included), or each row's number from 1,
    without sorting all rows in one task.

    Rows are partitioned by ranges and sorted within them; a range begins with the sum of the
    ranges before it.
    """
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    one = F.lit(1) if amount is None else F.col(amount)
    sizes = parts.groupBy("__p").agg(F.sum(one).alias("__m"))  # a row a partition
    before = sizes.withColumn("__b", F.coalesce(F.sum("__m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__m")
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = parts.withColumn("__i", F.sum(one).over(w))
    return within.join(before, "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def numbered(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    return running(df, *order, name=name)


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, comp) of vertices of (a, b) edges: the least id of the component; rounds are checkpointed."""
    now, before = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
