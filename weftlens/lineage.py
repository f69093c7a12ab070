"""Tables cut from their lineage in the folder that a cluster shares, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many bytes on disk are sent whole to every executor.
SMALL_TABLE = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of this machine in local mode, elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/weftlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(table: DataFrame) -> DataFrame:
    """A written table for the smaller side of a join: broadcast if its files hold at most SMALL_TABLE bytes, else as it is."""
    held = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if held <= SMALL_TABLE else table


def spread(df: DataFrame, *columns: str, least: int = 1) -> DataFrame:
    """df over all shuffle partitions (`least` or more; equal `columns` together), in front of work that costs more than its bytes tell: unlike other exchanges, this one isn't merged into few tasks."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), with the smallest node reachable as root.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones, until all hang on a
    root; the number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        state = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if state.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = written(small.toDF("u", "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
