"""Connected components without a driver-side graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A copy of df in the shared checkpoint folder, without lineage.

    The folder is that of ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster has no
    folder that all executors share by default, so there it is an error.
    """
    if not spark.sparkContext.getCheckpointDir():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-checkpoints-"))
    return df.checkpoint(True)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of ``checkpointed``'s result; nothing may read it any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unbroadcast(df: DataFrame) -> DataFrame:
    """df, as a side of a join that grows with the input: sizes that allow a broadcast are those of packed rows, which are several times as
    large in the driver, and each broadcast stays there until it is collected."""
    return df.hint("merge")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is its component's smallest node. edges: a, b.

    Alternating large and small stars, each round checkpointed, until nothing changes; a round doubles what a node can see.
    The checkpoints of a round are deleted once the next one stands.
    """
    e = checkpointed(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while not e.isEmpty():
        # large star: neighbours above me link to the smallest of my neighbours and me
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (a checkpoint of the minima leaves a plain join below, whose hot keys adaptive execution can split: a star's hub has all its edges)
        least = checkpointed(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(unbroadcast(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below me, and I, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unbroadcast(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, e = e, checkpointed(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop_checkpoint(old), drop_checkpoint(least)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
