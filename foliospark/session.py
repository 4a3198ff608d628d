"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "foliospark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings every operator here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor can reach, under ``spark.checkpoint.dir``.

    The cluster names the folder. Without the setting only a single machine,
    where all tasks share its disk, gets one below the warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_shared")
    return f"{root.rstrip('/')}/{name}"


def apart(df: DataFrame) -> DataFrame:
    """One side of a join whose sides both grow with the files: the join shuffles them, none goes through the driver.

    Before a plan runs Spark knows a table by its compressed files alone, and
    takes millions of rows of similar names for a few megabytes to broadcast.
    """
    return df.hint("merge")


#: Characters, as text, of a written table that is sent to every task.
SENT = 4_000_000


def measured(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: sent to every task if its rows are short as text, so that the other side stays where it is; else both are shuffled."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= SENT else apart(df)


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, at ``least`` so many, by ``keys``, where a row costs much more than its bytes in a file.

    A scan has a task per so many bytes; long derivations from short rows want
    tasks by rows.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write a shared intermediate once and read it back.

    Several branches of a plan then read one table with known size instead of
    recomputing it, and a lost executor costs no lineage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"cut/{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
