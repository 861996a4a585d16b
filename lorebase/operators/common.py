"""Small helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a table that a caller calls small is sent to all tasks.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if a bounded count shows it to be small; else as it is, and Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes in fewer partitions, as a small file does; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Spark limits each group before it shuffles."""
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def ordered_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with a the smaller id of the pair."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and with its plan cut: checkpointed in the folder that executors share; on one machine in one of our own where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lorebase-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
    return df.checkpoint()
