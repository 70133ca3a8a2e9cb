"""Small sides of joins: broadcast only after their size was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a measured side is sent to all executors.
BROADCAST_ROWS = 200_000


def measured(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, as a broadcast local relation if it has at most `limit` rows, else unchanged (a shuffle join follows).

    At most limit + 1 rows reach the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; in a local session without it a new one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a file in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A freshly scanned `df` over at least as many partitions as the session runs tasks at once, for work in Python.

    Only a scan of fewer splits than cores is dealt out anew; larger inputs keep their splits and move nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
