"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The first setting lets joins on (clip, f, y, x) reuse a partitioning by
#: (clip, f), so a whole chain of splats, windows and gathers runs after one
#: shuffle. Those chains compute much per byte, so adaptive execution may keep
#: partitions smaller than its usual megabyte while cores are idle. Shuffled
#: pixels take a few bytes each, but sorts, windows and footprints of a frame
#: hundreds, so the advisory size is four megabytes: with the usual 64 a task's
#: memory grew with the input. A frame larger than that still has a task.
RUNTIME = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are planned for."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a private one if unset, on one machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orbframe-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete a query's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    With ``free`` the shuffles that made it leave the disk at once, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, "cut"), spark.conf.get(FREED, None)
    if free:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)
