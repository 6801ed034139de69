"""Cutting the lineage of iterated plans by reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local one is made only in local mode, where one machine holds everything; a cluster without the setting raises."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandloom-checkpoint-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder; Spark deletes it with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results by the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
