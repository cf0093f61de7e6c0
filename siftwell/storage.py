"""Staging of intermediate tables in the cluster's shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-"))
    return context.getCheckpointDir()


def release(df: DataFrame) -> None:
    """Delete the staged tables that `df` reads; neither it nor what was derived from it can be read afterwards."""
    context = df.sparkSession.sparkContext
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[2].startswith("siftwell-"):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` once as Parquet and go on from the written table.

    Unlike a cache it survives the loss of executors, and unlike an RDD checkpoint it is columnar:
    later passes read only the columns they need. `compression` is the session's unless given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
