"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set as the checkpoint directory; a session on one machine that has neither gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting itself can't be changed in a running session
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="postlark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application's tables are, all of them; a dead application's are found by its id."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read from there: what is used several times isn't computed again, nor after an executor is lost."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete this application's tables, when nothing that reads them is needed any more."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = make(own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
