"""Tables and paths in the folder that all machines of the cluster share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local master, as in tests; a
    cluster needs the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="work-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: lineage ends there, and lost executors cost nothing that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by written(), once no lazy result reads it any more."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rpartition("/")[0])


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def drop_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
