"""Tables that end a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is named, a folder of our own in local mode, as in tests; an error on a cluster, whose
    executors would each write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="asofkit-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, prefix: str = "asofkit") -> str:
    """A new folder below the shared one, which `released` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it again: lineage ends, lost executors cost nothing."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """What `released` takes as `since`: tables written from now on."""
    return len(_WRITTEN)


def released(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that the operators have written in this process (since a mark); how many. For callers that have used or stored all results, which read them."""
    n = 0
    while len(_WRITTEN) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def forgotten(spark: SparkSession, path: str) -> None:
    """Delete one written table."""
    _WRITTEN.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
