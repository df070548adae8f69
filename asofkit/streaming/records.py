"""A write-once table of records that a stream fills: an epoch that is delivered again writes nothing, and a clash stops the stream.

<path>/data/epoch=N holds an epoch's new records, <path>/commits/N says that they are whole. Rows of an epoch without its commit are not read; the next attempt
at that epoch writes over them. A commit carries how many records the epoch had and a digest of them that does not depend on their order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import appended


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _commit_of(spark: SparkSession, path: str, epoch: int) -> dict | None:
    files, at = _file_system(spark, f"{path}/commits/{epoch}")
    if not files.exists(at):
        return None
    source = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _committed(spark: SparkSession, path: str, epoch: int, content: dict) -> None:
    """Write the commit beside and rename it, so that there is a whole one or none."""
    files, beside = _file_system(spark, f"{path}/commits/.{epoch}")
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not files.rename(beside, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{epoch}")):
        raise RuntimeError(f"epoch {epoch} was committed by another writer")


def records(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of all committed epochs, with the epoch that wrote each."""
    whole = {n for n in _names(spark, f"{path}/commits") if not n.startswith(".")}
    found = [n.removeprefix("epoch=") for n in _names(spark, f"{path}/data") if n.startswith("epoch=")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "epoch"]
    if not set(found) & whole:
        return spark.createDataFrame([], ", ".join([*fields, "epoch bigint"]))
    stored = spark.read.schema(", ".join([*fields, "epoch bigint"])).option("basePath", f"{path}/data").parquet(f"{path}/data")
    open_epochs = [int(n) for n in found if n not in whole]  # failed attempts: one at most for each writer
    return stored.where(~F.col("epoch").isin(open_epochs)) if open_epochs else stored


def commit(batch: DataFrame, epoch: int, path: str) -> dict:
    """Append an epoch of records (record_id, payload and further columns) to the table; what its commit says, with `replayed`.

    Records that the table has are not written again. Two payloads of one record_id, in the batch or between batch and table, are an error, and so is an epoch
    that comes again with other records; then nothing is committed. Nulls: a record without an id or payload is an error."""
    spark = batch.sparkSession
    none = F.raise_error(F.lit("a record without id or payload")).cast("string")
    batch = batch.drop("epoch").withColumn("record_id", F.when(F.col("record_id").isNull() | F.col("payload").isNull(), none).otherwise(F.col("record_id")))
    kept = batch.persist()
    try:
        one = F.xxhash64("record_id", F.sha2("payload", 256))
        each = kept.select(one.alias("h")).distinct()
        seen = each.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        digest, before = f"{seen['x']}:{seen['s']}", _commit_of(spark, path, epoch)
        if before is not None:
            if before["digest"] != digest:
                raise ValueError(f"epoch {epoch} came again with other records")
            return before | {"replayed": True}
        stored = records(spark, path, kept.schema).select("record_id", "payload")
        target = f"{path}/data/epoch={epoch}"
        appended(stored, kept).write.mode("overwrite").parquet(target)
        content = {"epoch": epoch, "records": seen["n"], "written": spark.read.schema(kept.schema).parquet(target).count(), "digest": digest}
        _committed(spark, path, epoch, content)
        return content | {"replayed": False}
    finally:
        kept.unpersist()


def sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stream's records into the table, each epoch by `commit`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: commit(batch, epoch, path) and None)
