"""The folder that the driver and all executors share, and what is written there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a session in one process may name none; it gets a folder in its warehouse.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that isn't there yet."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its plan is cut, a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its plan is cut, so that plans over it stay short.

    Rows of each value of the columns ``by``, which few values must have, lie in a folder of their own.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files that ``stored`` wrote; what reads them must be done."""
    for folder in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        fs, own = files(df.sparkSession, folder)
        fs.delete(own, True)


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path."""
    fs, own = files(spark, path)
    return fs.getContentSummary(own).getLength()
