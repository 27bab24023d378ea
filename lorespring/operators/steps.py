"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a new folder where it is unset and all of Spark is one local process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        where = tempfile.mkdtemp(prefix="lorespring-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: lineage ends there, and all who read it read the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Rounds:
    """Rows that rounds add to a table: each writes only its own, and all are read together."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count, self.schema = spark, new_folder(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round's rows; these rows."""
        path, self.schema = f"{self.path}/round={self.count}", df.schema
        df.write.parquet(path)
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def rows(self) -> DataFrame:
        """The rows of all rounds."""
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def discard(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Batches to Python hold ``size`` bytes at most, however wide the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release() -> None:
    """Give memory that this worker has freed back to the system: workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
