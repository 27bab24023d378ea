"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the word separators of every operator here: space and \x09-\x0D.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
#: Batches to Python are bounded in rows and bytes, so that neither side holds many long texts at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Spark's setting by which a query deletes its shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a function on texts takes at a time.
PART = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where a filter is pushed below projections."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, separated by ASCII white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WHITE}+"))


def free_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        # Driver and executors are one process of this machine.
        where = tempfile.mkdtemp(prefix="lorespring-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage so that a lost executor costs no more than one step, and fixes rows that later steps
    read more than once. The step's shuffle files are deleted once it is written, not when the driver next collects
    garbage, so that disk holds one step's at a time.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Give memory that this worker has freed back to the system: workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in bounded batches; a worker gives its memory back at the end of a task."""
    for name, value in BATCHES.items():
        df.sparkSession.conf.set(name, value)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def grouped(groups: GroupedData, function: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``applyInPandas``; a worker gives its memory back after each group."""

    def run(key, rows):
        try:
            return function(key, rows)
        finally:
            release()

    return groups.applyInPandas(run, schema)


def cogrouped(
    left: GroupedData, right: GroupedData, function: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str | StructType
) -> DataFrame:
    """``cogroup`` and ``applyInPandas``; a worker gives its memory back after each group."""

    def run(key, rows, others):
        try:
            return function(key, rows, others)
        finally:
            release()

    return left.cogroup(right).applyInPandas(run, schema)


def in_parts(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about ``size`` bytes of the texts in a column; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
