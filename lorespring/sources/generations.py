"""Immutable generations of a table behind a pointer, and an append-only provenance log, in any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def publish(df: DataFrame, root: str) -> int:
    """Write the next generation with its manifest, and only then point to it; the one before stays."""
    spark = df.sparkSession
    number = (current(spark, root) or 0) + 1
    folder = f"{root}/gen-{number:06d}"
    df.write.mode("overwrite").parquet(folder)
    stored = spark.read.parquet(folder)
    manifest = {"rows": stored.count(), "columns": stored.columns}
    _write(spark, f"{root}/gen-{number:06d}.json", json.dumps(manifest))
    _write(spark, f"{root}/CURRENT", str(number))
    return number


def current(spark: SparkSession, root: str) -> int | None:
    text = _read(spark, f"{root}/CURRENT")
    return int(text) if text and text.strip().isdigit() else None


def open_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest generation that agrees with its manifest, going back from the pointer."""
    number = current(spark, root) or 0
    while number > 0:
        manifest = _read(spark, f"{root}/gen-{number:06d}.json")
        if manifest:
            try:
                stored = spark.read.parquet(f"{root}/gen-{number:06d}")
                told = json.loads(manifest)
                if stored.columns == told["columns"] and stored.count() == told["rows"]:
                    return stored
            except Exception:  # noqa: BLE001 - a damaged generation is passed over
                pass
        number -= 1
    return None


def record(entries: DataFrame, path: str) -> None:
    """Append provenance rows as JSON lines with one time stamp."""
    entries.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def acquired_bytes(spark: SparkSession, path: str, origin: str) -> int:
    """What an origin has brought in so far."""
    log = spark.read.schema("url string, origin string, bytes long").json(path)
    return log.where(F.col("origin") == origin).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
