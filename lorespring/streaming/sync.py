"""Incremental upkeep: what arrives is added once, by sequence watermark, never by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespring.operators import memory, tables


def sync_once(arrived: DataFrame, store: str, keys: list[str]) -> None:
    """Append the rows of a batch whose keys a Parquet store doesn't have.

    Of the store only the files and row groups whose first key may lie between the batch's least and greatest are read.
    """
    spark = arrived.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(store)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        first = F.col(keys[0])
        low, high, nulls = arrived.agg(F.min(first), F.max(first), F.count_if(first.isNull())).first()
        within = F.lit(False) if low is None else first.between(low, high)
        existing = spark.read.schema(arrived.schema).parquet(store).where(within | first.isNull() if nulls else within)
    else:
        existing = spark.createDataFrame([], arrived.schema)
    tables.new_rows(existing, arrived, keys, *(F.asc(k) for k in keys)).write.mode("append").parquet(store)


def sync_stream(source: DataFrame, store: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Run a stream until its source is read, adding each key once; a batch that runs again adds nothing."""
    return (
        source.writeStream.foreachBatch(lambda batch, _: sync_once(batch, store, keys))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def turn_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Turns from Parquet files as they arrive."""
    return spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(folder)


def snapshot_stream(turns: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Running counts of turns and characters per conversation, and whether a snapshot is due."""
    counts = turns.groupBy("conv_id").agg(
        F.count("*").alias("new_turns"), F.floor(F.sum(F.length("text")) / 4).alias("tokens")
    )
    due = (F.col("new_turns") >= memory.SNAPSHOT_TURNS) | (F.col("tokens") >= memory.SNAPSHOT_TOKENS)
    return (
        counts.withColumn("due", due)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
