"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens). A text is looked up by the digest of its content and the
digest of the tokenizer file; only distinct contents that the cache lacks are encoded, and they are appended.

Defined results: a null text counts as an empty one (no bytes, no tokens); texts of any length are encoded whole;
copies share one entry; repeated rows each get their count; an empty table gives an empty result. Only the id and
text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespring.llm.common import in_parts, mapped, shared_dir
from lorespring.llm.word_tokens import encoder, version_of

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache as it is now; an empty one where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs``.

    ``cache_path`` names a cache to use and to extend; without it a new one is made in the shared folder.
    Contents that many rows share are collapsed before the shuffle, so a hot group costs one row a task.
    """
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    version = version_of(tokenizer_path)
    text = F.coalesce(docs["text"], F.lit(""))
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    keyed = docs.select(text.alias("text"), F.sha2(text, 256).alias("digest"))
    misses = keyed.dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in in_parts(batches):
            counts = [enc.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())],
                names=["tokenizer", "digest", "n_tokens"],
            )

    mapped(misses.select("digest", "text"), encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    cache = cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # appenders may race
    sizes = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest")
    )
    return sizes.join(cache, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
