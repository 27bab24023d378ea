"""Chunks of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.operators import chunking
from lorespring.plans.registry import query, read


def texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query()
def sliding_window_chunks(spark, sf_dir):
    return chunking.window_chunks(texts(spark, sf_dir), "doc_id")


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.window_chunks(texts(spark, sf_dir), "doc_id", split=chunking.recursive_spans)


@query()
def hierarchical_chunks(spark, sf_dir):
    return chunking.hierarchical_chunks(texts(spark, sf_dir), "doc_id")


@query()
def routed_chunks(spark, sf_dir):
    return chunking.chunks(texts(spark, sf_dir), "doc_id")


@query(r"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT doc_id, count(*) AS lines, count(DISTINCT raw) AS distinct_lines, max(length(raw)) AS longest FROM lines GROUP BY 1""")
def line_statistics(spark, sf_dir):
    lines = texts(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_distinct("raw").alias("distinct_lines"), F.max(F.length("raw")).alias("longest")
    )
