"""Documents uploaded in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.operators.steps import new_folder, written
from lorespring.plans.registry import query, read
from lorespring.streaming import uploads

PIECE_CHARS = 2000
#: Micro-batches that the pieces arrive in, and bytes of one of their files on average.
BATCHES, FILE_BYTES = 3, 64 << 20


@query("""
WITH d AS (SELECT doc_id, doc_id // 5 AS upload_id, (doc_id % 5)::INTEGER AS file_index, encode(text) AS data, octet_length(encode(text)) AS size,
  sha256(text) AS sha, doc_id % 11 = 5 AS damaged, max(doc_id) OVER (PARTITION BY doc_id // 5) AS last FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, count(*) OVER (PARTITION BY upload_id) AS files, upload_id % 7 = 3 AND doc_id = last AS lost FROM d),
whole AS (SELECT * FROM f WHERE upload_id IN (SELECT upload_id FROM f GROUP BY 1 HAVING count(*) = 5)),
ends AS (SELECT upload_id, bool_or(lost) AS lost, count(*) FILTER (WHERE NOT damaged) AS good, coalesce(sum(size), 0)::BIGINT AS size FROM whole GROUP BY 1)
SELECT upload_id, file_index, CASE WHEN damaged THEN 'REJECTED' ELSE 'ACCEPTED' END AS status, CASE WHEN damaged THEN 'CHECKSUM_MISMATCH' END AS code,
  size, CASE WHEN NOT damaged THEN sha END AS sha256 FROM whole WHERE NOT lost
UNION ALL SELECT upload_id, NULL, CASE WHEN lost THEN 'FAILED' WHEN good = 5 THEN 'COMPLETED' WHEN good > 0 THEN 'PARTIAL' ELSE 'FAILED' END,
  CASE WHEN lost THEN 'INCOMPLETE' END, size, NULL FROM ends""")
def uploads_in_pieces(spark, sf_dir):
    """Five documents an upload, in shuffled and repeated pieces; some are damaged, and some uploads lose a piece for good."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.expr("doc_id div 5").alias("upload_id"), (F.col("doc_id") % 5).cast("int").alias("file_index"), "text"
    )
    last_chunk = F.greatest(F.expr(f"(length(text) - 1) div {PIECE_CHARS}"), F.lit(0)).cast("int")
    copies = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    # A piece's number counts those of the files before it and the header; of a file there are a start, chunks and an end.
    sizes = [F.max(F.when(F.col("file_index") == j, last_chunk + 3)) for j in range(4)]
    before = F.array(*[sum(sizes[:i], F.lit(1)) for i in range(5)])
    whole = docs.groupBy("upload_id").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("last"), before.alias("before"), F.sum(F.octet_length("text") * copies).alias("sent")
    )
    whole = written(whole.where("n = 5").drop("n"), "whole-uploads")
    chunks = F.transform(
        F.sequence(F.lit(0), last_chunk),
        lambda i: F.encode(F.substring(F.col("text"), (i * PIECE_CHARS + 1).cast("int"), F.lit(PIECE_CHARS)), "utf-8"),
    )
    none, no_name = F.lit(None).cast("binary"), F.lit(None).cast("string")
    sha = F.when(F.col("doc_id") % 11 == 5, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    part = lambda kind, name, data, told: F.struct(F.lit(kind).alias("kind"), name.alias("name"), data.alias("data"), told.alias("sha256"))
    name = F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))
    parts = F.concat(
        F.array(part("start", name, none, no_name)), F.transform(chunks, lambda c: part("chunk", no_name, c, no_name)), F.array(part("end", no_name, none, sha))
    )
    docs = docs.join(whole, "upload_id").withColumn("before", F.element_at("before", F.col("file_index") + 1))
    laid = docs.select("upload_id", "doc_id", "last", "file_index", "before", F.posexplode(parts).alias("at", "p"))
    clock = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    pieces = laid.select(
        "upload_id", "doc_id", "last", (F.col("before") + F.col("at")).cast("int").alias("seq"), "p.kind", "file_index", "p.name", "p.data", "p.sha256",
        clock(F.col("upload_id") % 60).alias("at"),
    )
    lost = (F.col("upload_id") % 7 == 3) & (F.col("doc_id") == F.col("last")) & (F.col("kind") == "start")
    pieces = pieces.where(~lost).withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("doc_id", "last", "copy")
    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    headers = whole.select(
        "upload_id", F.lit(0).alias("seq"), F.lit("header").alias("kind"), F.lit(5).alias("file_index"), empty("name", "string"), empty("data", "binary"),
        empty("sha256", "string"), clock(F.col("upload_id") % 60).alias("at"),
    )
    source = new_folder(spark, "pieces")
    sent = whole.agg(F.sum("sent")).first()[0] or 0
    files = max(1, -(-sent // (BATCHES * FILE_BYTES)))
    pieces.unionByName(headers).repartition(BATCHES * files, "upload_id", "seq").write.parquet(source)
    target, checkpoint = new_folder(spark, "uploads"), new_folder(spark, "uploads-state")
    uploads.assemble_files(spark, source, target, checkpoint, files_a_batch=files)
    # Time goes on: more than an hour after their last pieces, unfinished uploads are given up.
    others = [c for c in headers.columns if c not in ("upload_id", "at")]
    later = headers.limit(1).select(F.lit(-1).cast("long").alias("upload_id"), *others, clock(F.lit(90_000)).alias("at"))
    later.write.mode("append").parquet(source)
    uploads.assemble_files(spark, source, target, checkpoint)
    return spark.read.schema(uploads.RESULT).parquet(target).drop("name", "content")
