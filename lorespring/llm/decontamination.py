"""Benchmark decontamination: broadcast hashes of test n-grams, verified hits, spans or documents removed.

Ten consecutive words of a benchmark text are a window; a shorter text is one window. The hashes of all windows are a
broadcast set that the windows of the training texts are looked up in, in the task that scans a text, so that only hits
are shuffled. Where there are more distinct windows than ``BROADCAST_WINDOWS``, they are broadcast in as many blocks,
one scan each. Texts with hits are read again: the words at each hit are compared with the windows' own words, so a
clash of hashes removes nothing. Everything is DataFrame functions.

Words are what is left of a text, A-Z lower-cased, between characters of ``BREAKS``: digits, letters and all that is not
ASCII. Defined results: a null or empty text has no words, so it is never hit and hits nothing; texts of any length are
scanned whole; equal rows get equal results, texts of one id are told apart by a 64-bit digest; a null doc_id is an id
of its own; items that repeat count once; a null item_id hits, but is not among the items; empty tables give no hits or
no rows. Only doc_id, text and item_id are read, so other columns may have any names; ``without_passages`` and
``clean_documents`` return all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.llm.common import discard, free_name, let, written

#: Words of a window.
SPAN = 10
#: Distinct windows that are broadcast at a time; 8 bytes each, and about 40 in the table that they are looked up in.
BROADCAST_WINDOWS = 1_000_000
#: Documents with hits up to this number are broadcast to the scan of all documents; more join by shuffle.
BROADCAST_DOCS = 100_000
#: Words of a text that one row holds while hits are verified.
PIECE = 4096
# The characters that separate words, after A-Z are lower-cased and before.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BREAKS_BEFORE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

_TEXT = ["id", "digest"]


def item_words(text: Column) -> Column:
    """The words of a text, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, f"[{BREAKS}]+"), "")


def n_words(text: Column) -> Column:
    """How many words ``item_words`` has."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BREAKS_BEFORE}]+"), "")).cast("long")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(words: Column, span: Column, body) -> Column:
    """``body`` of each ``span`` consecutive words; none where there are fewer."""
    starts = F.sequence(F.lit(1), F.size(words) - span + 1)
    return F.when(F.size(words) >= span, F.transform(starts, lambda i: body(F.slice(words, i, span))))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window_id, span, hash, window), and the items that hold them (window_id, item_id)."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    each = items.select("item_id", span.alias("span"), F.explode(_windows(F.col("words"), span, lambda w: w)).alias("window"))
    each = written(each.distinct(), "item-windows")
    windows = each.select("span", F.xxhash64(_hashes(F.col("window"))).alias("hash"), "window").distinct()
    windows = written(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    holders = written(each.join(windows, "window").select("window_id", "item_id").where("item_id IS NOT NULL").distinct(), "holders")
    discard(each)
    return windows, holders


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Documents by id and digest; the digest tells null ids from others."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(doc_id.isNull(), F.col("text")).alias("digest"), *more
    )


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, digest, span, place, hash) of the words whose hash is a window's; place counts words from 0."""
    spans = sorted(r[0] for r in windows.select("span").distinct().collect())  # SPAN of them at most
    blocks = -(-windows.count() // BROADCAST_WINDOWS)

    def scanned(h: Column) -> Column:
        return F.array(*(F.struct(F.lit(s).alias("span"), _windows(h, F.lit(s), F.xxhash64).alias("hashes")) for s in spans))

    by_span = _keyed(docs, F.explode(let(_hashes(item_words(F.col("text"))), scanned)).alias("of")) if spans else None
    if by_span is None:
        return _keyed(docs.limit(0)).withColumns({"span": F.lit(0), "place": F.lit(0), "hash": F.lit(0).cast("long")})
    # An inner explode would compute the hashes twice, once to test that there are any.
    each = by_span.select(*_TEXT, "of.span", F.posexplode_outer("of.hashes").alias("place", "hash"))
    found = None
    for number in range(blocks):
        block = windows.select("span", "hash") if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == number).select("span", "hash")
        part = each.join(F.broadcast(block.distinct()), ["hash", "span"], "left_semi").select(*_TEXT, "span", "place", "hash")
        found = part if found is None else found.unionByName(part)
    return written(found, "hits")


def _verified(docs: DataFrame, hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, digest, start, end, window_id) of the hits whose words are the window's."""
    by_piece = hits.groupBy(*_TEXT, F.expr(f"place div {PIECE}").cast("int").alias("piece")).agg(
        F.collect_set(F.struct("place", "span")).alias("found")
    )
    by_piece = written(by_piece, "hit-pieces")
    texts = by_piece.select(*_TEXT).distinct()
    n_texts = texts.count()
    texts = F.broadcast(texts) if n_texts <= BROADCAST_DOCS else texts
    held = _keyed(docs, F.col("text")).join(texts, _TEXT, "left_semi").distinct()

    def pieces(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(words) - 1) / PIECE).cast("int"))
        return F.transform(starts, lambda p: F.slice(words, p * PIECE + 1, F.lit(PIECE + SPAN - 1)))

    held = held.select(*_TEXT, F.posexplode(let(item_words(F.col("text")), pieces)).alias("piece", "words"))
    met = held.join(by_piece, [*_TEXT, "piece"])
    places = F.transform(
        "found", lambda x: F.struct(x["place"].alias("start"), F.slice(F.col("words"), x["place"] - F.col("piece") * PIECE + 1, x["span"]).alias("window"))
    )
    each = met.select(*_TEXT, F.explode(places).alias("at")).select(*_TEXT, "at.*")
    few = windows.count() <= BROADCAST_WINDOWS // 10
    own = windows.select("window", "window_id", "span")
    each = each.join(F.broadcast(own) if few else own, "window")
    return written(each.select(*_TEXT, "start", (F.col("start") + F.col("span")).alias("end"), "window_id"), "verified")


def passages(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans of hit words, (id, digest, start, end) with neither overlaps nor gaps of none, and their items (id, digest, item_id)."""
    windows, holders = benchmark_windows(benchmark)
    hits = _hits(docs, windows)
    verified = _verified(docs, hits, windows)
    ends = verified.groupBy(*_TEXT, "start").agg(F.max("end").alias("end"))
    by_text = Window.partitionBy(*_TEXT).orderBy("start")
    reach = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("first", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("first").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = written(runs.groupBy(*_TEXT, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run"), "spans")
    of_text = verified.select(*_TEXT, "window_id").distinct().join(holders, "window_id").select(*_TEXT, "item_id").distinct()
    items = written(of_text, "items")
    for used in (windows, holders, hits, verified):
        discard(used)
    return spans, items


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_DOCS else df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``."""
    spans, items = passages(docs, benchmark)
    hit = spans.groupBy(*_TEXT).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
    listed = items.groupBy(*_TEXT).agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    found = written(hit.join(listed, _TEXT, "left"), "contaminated")
    counted = _keyed(docs, F.col("doc_id"), n_words(F.col("text")).alias("n_words"))
    out = counted.join(_small(found), _TEXT, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def _spans_by_row(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its key and an array of its spans, null where it has none, and the names of these columns."""
    spans, _ = passages(docs, benchmark)
    doc_id, names = F.col("doc_id").cast("long"), [free_name(n, docs) for n in ("id", "digest", "spans")]
    listed = spans.groupBy(*_TEXT).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    listed = written(listed, "text-spans").toDF(*names)
    keyed = docs.withColumns(
        {names[0]: F.coalesce(doc_id, F.lit(0).cast("long")), names[1]: F.xxhash64(doc_id.isNull(), F.col("text"))}
    )
    return keyed.join(_small(listed), names[:2], "left"), *names


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit words, and what separates each from the word before, cut out of the texts."""
    joined, _, _, spans = _spans_by_row(docs, benchmark)
    text, where = F.col("text"), F.col(spans)

    def cut(pieces: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(where, lambda s: s["end"]))
        ends = F.concat(F.transform(where, lambda s: s["start"]), F.array(F.size(pieces)))
        return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(pieces, a + 1, b - a)))

    pieces = F.regexp_extract_all(text, F.lit(f"[{BREAKS_BEFORE}]*[^{BREAKS_BEFORE}]+"), F.lit(0))
    tail = F.regexp_extract(text, f"([{BREAKS_BEFORE}]*)$", 1)
    kept = F.concat(F.array_join(let(pieces, cut), ""), tail)
    return joined.withColumn("text", F.when(where.isNull(), text).otherwise(kept)).select(docs.columns)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    joined, _, _, spans = _spans_by_row(docs, benchmark)
    return joined.where(F.col(spans).isNull()).select(docs.columns)
