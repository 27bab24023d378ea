"""Splitting texts into chunks with offsets and deterministic ids.

The window rule depends on where each window before it ended, so it runs as a small Python helper inside an Arrow map;
lines, headings, paragraphs and ids around it are plain expressions. Offsets are in code points of the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T

SIZE, OVERLAP = 256, 20
# Separators from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
Span = tuple[int, int]


def check_window(size: int, overlap: int) -> None:
    """Raise unless 0 <= overlap < size."""
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be in [0, {size}), not {overlap}")


WORD_START = re.compile(r"\S")


def word_from(text: str, place: int) -> int:
    """The first place from here on that is not white space; the end of the text if there is none."""
    found = WORD_START.search(text, place)
    return found.start() if found else len(text)


def last_blank(text: str, low: int, high: int) -> int | None:
    """The last white space after ``low`` and before ``high``."""
    part = text[low + 1 : high]
    if part[-1:].isspace():
        return high - 1
    tail = len(part.rsplit(None, 1)[-1]) if part else 0
    return high - tail - 1 if tail < len(part) else None


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Span]:
    """Windows of at most ``size`` characters that begin at a word and end before white space where they can.

    The next one begins ``overlap`` characters before the end, but later than the one before.
    """
    spans = []
    begin = word_from(text, 0)
    while begin + size < len(text):
        stop = last_blank(text, begin, begin + size) or begin + size
        spans.append((begin, stop))
        begin = word_from(text, max(stop - overlap, begin + 1))
    return spans + [(begin, len(text))] * (begin < len(text))


def _fitted(text: str, low: int, high: int, size: int, marks: Sequence[str]) -> Iterator[Span]:
    """The stretch from ``low`` to ``high`` in spans of at most ``size``, ended behind the coarsest mark that it holds."""
    if high - low <= size:
        yield low, high
        return
    for finer, mark in enumerate(marks, 1):
        ends = [m.end() for m in re.compile(re.escape(mark)).finditer(text, low, high)]
        if ends:
            break
    else:
        yield from ((low + a, low + b) for a, b in windows(text[low:high], size, 0))
        return
    ends += [high] * (ends[-1] < high)
    while low < high:
        first = bisect_right(ends, low)
        reach = bisect_right(ends, low + size) - 1
        if reach >= first:
            yield low, ends[reach]
            low = ends[reach]
        else:
            yield from _fitted(text, low, ends[first], size, marks[finer:])
            low = ends[first]


def recursive_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[Span]:
    """Spans that end at separators, the coarsest first; each reaches back over the one before as far as sizes allow."""
    plain = [(a, b) for a, b in _fitted(text, 0, len(text), size, separators) if not text[a:b].isspace() and a < b]
    reach = [0] + [min(overlap, size - (b - a), a - before) for (before, _), (a, b) in zip(plain, plain[1:])]
    return [(a - max(0, r), b) for (a, b), r in zip(plain, reach)]


def _exploded(df: DataFrame, spans: Column) -> DataFrame:
    out = df.select("*", F.posexplode(spans).alias("ordinal", "span"))
    return out.withColumn("start", F.col("span")[0]).withColumn("end", F.col("span")[1]).drop("span")


def spans_udf(split, size: int, overlap: int):
    """A column of spans by one of the splitters."""

    @F.pandas_udf("array<array<int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [list(s) for s in split(t, size, overlap)] if t else [])

    return spans


def window_chunks(df: DataFrame, id_column: str, size: int = SIZE, overlap: int = OVERLAP, split=windows) -> DataFrame:
    """(id, ordinal, start, end, chunk, chunk_id) for (id, text); ids are SHA-256 of parent, ordinal and chunk."""
    check_window(size, overlap)
    cut = _exploded(df.select(id_column, "text"), spans_udf(split, size, overlap)(F.col("text")))
    cut = cut.withColumn("chunk", F.expr("substring(text, start + 1, end - start)")).drop("text")
    return cut.withColumn("chunk_id", T.digest(F.col(id_column), F.col("ordinal"), F.col("chunk")))


def sections(df: DataFrame, id_column: str) -> DataFrame:
    """(id, section, name, start, text): the parts between headings, PREAMBLE before the first, MAIN without any.

    A heading is a line that ``is_heading`` names outside of code fences, or one above an underline of three or more
    ``=`` or ``-``. Section text is stripped, and ``start`` is where it begins; empty sections are left out.
    """
    lines = df.select(id_column, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    order = Window.partitionBy(id_column).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.regexp_like("raw", F.lit(r"^\s*(?:```|~~~)"))
    underline = F.regexp_like("raw", F.lit(r"^(?:={3,}|-{3,})\s*$"))
    lines = lines.withColumn("offset", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)))
    lines = lines.withColumn("fences", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)))
    outside = (F.col("fences") % 2 == 0) & ~fence
    below = F.coalesce(F.lead(underline).over(order), F.lit(False)) & (F.trim("raw") != "")
    lines = lines.withColumn("rule", underline & F.coalesce(F.trim(F.lag("raw").over(order)) != "", F.lit(False)) & outside)
    lines = lines.withColumn("heading", outside & ~F.col("rule") & (T.is_heading(F.col("raw")).isNotNull() | below))
    lines = lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = ~F.col("heading") & ~F.col("rule")
    parts = lines.groupBy(id_column, "section").agg(
        F.max(F.when(F.col("heading"), T.strip_white(F.col("raw")))).alias("name"),
        F.min(F.when(body, F.col("offset"))).alias("begin"),
        F.array_sort(F.collect_list(F.when(body, F.struct("pos", "raw")))).alias("body"),
    )
    parts = parts.withColumn("whole", F.array_join("body.raw", "\n"))
    many = F.max("section").over(Window.partitionBy(id_column)) > 0
    name = F.regexp_replace(F.col("name"), r"^#+\s*|\s*#+$", "")
    parts = parts.withColumn("name", F.when(F.col("section") > 0, name).when(many, "PREAMBLE").otherwise("MAIN"))
    lead = F.length("whole") - F.length(F.regexp_replace("whole", r"(?U)^\s+", ""))
    parts = parts.withColumn("text", T.strip_white(F.col("whole"))).where("text <> ''")
    return parts.select(id_column, "section", "name", (F.col("begin") + lead).cast("int").alias("start"), "text")


def contexts(sections: DataFrame, id_column: str) -> DataFrame:
    """(id, section, name, context, start, text): the paragraphs of sections, at their place in the document."""
    parts = F.split("text", r"(?<=\n)(?=[^\S\n]*\n)|(?<=\n)(?=[^\n]*\S)")
    cut = sections.select(id_column, "section", "name", F.col("start").alias("base"), F.posexplode(parts).alias("line", "raw"))
    order = Window.partitionBy(id_column, "section").orderBy("line")
    cut = cut.withColumn("at", F.coalesce(F.sum(F.length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blank = T.strip_white(F.col("raw")) == ""
    cut = cut.withColumn("context", F.sum(blank.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.where(~blank).groupBy(id_column, "section", "name", "base", "context").agg(
        F.min("at").alias("at"), F.array_join(F.array_sort(F.collect_list(F.struct("line", "raw")))["raw"], "").alias("raw")
    )
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    place = F.row_number().over(Window.partitionBy(id_column, "section").orderBy("at")) - 1
    start = (F.col("base") + F.col("at") + lead).cast("int")
    return cut.select(id_column, "section", "name", place.alias("context"), start.alias("start"), T.strip_white(F.col("raw")).alias("text"))


def hierarchical_chunks(df: DataFrame, id_column: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of the paragraphs of the sections: id, section, name, context, ordinal, start, end, chunk."""
    check_window(size, overlap)
    parts = contexts(sections(df, id_column), id_column).withColumnRenamed("start", "base")
    cut = _exploded(parts, spans_udf(windows, size, overlap)(F.col("text")))
    cut = cut.withColumn("chunk", F.expr("substring(text, start + 1, end - start)"))
    return cut.select(
        id_column, "section", "name", "context", "ordinal",
        (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "chunk",
    )


def chunks(df: DataFrame, id_column: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Hierarchical chunks of texts with a heading, recursive ones of the others: id, kind, start, end, chunk."""
    parts = sections(df, id_column)
    titled = parts.groupBy(id_column).agg(F.max("section").alias("last")).where("last > 0").select(id_column)
    one = hierarchical_chunks(df.join(titled, id_column, "left_semi"), id_column, size, overlap)
    two = window_chunks(df.join(titled, id_column, "left_anti"), id_column, size, overlap, recursive_spans)
    names = [id_column, "start", "end", "chunk"]
    return one.select(*names, F.lit("hierarchical").alias("kind")).unionByName(
        two.select(*names, F.lit("recursive").alias("kind"))
    )
