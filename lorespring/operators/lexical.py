"""Postings and BM25 over any text column, with or without stemming."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lorespring.functions import text as T
from lorespring.operators.steps import bounded_batches, written
from lorespring.operators.vectors import ranked

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Postings met by terms that one task scores, on average; terms asked for that are broadcast.
TASK_HITS, BROADCAST_TERMS = 1_000_000, 1_000_000
VOWELS = "aeiou"
# The suffix tables of Porter's algorithm, longest first within what can match together.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in VOWELS and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(stem: str) -> int:
    kinds = _consonants(stem)
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _short_end(word: str) -> bool:
    kinds = _consonants(word)
    return len(word) > 2 and kinds[-3:] == [True, False, True] and word[-1] not in "wxy"


def _swap(word: str, pairs: Sequence[tuple[str, str]]) -> str:
    for old, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3:
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: -len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            if word.endswith(old) and not all(_consonants(word[: -len(old)])):
                word = word[: -len(old)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and not all(_consonants(word[:-1])):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for old in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(old):
            base = word[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stemmed(lists: pd.Series) -> pd.Series:
    """Words without diacritics, stemmed."""

    @lru_cache(maxsize=100_000)
    def one(word: str) -> str:
        plain = unicodedata.normalize("NFD", word)
        return stem("".join(c for c in plain if not unicodedata.combining(c)))

    return lists.map(lambda ws: [one(w) for w in ws] if ws is not None else None)


def tokens(df: DataFrame, stemming: bool = False) -> DataFrame:
    """(id, term) for every word of (id, text), repeats included."""
    found = F.transform(T.words(F.col("text")), F.lower)
    return df.select("id", F.explode(stemmed(found) if stemming else found).alias("term"))


def counted(words: Column) -> Column:
    """(term, tf) of each distinct word of a list, from its runs in order; no table of words is held."""
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        tf = lambda at, s, j: (F.coalesce(F.get(at, j + 1), F.size(w)) - s).cast("long")
        return let(starts, lambda at: F.transform(at, lambda s, j: F.struct(F.get(w, s).alias("term"), tf(at, s, j).alias("tf"))))

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs))


def postings(
    df: DataFrame, stemming: bool = False, wanted: DataFrame | None = None, carried: Sequence[str] = (), unique: bool = False
) -> DataFrame:
    """(term, id, tf, length) and the ``carried`` columns, for the terms of (id, text), or the ``wanted`` ones (term) only.

    Words are counted text by text where they are scanned, so a task's memory is that of a text. Only the postings of
    ids that several rows have are added up in a shuffle; ``unique`` says that there are none.
    """
    if stemming:
        bounded_batches(df.sparkSession, 4 << 20)
    found = F.transform(T.words(F.coalesce(F.col("text"), F.lit(""))), F.lower)

    def each(rows: DataFrame) -> DataFrame:
        sized = rows.select("id", *carried, (stemmed(found) if stemming else found).alias("words"))
        sized = sized.select("id", *carried, F.size("words").alias("length"), F.explode(counted(F.col("words"))).alias("of"))
        out = sized.select("of.term", "id", "of.tf", "length", *carried)
        return out if wanted is None else out.join(wanted, "term", "left_semi")

    twice = None if unique else df.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("same"))
    if twice is None or twice.isEmpty():
        return each(df)
    repeated = F.col("id").eqNullSafe(F.col("same"))
    firsts = [F.first(c).alias(c) for c in ("length", *carried)]
    summed = each(df.join(twice, repeated, "left_semi")).groupBy("term", "id").agg(F.sum("tf").alias("tf"), *firsts)
    return each(df.join(twice, repeated, "left_anti")).unionByName(summed)


def collection(df: DataFrame) -> DataFrame:
    """One row: n, the number of texts, and mean, that of their lengths in words, which stemming leaves as they are."""
    found = T.words(F.coalesce(F.col("text"), F.lit("")))
    return df.select(F.size(found).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def asked_terms(queries: DataFrame, stemming: bool = False, carried: Sequence[str] = (), most: int | None = T.MAX_TERMS) -> DataFrame:
    """(query_id, term) and the ``carried`` columns for the first ``most`` searchable terms of (query_id, text), or all if None."""
    asked = queries.select("query_id", *carried, F.explode(T.lexical_terms(F.col("text"), most)).alias("term"))
    if stemming:
        asked = asked.select("query_id", *carried, F.explode(stemmed(F.array("term"))).alias("term"))
    return asked.distinct()


def scored(
    counts: DataFrame, frequency: DataFrame, stats: DataFrame, asked: DataFrame, k: int | None, within: str | None = None, admits: Column | None = None
) -> DataFrame:
    """(query_id, id, score, rank) by BM25 from postings, document frequencies (term, df), (n, mean) of all texts, and terms asked for.

    ``within`` names a column of postings and terms that must be equal, which the join is on; ``admits`` is a condition
    on the columns that they carry. Neither changes the statistics. A lower score is better; ties rank by id. Postings
    are dealt by id, to so many tasks that each meets a bounded number of the terms that are broadcast; scores are summed
    there, and of each query only a task's best k go on.
    """
    on = ["term", within] if within else ["term"]
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = frequency.join(F.broadcast(stats)).select("term", "mean", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf"))
    asked = written(asked.join(weighed, "term"), "weighed-terms")
    held = counts.groupBy(*on).agg(F.count("*").alias("df")) if within else frequency
    met = asked.groupBy(*on).agg(F.count("*").alias("asking")).join(held, on).agg(F.sum(F.col("df") * F.col("asking")).alias("hits"), F.sum("asking").alias("asked"))
    told = met.first()
    tasks = -(-(told.hits or 0) // TASK_HITS)
    counts = counts.repartition(tasks, "id") if tasks > 1 else counts.repartition("id")
    hits = counts.join(F.broadcast(asked) if (told.asked or 0) <= BROADCAST_TERMS else asked, on)
    hits = hits if admits is None else hits.where(admits)
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    summed = hits.groupBy("query_id", "id").agg((-F.sum(part)).alias("score"))
    return ranked(summed.withColumn("score", F.round("score", 9)), ["query_id"], F.asc("score"), F.asc("id"), limit=k)


def bm25(
    df: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    stemming: bool = False,
    within: str | None = None,
    admits: Column | None = None,
    query_columns: Sequence[str] = (),
    row_columns: Sequence[str] = (),
    eligible: DataFrame | None = None,
    most: int | None = T.MAX_TERMS,
) -> DataFrame:
    """(query_id, id, score, rank) of the texts (id, text) that hold any term of the queries (query_id, text).

    A lower score is better; scores with ties rank by id. ``within`` and ``admits`` restrict what a query may find, from
    columns that both sides bring along, and ``eligible`` (id) what any may: these have no part in the statistics, which
    are those of all texts, and what is not admitted takes no place among the k. A query's first ``most`` terms are
    searched for, or all if None.
    """
    scope = [within] if within else []
    asked = written(asked_terms(queries, stemming, list(dict.fromkeys([*scope, *query_columns])), most), "asked-terms")
    wanted = asked.select("term").distinct()
    counts = written(postings(df, stemming, wanted, list(dict.fromkeys([*scope, *row_columns]))), "postings")
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    if eligible is not None:
        counts = counts.join(eligible, "id", "left_semi")
    return scored(counts, frequency, collection(df), asked, k, within, admits)
