"""A keyword index that is kept: postings, document frequencies and lengths as tables that each batch adds to.

A batch writes a folder of its own in every table and then one row of totals, which makes it count: what a batch that
broke off has left is not read, and is written over by the next. Removals are rows too, and hold for the batches before
them, so that nothing is rewritten. Frequencies and totals are sums of the batches' own; a search reads the postings of
its terms. ``compacted`` folds all batches into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import lexical
from lorespring.operators.steps import exists, written

_TABLES = {
    "texts": "id long, length int",
    "postings": "term string, id long, tf long, length int",
    "frequency": "term string, df long",
    "removed": "id long",
    "marks": "conv_id long, through long",
    "totals": "texts long, words long",
}


@dataclass(frozen=True)
class KeywordIndex:
    """An index in a folder that the driver and all executors share."""

    spark: SparkSession
    path: str
    stemming: bool = False

    def table(self, name: str) -> DataFrame:
        """All batches of a table that count, each row with its batch."""
        schema = f"{_TABLES[name]}, batch int"
        if not exists(self.spark, f"{self.path}/totals"):
            return self.spark.createDataFrame([], schema)
        last = self.last_batch()
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") <= last)

    def last_batch(self) -> int:
        """The number of the last batch that counts; 0 before the first."""
        if not exists(self.spark, f"{self.path}/totals"):
            return 0
        rows = self.spark.read.schema(f"{_TABLES['totals']}, batch int").parquet(f"{self.path}/totals")
        return rows.agg(F.max("batch")).first()[0] or 0

    def live(self, name: str) -> DataFrame:
        """The rows of texts or postings that no later batch has removed."""
        rows, gone = self.table(name), self.table("removed").select("id", F.col("batch").alias("removed_in"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (gone["removed_in"] > rows["batch"]), "left_anti")

    def collection(self) -> DataFrame:
        """One row with the number of texts and their mean length."""
        sums = self.table("totals").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n"), F.sum("words").alias("words"))
        return sums.select("n", (F.col("words") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))

    def frequencies(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, df) of the terms that any text still holds."""
        rows = self.table("frequency") if wanted is None else self.table("frequency").join(wanted, "term", "left_semi")
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def watermarks(self) -> DataFrame:
        """(conv_id, through): the last turn of each conversation that the index has seen."""
        return self.table("marks").groupBy("conv_id").agg(F.max("through").alias("through"))

    def sync(self, texts: DataFrame, removed: DataFrame | None = None, marks: DataFrame | None = None) -> int:
        """Remove the ids in ``removed`` (id), then add the texts (id, text) whose ids the index hasn't got; the number added.

        A removed id may come again in the same batch, which replaces its text. Of an id that repeats in a batch the
        smallest text counts; null ids are left out, a null text is an empty one.
        """
        batch = self.last_batch() + 1
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        read = lambda name: self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}/batch={batch}")
        held, postings = self.live("texts"), self.live("postings")
        gone = held.select("id").limit(0) if removed is None else held.select("id").join(removed, "id", "left_semi").distinct()
        write(gone, "removed")
        gone = read("removed")
        kept = held.join(gone, "id", "left_anti")
        text = F.coalesce(F.col("text"), F.lit("")).alias("text")
        new = texts.where(F.col("id").isNotNull()).select("id", text).groupBy("id").agg(F.min("text").alias("text"))
        new = new.join(kept.select("id"), "id", "left_anti")
        write(new.select("id", F.size(T.words(F.col("text"))).alias("length")), "texts")
        fresh = read("texts")
        write(lexical.postings(new.join(fresh.select("id"), "id", "left_semi"), self.stemming, unique=True).select("term", "id", "tf", "length"), "postings")
        more = read("postings").groupBy("term").agg(F.count("*").alias("df"))
        less = postings.join(gone, "id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
        write(more.unionByName(less), "frequency")
        if marks is not None:
            write(marks.select("conv_id", "through"), "marks")
        lost = held.join(gone, "id", "left_semi").select((-F.lit(1)).alias("n"), (-F.col("length")).alias("words"))
        sums = fresh.select(F.lit(1).alias("n"), F.col("length").alias("words")).unionByName(lost)
        zero = F.lit(0).cast("long")
        write(sums.agg(F.coalesce(F.sum("n"), zero).alias("texts"), F.coalesce(F.sum("words"), zero).alias("words")), "totals")
        return fresh.count()

    def sync_turns(self, turns: DataFrame) -> int:
        """Add the turns (id, conv_id, turn, text) behind each conversation's watermark; the number added."""
        seen = self.watermarks()
        fresh = turns.join(seen, "conv_id", "left").where(F.col("through").isNull() | (F.col("turn") > F.col("through")))
        marks = fresh.groupBy("conv_id").agg(F.max("turn").alias("through"))
        return self.sync(fresh.select("id", "text"), marks=marks)

    def search(self, queries: DataFrame, k: int | None = None, eligible: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank) by BM25, as over all texts that the index holds."""
        asked = written(lexical.asked_terms(queries, self.stemming), "asked-terms")
        wanted = asked.select("term").distinct()
        counts = self.live("postings").join(wanted, "term", "left_semi")
        counts = counts if eligible is None else counts.join(eligible, "id", "left_semi")
        return lexical.scored(counts, self.frequencies(wanted), self.collection(), asked, k)

    def compacted(self, path: str) -> KeywordIndex:
        """The index as one batch in another folder, without what was removed."""
        other = KeywordIndex(self.spark, path, self.stemming)
        whole = {
            "texts": self.live("texts").select("id", "length"),
            "postings": self.live("postings").select("term", "id", "tf", "length"),
            "frequency": self.frequencies(),
            "marks": self.watermarks(),
            "totals": self.table("totals").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")),
        }
        for name, rows in whole.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch=1")
        return other
