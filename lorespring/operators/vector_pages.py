"""Labels with their vectors, page after page, from where the last run stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespring.operators.steps import discard, exists, written
from lorespring.operators.tables import numbered

PAGE = 100_000
#: Labels that are looked up together, a page at least: small pages share the jobs that read them.
TOGETHER = 1_000_000
_STATE = "through long, n_kept long, n_missing long, page int"


@dataclass(frozen=True)
class VectorPages:
    """A reader of (label, vector_id) and (vector_id, vector) whose watermark lies in a folder.

    A page is the next labels in order; those without a stored vector are left out and counted, and the watermark
    passes them all the same, so they are not looked for again. Pages are looked up a run of about ``TOGETHER`` labels
    at a time. Their rows are written first and their state last, each run in a folder named by its first page: pages
    without a state don't count, and are looked up again by a run of their own.
    """

    spark: SparkSession
    path: str
    size: int = PAGE

    def _states(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/state"):
            return self.spark.createDataFrame([], f"{_STATE}, run int")
        return self.spark.read.schema(f"{_STATE}, run int").parquet(f"{self.path}/state")

    def state(self) -> DataFrame:
        """A row for each page that is done: through (its last label), n_kept and n_missing."""
        return self._states().drop("run")

    def rows(self, schema: str = "label long, vector_id long, vector array<float>") -> DataFrame:
        """The rows of all pages that are done."""
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], f"{schema}, page int")
        held = self.spark.read.schema(f"{schema}, stored boolean, page int, run int").parquet(f"{self.path}/rows").where("stored")
        return held.join(F.broadcast(self._states().select("run", "page")), ["run", "page"], "left_semi").drop("run", "stored")

    def pending(self, labels: DataFrame) -> int:
        """How many labels lie behind the watermark."""
        through = self.state().agg(F.max("through")).first()[0]
        return (labels if through is None else labels.where(F.col("label") > through)).count()

    def read(self, labels: DataFrame, vectors: DataFrame, most: int | None = None, each: Callable[[int], None] | None = None) -> int:
        """Read up to ``most`` pages, or all; ``each`` is called with a page's number before its state is written."""
        done = self.state().agg(F.max("page"), F.max("through")).first()
        page, through, n = (done[0] or 0), done[1], 0
        rest = labels if through is None else labels.where(F.col("label") > through)
        if most is not None and most * self.size <= PAGE:
            rest = rest.orderBy("label").limit(most * self.size)
        ordered = written(numbered(rest.select("label", "vector_id"), "place", "label"), "page-order")
        pages = -(-ordered.count() // self.size)
        pages = pages if most is None else min(pages, most)
        step = max(1, TOGETHER // self.size)
        while n < pages:
            run, last = page + n + 1, page + min(n + step, pages)
            part = ordered.where((F.col("place") > n * self.size) & (F.col("place") <= (last - page) * self.size))
            part = part.withColumn("page", (F.expr(f"(place - 1) div {self.size}") + (page + 1)).cast("int")).drop("place")
            both = part.join(vectors.withColumn("stored", F.lit(True)), "vector_id", "left")
            path = f"{self.path}/rows/run={run}"
            both.select("label", "vector_id", "vector", F.coalesce("stored", F.lit(False)).alias("stored"), "page").write.mode("overwrite").parquet(path)
            looked = self.spark.read.schema("label long, stored boolean, page int").parquet(path)
            sums = looked.groupBy("page").agg(F.max("label").alias("through"), F.count_if("stored").alias("n_kept"), F.count_if(~F.col("stored")).alias("n_missing"))
            sums = sums.where("through is not null").select("through", "n_kept", "n_missing", "page")
            try:
                for n in range(run - page, last - page + 1):
                    if each:
                        each(page + n)
            except BaseException:
                last = page + n - 1
                raise
            finally:
                if last >= run:
                    sums.where(F.col("page") <= last).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/run={run}")
        discard(ordered)
        return n
