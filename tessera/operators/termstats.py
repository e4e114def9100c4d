"""Term statistics of a corpus, kept up by differences: places and documents of every term, without a recount.

Below one folder, each batch is a table of signed differences (term, places, documents) with one row of totals (term
null). A change subtracts what its old text had and adds what the new one has, so a batch costs the texts that changed;
the statistics are the sums over batches, and compaction writes them as one batch. A batch has a number and replaces
itself if it runs again; batches up to the number a compaction has taken are out of force.

Defined results: terms are the words of three letters or more that are no stop words, as the keyword index has them; a
null text has no terms but is a document; rows that repeat a path are documents of their own; terms that no document
holds any more are gone; an empty corpus has totals of 0."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import inverted

SCHEMA = "term string, places bigint, documents bigint, batch bigint"


def counted(texts: DataFrame, sign: int) -> DataFrame:
    """term, places and documents of texts (path, text), times a sign; the row without a term has the documents of all."""
    rows = inverted.term_counts(texts.select(F.col("path").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "text"))
    terms = rows.select("term", (F.col("n") * sign).alias("places"), F.lit(sign).cast("long").alias("documents"))
    totals = texts.select(
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("places"), F.lit(sign).cast("long").alias("documents")
    )
    return terms.unionByName(totals)


class TermStatistics:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        sums = rows.groupBy("term").agg(F.sum("places").alias("places"), F.sum("documents").alias("documents"))
        kept = sums.where("places <> 0 or documents <> 0").withColumn("batch", F.lit(batch).cast("long"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/{name}")

    def compacted(self) -> int:
        """The number of the newest compaction, or -1."""
        found = self._batches("base").agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def apply(self, batch: int, gone: DataFrame | None, fresh: DataFrame | None) -> None:
        """Batch `batch`: texts (path, text) that are no longer, and those that are new. A changed text is in both."""
        if batch <= self.compacted():
            raise ValueError(f"batch {batch} has been compacted")
        parts = [counted(df, sign) for df, sign in ((gone, -1), (fresh, 1)) if df is not None]
        self._put(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "deltas", batch)

    def _sums(self) -> DataFrame:
        last = self.compacted()
        rows = self._batches("base").where(F.col("batch") == last).unionByName(self._batches("deltas").where(F.col("batch") > last))
        return rows.groupBy("term").agg(F.sum("places").alias("places"), F.sum("documents").alias("documents"))

    def totals(self) -> int:
        """Documents of the corpus."""
        return self._sums().where("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]

    def terms(self) -> DataFrame:
        """term, places, documents and idf of every term."""
        found = self._sums().where("term is not null and documents > 0")
        return found.withColumn("idf", F.log(F.lit(self.totals()) / F.col("documents")))

    def compact(self) -> int:
        """Write the sums over all batches as one; earlier ones are out of force. Returns the number of the last batch in it."""
        last = self._batches("deltas").agg(F.max("batch")).first()[0]
        if last is None or last <= self.compacted():
            return self.compacted()
        self._put(self._sums(), "base", last)
        return last
