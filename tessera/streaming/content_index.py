"""An index of documents' chunks and vectors that grows by batches and embeds every content once.

Below one folder:

- chunks/batch=B/language=L: a row of every chunk that batch B brought, with its document's version
- vectors: one row of every content (its SHA-256) with its vector

A document's version is (batch, time of its file, file); its newest version is the current one. A batch
writes its own partitions of chunks and replaces them if it runs again, and embeds only contents that
have no vector yet, so a batch that ran halfway and runs again has the same result.

Defined results: a null text has no chunks, and takes the place of the document's earlier text; a null
or empty lang is a partition that Spark names; rows without a doc_id are never replaced; rows that repeat
a doc_id within one file are both current; columns other than those named are left out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, embedding, search

VECTORS = "hash string, embedding array<float>"


class ContentIndex:
    """`model` embeds texts; its requests hold at most max_texts texts and max_tokens tokens."""

    def __init__(
        self, spark: SparkSession, root: str, model: embedding.Model | None = None, chunk_tokens: int = 250, max_texts: int = 256,
        max_tokens: int = 50_000
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.model = model or embedding.hash_model()
        self.chunk_tokens, self.max_texts, self.max_tokens = chunk_tokens, max_texts, max_tokens

    def _table(self, name: str, spark: SparkSession | None = None) -> DataFrame | None:
        try:
            return (spark or self.spark).read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:  # nothing has been written yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def chunked(self, docs: DataFrame) -> DataFrame:
        """Rows of chunks of docs (doc_id, text, lang, file_time, file); seq is null for a document without any."""
        return chunking.text_pieces(docs.select("doc_id", "lang", "file_time", "file", "text"), "text", self.chunk_tokens)

    def take(self, docs: DataFrame, batch: int) -> dict:
        """Add a batch of documents; returns what was read and written."""
        spark = docs.sparkSession
        read, made, fresh = Observation(), Observation(), Observation()
        seen = docs.observe(read, F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
        rows = self.chunked(seen).observe(made, F.count("seq").alias("chunks"))
        writer = rows.withColumns({"batch": F.lit(batch), "language": F.col("lang")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch", "language").parquet(f"{self.root}/chunks")
        mine = self._table("chunks", spark)
        out = {"batch": batch, **read.get, **made.get, "embedded": 0, "failed": 0}
        if mine is None:
            return out
        contents = mine.where((F.col("batch") == batch) & F.col("seq").isNotNull()).select("hash", "content", "tokens")
        path = f"{self.root}/vectors"
        spark.createDataFrame([], VECTORS).write.mode("ignore").parquet(path)  # so that there is a table to look up
        new = embedding.missing(contents, spark.read.schema(VECTORS).parquet(path))
        vectors = embedding.embed_requests(new, self.model, "content", self.max_texts, self.max_tokens, text_tokens=1 << 30, tokens="tokens")
        vectors = vectors.observe(fresh, F.count("embedding").alias("embedded"), F.count("error").alias("failed"))
        vectors.where("embedding is not null").select("hash", "embedding").write.mode("append").parquet(path)
        out |= fresh.get
        if out["failed"]:  # what succeeded is kept, the batch is taken again
            raise RuntimeError(f"batch {batch}: {out['failed']} contents were not embedded")
        return out

    def current(self) -> DataFrame:
        """Chunks of the newest version of each document."""
        chunks = self._table("chunks")
        if chunks is None:
            raise LookupError("nothing has been indexed")
        version = F.struct("batch", "file_time", "file")
        newest = chunks.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max(version).alias("newest"))
        kept = chunks.join(newest, F.col("doc_id") == F.col("of"), "left").where(F.col("newest").isNull() | (version == F.col("newest")))
        return kept.where("seq is not null").drop("of", "newest", "language")

    def vectors(self) -> DataFrame:
        found = self._table("vectors")
        return self.spark.createDataFrame([], VECTORS) if found is None else found

    def rows(self) -> DataFrame:
        """Current chunks with their vectors, as search takes them."""
        return self.current().join(self.vectors(), "hash", "left")

    def search(self, questions: DataFrame, k: int = 10, metric: str = "COSINE") -> DataFrame:
        """query_id, rank, score, hash, uses, and doc_id, seq, lines, keywords and content of the first chunk of each of the k
        contents nearest to a question (query_id, text).

        Contents are searched once each, whatever the number of their chunks. Questions without a vector find nothing."""
        asked = embedding.embed_requests(
            questions.select("query_id", "text"), self.model, "text", self.max_texts, self.max_tokens, text_tokens=1 << 30
        )
        asked = asked.where("embedding is not null").select("query_id", F.col("embedding").alias("query"))
        asked = self.spark.createDataFrame(asked.collect(), asked.schema)  # the model answers once: a set of questions
        current = self.current()
        vectors = self.vectors().join(current.select("hash").distinct(), "hash", "left_semi").withColumnRenamed("hash", "id")
        hits = search.batch_top_k(asked, vectors, k, metric).select("query_id", F.col("id").alias("hash"), "score", "rank")
        found = current.join(F.broadcast(hits.select("hash").distinct()), "hash")  # k contents a question
        first = F.min(F.struct("doc_id", "seq", "start_line", "end_line", "lang", "keywords", "content")).alias("c")
        return hits.join(
            found.groupBy("hash").agg(F.count("*").alias("uses"), first), "hash"
        ).select("query_id", "rank", "score", "hash", "uses", "c.*")

    def unused(self) -> DataFrame:
        """Vectors that no current chunk refers to."""
        return embedding.unused(self.vectors(), self.current())
