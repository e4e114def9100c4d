"""Keep a search index of a growing folder of documents: a stream that takes only new files.

    python jobs/index_documents.py --documents 'hdfs:///in/documents*' --output hdfs:///index [--config FILE]

Reads Parquet files of documents (doc_id, text, lang). Every file is taken once, as the checkpoint below the
output says; its texts are cut into chunks within a token budget, with keywords, line numbers and the SHA-256
of their content, and only contents that no earlier file had are embedded. A document that comes again
replaces its earlier chunks. Run again without new files, the job reads nothing and changes nothing; after a
failure, it takes the unfinished batch again, with the same result.

Written below the output: chunks (partitioned by batch and language), vectors, log (what each batch
read and wrote, JSON), checkpoint.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.operators.embedding import Model, hash_model
from tessera.plans import logs
from tessera.streaming.content_index import ContentIndex

LOG = logs.logger("jobs.index_documents")
DEFAULTS = json.loads(open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "index_documents.json")).read())


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None, model: Model | None = None) -> DataFrame:
    """Take the files of `documents` (a folder or a glob) that are new, and return the index as it stands then:
    doc_id, lang, seq, start_line, end_line, tokens, hash, uses (current chunks of that content), used and
    positive (places of the content's vector that are not 0, and that are above it)."""
    c = DEFAULTS | (config or {})
    output = output.rstrip("/")
    index = ContentIndex(spark, output, model or hash_model(c["dims"]), c["chunk_tokens"], c["max_texts"], c["max_tokens"])
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(documents)
    named = files.select("*", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"))

    def take(rows: DataFrame, batch: int) -> None:
        done = index.take(rows, batch)
        LOG.info("batch", extra={"data": {"read": documents, "wrote": output, **done}})
        line = rows.sparkSession.createDataFrame([json.dumps(done)], "string").withColumn("batch", F.lit(batch))
        line.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(f"{output}/log")

    query = named.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info(
        "ended",
        extra={"data": {
            "batches": sum(p["numInputRows"] > 0 for p in query.recentProgress),
            "rows": sum(p["numInputRows"] for p in query.recentProgress)
        }}
    )
    return table(index)


def answer(spark: SparkSession, output: str, questions: str, answers: str, config: dict | None = None, model: Model | None = None) -> DataFrame:
    """Write the ten chunks of the index nearest to each of a table of questions, and return them."""
    c = DEFAULTS | (config or {})
    index = ContentIndex(spark, output, model or hash_model(c["dims"]), c["chunk_tokens"], c["max_texts"], c["max_tokens"])
    seen = Observation()
    found = index.search(spark.read.parquet(questions)).withColumn("language", F.col("lang")).observe(seen, F.count("*").alias("answers"))
    found.write.mode("overwrite").partitionBy("language").parquet(answers)
    LOG.info("answered", extra={"data": {"read": questions, "wrote": answers, **seen.get}})
    return spark.read.schema(found.schema).parquet(answers).drop("language")


def table(index: ContentIndex) -> DataFrame:
    """The index with what its contents' vectors hold."""
    rows = index.current()
    vectors = index.vectors().select(
        "hash", F.size(F.filter("embedding", lambda x: x != 0)).alias("used"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("positive")
    )
    contents = rows.groupBy("hash").agg(F.count("*").alias("uses")).join(vectors, "hash", "left")
    return rows.select("doc_id", "lang", "seq", "start_line", "end_line", "tokens", "hash").join(contents, "hash").select(
        "doc_id", "lang", "seq", "start_line", "end_line", "tokens", "hash", "uses", "used", "positive"
    )


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--documents", required=True, help="folder or glob of Parquet files")
    p.add_argument("--output", required=True, help="folder of the index")
    p.add_argument("--config", help="JSON file; see index_documents.json")
    p.add_argument("--questions", help="Parquet file of questions (query_id, text): their ten best chunks go to --answers")
    p.add_argument("--answers", help="folder for answers, replaced by each run, partitioned by language")
    a = p.parse_args(arguments)
    logs.set_up(pretty=False)
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    config = json.loads(open(a.config).read()) if a.config else None
    try:
        run(spark, a.documents, a.output, config)
        if a.questions and a.answers:
            answer(spark, a.output, a.questions, a.answers, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
