"""Build the keyword index of documents, language by language: terms and scored postings.

    python jobs/keyword_index.py --documents hdfs:///in/documents --output hdfs:///keywords [--languages en,de] [--config FILE]

Reads Parquet documents (doc_id, text, lang). Written below the output, partitioned by language: terms (df, idf)
and postings (term, doc_id, n, score, df), ordered by term, so a search for a term reads few row groups. Named
languages are replaced and others left as they are; without names, all are. A run replaces whole partitions,
so it may be repeated at any time, after a failure too, with the same result.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.operators import inverted
from tessera.plans import logs
from tessera.session import setting

LOG = logs.logger("jobs.keyword_index")
DEFAULTS = json.loads(open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "keyword_index.json")).read())
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
TERMS = "lang string, term string, df bigint, documents bigint, idf double"


def run(spark: SparkSession, documents: str, output: str, languages: list[str] | None = None, config: dict | None = None) -> DataFrame:
    """Write the index of the documents of the named languages (of all, without names), and return the postings
    that the output has then: lang, term, doc_id, n, score, df."""
    c = DEFAULTS | (config or {})
    output, languages = output.rstrip("/"), list(languages or c["languages"])
    docs = spark.read.parquet(documents).select("doc_id", "text", F.nullif("lang", F.lit("")).alias("lang"))
    docs = docs.where(F.col("lang").isin(languages)) if languages else docs
    shape = StructType([
        StructField("lang", StringType()), StructField("term", StringType()), docs.schema["doc_id"], StructField("n", LongType()),
        StructField("score", DoubleType()), StructField("df", LongType())
    ])

    def write(rows: DataFrame, name: str) -> None:
        w = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if languages else "static")
        w.option("maxRecordsPerFile", c["rows_per_file"]).partitionBy("lang").parquet(f"{output}/{name}")
        for gone in sorted(set(languages) - set(kept.get["languages"])):  # named, but without rows now
            spark.createDataFrame([], rows.drop("lang").schema).write.mode("overwrite").parquet(f"{output}/{name}/lang={gone}")

    held = inverted.blocks(docs).persist(StorageLevel.DISK_ONLY)  # texts are read once; a lost executor's part is counted anew
    kept = Observation()  # of the terms, which are fewer than the postings that they count
    try:
        found = inverted.block_terms(docs, held).observe(
            kept, F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.collect_set("lang").alias("languages")
        )
        write(found, "terms")
        known = spark.read.schema(TERMS).parquet(f"{output}/terms")
        known = known.where(F.col("lang").isin(languages)) if languages else known
        with setting(spark, WRITERS, 4):  # rows come in the order of languages: the writer need not sort them again
            write(inverted.block_postings(held, known), "postings")
    finally:
        held.unpersist()
    read = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().asDict()
    LOG.info("ended", extra={"data": {"read": documents, "wrote": output, **read, **kept.get}})
    return table(spark, output, shape)


def table(spark: SparkSession, output: str, shape: StructType) -> DataFrame:
    """The postings; each has its term's df, so reading them joins nothing."""
    return spark.read.schema(shape).parquet(f"{output}/postings").select("lang", "term", "doc_id", "n", "score", "df")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--documents", required=True, help="Parquet files or folder")
    p.add_argument("--output", required=True, help="folder of the index")
    p.add_argument("--languages", default="", help="comma-separated; all, if none is named")
    p.add_argument("--config", help="JSON file; see keyword_index.json")
    a = p.parse_args(arguments)
    logs.set_up(pretty=False)
    spark = SparkSession.builder.appName("keyword_index").getOrCreate()
    try:
        run(spark, a.documents, a.output, [x for x in a.languages.split(",") if x], json.loads(open(a.config).read()) if a.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
