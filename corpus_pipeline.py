"""The corpus pipeline: documents through five stages, each a DataFrame to a DataFrame.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all
but the last return the columns of documents. run() writes each stage's result to the shared
folder and reads it again as the next one's docs.

1 quality_rules: documents that the base rules or the trees reject go.
2 line_dedup: lines with an earlier equal or near-equal line go from the texts; a document that loses all its words goes.
3 ngram_join: of each class of near-duplicate documents the least doc_id stays.
4 decontamination: documents that hold a window of a benchmark item go.
5 bpe: token counts and digests of the remaining texts.

Defined results: a null or empty text has no words and goes in stage 1; documents without an id are
judged like others and stand for no class; rows that repeat an id or a text are documents of their
own until stage 2, which takes equal lines from all but the first place, and stage 3, which keeps
the rows of the least id of a class; without labels of both classes the base rules alone decide; an
empty table passes every stage as an empty table; other columns are kept to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from tessera.llm.common import staged
from tessera.llm.queries import table, word_bpe_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, word_bpe_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL has no trained trees and no BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
