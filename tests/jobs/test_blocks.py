"""The keyword index goes through one shuffle of blocks, with the rows of counts that are joined to their terms."""

import pytest
from pyspark.sql import functions as F

from jobs import keyword_index
from tessera.operators import inverted

WORDS = ("alpha", "beta", "gamma", "delta", "omega", "Straße", "the", "common")


def corpus(spark, n=300):
    """Documents of several languages (one of them null), a word that all hold, empty and null texts, ids that repeat."""
    text = lambda i: None if i % 50 == 7 else "" if i % 50 == 9 else " ".join(["common", *(WORDS[(i * k) % 8] for k in range(i % 6)), f"w{i % 90}x"])
    return spark.createDataFrame([(f"d{i % 280}", text(i), ("en", "de", None)[i % 3]) for i in range(n)], "doc_id string, text string, lang string").repartition(3)


@pytest.mark.parametrize(("most", "long"), [(1_000_000, 64), (40, 3)])
def test_blocks_hold_what_counts_hold(spark, most, long):
    """whatever a task brings together, each posting is there once, and a block has at most so many."""
    docs = corpus(spark)
    held = inverted.blocks(docs, most, long)
    rows = held.select("lang", "term", F.inline(F.arrays_zip("doc_ids", "n", "sizes")))
    want = inverted.term_counts(docs).select("lang", "term", "doc_id", F.col("n").cast("int"), "size")
    assert sorted(rows.collect(), key=str) == sorted(want.collect(), key=str)
    assert held.count() < want.count() and held.agg(F.max(F.size("doc_ids"))).first()[0] <= long
    known = inverted.terms(docs)
    assert sorted(inverted.block_terms(docs, held).collect(), key=str) == sorted(known.collect(), key=str)
    assert inverted.blocks(docs.limit(0)).collect() == []


@pytest.mark.parametrize("frequent", [10_000, 10])
def test_block_postings_shuffle_blocks_once(spark, monkeypatch, frequent):
    """one exchange of blocks, by range, serves their terms' df and their order; frequent terms are met by broadcast."""
    monkeypatch.setattr(inverted, "FREQUENT", frequent)
    docs = corpus(spark)
    known, held = inverted.terms(docs), inverted.blocks(docs, 60, 4).cache()
    found = inverted.block_postings(held, known)
    want = inverted.postings(inverted.term_counts(docs), known).select("lang", "term", "doc_id", "n", F.round("score", 9), "df")
    assert sorted(found.withColumn("score", F.round("score", 9)).collect(), key=str) == sorted(want.collect(), key=str)
    assert dict(found.dtypes) == {"lang": "string", "term": "string", "doc_id": "string", "n": "bigint", "score": "double", "df": "bigint"}
    fixed = spark.createDataFrame(known.collect(), known.schema)  # a table, as the job reads it
    plan = inverted.block_postings(held, fixed)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange rangepartitioning") == 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1  # at most the documents of each language


def test_postings_are_in_order_of_terms(spark, tmp_path):
    """files keep the order of terms without a sort of their rows, the setting for it is taken back, and the log counts them."""
    corpus(spark).write.parquet(f"{tmp_path}/in")
    before = dict(spark.conf.getAll)
    out = keyword_index.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert dict(spark.conf.getAll) == before
    held = out.withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()}).orderBy("file", "at").collect()
    of = {}
    for r in held:
        of.setdefault(r.file, []).append(r.term)
    assert all(terms == sorted(terms) for terms in of.values()) and len(held) == inverted.term_counts(corpus(spark)).count()
    assert spark.read.parquet(f"{tmp_path}/out/terms").agg(F.sum("df")).first()[0] == len(held)
