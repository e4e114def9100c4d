"""Packed requests, answers out of order, limits and errors; vectors by content; keywords counted inside rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import text as T
from tessera.functions.vectors import hash_embed
from tessera.operators import embedding, inverted, keywords


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, content string").coalesce(1)


@pytest.mark.parametrize(("batch", "in_flight"), [(1, 1), (3, 4), (10_000, 2)])
def test_requests_keep_their_limits_and_rows_their_order(spark, batch, in_flight):
    """Texts of many sizes; answers come late and by place; Arrow batches of any size."""
    r = random.Random(batch)
    texts = [" ".join("w" for _ in range(r.choice([0, 1, 5, 30, 41]))) for _ in range(200)] + [None]

    def model(some):
        time.sleep(r.random() / 200)
        return [(i, [float(len(some[i])), float(len(some))]) for i in random.sample(range(len(some)), len(some))]

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        out = embedding.embed_requests(rows_of(spark, texts), model, max_texts=7, max_tokens=60, text_tokens=40, in_flight=in_flight).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert [x.i for x in out] == list(range(201))
    requests = {}
    for x in out:
        n = None if texts[x.i] is None else len(texts[x.i].split())
        if n is None or n > 40:
            assert x.embedding is None and x.request is None and x.error
            continue
        assert x.embedding == [len(texts[x.i]), x.together] and x.error is None
        requests.setdefault(x.request, []).append((x.place, n, x.together))
    assert sorted(requests) == list(range(len(requests)))
    for number, held in requests.items():
        assert [p for p, _, _ in held] == list(range(len(held))) and {t for _, _, t in held} == {len(held)}
        assert len(held) <= 7 and sum(n for _, n, _ in held) <= 60
        if number + 1 in requests:  # the next text did not fit
            assert len(held) == 7 or sum(n for _, n, _ in held) + requests[number + 1][0][1] > 60


def test_groups_errors_and_wrong_answers(spark):
    df = spark.createDataFrame([(i, "abcdef"[i // 2], f"t{i}") for i in range(10)], "i int, g string, content string").coalesce(1)

    def model(texts):
        if "t4" in texts:
            raise ValueError("no")
        return [[1.0]] * (len(texts) + (1 if "t6" in texts else 0))

    out = sorted(embedding.embed_requests(df, model, group="g", tries=1).collect())
    assert [x.request for x in out] == [i // 2 for i in range(10)]
    assert [x.error for x in out] == [None] * 4 + ["no"] * 2 + ["3 vectors for 2 texts"] * 2 + [None] * 2
    assert embedding.embed_requests(df.limit(0), model).collect() == [] and embedding.embed_requests(df, model).columns[:3] == df.columns


def test_pace_of_requests(spark):
    began = time.monotonic()
    df = rows_of(spark, ["x"] * 6)
    out = embedding.embed_requests(df, lambda texts: [[0.0]] * len(texts), max_texts=1, per_second=10 * spark.sparkContext.defaultParallelism)
    assert out.count() == 6 and time.monotonic() - began >= 0.5


def test_offline_model_equals_the_column_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    want = {r.doc_id: r.embedding for r in hash_embed(docs, "doc_id", "text").collect()}
    model = embedding.hash_model()
    rows = docs.collect()
    for r, v in zip(rows, model([r.text for r in rows]), strict=True):
        assert v == pytest.approx(want[r.doc_id])
    assert model(["", "a b"]) == [[0.0] * 64] * 2


def test_missing_and_unused_contents(spark):
    rows = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), ("h3", "c")], "hash string, content string")
    cache = spark.createDataFrame([("h2", [1.0]), ("h9", [2.0])], "hash string, embedding array<float>")
    assert sorted(r.hash for r in embedding.missing(rows, cache).collect()) == ["h1", "h3"]
    assert sorted(r.hash for r in embedding.missing(rows, None).collect()) == ["h1", "h2", "h3"]
    assert [r.hash for r in embedding.unused(cache, rows).collect()] == ["h9"]
    assert {r.hash: r.uses for r in embedding.uses(rows).collect()} == {"h1": 2, "h2": 1, "h3": 1}


def test_word_counts_and_scored_words_inside_rows(spark):
    r = random.Random(5)
    texts = [
        "", None, "one", "One one two", "the the of", "x " * 5, "é é plain, plain plain. word"
    ] + [" ".join(r.choice(["alpha", "beta,", "Gamma", "the", "delta"]) for _ in range(r.randrange(200))) for _ in range(30)]
    df = rows_of(spark, texts)
    for row in df.select("content", T.word_counts(F.split("content", " ")).alias("c")).collect():
        words = [] if row.content is None else row.content.split(" ")
        assert [(x.first, x.n) for x in row.c] == [(w, words.count(w)) for w in sorted(set(words))]
    want = {x.i: [(k.keyword, pytest.approx(k.score)) for k in x.k] for x in df.where("content is not null").select("i", T.scored_keywords(F.col("content")).alias("k")).collect()}
    got = {}
    for x in sorted(keywords.scored_keywords(df.where("content is not null"), "i", "content").collect(), key=lambda x: (x.i, x["rank"])):
        got.setdefault(x.i, []).append((x.keyword, x.score))
    assert got == {i: k for i, k in want.items() if k}
    plan = keywords.scored_keywords(df, "i", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("ReusedExchange", "") or "hashpartitioning" not in plan  # texts are not shuffled


def test_words_in_arrow_are_those_of_the_column_form(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("aBzé_1 \t\n.,-İK\u00a0\u2003") for _ in range(r.randrange(60))) for _ in range(300)] + [None, "", "The word of Words"]
    rows = rows_of(spark, texts).select("content", T.without(T.plain_words(F.coalesce("content", F.lit(""))), fixed.SCORED_STOP_WORDS).alias("w")).collect()
    assert [inverted.words_of(x.content or "") for x in rows] == [x.w for x in rows]


def test_term_counts_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "en", None), (2, "en", ""), (3, None, "Word word the"), (3, None, "word")], "doc_id long, lang string, text string"
    )
    got = sorted((r.doc_id, r.lang, r.term, r.n, r.size) for r in inverted.term_counts(docs).collect())
    assert got == [(3, None, "word", 1, 1), (3, None, "word", 2, 2)]
    known = inverted.terms(docs)
    none = docs.limit(0)
    assert inverted.postings(inverted.term_counts(none), inverted.terms(none)).collect() == []
    assert [(r.lang, r.df, r.documents, r.idf) for r in known.collect()] == [(None, 2, 2, 0.0)]
    assert len(inverted.postings(inverted.term_counts(docs), known).collect()) == 2
