"""Findings on growth: the cheaper forms have the rows of the plain ones, and what they send and hold is bounded."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ann, chunking, embedding, keywords, search

SIGNS = [*"aZ_9 \t\n\n\r\x0b\x0c\x1c\x85\xa0  ﻿é😀İK.,;(){}[]<>=+-*/&|!\"'`#", "the", "word ", "function ", "fooBar "]


def odd_texts(n=200, size=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, size))) for _ in range(n)] + [None, "", "\n", "\n\n", "a\n"]


def test_pieces_in_arrow_batches_are_those_of_the_columns(spark):
    """F8: lines, tokens, keywords and hashes of pieces without column functions, on odd white space, signs and nulls."""
    df = spark.createDataFrame(list(enumerate(odd_texts())), "i int, text string")
    c = F.col("p.content")
    plain = df.select("i", F.posexplode_outer(chunking.split_lines(F.col("text"), F.lit(1), 20)).alias("seq", "p")).select(
        "i", "seq", "p.start_line", "p.end_line", T.count_tokens(c).alias("tokens"), T.chunk_keywords(c).alias("keywords"),
        embedding.content_key(c).alias("hash"), c.alias("content")
    )
    of = lambda rows: sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] or 0))
    found = chunking.text_pieces(df, "text", 20)
    assert found.columns == plain.columns and of(found) == of(plain)


def test_tokens_that_are_known_are_not_counted_again(spark):
    """F8: a named column of tokens packs requests; the plan has no pattern of the count."""
    df = spark.createDataFrame([(i, f"t{i}", 30) for i in range(4)], "i int, content string, n int").coalesce(1)
    out = embedding.embed_requests(df, lambda texts: [[0.0]] * len(texts), max_tokens=60, tokens="n")
    assert [r.request for r in out.orderBy("i").collect()] == [0, 0, 1, 1]
    assert "regexp_count" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_identifier_keywords_are_counted_in_their_row(spark):
    """words, order and ranks of the column form without a shuffle of words; rows that repeat a key are added up."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts(300, 500, 2)) if t is not None] + [(900, "a_b // x\u2028ok_fine `q` okFine")], "i int, t string")
    words = df.select("i", F.posexplode(T.identifier_words(F.col("t"))).alias("pos", "word"))
    plain = words.groupBy("i", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    found = keywords.identifier_counts(df, "i", "t")
    assert sorted(map(tuple, found.select("i", "word", "n", "pos").collect())) == sorted(map(tuple, plain.collect())) != []
    assert "Exchange" not in keywords.identifier_keywords(df, "i", "t")._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([(1, "blue blue red"), (1, "red red"), (2, "red"), (None, "blue")], "i int, t string")
    got = sorted(map(tuple, keywords.identifier_keywords(twice, "i", "t").collect()), key=str)
    assert got == [(1, "blue", 2), (1, "red", 1), (2, "red", 1), (None, "blue", 1)]


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_best_rows_hold_a_step_of_scores(monkeypatch, metric):
    """one step never has more than STEP scores, whatever the number of queries; ties go by id."""
    r = np.random.default_rng(1)
    x, q = np.round(r.normal(size=(500, 4))), np.round(r.normal(size=(90, 4))) + 0.5
    sizes, plain = [], search._scores
    monkeypatch.setattr(search, "STEP", 1000)
    monkeypatch.setattr(search, "_scores", lambda *a: sizes.append(len(a[0]) * len(a[1])) or plain(*a))
    held = search.Best(len(q), 7, metric)
    for lo in range(0, 500, 130):
        held.add(x[lo : lo + 130], pa.array(range(1000 - lo, 1000 - lo - len(x[lo : lo + 130]), -1)), np.arange(len(q)), q)
    score = plain(x, q, metric) * (-1 if metric != "L2" else 1)
    want = [(i, id_) for i in range(len(q)) for _, id_ in sorted((s, 1000 - n) for n, s in enumerate(score[:, i]) if np.isfinite(s))[:7]]
    (b,) = held.batch()
    assert sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) == sorted(want) and max(sizes) <= 1000


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_many_queries_are_compared_in_their_cells(spark, monkeypatch, metric):
    """where codes would name more rows than can be sent, no names are: one pass over the cells, the rows of brute force."""
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, (r.normal(size=6) + i % 3).tolist()) for i in range(400)] + [(900, [0.0] * 6), (901, None)], "id int, embedding array<double>")
    model = ann.fit(rows, metric, cells=8)
    coded = ann.encode(rows, model)
    asked = rows.where("id % 10 = 0 and id < 400").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    of = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(ann, "NAMED", 0)
    found = ann.search(coded, model, asked, 5, ann.MOST_CELLS, 1)
    exact = search.batch_top_k(asked, rows.where("id < 900"), 5, metric)
    assert of(found) == of(exact) and len(of(found)) == 200
    assert of(ann.search(coded, model, asked, 5, ann.MOST_CELLS, 1, query_bytes=500)) == of(exact)
    some = ann.recall(ann.search(coded, model, asked, 5, 4, 1), exact).agg(F.avg("recall")).first()[0]
    monkeypatch.setattr(ann, "NAMED", 1 << 17)
    assert some >= ann.recall(ann.search(coded, model, asked, 5, 4, 1), exact).agg(F.avg("recall")).first()[0]
