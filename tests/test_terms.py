"""Substring joins against brute force, and term statistics over batches, repeats and compaction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import keywords
from tessera.operators.termstats import TermStatistics


def test_containing_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda most: "".join(r.choice("abcé") for _ in range(r.randint(0, most)))
    words, texts = [word(5) for _ in range(120)] + [None, "zzzz"], [word(14) for _ in range(200)] + [None, "a" * 3000]
    got = keywords.containing(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in texts], "run string"))
    want = {(w, t) for w in words for t in texts if w and t and w in t}
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert keywords.containing(spark.createDataFrame([], "word string"), spark.createDataFrame([("a",)], "run string")).collect() == []


def brute(texts):
    out = {}
    for t in texts:
        words = [w for w in re.split(
            r"\s+", re.sub(r"[^\w\s]", " ", t or "", flags=re.ASCII).lower()
        ) if len(w) > 2 and w not in fixed.SCORED_STOP_WORDS]
        for w in set(words):
            n, d = out.get(w, (0, 0))
            out[w] = n + words.count(w), d + 1
    return out


def test_statistics_follow_changes(spark, tmp_path):
    """Random changes over batches, batches that run twice, and compactions: always what a recount gives."""
    r = random.Random(4)
    text = lambda: r.choice([None, "", " ".join(r.choice(["alpha", "beta", "gamma", "the", "delta."]) for _ in range(r.randrange(12)))])
    held = {f"p{i}": text() for i in range(30)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "path string, text string")
    stats = TermStatistics(spark, f"file://{tmp_path}/t")
    assert stats.totals() == 0 and stats.terms().collect() == [] and stats.compact() == -1
    stats.apply(0, None, frame(held))
    for batch in range(1, 5):
        gone = {p: held[p] for p in r.sample(sorted(held), 6)}
        fresh = {p: text() for p in r.sample(sorted(gone), 3)} | {f"n{batch}": text()}
        for _ in range(r.choice([1, 2])):  # again, as after a failure
            stats.apply(batch, frame(gone), frame(fresh))
        held = {p: t for p, t in held.items() if p not in gone} | fresh
        if batch in (2, 4):
            assert stats.compact() == batch == stats.compact()
            with pytest.raises(ValueError, match="compacted"):
                stats.apply(batch, None, frame(fresh))
        assert stats.totals() == len(held)
        assert {x.term: (x.places, x.documents) for x in stats.terms().collect()} == brute(held.values())
    assert spark.read.parquet(f"file://{tmp_path}/t/base").where(F.col("batch") == 4).count() <= 5
