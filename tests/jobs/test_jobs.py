"""The jobs: rows against SQL, runs over growing and changed input, failures, and their command lines."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import index_documents, keyword_index, queries
from tessera.streaming.content_index import ContentIndex

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows_of_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    rounded = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    places = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(rounded, df.select(columns).collect())) == sorted(rounded(r[i] for i in places) for r in want.fetchall())


def put(spark, rows, folder, columns="doc_id long, text string, lang string"):
    """One more file in a folder of documents."""
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(folder)


def logged(spark, output):
    rows = spark.read.text(f"{output}/log").collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda r: r["batch"])


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_index_takes_only_new_files(spark, sf_dir, tmp_path):
    """Two runs over growing input, a third without any: each file is read once, each content embedded once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    folder, output = f"{tmp_path}/in", f"{tmp_path}/out"
    docs.where("doc_id % 2 = 0").coalesce(1).write.parquet(folder)
    index_documents.run(spark, folder, output)
    docs.where("doc_id % 2 = 1").coalesce(1).write.mode("append").parquet(folder)
    grown = index_documents.run(spark, folder, output)
    log = logged(spark, output)
    assert [r["documents"] for r in log] == [docs.where("doc_id % 2 = 0").count(), docs.where("doc_id % 2 = 1").count()]
    contents = ContentIndex(spark, output).current().select("hash").distinct().count()
    assert sum(r["embedded"] for r in log) == contents == spark.read.parquet(f"{output}/vectors").count()
    assert log[1]["embedded"] < log[1]["chunks"]  # copies of earlier texts are not embedded again
    before = files(output)
    once = index_documents.run(spark, f"{sf_dir}/documents.parquet*", f"{tmp_path}/once")
    again = index_documents.run(spark, folder, output)
    assert files(output) == before and len(logged(spark, output)) == 2
    assert sorted(grown.collect()) == sorted(again.collect()) == sorted(once.collect())


def test_index_replaces_documents_and_knows_odd_rows(spark, tmp_path):
    folder, output = f"{tmp_path}/in", f"{tmp_path}/out"
    put(
        spark,
        [(1, "first text", "en"), (2, "second text", "en"), (3, "gone later", None), (None, "no id", ""), (4, None, "de"), (5, "", "01")],
        folder
    )
    rows = {r.doc_id: r for r in index_documents.run(spark, folder, output).collect()}
    assert sorted(rows, key=str) == [1, 2, 3, 5, None] and rows[5].lang == "01" and rows[None].lang == ""
    put(spark, [(2, "first text", "fr"), (3, None, None), (None, "no id", "")], folder)
    index_documents.run(spark, folder, output)
    index = ContentIndex(spark, output)
    got = sorted(((r.doc_id, r.content, r.lang) for r in index.current().collect()), key=str)
    assert got == sorted([(1, "first text", "en"), (2, "first text", "fr"), (5, "", "01"), (None, "no id", ""), (None, "no id", "")], key=str)
    assert logged(spark, output)[1]["embedded"] == 0
    unused = {r.hash for r in index.unused().collect()}
    texts = spark.createDataFrame([("second text",), ("gone later",)], "t string").select(F.sha2("t", 256).alias("h")).collect()
    assert unused == {r.h for r in texts}
    assert index.rows().where("embedding is null").count() == 0


def test_answers_from_the_index(spark, sf_dir, tmp_path):
    """Questions that are contents of the index find themselves first, once for all their copies; answers are replaced."""
    output = f"{tmp_path}/out"
    index_documents.run(spark, f"{sf_dir}/documents.parquet*", output)
    index = ContentIndex(spark, output)
    some = index.current().where("tokens > 60").orderBy("hash").limit(5).select("hash", "content").distinct()
    asked = some.select(F.col("hash").alias("query_id"), F.col("content").alias("text"))
    asked.unionByName(spark.createDataFrame([("none", None), ("empty", "")], asked.schema)).write.parquet(f"{tmp_path}/questions")
    for _ in range(2):
        rows = index_documents.answer(spark, output, f"{tmp_path}/questions", f"{tmp_path}/answers").collect()
    want = {r.query_id: r.text for r in asked.collect()}
    assert {r.query_id for r in rows} == set(want) and len(rows) == 10 * len(want)
    uses = {r.hash: r["count"] for r in index.current().groupBy("hash").count().collect()}
    for r in rows:
        assert r.uses == uses[r.hash] and -1 <= r.score <= 1.0000001
        if r["rank"] == 1:
            assert r.score == pytest.approx(1.0, abs=1e-5)
    assert sum(r["rank"] == 1 and r.content == want[r.query_id] for r in rows) == len(want)


def test_failed_batch_is_taken_again(spark, tmp_path):
    """A model that fails for one text: what succeeded is kept, the next run takes the batch again, with one copy of all."""
    folder, output = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, [(i, f"text number {i}", "en") for i in range(6)], folder)

    def weak(texts):
        if any("3" in t for t in texts):
            raise ValueError("no")
        return [[1.0, 0.0] for _ in texts]

    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException, match="were not embedded"):
        index_documents.run(spark, folder, output, {"max_texts": 1}, weak)
    kept = spark.read.parquet(f"{output}/vectors").count()
    assert kept == 5
    rows = index_documents.run(spark, folder, output, {"max_texts": 1}, lambda texts: [[0.0, 1.0] for _ in texts]).collect()
    assert sorted((r.doc_id, r.uses, r.used) for r in rows) == [(i, 1, 1) for i in range(6)]
    assert logged(spark, output) == [{"batch": 0, "documents": 6, "bytes": 78, "chunks": 6, "embedded": 1, "failed": 0}]


def test_keyword_index_replaces_named_languages(spark, tmp_path):
    first = [
        (1, "alpha beta beta", "en"), (2, "alpha gamma", "en"), (3, "delta wort wort", "de"), (4, None, "en"), (5, "same same", None),
        (6, "other same", ""), (6, "other", "")
    ]
    put(spark, first, f"{tmp_path}/a")
    put(spark, [(1, "omega", "en"), (9, "zeta", "fr"), (3, "changed", "de")], f"{tmp_path}/b")
    output = f"{tmp_path}/out"
    whole = keyword_index.run(spark, f"{tmp_path}/a", output)
    rows = {(r.lang, r.term, r.doc_id): r for r in whole.collect()}
    assert {(k[1], r.n, r.df) for k, r in rows.items() if k[0] is None and k[2] == 5} == {("same", 2, 2)}
    beta = rows["en", "beta", 1]
    assert (beta.n, beta.df) == (2, 1) and beta.score == pytest.approx(2 / 3 * 1.0986123)
    held = sorted(whole.collect(), key=str)
    assert sorted(keyword_index.run(spark, f"{tmp_path}/a", output).collect(), key=str) == held
    named = keyword_index.run(spark, f"{tmp_path}/b", output, ["en", "it", "de"])
    got = sorted(((r.lang, r.term, r.doc_id) for r in named.collect()), key=str)
    assert got == sorted([("en", "omega", 1), ("de", "changed", 3), *((r.lang, r.term, r.doc_id) for r in held if r.lang is None)], key=str)
    put(spark, [(1, "omega", "en")], f"{tmp_path}/c")
    after = keyword_index.run(spark, f"{tmp_path}/c", output, ["en", "de"])  # German has no documents any more
    assert {r.lang for r in after.collect()} == {"en", None}
    assert [r.term for r in keyword_index.run(spark, f"{tmp_path}/c", output).collect()] == ["omega"]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none")
    assert keyword_index.run(spark, f"{tmp_path}/none", output).collect() == []


def test_settings_are_left_as_they_were(spark, sf_dir, tmp_path):
    before = dict(spark.conf.getAll)
    queries.job1_index_documents(spark, sf_dir)
    queries.job2_keyword_index(spark, sf_dir)
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("job", ["index_documents", "keyword_index"])
def test_command_lines(sf_dir, tmp_path, job):
    config = tmp_path / "config.json"
    config.write_text(open(f"{REPO}/jobs/{job}.json").read())
    command = [
        sys.executable, f"{REPO}/jobs/{job}.py", "--documents", f"{sf_dir}/documents.parquet*", "--output", f"{tmp_path}/out", "--config",
        str(config)
    ]
    done = subprocess.run(
        command, capture_output=True, text=True, timeout=300, cwd=tmp_path,
        env=os.environ | {
            "SPARK_LOCAL_DIRS": str(tmp_path),
            "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"
        }
    )
    assert done.returncode == 0, done.stderr[-2000:]
    lines = [json.loads(x) for x in done.stderr.splitlines() if x.startswith('{"timestamp"')]
    assert lines and lines[-1]["message"] == "ended" and files(f"{tmp_path}/out")


def test_postings_are_read_without_a_join(spark, tmp_path):
    """Each posting has its term's df beside it: what the job returns shuffles nothing."""
    spark.createDataFrame([(1, "alpha omega omega", "en"), (2, "omega", "en"), (3, "omega", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/in")
    out = keyword_index.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((r.lang or "", r.term, r.doc_id, r.n, r.df) for r in out.collect()) == [
        ("", "omega", 3, 1, 1), ("en", "alpha", 1, 1, 1), ("en", "omega", 1, 2, 2), ("en", "omega", 2, 1, 2)
    ]
